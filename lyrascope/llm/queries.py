"""Registered queries of the operators, each over its whole table, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from lyrascope.llm import (
    attention_lm,
    bit_packing,
    bpe_counts,
    html_suffix,
    i_match,
    merge_dropout,
    odd_sketch,
    pfair_mixing,
    prefix_trie,
    quality_crf,
    recompression,
    token_alignment,
    weak_rules,
)
from lyrascope.llm.shared import new_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = quality_crf.fit(docs, labels(spark, sf_dir))
    return quality_crf.with_fold(quality_crf.score(docs, field))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_suffix.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(documents(spark, sf_dir))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.digests(documents(spark, sf_dir))


def op7_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    bit_packing.write_ids(documents(spark, sf_dir), path)
    return bit_packing.read_digests(spark.read.parquet(path))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i_match.fingerprints(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digests(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("ref")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_quality_classifier,
        op3_source_mixing,
        op4_main_text,
        op5_quality_rules,
        op6_merge_dropout,
        op7_bit_packing,
        op8_fingerprints,
        op9_near_duplicates,
        op10_token_counts,
        op11_token_alignment,
        op12_substring_dedup,
        op13_prefix_trie,
    )
}

# The other operators' methods are beyond SQL; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op9_near_duplicates": r"""
with recursive word as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
),
member as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
           else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as s
  from word
),
size as (select doc_id, count(*) as n from member group by doc_id),
edge as (
  select a.doc_id as x, b.doc_id as y
  from member a join member b on a.s = b.s and a.doc_id <> b.doc_id
  join size m on m.doc_id = a.doc_id join size n on n.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, m.n, n.n
  having 100 * count(*) >= 85 * (m.n + n.n - count(*))
),
reach(x, y) as (
  select doc_id, doc_id from word union select r.x, e.y from reach r join edge e on r.y = e.x
),
component as (select x as doc_id, min(y) as component_id from reach group by x)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from word w left join size using (doc_id) join component using (doc_id)
""",
    "op12_substring_dedup": r"""
with word as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') as w
  from documents
),
win as (
  select doc_id, unnest(range(1, len(w) - 11)) as i, array_to_string(w[i:i + 12], ' ') as key
  from word
),
covered as (
  select distinct doc_id, unnest(range(i, i + 13)) as i
  from (select *, min(doc_id) over (partition by key) as smallest from win)
  where smallest < doc_id
),
gone as (select doc_id, count(*) as n_removed from covered group by doc_id),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as kept
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from word)
  anti join covered using (doc_id, i)
  group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from word left join gone using (doc_id) left join kept using (doc_id)
""",
    # DuckDB has no crc32: a byte is added, then the sum is shifted eight times.
    "op13_prefix_trie": r"""
with turn as (
  select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t,
         row_number() over (partition by conv_id order by turn nulls first) as place
  from conversations where conv_id is not null
),
own as (select conv_id, list(t order by place) as ts from turn group by conv_id),
headed as (
  select *, conv_id - conv_id % 100 as base, xor(list_reduce(
    list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''),
      lambda c: list_concat([ord(c)::bigint], list_transform(range(8), lambda i: -1::bigint))))),
    lambda a, x: case when x >= 0 then xor(a, x)
                      else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 6 as h
  from own
),
built as (
  select a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) as ts
  from headed a left join own b on b.conv_id = a.base
),
member as (
  select conv_id, unnest(range(0, len(ts) + 1)) as depth, ts from built
),
path as (
  select conv_id, depth, ts[1:depth] as path, len(ts) = depth as is_end,
         case when depth > 0 then ts[1:depth - 1] end as up,
         coalesce(len(ts[depth].text), 0) as n_chars
  from member
),
node as (
  select path, any_value(up) as up, any_value(depth) as depth, min(conv_id) as conv_id,
         count(*) as n_convs, any_value(n_chars) as n_chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id)
                         filter (where is_end), '')) as ends_sha256
  from path group by path
),
child as (select up as path, count(*) as n_children from node where up is not null group by up),
above as (
  select path as below, n_chars * (n_convs - 1) as saved, n_children is null as leaf,
         path[1:unnest(range(0, depth + 1))] as path
  from node left join child using (path)
),
total as (
  select path, sum(saved)::bigint as saved_tokens, count(*) filter (where leaf) as n_leaves
  from above group by path
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs,
       coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from node n join total using (path) left join child using (path)
left join node p on p.path = n.up
""",
}
