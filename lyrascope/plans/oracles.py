"""DuckDB SQL that states the same results over the same tables."""

from lyrascope.constants import NA_TOKENS, WHITESPACE

RATING_1 = "case when d.doc_id % 23 = 0 then null else 1 + d.doc_id % 5 end"
RATING_2 = "case when d.doc_id % 29 = 0 then null else 1 + (d.doc_id + d.n_chars % 2) % 5 end"

SONGS = f"""
songs as (
  select d.doc_id as text_id, d.lang as language, d.text,
         row_number() over (partition by d.lang order by d.doc_id) as position,
         min(d.doc_id) over (partition by d.lang, d.text) as keep_id,
         {RATING_1} as rating_1,
         {RATING_2} as rating_2,
         case when l.quality is null then null when l.quality = 0 then 'yes' else 'no' end
           as hallucination_1,
         case when l.toxic is null then null when l.toxic = 1 then 'yes' else 'no' end
           as hallucination_2,
         case when d.doc_id % 31 = 0 then null when d.doc_id % 3 = 0 then 'none'
              when d.doc_id % 3 = 1 then 'barely' else 'significantly' end as unusual_language,
         len(list_filter(regexp_split_to_array(d.text, '[ \\t\\n\\r]+'), lambda x: x <> ''))
           as n_words
  from documents d left join labels l on d.doc_id = l.doc_id
)"""

WORDS = """
tok as (
  select doc_id, lang, generate_subscripts(l, 1) - 1 as pos, unnest(l) as w from (
    select doc_id, lang,
           list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') as l
    from documents)
),
words as (
  select doc_id as text_id, lang as language, pos, w as word,
    case when length(w) <= 3 then 'not_important'
         when (doc_id * 31 + pos) % 7 = 0 then 'wrong' else 'correct' end as status_1,
    case when length(w) <= 2 or (doc_id + pos) % 11 = 0 then 'not_important'
         when (doc_id * 31 + pos) % 7 = 0 and pos % 3 <> 0 then 'wrong' else 'correct' end
      as status_2
  from tok
)"""

SONG_COUNTS = """
counts as (
  select s.language, s.text_id, s.rating_1,
         count(*) filter (w.status_1 = 'correct') as n_correct,
         count(*) filter (w.status_1 = 'wrong') as n_wrong,
         count(*) filter (w.status_1 = 'not_important') as n_not_important,
         count(w.pos) as n_words
  from songs s left join words w on s.text_id = w.text_id
  where s.text_id = s.keep_id
  group by all
),
totals as (
  select language, cast(sum(n_correct) as bigint) as n_correct,
         cast(sum(n_wrong) as bigint) as n_wrong,
         cast(sum(n_not_important) as bigint) as n_not_important,
         cast(sum(n_words) as bigint) as n_words,
         case when sum(n_correct + n_wrong) > 0
              then sum(n_correct) / sum(n_correct + n_wrong) else 0 end as mean_correctness,
         case when sum(n_words) > 0
              then sum(n_correct + n_wrong) / sum(n_words) else 0 end as mean_importance
  from counts group by language
)"""

BASE = f"with {SONGS}, {WORDS}"

HALLUCINATIONS = """
select language, n_hallucinations, n_songs_minus_repeat,
       n_hallucinations || ' out of ' || n_songs_minus_repeat || ' songs' as hallucinations
from (
  select language,
         count(*) filter (hallucination_1 = 'yes' and text_id = keep_id) as n_hallucinations,
         count(*) - 1 as n_songs_minus_repeat
  from songs group by language)"""


def kappa_ctes(name: str, cells: str, keys: str) -> str:
    """CTEs that turn a table (keys, a, b) of rated pairs into kappas per key."""
    same_keys = " and ".join(f"x.{k} is not distinct from y.{k}" for k in keys.split(", "))
    return f"""
{name}_pairs as ({cells}),
{name}_n as (
  select {keys}, count(*) as n_pairs, count(*) filter (a = b) as n_agree
  from {name}_pairs group by {keys}
),
{name}_a as (select {keys}, a as label, count(*) as n from {name}_pairs group by all),
{name}_b as (select {keys}, b as label, count(*) as n from {name}_pairs group by all),
{name}_products as (
  select {', '.join('x.' + k for k in keys.split(', '))},
         sum(cast(x.n as double) * y.n) as products
  from {name}_a x join {name}_b y on {same_keys} and x.label = y.label
  group by all
),
{name}_kappa as (
  select x.*,
         case when coalesce(y.products, 0) < cast(n_pairs as double) * n_pairs
              then (cast(n_agree as double) * n_pairs - coalesce(y.products, 0))
                   / (cast(n_pairs as double) * n_pairs - coalesce(y.products, 0)) end as kappa
  from {name}_n x left join {name}_products y on {same_keys}
)"""


KAPPA_RATING = kappa_ctes(
    "rating",
    """select language, rating_1 as a, rating_2 as b from songs
       where text_id = keep_id and rating_1 is not null and rating_2 is not null""",
    "language",
)
KAPPA_HALLUCINATION = kappa_ctes(
    "hallucination",
    """select language, hallucination_1 as a, hallucination_2 as b from songs
       where text_id = keep_id and hallucination_1 is not null and hallucination_2 is not null""",
    "language",
)
KAPPA_WORDS = kappa_ctes(
    "word",
    """select w.language, w.text_id, status_1 as a, status_2 as b
       from words w join songs s on w.text_id = s.text_id where s.text_id = s.keep_id""",
    "language, text_id",
)
KAPPA_IMPORTANT = kappa_ctes(
    "important",
    """select w.language, w.text_id, status_1 as a, status_2 as b
       from words w join songs s on w.text_id = s.text_id where s.text_id = s.keep_id
       and status_1 in ('correct', 'wrong') and status_2 in ('correct', 'wrong')""",
    "language, text_id",
)
KAPPA_SELF = kappa_ctes(
    "self",
    """select s.language, s.keep_id, s.text_id as dup_id, x.status_1 as a, y.status_1 as b
       from songs s join words x on x.text_id = s.keep_id
       join words y on y.text_id = s.text_id and x.pos = y.pos
       where s.text_id <> s.keep_id""",
    "language, keep_id, dup_id",
)
KAPPA_ALL_WORDS = kappa_ctes(
    "word",
    "select language, text_id, status_1 as a, status_2 as b from words",
    "language, text_id",
)
IMPORTANT_KAPPA = "case when n_agree = n_pairs then 1.0 else kappa end"

SELF_AGREEMENT = """
self_agreement as (
  select language,
         case when count(*) filter (kappa is null) > 0 then null else avg(kappa) end
           as self_agreement
  from self_kappa group by language
)"""

CORPUS = f"""
corpus as (
  select 'd' || d.doc_id as item_id,
         case when quality = 0 and toxic = 1 then 'NA' when quality = 0 then null
              when toxic = 1 then ' ' || chr(9) || chr(160)
              else chr(8195) || ' ' || text || chr(10) || chr(9) end as translation
  from documents d left join labels l on d.doc_id = l.doc_id
  union all
  select 'b' || item_id, text from benchmark
),
marked as (
  select item_id, trim(valid, {' || '.join(f'chr({ord(c)})' for c in WHITESPACE)})
           as translation
  from (select item_id, case when translation not in ({', '.join(f"'{t}'" for t in NA_TOKENS)})
                             then translation end as valid from corpus)
),
cleaned as (select * from marked where translation is not null and translation <> '')"""

COLORED = """
src as (
  select doc_id, lang, n_chars,
         list_filter(regexp_split_to_array(replace(text, chr(10), ' '), '\\s+'),
                     lambda x: x <> '') as l from documents
),
tok as (
  select doc_id, lang, generate_subscripts(l, 1) - 1 as pos, unnest(l) as w from src
)"""

def topic_sql(groups: str) -> str:
    """Words of all documents, and term weights learnt from those whose language has a topic."""
    return f"""
topic as ({groups}),
word as (
  select doc_id, lang, generate_subscripts(l, 1) - 1 as pos, unnest(l) as t from (
    select doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}]+'),
                                     lambda x: x <> '') as l
    from documents)
),
tf as (select topic_id, t, count(*) as tf from word join topic using (lang) group by all),
mean_words as (select sum(tf) / count(distinct topic_id) as a from tf),
idf as (
  select t, ln(1 + (select a from mean_words) / sum(tf)) as idf from tf group by t
),
weighted as (select topic_id, t, tf * idf as weight from tf join idf using (t)),
kept as (
  select *, row_number() over (partition by topic_id order by weight desc, t) as rank
  from weighted qualify rank <= 200
)"""


def score_sql(groups: str) -> str:
    """Scores of all documents against the topics that are not the outlier."""
    return f"""{topic_sql(groups)},
topic_norm as (
  select topic_id, sqrt(sum(weight * weight)) as norm from weighted group by topic_id
),
start as (
  select doc_id, unnest(range(greatest(max(pos) - 3, 0) + 1)) as start from word group by doc_id
),
bag as (
  select s.doc_id, s.start, w.t, count(*) as c from start s
  join word w on w.doc_id = s.doc_id and w.pos between s.start and s.start + 3 group by all
),
bag_norm as (
  select doc_id, start, sqrt(sum(c * idf * c * idf)) as norm
  from bag join idf using (t) group by doc_id, start
),
similarity as (
  select b.doc_id, b.start, k.topic_id,
         sum(b.c * i.idf * k.weight) / any_value(n.norm) / any_value(tn.norm) as similarity
  from bag b join idf i on b.t = i.t join weighted k on b.t = k.t and k.topic_id >= 0
  join bag_norm n on n.doc_id = b.doc_id and n.start = b.start
  join topic_norm tn on tn.topic_id = k.topic_id
  group by b.doc_id, b.start, k.topic_id
),
score as (
  select doc_id as id, topic_id, sum(similarity) as score from similarity
  where similarity >= 0.1 group by doc_id, topic_id
)"""


LANGUAGE_TOPICS = """select lang, count(*) as count, row_number() over (order by lang) - 1 as topic_id
  from documents group by lang"""

# French texts are the outlier group, Spanish ones are not learnt from.
HELDOUT_TOPICS = "select * from (values ('de', 0), ('en', 1), ('fr', -1)) v(lang, topic_id)"

TOPICS = topic_sql(LANGUAGE_TOPICS)

SCORES = f"""{score_sql(LANGUAGE_TOPICS)},
distribution as (
  select id, topic_id, score / sum(score) over (partition by id) as prob from score
),
assigned as (
  select d.doc_id as id, coalesce(b.topic_id, 0) as assigned_topic,
         coalesce(b.prob, 0.0) as top_topic_prob, b.id is not null as has_mass
  from documents d left join (
    select * from distribution
    qualify row_number() over (partition by id order by prob desc, topic_id) = 1) b
  on d.doc_id = b.id
),
labelled as (
  select a.*, case when t.lang <> 'fr' then 'topic ' || t.lang end as topic_label
  from assigned a join topic t on a.assigned_topic = t.topic_id
)"""

NORMED = """
normed as (
  select vec_id, dimension, value / nullif(sum(abs(value)) over (partition by vec_id), 0)
           as value
  from (select vec_id, generate_subscripts(embedding, 1) - 1 as dimension,
               cast(unnest(embedding) as double) as value from embeddings)
)"""

ORACLES = {
    "mt_word_counts": f"""{BASE}, {SONG_COUNTS}
select language, n_correct, n_wrong, n_not_important, n_words from totals""",
    "mt_correctness": f"""{BASE}, {SONG_COUNTS}
select language, round(mean_correctness, 6) as mean_correctness from totals""",
    "mt_importance": f"""{BASE}, {SONG_COUNTS}
select language, round(mean_importance, 6) as mean_importance from totals""",
    "mt_song_points": f"""{BASE}, {SONG_COUNTS}
select language, text_id, rating_1 as overall_rating,
       round(rating_1 + case language when 'de' then -0.03 when 'en' then 0.06
                        when 'es' then 0.03 else 0.0 end, 6)::double as shifted_rating,
       round(case when n_correct + n_wrong > 0
                  then n_correct / (n_correct + n_wrong) else 0 end, 6) as correctness
from counts""",
    "mt_mean_rating": f"""with {SONGS}
select language, count(rating_1) as n_rated, round(avg(rating_1), 6) as mean_rating
from songs group by language""",
    "mt_hallucination": f"with {SONGS} {HALLUCINATIONS}",
    "mt_unusual_language": f"""with {SONGS}
select language, unusual_language, n_songs,
       row_number() over (partition by language order by first_id) as seen_rank
from (select language, unusual_language, count(*) as n_songs, min(text_id) as first_id
      from songs where text_id = keep_id group by language, unusual_language)""",
    "mt_language_report": f"""{BASE}, {SONG_COUNTS}, {KAPPA_SELF}, {SELF_AGREEMENT},
hall as ({HALLUCINATIONS})
select t.language, t.n_words, h.n_hallucinations, h.n_songs_minus_repeat,
       n_unusual_none, n_unusual_barely, n_unusual_significantly, n_unusual_missing,
       round(mean_rating, 6) as mean_rating, round(mean_correctness, 6) as mean_correctness,
       round(mean_importance, 6) as mean_importance,
       round(case when a.language is null then 0.0 else a.self_agreement end, 6)
         as self_agreement
from totals t join hall h using (language)
join (select language, avg(rating_1) as mean_rating,
             count(*) filter (text_id = keep_id and unusual_language = 'none')
               as n_unusual_none,
             count(*) filter (text_id = keep_id and unusual_language = 'barely')
               as n_unusual_barely,
             count(*) filter (text_id = keep_id and unusual_language = 'significantly')
               as n_unusual_significantly,
             count(*) filter (text_id = keep_id and unusual_language is null)
               as n_unusual_missing
      from songs group by language) u using (language)
left join self_agreement a on a.language = t.language""",
    "repeated_songs": f"""with {SONGS}
select language, keep_id, text_id as dup_id from songs where text_id <> keep_id""",
    "repeat_rule_check": f"""with {SONGS},
dup as (select language, text_id as dup_id from songs where text_id <> keep_id)
select s.language, count(i.dup_id) as n_by_id, count(p.dup_id) as n_by_position,
       count(*) filter ((i.dup_id is null) <> (p.dup_id is null)) as n_differ
from songs s
left join dup i on i.language = s.language and i.dup_id = s.text_id
left join dup p on p.language = s.language and p.dup_id = s.position
group by s.language""",
    "kappa_rating": f"""with {SONGS}, {KAPPA_RATING}
select language, n_pairs, n_agree, round(kappa, 6) as kappa from rating_kappa""",
    "kappa_hallucination": f"""with {SONGS}, {KAPPA_HALLUCINATION}
select language, n_pairs, n_agree, round(kappa, 6) as kappa from hallucination_kappa""",
    "kappa_words_song": f"""{BASE}, {KAPPA_WORDS}
select s.language, s.text_id, s.n_words, round(k.kappa, 6) as kappa_words
from songs s left join word_kappa k on s.text_id = k.text_id where s.text_id = s.keep_id""",
    "kappa_important_song": f"""{BASE}, {KAPPA_IMPORTANT}
select language, text_id, n_pairs as n_important,
       round({IMPORTANT_KAPPA}, 6) as kappa_important from important_kappa""",
    "accuracy_important_song": f"""{BASE}, {KAPPA_IMPORTANT}
select language, text_id, n_pairs as n_important,
       round(n_agree / n_pairs, 6) as accuracy_important from important_kappa""",
    "kappa_self": f"""{BASE}, {KAPPA_SELF}
select language, keep_id, dup_id, n_pairs as n_words, round(kappa, 6) as kappa
from self_kappa""",
    "iaa_report": f"""{BASE}, {KAPPA_RATING}, {KAPPA_HALLUCINATION}, {KAPPA_WORDS},
{KAPPA_IMPORTANT},
per_song as (
  select s.language, s.text_id, k.kappa as kappa_words,
         i.n_agree / i.n_pairs as accuracy, i.text_id is not null as has_important,
         case when i.n_agree = i.n_pairs then 1.0 else i.kappa end as kappa_important
  from songs s left join word_kappa k on s.text_id = k.text_id
  left join important_kappa i on s.text_id = i.text_id
  where s.text_id = s.keep_id
),
means as (
  select language, count(*) as n_songs, count(*) as n_word_songs,
         case when count(kappa_words) < count(*) then null else avg(kappa_words) end
           as mean_kappa_words,
         avg(kappa_words) as mean_defined_kappa_words,
         count(*) - count(kappa_words) as n_undefined_kappa_words,
         avg(accuracy) as mean_accuracy_important,
         count(*) filter (has_important) as n_important_songs,
         case when count(*) filter (has_important) = 0 then 0.0
              when count(kappa_important) < count(*) filter (has_important) then null
              else avg(kappa_important) end as mean_kappa_important
  from per_song group by language
)
select m.language, n_songs, n_word_songs, n_undefined_kappa_words, n_important_songs,
       round(mean_kappa_words, 6) as mean_kappa_words,
       round(mean_defined_kappa_words, 6) as mean_defined_kappa_words,
       round(mean_accuracy_important, 6) as mean_accuracy_important,
       round(mean_kappa_important, 6) as mean_kappa_important,
       round(r.kappa, 6) as kappa_rating, round(h.kappa, 6) as kappa_hallucination
from means m left join rating_kappa r on m.language = r.language
left join hallucination_kappa h on m.language = h.language""",
    "song_alignment": f"""with {SONGS},
second as (
  select language, text_id, n_words,
         row_number() over (partition by language order by text_id) as position
  from songs where text_id in (select doc_id from labels)
)
select a.language, a.position, a.text_id as text_id_a, b.text_id as text_id_b,
       a.n_words as n_words_a, b.n_words as n_words_b,
       case when a.text_id <> a.keep_id then 'repeat'
            when a.text_id <> b.text_id then 'id_mismatch'
            when a.n_words <> b.n_words then 'length_mismatch' else 'aligned' end as outcome
from songs a join second b on a.language = b.language and a.position = b.position""",
    "songs_in_common": f"""{BASE}, {KAPPA_ALL_WORDS}
select s.language, s.text_id, rating_1 as overall_rating_a, rating_2 as overall_rating_b,
       round(k.kappa, 6) as kappa_words
from songs s left join word_kappa k on s.text_id = k.text_id
where s.text_id in (select doc_id from labels)""",
    "word_statuses": f"""with {WORDS}
select language, '1' as annotator, status_1 as status, count(*) as n_words,
       cast(sum(pos) as bigint) as sum_pos, cast(sum(length(word)) as bigint) as n_letters
from words group by language, status_1""",
    "corpus_clean": f"with {CORPUS} select item_id, translation from cleaned",
    "corpus_dropped": f"""with {CORPUS}
select count(*) as n_texts, count(*) filter (translation is null) as n_missing,
       count(*) filter (translation = '') as n_blank,
       count(*) filter (translation is null or translation = '') as n_dropped
from marked""",
    "subset_semi": f"""with {CORPUS}
select item_id, cast(length(translation) as integer) as n_chars from cleaned
where item_id in (select 'd' || doc_id from labels)""",
    "subset_missing": f"""with {CORPUS}
select distinct 'd' || doc_id as item_id from labels
where 'd' || doc_id not in (select item_id from cleaned)""",
    "content_words": f"""with {COLORED}
select lang as language, length(w) > 3 as is_content, count(*) as n_words,
       cast(sum(pos) as bigint) as sum_pos, cast(sum(length(w)) as bigint) as n_letters
from tok group by all""",
    "content_out_of_range": f"""with {COLORED}
select lang as language, doc_id as text_id, cast(len(l) as integer) as n_words,
       cast(len(l) as integer) as pos
from src where n_chars % 2 = 1""",
    "stratified_folds": """
select doc_id, lang, cast((row_number() over (
         partition by lang order by md5(doc_id || '|42'), doc_id) - 1) % 5 as integer) as fold
from documents""",
    "lda_corpus": """
select doc_id as id, lang as label, cast((row_number() over (
         partition by lang order by md5(doc_id || '|42'), doc_id) - 1) % 5 as integer) as fold,
       len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}]+'),
                       lambda x: x <> '')) as n_words
from documents""",
    "pca_total_variance": f"""with {NORMED}
select count(*) as n_components, round(sum(v) * 1e6, 3) as total_variance
from (select var_samp(value) as v from normed group by dimension)""",
    "pca_row_length": f"""with {NORMED},
centred as (
  select vec_id, value - avg(value) over (partition by dimension) as value from normed
)
select vec_id, round(sum(value * value) * 1e6, 3) as squared_length
from centred group by vec_id""",
    "pca_means": f"""with {NORMED}
select distinct cast(dimension as integer) as dimension, 0.0::double as mean from normed""",
    "pca_whiten_covariance": f"""with {NORMED},
d as (select distinct cast(dimension as integer) as d from normed)
select a.d as i, b.d as j, case when a.d = b.d then 1.0 else 0.0 end::double as covariance
from d a join d b on a.d <= b.d""",
    "topic_info": """
select row_number() over (order by lang) - 1 as topic_id, 'topic ' || lang as name,
       count(*) as count
from documents group by lang qualify lang <> 'fr'""",
    "topic_scores_heldout": f"""with {score_sql(HELDOUT_TOPICS)}
select d.doc_id as id, s.topic_id, round(s.score, 6) as score
from documents d left join score s on s.id = d.doc_id""",
    "topic_terms": f"""with {TOPICS}
select topic_id, t as term, round(weight, 6) as weight, rank from kept""",
    "topic_distribution": f"""with {SCORES}
select id, topic_id, round(prob, 6) as prob from distribution""",
    "topic_assign": f"""with {SCORES}
select id, assigned_topic, round(top_topic_prob, 6) as top_topic_prob, has_mass, topic_label
from labelled""",
    "topic_summary": f"""with {SCORES}
select id, assigned_topic, coalesce(topic_label, 'unknown') as topic_label,
       round(top_topic_prob, 6) as top_topic_prob from labelled""",
    "topic_wide": f"""with {SCORES}
select l.id, assigned_topic, any_value(topic_label) as topic_label,
       round(coalesce(sum(prob) filter (topic_id = 0), 0.0), 6) as topic_0,
       round(coalesce(sum(prob) filter (topic_id = 1), 0.0), 6) as topic_1,
       round(coalesce(sum(prob) filter (topic_id = 2), 0.0), 6) as topic_2,
       round(coalesce(sum(prob) filter (topic_id = 3), 0.0), 6) as topic_3
from labelled l left join distribution d on l.id = d.id group by l.id, assigned_topic""",
    "topic_uniformity": f"""with {SCORES},
observed as (
  select t.topic_id, count(a.id) as n from topic t
  left join assigned a on a.assigned_topic = t.topic_id group by t.topic_id
)
select cast(sum(n) as bigint) as n_documents, cast(count(*) as integer) as n_topics,
       round(sum((n - e) * (n - e) / e), 6) as chi_square
from observed, (select sum(n) / count(*) as e from observed)""",
    "topic_label_similarity": f"""with {SCORES},
vec as (
  select source as label, topic_id, sum(prob) as weight
  from distribution x join documents d on x.id = d.doc_id group by all
),
norm as (select label, sqrt(sum(weight * weight)) as norm from vec group by label)
select a.label as label_a, b.label as label_b,
       round(sum(a.weight * b.weight) / any_value(m.norm) / any_value(n.norm), 6) as similarity
from vec a join vec b on a.topic_id = b.topic_id and a.label < b.label
join norm m on m.label = a.label join norm n on n.label = b.label
group by a.label, b.label""",
    "l1_normalise": f"""with {NORMED}
select vec_id, cast(dimension as integer) as dimension, round(coalesce(value, 0.0), 6) as value
from normed""",
    "covariance": f"""with {NORMED}
select cast(x.dimension as integer) as i, cast(y.dimension as integer) as j,
       round(covar_samp(x.value, y.value) * 1e6, 6) as covariance
from normed x join normed y on x.vec_id = y.vec_id and x.dimension <= y.dimension
group by x.dimension, y.dimension""",
}

ORACLES["export_read_back"] = f"""{BASE}
select s.language, cast(position as integer) as position, cast(s.text_id as integer) as text_id,
       'song ' || s.text_id || ' of "textId" {{' as title,
       cast(any_value(rating_1) as integer) as overall_rating,
       any_value(unusual_language) as unusual_language, cast(count(w.pos) as integer) as n_words,
       cast(count(*) filter (status_1 = 'wrong') as integer) as n_wrong,
       cast(coalesce(sum(length(word)), 0) as integer) as n_letters
from songs s left join words w on s.text_id = w.text_id
group by s.language, position, s.text_id"""

ORACLES["corpus_read_back"] = """
select 'd' || doc_id as item_id, cast(length(text) as integer) as n_chars, md5(text) as text_md5
from documents"""

ORACLES["ids_read_back"] = f"""with {CORPUS}
select 'd' || doc_id as item_id, 'd' || doc_id not in (select item_id from cleaned) as is_missing
from labels"""

ORACLES["probabilities_read_back"] = f"""with {SCORES},
topic_list as (select topic_id from topic)
select cast(l.id as varchar) as id, assigned_topic, topic_label,
       cast(count(*) over (partition by l.id) as integer) as n_topics,
       round(cast(has_mass as integer), 3)::double as total,
       cast(t.topic_id as integer) as topic_id,
       round(cast(cast(round(coalesce(prob, 0.0), 6) as float) as double), 6) as prob
from labelled l cross join topic_list t
left join distribution d on d.id = l.id and d.topic_id = t.topic_id"""

ORACLES["summary_read_back"] = ORACLES["topic_summary"].replace(
    "select id,", "select cast(id as varchar) as id,"
)

ORACLES["pca_report_facts"] = f"""with {NORMED},
cov as (
  select x.dimension as i, y.dimension as j, covar_samp(x.value, y.value) as c
  from normed x join normed y on x.vec_id = y.vec_id group by all
),
total as (select sum(c) as t, count(*) as n from cov where i = j),
square as (
  select a.i, b.j, sum(a.c * b.c) as c from cov a join cov b on a.j = b.i group by a.i, b.j
)
select n as n_components, n as last_component, 1.0::double as cumulative,
       (select round(sum(c * c) / (t * t), 8) from cov) as squares,
       (select round(sum(s.c * v.c) / (t * t * t), 8)
        from square s join cov v on s.i = v.i and s.j = v.j) as cubes,
       true as descending, true as target_passed, true as none_to_spare, true as numbered
from total"""

ORACLES["quality_report_text"] = f"""
with r as ({ORACLES["mt_language_report"]}), u as ({ORACLES["mt_unusual_language"]}),
lines as (
  select '' as block, 0 as line, 'Machine Translation Evaluation Results' as text
  union all select '', 1000000, ''
  union all
  select language, unnest([0, 1, 2, 3, 4, 5, 6, 7, 1000000]), unnest([
    'Language: ' || language,
    '  Mean overall rating: ' || coalesce(printf('%.2f', round(mean_rating, 2)), 'nan'),
    '  Mean correctness: ' || printf('%.2f', round(mean_correctness, 2)),
    '  Mean importance: ' || printf('%.2f', round(mean_importance, 2)),
    '  Total words evaluated: ' || n_words,
    '  Self-agreement of annotator: ' || coalesce(printf('%.2f', round(self_agreement, 2)), 'nan'),
    '  Hallucinations: ' || n_hallucinations || ' out of ' || n_songs_minus_repeat || ' songs',
    '  Unusual language distribution:', ''])
  from r
  union all
  select language, seen_rank + 7, '    ' || coalesce(unusual_language, 'None') || ': ' || n_songs
  from u
)
select row_number() over (order by block, line) as line, text from lines"""

ORACLES["agreement_report_text"] = f"""
with r as ({ORACLES["iaa_report"]}),
lines as (
  select language as block, unnest([0, 1, 2, 3, 4, 5]) as line, unnest([
    language || ' AB CD',
    'Cohen''s kappa for overallRating: ' || coalesce(printf('%.4f', kappa_rating), 'nan'),
    'Cohen''s kappa for hallucination: ' || coalesce(printf('%.4f', kappa_hallucination), 'nan'),
    'Mean Cohen''s kappa for word-level labels: '
      || coalesce(printf('%.4f', mean_kappa_words), 'nan'),
    'Mean accuracy for important word-level labels: '
      || coalesce(printf('%.4f', mean_accuracy_important), 'nan'),
    'Mean Cohen''s kappa for important word-level labels: '
      || coalesce(printf('%.4f', mean_kappa_important), 'nan')]) as text
  from r
)
select row_number() over (order by block, line) as line, text from lines"""

# The model of two merged parts is that of the whole.
ORACLES["topic_model_reload"] = ORACLES["topic_distribution"]
