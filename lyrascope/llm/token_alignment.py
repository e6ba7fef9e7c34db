"""Alignment of two tokenizers' tokens by counting linked pairs in sorted runs (operator 11).

A token of the byte-level tokenizer A and one of the piece tokenizer B are linked if they end at
the same byte; the common ends cut both sequences into groups.  Links are counted over the whole
corpus like in an external sort: a chunk of documents is a run of pair-document records in
order of the pair, B's id first, compressed and written.  The pairs of all runs are cut by the
first bits of B's id, each part is merged by a heap over its runs, and as all pairs of one B id
come one after the other, their highest count is known as they pass.  A second pass over the
part's runs sends every pair's count back to its run, where the documents add up their records.

What is shuffled is a run's distinct pairs, not its links, so a frequent pair costs one entry
per run and its documents stay where they are.
"""

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.llm.text import chunks, flat, sums

# The vocabulary of byte_bpe_50k.json as ranks, read by the faster of its two libraries.
BYTES = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"

MARK = "▁"

# Distinct pairs of all runs that one task merges, and runs it merges at a time.
PER_TASK = 1 << 20
FAN_IN = 64

# Pairs of a run that the heap moves at a time.
STEP = 1 << 14

A_BITS = 20


@dataclass
class Aligned:
    """Tokens, groups and links of some documents; the offsets are per document."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    groups: list[bytes]


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the spelling of ids in groups."""

    def __init__(self, byte_file: str, piece_file: str):
        with open(public_tokenizers.path(byte_file), "rb") as lines:
            ranks = {
                base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)
            }
        self.coder = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.pieces = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(piece_file)
        )
        a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            a[rank] = token
        b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_a, self.bytes_b = pa.array(a, pa.large_binary()), pa.array(b, pa.large_binary())
        self.size_a, self.size_b = (np.array([len(t) for t in ts], np.int64) for ts in (a, b))
        self.count_a, self.count_b = len(a), len(b)
        self.b_bits = max(self.count_b - 1, 1).bit_length()
        # An id of A or B inside its group, then as the last one of its group.
        spelt = [
            b"%d" % i + mark
            for n, inner, last in ((len(a), b",", b"|"), (len(b), b",", b";"))
            for mark in (inner, last)
            for i in range(n)
        ]
        self.spelt = pa.array(spelt, pa.large_binary())
        self.spelt_size = np.array([len(s) for s in spelt], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        return piece.replace(MARK, " ").encode()

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers, B's id first.

        B's ids are scattered over their bits, so that parts cut by the first bits are of about
        one size.
        """
        return self.scatter(b) << A_BITS | a.astype(np.int64)

    def scatter(self, b: np.ndarray) -> np.ndarray:
        return b.astype(np.int64) * 0x9E3779B1 & (1 << self.b_bits) - 1

    def pair(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and B of keys."""
        back = pow(0x9E3779B1, -1, 1 << self.b_bits)
        return key & (1 << A_BITS) - 1, (key >> A_BITS) * back & (1 << self.b_bits) - 1

    def align(self, texts: pa.Array) -> Aligned:
        """Tokens of every text; those of texts that do not come back byte by byte are dropped."""
        values = pc.fill_null(texts.cast(pa.large_string()), "")
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        spaced = pc.binary_join_element_wise(space, values, nothing)
        plain = values.to_pylist()
        ids_a = [self.coder.encode_to_numpy(" " + t) if t else [] for t in plain]
        ids_b = self.pieces.encode(plain, num_threads=1) if plain else []
        offsets_a, a = _joined(ids_a)
        offsets_b, b = _joined(ids_b)
        ends, data = flat(spaced)
        wanted = np.where(pc.binary_length(values).to_numpy() > 0, np.diff(ends), 0)
        good = np.ones(len(plain), bool)
        for offsets, ids, size, table in (
            (offsets_a, a, self.size_a, self.bytes_a),
            (offsets_b, b, self.size_b, self.bytes_b),
        ):
            good &= sums(size[ids], offsets) == wanted
            good &= sums((size[ids] == 0).astype(np.int64), offsets) == 0
            good &= self._come_back(offsets, ids, table, size, ends, data, good & (wanted > 0))
        a, offsets_a = _only(a, offsets_a, good)
        b, offsets_b = _only(b, offsets_b, good)
        return self._grouped(a, offsets_a, b, offsets_b)

    @staticmethod
    def _come_back(offsets, ids, table, size, ends, data, asked) -> np.ndarray:
        """Whether the tokens of the texts that are asked for are the texts' bytes."""
        made = np.ones(len(asked), bool)
        kept, at = _only(ids, offsets, asked)
        if not len(kept):
            return made
        joined = np.frombuffer(
            table.take(pa.array(kept)).buffers()[2], np.uint8, int(size[kept].sum())
        )
        same = joined == data[np.repeat(asked, np.diff(ends))]
        bytes_at = np.r_[0, np.cumsum(np.where(asked, np.diff(ends), 0))]
        made &= sums((~same).astype(np.int64), bytes_at) == 0
        return made

    def _grouped(self, a, offsets_a, b, offsets_b) -> Aligned:
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        at = np.zeros(total + 1, bool)
        at[ends_b] = True
        last_a = at[ends_a]
        at[:] = False
        at[ends_a] = True
        last_b = at[ends_b]
        cut_a, cut_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        # A group is written as its tokens of A and then those of B.
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        spelling = np.empty(len(a) + len(b), np.int64)
        before_b = np.r_[0, cut_b + 1]
        place = np.arange(len(a)) + before_b[group_a]
        spelling[place] = a + last_a * self.count_a
        place = np.arange(len(b)) + (cut_a + 1)[group_b]
        spelling[place] = b + last_b * self.count_b + 2 * self.count_a
        text = memoryview(b"")
        if len(spelling):
            text = memoryview(self.spelt.take(pa.array(spelling)).buffers()[2])
        ends = np.r_[0, np.cumsum(self.spelt_size[spelling])]
        bounds = ends[offsets_a + offsets_b].tolist()
        groups = [
            bytes(text[x : max(y - 1, x)]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        n_groups = sums(last_a.astype(np.int64), offsets_a)
        n_a, n_b = np.diff(offsets_a), np.diff(offsets_b)
        return Aligned(n_a, n_b, n_groups, a[cut_a], b[cut_b], groups)


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lists], np.int64)
    values = [np.asarray(x, np.int64) for x in lists]
    joined = np.concatenate(values) if values else np.empty(0, np.int64)
    return np.r_[0, np.cumsum(lengths)], joined


def _only(values: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
    """The lists of the wanted documents; the others are empty."""
    lengths = np.diff(offsets)
    return values[np.repeat(wanted, lengths)], np.r_[0, np.cumsum(np.where(wanted, lengths, 0))]


@cache
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def squeeze(values: np.ndarray) -> bytes:
    """An array of integers by bytes of equal weight, compressed."""
    planes = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _steps(sorted_values: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_values, prepend=0))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data))


RUN = [
    ("run", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())),
    ("n_a", pa.binary()),
    ("n_b", pa.binary()),
    ("n_groups", pa.binary()),
    ("groups_sha256", pa.list_(pa.string())),
    ("pairs", pa.binary()),
    ("totals", pa.binary()),
    ("n_pairs", pa.int64()),
    ("records", pa.binary()),
    ("docs", pa.binary()),
    ("counts", pa.binary()),
]
PART = [
    ("part", pa.int32()),
    ("run", pa.int64()),
    ("pairs", pa.binary()),
    ("totals", pa.binary()),
]
ANSWER = [
    ("part", pa.int32()),
    ("run", pa.int64()),
    ("n", pa.int64()),
    ("counts", pa.binary()),
    ("best", pa.binary()),
]
COUNTED = [("key", pa.int64()), ("n", pa.int64()), ("best", pa.bool_())]
RESULT = [
    ("doc_id", pa.int64()),
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("n_groups", pa.int64()),
    ("n_links", pa.int64()),
    ("n_best", pa.int64()),
    ("count_sum", pa.int64()),
    ("groups_sha256", pa.string()),
]

NAMES = {
    pa.int64(): "long",
    pa.int32(): "int",
    pa.binary(): "binary",
    pa.bool_(): "boolean",
    pa.string(): "string",
    pa.list_(pa.int64()): "array<long>",
    pa.list_(pa.string()): "array<string>",
}


def ddl(fields: list[tuple]) -> str:
    return ", ".join(f"{name} {NAMES[kind]}" for name, kind in fields)


def _rows(rows: list[dict], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def _run(number: int, chunk: pa.RecordBatch, own: Aligner) -> dict:
    """One sorted run: the chunk's pairs, and per pair its documents and their links."""
    found = own.align(chunk.column("text"))
    doc = np.repeat(np.arange(chunk.num_rows), found.n_groups)
    # One number per link, so that sorting needs no index: the pair, then the document.
    bits = max(chunk.num_rows - 1, 1).bit_length()
    if own.b_bits + A_BITS + bits < 64:
        links = np.sort(own.key(found.links_a, found.links_b) << bits | doc)
        key, doc = links >> bits, links & (1 << bits) - 1
    else:
        key = own.key(found.links_a, found.links_b)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
    new_key = np.diff(key, prepend=-1) != 0
    new = np.flatnonzero(new_key | (np.diff(doc, prepend=-1) != 0))
    pair = np.flatnonzero(new_key)
    return {
        "run": number,
        "doc_ids": chunk.column("doc_id").to_pylist(),
        "n_a": squeeze(found.n_a),
        "n_b": squeeze(found.n_b),
        "n_groups": squeeze(found.n_groups),
        "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups],
        "pairs": _steps(key[pair]),
        "totals": squeeze(np.diff(np.r_[pair, len(key)])),
        "n_pairs": len(pair),
        "records": squeeze(np.diff(np.r_[np.searchsorted(new, pair), len(new)])),
        "docs": squeeze(doc[new]),
        "counts": squeeze(np.diff(np.r_[new, len(key)])),
    }


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending keys with their totals over some sorted runs of (keys, totals).

    The heap has every run's next key.  What is taken at a time reaches to the smallest key
    that ends a step of a run, so no key is split.
    """
    heap = [(int(keys[0]), i, 0) for i, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        limit = min(int(runs[i][0][min(at + STEP, len(runs[i][0])) - 1]) for _, i, at in heap)
        taken = []
        while heap and heap[0][0] <= limit:
            _, i, at = heapq.heappop(heap)
            keys, totals = runs[i]
            stop = int(np.searchsorted(keys, limit, "right"))
            taken.append((keys[at:stop], totals[at:stop]))
            if stop < len(keys):
                heapq.heappush(heap, (int(keys[stop]), i, stop))
        keys = np.concatenate([k for k, _ in taken])
        totals = np.concatenate([t for _, t in taken])
        order = np.argsort(keys, kind="stable")
        keys, totals = keys[order], totals[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(totals, first)


def _whole(steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    made = list(steps)
    if not made:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([k for k, _ in made]), np.concatenate([t for _, t in made])


def count_part(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and whether each count is its B id's highest, over compressed runs.

    Runs are expanded FAN_IN at a time and merged into longer ones, which are compressed again.
    """
    while len(runs) > FAN_IN:
        runs = [
            tuple(
                f(x)
                for f, x in zip(
                    (_steps, squeeze),
                    _whole(merge([_opened(r) for r in runs[i : i + FAN_IN]])),
                    strict=True,
                )
            )
            for i in range(0, len(runs), FAN_IN)
        ]
    keys, counts = _whole(merge([_opened(r) for r in runs]))
    if not len(keys):
        return keys, counts, np.empty(0, bool)
    of_b = keys >> A_BITS
    first = np.flatnonzero(np.diff(of_b, prepend=-1))
    highest = np.maximum.reduceat(counts, first)
    return keys, counts, counts == np.repeat(highest, np.diff(np.r_[first, len(keys)]))


def _opened(run: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(run[0]), expand(run[1])


def _by_part(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows that are sorted by part, part by part."""
    current, held = None, []
    for batch in rows:
        for row in batch.to_pylist():
            if held and row["part"] != current:
                yield current, held
                held = []
            current = row["part"]
            held.append(row)
    if held:
        yield current, held


def _parts(total: int, per_task: int, b_bits: int) -> int:
    return 1 << min(max(-(-total // per_task) - 1, 0).bit_length(), b_bits)


def _runs(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        own = aligner(byte_file, piece_file)
        for number, chunk in enumerate(chunks(batches)):
            yield _rows([_run(task << 32 | number, chunk, own)], RUN)

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return written(map_arrow(texts, make, ddl(RUN)), "runs")


def _spilled(runs: DataFrame, parts: int, b_bits: int) -> DataFrame:
    """The runs' pairs cut by the first bits of B's id, part by part in every task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = A_BITS + b_bits - (parts.bit_length() - 1)
        for batch in batches:
            for row in batch.to_pylist():
                keys, totals = _opened((row["pairs"], row["totals"]))
                bounds = np.searchsorted(keys >> shift, np.arange(parts + 1))
                made = [
                    {
                        "part": int(part),
                        "run": row["run"],
                        "pairs": _steps(keys[bounds[part] : bounds[part + 1]]),
                        "totals": squeeze(totals[bounds[part] : bounds[part + 1]]),
                    }
                    for part in np.flatnonzero(np.diff(bounds))
                ]
                if made:
                    yield _rows(made, PART)

    cut_runs = map_arrow(runs.select("run", "pairs", "totals"), cut, ddl(PART))
    return cut_runs.repartition(parts, "part").sortWithinPartitions("part", "run")


def _counted(spilled: DataFrame) -> DataFrame:
    """Answers to every run of every part: the counts of its pairs, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            keys, counts, best = count_part([(r["pairs"], r["totals"]) for r in rows])
            for row in rows:
                at = np.searchsorted(keys, _summed(row["pairs"]))
                answer = {
                    "part": part,
                    "run": row["run"],
                    "n": len(at),
                    "counts": squeeze(counts[at]),
                    "best": np.packbits(best[at]).tobytes(),
                }
                yield _rows([answer], ANSWER)

    return map_arrow(spilled, count, ddl(ANSWER))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of runs with the counts of their links added up."""
    for batch in batches:
        for row in batch.to_pylist():
            answers = row["answers"] or []
            n = len(row["doc_ids"])
            n_groups, records = expand(row["n_groups"]), expand(row["records"])
            links, doc = expand(row["counts"]), expand(row["docs"])
            none = [np.empty(0, np.int64)]
            counts = np.concatenate([expand(a["counts"]) for a in answers] or none)
            best = np.concatenate(
                [np.unpackbits(np.frombuffer(a["best"], np.uint8))[: a["n"]] for a in answers] or none
            )
            assert len(counts) == len(best) == len(records)
            count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(count_sum, doc, links * np.repeat(counts, records))
            np.add.at(n_best, doc, links * np.repeat(best, records))
            columns = [
                row["doc_ids"],
                expand(row["n_a"]),
                expand(row["n_b"]),
                n_groups,
                n_groups,
                n_best,
                count_sum,
                row["groups_sha256"],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns, RESULT, strict=True)],
                schema=pa.schema(RESULT),
            )


def align(
    docs: DataFrame,
    byte_file: str = BYTES,
    piece_file: str = PIECES,
    per_task: int = PER_TASK,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of documents.

    Two tokens with one end are one link, so a document has as many links as groups.  NULL and
    empty texts, and those whose tokens do not give back a space and the text, have no tokens.
    Every row counts, also repeated ones and those without a doc_id; further columns are left
    out.
    """
    runs = _runs(docs, byte_file, piece_file)
    b_bits = aligner(byte_file, piece_file).b_bits
    total = runs.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
    counted = _counted(_spilled(runs, _parts(total, per_task, b_bits), b_bits))
    items = F.sort_array(F.collect_list(F.struct("part", "n", "counts", "best")))
    answers = written(counted, "answers").groupBy("run").agg(items.alias("answers"))
    return map_arrow(runs.join(answers, "run", "left"), _added, ddl(RESULT))


def pair_counts(
    docs: DataFrame,
    byte_file: str = BYTES,
    piece_file: str = PIECES,
    per_task: int = PER_TASK,
) -> DataFrame:
    """id_a, id_b, n (links) and best (n is id_b's highest) of every linked pair of ids."""
    runs = _runs(docs, byte_file, piece_file)
    b_bits = aligner(byte_file, piece_file).b_bits
    total = runs.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_file, piece_file)
        for _, rows in _by_part(batches):
            keys, counts, best = count_part([(r["pairs"], r["totals"]) for r in rows])
            a, b = own.pair(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(counts), pa.array(best)],
                ["id_a", "id_b", "n", "best"],
            )

    spilled = _spilled(runs, _parts(total, per_task, b_bits), b_bits)
    return map_arrow(spilled, count, "id_a long, id_b long, n long, best boolean")


def groups(docs: DataFrame, byte_file: str = BYTES, piece_file: str = PIECES) -> DataFrame:
    """doc_id and ``groups``: ids of A and of B by group, ``a1,a2|b1;a3|b2,b3``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_file, piece_file)
        for chunk in chunks(batches):
            found = [g.decode() for g in own.align(chunk.column("text")).groups]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "groups"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(texts, make, "doc_id long, groups string")
