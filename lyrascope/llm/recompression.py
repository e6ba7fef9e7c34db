"""Removal of repeated word sequences by recompression (operator 12).

A text is a sequence of symbols, at first its words.  A round names runs of one symbol, and then
every pair of a left and a right symbol, where a hash of the symbol tells its side.  Which
symbols are made depends on their surroundings alone, so equal passages get equal symbols but
for their edges.  Every symbol carries its context: the words that decide that it is there.  A
window of words that holds a symbol's context holds the symbol wherever it occurs.

A window is known by its anchor, the longest phrase of neighbouring symbols whose context it
holds; windows side by side mostly share one.  Two rounds of Spark decide which are repeated:
first, all blocks of documents name their anchors, and anchors that no other block has drop
out; then, the windows of shared anchors are compared by 96 bits of hash over their words, with
the smallest document that starts them.  Names are hashes of what they stand for, so they are
the same everywhere without a shuffle that hands them out.

Both rounds move sorted, delta-coded arrays, cut by the first bits of the names: a name is sent
once a block however often it occurs, and the answer is one bit.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.llm.text import chunks, words

WINDOW = 13

# Rounds of naming, and how many neighbouring symbols make a phrase.
ROUNDS = 2
PHRASE = 2

# Names that are compared in one task.
PER_TASK = 1 << 20

U = np.uint64
FIRST, SECOND = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers that maps no two to one."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@dataclass
class Symbols:
    """Symbols of some texts in order: names, words they cover and words that decide them."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray  # first word of the context
    high: np.ndarray  # word after the context
    text: np.ndarray  # the text that each is in

    def widen(self, at: np.ndarray, by: "Symbols", of: np.ndarray) -> None:
        """Add to the contexts of the symbols ``at`` those of the symbols ``of``."""
        self.low[at] = np.minimum(self.low[at], by.low[of])
        self.high[at] = np.maximum(self.high[at], by.high[of])


def name_runs(s: Symbols, code: np.ndarray) -> Symbols:
    """Runs of equal symbols as one; ``code`` has the words' codes.

    A run's context reaches to the symbols beside it, which must differ: a differing word next
    to the run shows that, else the whole neighbour is needed.
    """
    same = (s.name[1:] == s.name[:-1]) & (s.text[1:] == s.text[:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[first[1:], len(s.name)] - 1
    length = last - first + 1
    name = s.name[first]
    several = length > 1
    name[several] = mix(name[several] * U(3) + length[several].astype(U))
    made = Symbols(
        name,
        s.start[first],
        s.end[last],
        np.minimum.reduceat(s.low, first),
        np.maximum.reduceat(s.high, first),
        s.text[first],
    )
    beside = made.text[1:] == made.text[:-1]
    before, after = code[made.end - 1], code[made.start]
    # Without a neighbour the context reaches out of the text: no window holds it.
    unlike_left = np.r_[True, ~beside | (before[:-1] != before[1:])]
    unlike_right = np.r_[~beside | (after[:-1] != after[1:]), True]
    old = Symbols(made.name, made.start, made.end, made.low.copy(), made.high.copy(), made.text)
    made.low = np.where(unlike_left, np.minimum(made.low, made.start - 1), made.low)
    made.high = np.where(unlike_right, np.maximum(made.high, made.end + 1), made.high)
    like = np.flatnonzero(~unlike_left)
    made.widen(like, old, like - 1)
    like = np.flatnonzero(~unlike_right)
    made.widen(like, old, like + 1)
    return made


def name_pairs(s: Symbols, number: int) -> Symbols:
    """Every left symbol with a right one after it as one symbol.

    A pair is decided by its two symbols.  A right symbol that is left alone needs the one
    before it as context, a left symbol the one after it.
    """
    left = (mix(s.name + U(number)) & U(1)).astype(bool)
    beside = s.text[1:] == s.text[:-1]
    head = np.flatnonzero(left[:-1] & ~left[1:] & beside)
    alone = np.ones(len(left), bool)
    alone[head] = alone[head + 1] = False
    made = Symbols(s.name.copy(), s.start, s.end.copy(), s.low.copy(), s.high.copy(), s.text)
    made.widen(head, s, head + 1)
    made.name[head] = mix(s.name[head] * U(5) + mix(s.name[head + 1]))
    made.end[head] = s.end[head + 1]
    has_left, has_right = np.r_[False, beside], np.r_[beside, False]
    right = alone & ~left
    made.widen(np.flatnonzero(right & has_left), s, np.flatnonzero(right & has_left) - 1)
    made.low[right & ~has_left] = s.start[right & ~has_left] - 1
    other = alone & left
    made.widen(np.flatnonzero(other & has_right), s, np.flatnonzero(other & has_right) + 1)
    made.high[other & ~has_right] = s.end[other & ~has_right] + 1
    kept = np.ones(len(left), bool)
    kept[head + 1] = False
    return Symbols(*[getattr(made, f)[kept] for f in Symbols.__dataclass_fields__])


def parse(hashes: np.ndarray, code: np.ndarray, text: np.ndarray, rounds: int) -> list[Symbols]:
    """Symbols after every round, the words first."""
    place = np.arange(len(hashes))
    levels = [Symbols(hashes, place, place + 1, place.copy(), place + 1, text)]
    for number in range(rounds):
        levels.append(name_pairs(name_runs(levels[-1], code), number))
    return levels


def phrases(s: Symbols, size: int) -> Symbols:
    """Every ``size`` neighbouring symbols of one text."""
    n = max(len(s.name) - size + 1, 0)
    name, low, high = mix(s.name[:n] + U(size)), s.low[:n], s.high[:n]
    for j in range(1, size):
        name = mix(name * U(7) + s.name[j : n + j])
        low, high = np.minimum(low, s.low[j : n + j]), np.maximum(high, s.high[j : n + j])
    end, whole = s.end[size - 1 :], s.text[:n] == s.text[size - 1 :]
    return Symbols(*[x[whole] for x in (name, s.start[:n], end, low, high, s.text[:n])])


def anchors(
    levels: list[Symbols], letters: np.ndarray, window: int = WINDOW, phrase: int = PHRASE
) -> np.ndarray:
    """The anchor of the window that starts at every word (within its text or not).

    The longest phrase, in ``letters`` (a running sum by word), of those whose context the
    window holds, and of equal ones that of the largest hash.  Windows without one take a
    single symbol, of the last round that has one; words always have.
    """
    n = len(letters) - 1
    found = np.zeros(n, U)
    tries = [phrases(levels[-1], size) for size in range(phrase, 0, -1)] + levels[-2::-1]
    for number, s in enumerate(tries):
        missing = np.r_[0, np.cumsum(found == 0)]
        if not missing[-1]:
            break
        # The windows that hold the context start from ``first`` to ``low``.
        first = np.maximum(s.high - window, 0)
        low = np.minimum(s.low, n - 1)
        use = np.flatnonzero(first <= low)
        use = use[missing[low[use] + 1] > missing[first[use]]]
        first, span = first[use], low[use] - first[use]
        size = np.minimum(letters[s.end[use]] - letters[s.start[use]], 4095).astype(U)
        rank = size << U(52) | mix(s.name[use] + U(number)) >> U(12) | U(1)
        best = np.zeros(n, U)
        for step in range(window):
            wide = span >= step
            np.maximum.at(best, first[wide] + step, rank[wide])
        found = np.where(found == 0, best, found)
    return mix(found)


def squeeze(values: np.ndarray) -> bytes:
    """An array of numbers by bytes of equal weight, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return squeeze(np.diff(values, prepend=U(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, U), dtype=U)


BLOCK = (
    "block long, doc_ids binary, known binary, offsets binary, codes binary, distinct binary, "
    "run_name binary, run_length binary, names binary, n_names long, n_words long"
)
REQUEST = "part int, block long, names binary, checks binary, docs binary"
ANSWER = "part int, block long, n long, bits binary"


def _hashes(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every word."""
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in distinct])
    both = np.frombuffer(digests, U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _starts(offsets: np.ndarray, known: np.ndarray, window: int) -> np.ndarray:
    """Places where a whole window starts, in documents that have an id."""
    first, last = offsets[:-1][known], offsets[1:][known] - window + 1
    change = np.zeros(offsets[-1] + 1, np.int64)
    long = last > first
    np.add.at(change, first[long], 1)
    np.add.at(change, last[long], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


@dataclass
class Settings:
    window: int = WINDOW
    rounds: int = ROUNDS
    phrase: int = PHRASE


def _blocks(settings: Settings):
    """A function for mapInArrow: one row per chunk of texts, with its words and anchors."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            ids = chunk.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            w = words(chunk.column("text"))
            raw = w.distinct.to_pylist()
            first, _ = _hashes(raw)
            size = np.array([len(x) for x in raw], np.int64)
            letters = np.r_[0, np.cumsum(size[w.codes])]
            starts = _starts(w.offsets, known, settings.window)
            names = run_name = run_length = np.empty(0, U)
            if len(starts):
                levels = parse(first[w.codes], w.codes, w.owner, settings.rounds)
                of = anchors(levels, letters, settings.window, settings.phrase)[starts]
                edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                names, run_name = np.unique(of[edge], return_inverse=True)
                run_length = np.diff(np.r_[edge, len(of)])
            # Frequent words get small codes, whose upper bytes compress to little.
            order = np.argsort(-np.bincount(w.codes, minlength=len(raw)), kind="stable")
            rank = np.empty(len(raw), np.int32)
            rank[order] = np.arange(len(raw))
            row = {
                "block": task << 32 | number,
                "doc_ids": squeeze(ids.fill_null(0).to_numpy()),
                "known": known.tobytes(),
                "offsets": squeeze(w.offsets.astype(np.int64)),
                "codes": squeeze(rank[w.codes]),
                "distinct": zstandard.ZstdCompressor(level=1).compress(
                    b" ".join([raw[i] for i in order])
                ),
                "run_name": squeeze(run_name.astype(np.int32)),
                "run_length": squeeze(run_length.astype(np.int32)),
                "names": _steps(names),
                "n_names": len(names),
                "n_words": len(w.codes),
            }
            yield pa.RecordBatch.from_pylist([row], _schema(BLOCK))

    return make


def _schema(text: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], types[f.split()[1]]) for f in text.split(", ")])


def _cut(names: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Part, start and end of the names of each part that has some; parts is a power of two."""
    of = (names >> U(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else names * 0
    bounds = np.searchsorted(of, np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(bounds)):
        yield int(part), int(bounds[part]), int(bounds[part + 1])


def _requests(parts: int, block: int, names, checks=None, docs=None) -> pa.RecordBatch | None:
    rows = [
        {
            "part": part,
            "block": block,
            "names": _steps(names[a:b]),
            "checks": None if checks is None else squeeze(checks[a:b]),
            "docs": None if docs is None else squeeze(docs[a:b]),
        }
        for part, a, b in _cut(names, parts)
    ]
    return pa.RecordBatch.from_pylist(rows, _schema(REQUEST)) if rows else None


def _answered(requests: DataFrame, parts: int, judge) -> DataFrame:
    """Answers to the requests of all blocks: part, block, n and as many bits.

    ``judge`` takes the names, checks, documents and blocks of all requests of a part.
    """

    def close(part: int, held: list[tuple]) -> pa.RecordBatch:
        lengths = [len(names) for _, names, _, _ in held]
        columns = [
            None if held[0][i] is None else np.concatenate([h[i] for h in held]) for i in (1, 2, 3)
        ]
        of = np.repeat(np.arange(len(held)), lengths)
        verdicts = np.split(judge(*columns, of), np.cumsum(lengths)[:-1])
        rows = [
            {"part": part, "block": h[0], "n": n, "bits": np.packbits(v).tobytes()}
            for h, n, v in zip(held, lengths, verdicts, strict=True)
        ]
        return pa.RecordBatch.from_pylist(rows, _schema(ANSWER))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != current and held:
                    yield close(current, held)
                    held = []
                current = row["part"]
                checks, docs = row["checks"], row["docs"]
                held.append(
                    (
                        row["block"],
                        _summed(row["names"]),
                        None if checks is None else expand(checks, np.uint32),
                        None if docs is None else expand(docs, np.int64),
                    )
                )
        if held:
            yield close(current, held)

    ordered = requests.repartition(parts, "part").sortWithinPartitions("part")
    return map_arrow(ordered, answer, ANSWER)


def _elsewhere(names, _checks, _docs, of) -> np.ndarray:
    """Names that another block has too; a block names each once."""
    order = np.argsort(names, kind="stable")
    equal = names[order][1:] == names[order][:-1]
    shared = np.empty(len(names), bool)
    shared[order] = np.r_[False, equal] | np.r_[equal, False]
    return shared


def _earlier(names, checks, docs, of) -> np.ndarray:
    """Windows that start in a smaller document of another block."""
    order = np.lexsort((docs, checks, names))
    names, checks, docs = names[order], checks[order], docs[order]
    first = np.r_[True, (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])]
    smallest = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
    verdict = np.empty(len(names), bool)
    verdict[order] = docs > smallest
    return verdict


@dataclass
class Candidates:
    """Windows of one block whose anchors are shared, and their distinct word sequences."""

    place: np.ndarray  # of every window
    group: np.ndarray  # its sequence
    doc: np.ndarray  # its document's id
    names: np.ndarray  # of the sequences, sorted
    checks: np.ndarray
    docs: np.ndarray  # smallest id of a document in the block that starts the sequence


@dataclass
class Block:
    """Words of one chunk of documents."""

    doc_ids: np.ndarray
    known: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray
    distinct: list[bytes]

    @classmethod
    def read(cls, row: dict) -> "Block":
        joined = zstandard.ZstdDecompressor().decompress(row["distinct"])
        return cls(
            expand(row["doc_ids"], np.int64),
            np.frombuffer(row["known"], bool),
            expand(row["offsets"], np.int64),
            expand(row["codes"], np.int32),
            joined.split(b" ") if joined else [],
        )

    def candidates(self, row: dict, window: int) -> Candidates:
        """Windows whose anchor another block has, or another document of this block."""
        starts = _starts(self.offsets, self.known, window)
        owner = np.repeat(np.arange(len(self.doc_ids)), np.diff(self.offsets))
        run_name = expand(row["run_name"], np.int32)
        run_length = expand(row["run_length"], np.int32)
        shared = _bits(row["answers"], row["n_names"])
        first = np.cumsum(run_length) - run_length
        # An anchor in two runs may be in two documents of the block.
        shared |= np.bincount(run_name, minlength=len(shared)) > 1
        # One run may go on in the next document.
        if len(starts):
            crosses = owner[starts[first]] != owner[starts[first + run_length - 1]]
            shared[run_name[crosses]] = True
        place = starts[np.repeat(shared[run_name], run_length)]
        one, two = _hashes(self.distinct) if len(place) else (np.empty(0, U), np.empty(0, U))
        names, checks = np.zeros(len(place), U), np.zeros(len(place), U)
        for j in range(window):
            code = self.codes[place + j]
            names, checks = names * FIRST + one[code], checks * SECOND + two[code]
        names, checks = mix(names), (mix(checks) >> U(32)).astype(np.uint32)
        doc = self.doc_ids[owner[place]]
        order = np.lexsort((doc, checks, names))
        names, checks = names[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return Candidates(place, group, doc, names[new], checks[new], doc[order][new])


def _bits(answers: list[dict] | None, n: int) -> np.ndarray:
    """The bits of a block's answers, part by part."""
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: a["n"]] for a in answers or []]
    made = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    assert len(made) == n
    return made


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    """All answers that a block got, by part.

    They are a bit per name, written so that Spark knows their size and broadcasts them to the
    blocks while they are few; else blocks and answers meet in a shuffle.
    """
    items = F.sort_array(F.collect_list(F.struct("part", "n", "bits")))
    return written(answers.groupBy("block").agg(items.alias(name)), name)


def _kept(block: Block, covered: np.ndarray) -> pa.RecordBatch:
    """doc_id, n_words, removed spans and kept text of a block's documents."""
    rest = np.flatnonzero(~covered)
    vocabulary = pa.array([w + b" " for w in block.distinct], pa.large_binary())
    taken = vocabulary.take(pa.array(block.codes[rest])) if len(rest) else vocabulary[:0]
    sizes = np.array([len(w) + 1 for w in block.distinct], np.int64)
    ends = np.r_[0, np.cumsum(sizes[block.codes[rest]])] if len(rest) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2])[: ends[-1]] if len(rest) else memoryview(b"")
    bounds = ends[np.searchsorted(rest, block.offsets)]
    texts = [
        bytes(data[a : max(b - 1, a)]).decode()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]
    # Covered words side by side, within one document.
    change = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    cuts = np.unique(np.r_[change, block.offsets])
    start, end = cuts[:-1], cuts[1:]
    inside = covered[start] if len(start) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    owner = np.searchsorted(block.offsets, start, "right") - 1
    base = block.offsets[owner]
    spans = pa.StructArray.from_arrays(
        [pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]
    )
    n_spans = np.bincount(owner, minlength=len(block.doc_ids))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.doc_ids, pa.int64(), mask=~block.known),
            pa.array(np.diff(block.offsets), pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_spans)], pa.int32()), spans),
            pa.array(texts, pa.string()),
        ],
        ["doc_id", "n_words", "removed", "kept"],
    )


def _parts(total: int, per_task: int) -> int:
    """A power of two, so that parts are told by the first bits of a name."""
    return 1 << max(-(-total // per_task) - 1, 0).bit_length()


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    rounds: int = ROUNDS,
    phrase: int = PHRASE,
    per_task: int = PER_TASK,
) -> DataFrame:
    """Documents (doc_id, text) without the words that a smaller document has in a window.

    Returns doc_id, n_words, ``removed`` (spans of words, from 0) and ``kept`` (the other words,
    joined by a space) for every row.  A window is ``window`` words in a row, compared in the
    input as it is.  NULL and empty texts have no words, shorter ones no window.  Rows of one
    doc_id are not compared with each other; rows without one are left whole and no other row
    is compared with them.  Further columns are left out.
    """
    settings = Settings(window, rounds, phrase)
    blocks = written(
        map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _blocks(settings), BLOCK),
        "words",
    )
    total = blocks.agg(
        F.coalesce(F.sum("n_names"), F.lit(0)).alias("names"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"),
    ).first()
    parts = _parts(total["names"], per_task)
    # A window is asked for if its anchor is shared, which is known for no window yet.
    window_parts = _parts(total["words"], 4 * per_task)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = _requests(parts, row["block"], _summed(row["names"]))
                if made:
                    yield made

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Block.read(row).candidates(row, window)
                made = _requests(window_parts, row["block"], c.names, c.checks, c.docs)
                if made:
                    yield made

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                c = block.candidates(row, window)
                repeated = _bits(row["verdicts"], len(c.names))[c.group] | (c.doc > c.docs[c.group])
                change = np.zeros(len(block.codes) + 1, np.int64)
                np.add.at(change, c.place[repeated], 1)
                np.add.at(change, c.place[repeated] + window, -1)
                yield _kept(block, np.cumsum(change[:-1]) > 0)

    named = map_arrow(blocks.select("block", "names"), ask, REQUEST)
    answers = _by_block(_answered(named, parts, _elsewhere), "answers")
    candidates = blocks.drop("names").join(answers, "block", "left")
    windows = map_arrow(candidates, ask_windows, REQUEST)
    verdicts = _by_block(_answered(windows, window_parts, _earlier), "verdicts")
    return map_arrow(
        candidates.join(verdicts, "block", "left"),
        remove,
        "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string",
    )


def digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    n_removed = F.expr("aggregate(removed, 0L, (n, span) -> n + span.end - span.start)")
    return remove_repeats(docs, **settings).select(
        "doc_id",
        "n_words",
        n_removed.alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
