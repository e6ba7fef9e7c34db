"""SentencePiece encoding with seeded merge-dropout, and decoding (operator 6).

A text is encoded by merging the best-ranked adjacent pair again and again, but every candidate
merge is skipped if a keyed hash of seed, variant, segment, place and pieces falls below the
dropout rate.  So one text has many segmentations, each of which comes back for its key, and
all decode to the text itself.  Every occurrence of a segment gets one of VARIANTS variants by
a hash of the document and the segment's place in it.

The agenda is worked off for many distinct segments at once: each round takes the best
candidate of every segment.  A long segment has an agenda of its own, a heap over a linked list
of its symbols.  Characters without a piece, and the sign that stands for a space,
are spelt in byte pieces.
"""

import heapq
import zlib
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.bpe_counts import MARK, MODEL, merger, segments
from lyrascope.llm.odd_sketch import mix
from lyrascope.llm.shared import map_arrow
from lyrascope.llm.text import binary, flat, gather, map_chunks, sums

DROPOUT = 0.1
SEED = 1
VARIANTS = 16

# Segments of more symbols have a heap of their own.
LONG = 64

# Rank of a pair that is not merged.
NEVER = np.int32(2**31 - 1)


def draw(own: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for the merge into a piece at a place of a keyed segment."""
    at = own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = mix(at ^ piece.astype(np.uint64) << np.uint64(40))
    return (drawn >> np.uint64(11)) * 2.0**-53


def draw_one(own: int, place: int, piece: int) -> float:
    """``draw`` of single integers."""
    x = (own + place * 0x9E3779B97F4A7C15 & MASK) ^ (piece << 40 & MASK)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return ((x ^ x >> 31) >> 11) * 2.0**-53


MASK = (1 << 64) - 1


class Vocabulary:
    """Piece ids, bytes and pair merges of a sentencepiece BPE vocabulary."""

    def __init__(self, model: str):
        pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = pieces.get_piece_size()
        self.rank = merger(model).rank
        self.joined = merger(model).joined
        names = [pieces.id_to_piece(i) for i in range(n)]
        self.id = {names[i]: i for i in range(n) if names[i] in self.rank}
        self.byte = np.array([pieces.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        spelt = [name.replace(MARK, " ").encode() if name in self.rank else b"" for name in names]
        for b, i in enumerate(self.byte.tolist()):
            spelt[i] = bytes([b])
        self.spelt_offsets = np.r_[0, np.cumsum([len(s) for s in spelt])]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        # Single characters: pieces by code point, others beyond the ids, spelt in bytes.
        self.beyond = n
        # All ways to merge two pieces or characters into a piece.
        pairs = [
            (piece[:k], piece[k:], i)
            for piece, i in self.id.items()
            for k in range(1, len(piece))
            if self._symbol(piece[:k]) is not None and self._symbol(piece[k:]) is not None
        ]
        key = np.array(
            [self._symbol(a) << 32 | self._symbol(b) for a, b, _ in pairs], np.uint64
        )
        self.merged = np.array([i for _, _, i in pairs], np.int32)
        self.order = np.zeros(n, np.int32)
        self.order[list(self.id.values())] = [self.rank[piece] for piece in self.id]
        self._place(key)

    def _symbol(self, text: str) -> int | None:
        """Number of a piece, or of a character that is none."""
        if text in self.id:
            return self.id[text]
        return self.beyond + ord(text) if len(text) == 1 else None

    def _place(self, key: np.ndarray) -> None:
        """Open-addressed table of the pairs, with linear steps."""
        bits = int(len(key) * 4).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + 64, np.uint64)
        self.pair = np.full(len(self.keys), -1, np.int32)
        home = (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        self.steps = 0
        for k, h in enumerate(home.tolist()):
            start = h
            while self.pair[h] >= 0:
                h += 1
            self.keys[h], self.pair[h] = key[k], k
            self.steps = max(self.steps, h - start + 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two symbols merge into, -1 if none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        made = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.steps):
            pair = self.pair[at[open_]]
            hit = (pair >= 0) & (self.keys[at[open_]] == key[open_])
            made[open_[hit]] = self.merged[pair[hit]]
            open_ = open_[(pair >= 0) & ~hit]
            if not len(open_):
                break
            at[open_] += 1
        return made

    def symbols(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and first symbols (characters) of segments."""
        places, data = flat(distinct)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        known, index = np.unique(points, return_inverse=True)
        # A space is the sign for it; the sign itself in a text is spelt in bytes.
        table = np.array(
            [
                self.id[MARK]
                if c == 0x20
                else self.beyond + c
                if chr(c) == MARK or chr(c) not in self.id
                else self.id[chr(c)]
                for c in known.tolist()
            ],
            np.int64,
        )
        sizes = sums((data & 0xC0 != 0x80).astype(np.int64), places)
        return np.r_[0, np.cumsum(sizes)], table[index]

    def segment(self, distinct: pa.Array, codes, variants, seed: int, dropout: float):
        """Symbols left of segments (by code and variant) after all merges: lengths, values."""
        offsets, first = self.symbols(distinct)
        names = np.array([zlib.crc32(w) for w in distinct.to_pylist()], np.uint64)
        key = names[codes] << np.uint64(20) ^ np.uint64(seed << 8) ^ variants.astype(np.uint64)
        own = mix(key)
        sizes = np.diff(offsets)[codes]
        lengths = np.zeros(len(codes), np.int64)
        made_rows, made_values = [], []
        # Rows of about one width are merged together.
        width = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w > LONG:
                for row in rows.tolist():
                    own_symbols = first[offsets[codes[row]] : offsets[codes[row] + 1]]
                    left = self._merge_long(own_symbols, own[row], dropout)
                    lengths[row] = len(left)
                    made_rows.append(np.array([row]))
                    made_values.append(left)
                continue
            for part in np.array_split(rows, max(1, len(rows) * int(w) // 2_000_000)):
                left = self._merge(offsets, first, codes[part], own[part], int(w), dropout)
                n = (left >= 0).sum(1)
                lengths[part] = n
                made_rows.append(part)
                made_values.append(left[left >= 0])
        rows = np.concatenate([*made_rows, np.empty(0, np.int64)]).astype(np.int64)
        values = np.concatenate([*made_values, np.empty(0, np.int64)])
        # Back into the order of the rows.
        starts = np.zeros(len(codes), np.int64)
        starts[rows] = np.r_[0, np.cumsum(lengths[rows])[:-1]] if len(rows) else 0
        ends = np.cumsum(lengths)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(
            starts - (ends - lengths), lengths
        )
        return lengths, values[index]

    def _merge(self, offsets, first, codes, own, width: int, dropout: float) -> np.ndarray:
        n = len(codes)
        sizes = np.diff(offsets)[codes]
        column = np.arange(width)
        inside = column < sizes[:, None]
        symbol = np.full((n, width), -1, np.int64)
        symbol[inside] = first[(offsets[:-1][codes][:, None] + column)[inside]]
        start = np.where(inside, column, 0)
        rank = np.full((n, width), NEVER, np.int32)
        into = np.full((n, width), -1, np.int32)

        def candidates(r, c):
            """Pieces and ranks of the pairs at row r and columns c, c + 1."""
            a, b = symbol[r, c], symbol[r, c + 1]
            found = self.find(a, b)
            share = draw(own[r], start[r, c], found)
            fine = (found >= 0) & (share >= dropout)
            into[r, c] = found
            rank[r, c] = np.where(fine, self.order[found], NEVER)

        if width > 1:
            candidates(*np.nonzero(inside[:, 1:]))
        alive = np.arange(n)
        while len(alive):
            best = rank[alive].argmin(1)
            going = rank[alive, best] < NEVER
            alive, best = alive[going], best[going]
            if not len(alive):
                break
            symbol[alive, best] = into[alive, best]
            # Close the gap after the merged pair.
            source = column + (column > best[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            for table, empty in ((symbol, -1), (start, 0), (rank, NEVER), (into, -1)):
                moved = np.take_along_axis(table[alive], np.minimum(source, width - 1), 1)
                moved[:, -1] = empty
                table[alive] = moved
            rank[alive, best] = NEVER
            has_next = (best + 1 < width) & (symbol[alive, np.minimum(best + 1, width - 1)] >= 0)
            candidates(alive[has_next], best[has_next])
            has_before = best > 0
            candidates(alive[has_before], best[has_before] - 1)
        return symbol

    @cached_property
    def merges(self) -> dict[int, int]:
        """The piece that two symbols merge into, by both numbers in one."""
        used = self.pair >= 0
        return dict(zip(self.keys[used].tolist(), self.merged[self.pair[used]].tolist(), strict=True))

    def _merge_long(self, first: np.ndarray, own: np.uint64, dropout: float) -> np.ndarray:
        """Symbols left of one segment, by a heap of candidates over a linked list of symbols."""
        n = len(first)
        merges, order, symbol = self.merges, self.order, first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.find(first[:-1], first[1:])
        places = np.arange(n - 1)
        fine = (found >= 0) & (draw(np.full(n - 1, own), places, found) >= dropout)
        agenda = [
            (rank, i, i + 1, piece)
            for rank, i, piece in zip(
                order[found[fine]].tolist(), places[fine].tolist(), found[fine].tolist(), strict=True
            )
        ]
        heapq.heapify(agenda)

        def offer(i: int) -> None:
            j = after[i]
            piece = merges.get(symbol[i] << 32 | symbol[j])
            if piece is not None and draw_one(int(own), i, piece) >= dropout:
                heapq.heappush(agenda, (int(order[piece]), i, j, piece))

        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            # Void once one of its symbols has been merged with another.
            if symbol[i] < 0 or after[i] != j or merges.get(symbol[i] << 32 | symbol[j]) != piece:
                continue
            symbol[i], symbol[j] = piece, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s in symbol if s >= 0], np.int64)

    def ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, those without a piece in bytes; and the number of ids of each."""
        lengths = np.ones(len(symbols), np.int64)
        strange = symbols >= self.beyond
        if not strange.any():
            return symbols, lengths
        raw = [chr(c).encode() for c in (symbols[strange] - self.beyond).tolist()]
        lengths[strange] = [len(r) for r in raw]
        ids = np.repeat(symbols, lengths)
        spelt = np.frombuffer(b"".join(raw), np.uint8)
        ids[np.repeat(strange, lengths)] = self.byte[spelt]
        return ids, lengths

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts that the ids spell, and the number of bytes of each.

        The space that encoding puts before a text is taken off.
        """
        data, lengths = gather(self.spelt_offsets, self.spelt, ids)
        sizes = sums(lengths, np.r_[0, np.cumsum(counts)])
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        return np.delete(data, begin), np.maximum(sizes - 1, 0)


@cache
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def encode_texts(texts: pa.Array, keys: np.ndarray, model=MODEL, seed=SEED, dropout=DROPOUT):
    """Ids of all texts one after the other and the number of ids of each.

    ``keys`` is a number per text that, with the seed, decides the merges that are skipped.
    """
    own = vocabulary(model)
    found = segments(texts, own.joined)
    place = np.arange(len(found.codes)) - np.repeat(found.offsets[:-1], np.diff(found.offsets))
    drawn = mix(
        keys.astype(np.int64).view(np.uint64)[found.owner] * np.uint64(0x9E3779B97F4A7C15)
        + place.astype(np.uint64)
    )
    variant = (drawn % np.uint64(VARIANTS)).astype(np.int64)
    distinct, index = np.unique(found.codes * VARIANTS + variant, return_inverse=True)
    lengths, symbols = own.segment(
        found.distinct, distinct // VARIANTS, distinct % VARIANTS, seed, dropout
    )
    ids, spelt = own.ids(symbols)
    sizes = sums(spelt, np.r_[0, np.cumsum(lengths)])
    values, counts = gather(np.r_[0, np.cumsum(sizes)], ids, index)
    return values, sums(counts, found.offsets)


def encode_documents(
    docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT
) -> DataFrame:
    """doc_id and ids (array<int>) of documents (doc_id, text), in one narrow map.

    NULL and empty texts have no ids; a NULL doc_id is a key like any other; rows of one doc_id
    and text get equal ids; further columns are left out.
    """

    def encode(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(chunk.column("text"), "")
        keys = pc.fill_null(chunk.column("doc_id"), -1).to_numpy()
        ids, counts = encode_texts(texts, keys, model, seed, dropout)
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
            ],
            ["doc_id", "ids"],
        )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(texts, map_chunks(encode), "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids)."""

    def decode(batches):
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            data, sizes = vocabulary(model).decode(lists.flatten().to_numpy(), counts)
            texts = binary(sizes, data).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return map_arrow(coded.select("doc_id", "ids"), decode, "doc_id long, text string")


def digests(
    docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT
) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and lossless of documents.

    ``lossless`` tells whether the decoded bytes are the text's; the cases are those of
    ``encode_documents``.
    """

    def digest(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(chunk.column("text"), "")
        keys = pc.fill_null(chunk.column("doc_id"), -1).to_numpy()
        ids, counts = encode_texts(texts, keys, model, seed, dropout)
        data, sizes = vocabulary(model).decode(ids, counts)
        offsets, raw = flat(texts)
        if len(data) == len(raw):
            # Where a text's bytes differ, or the texts do not start at the same place.
            wrong = sums((data != raw).astype(np.int64), offsets) + (sizes != np.diff(offsets))
        else:
            wrong = (sizes != np.diff(offsets)).astype(np.int64)
        ends = np.cumsum(counts)
        little = ids.astype("<u4")
        places = zip((ends - counts).tolist(), ends.tolist(), strict=True)
        crc = [zlib.crc32(little[a:b]) for a, b in places]
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(wrong == 0),
            ],
            ["doc_id", "n_tokens", "ids_crc32", "lossless"],
        )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    spec = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean"
    return map_arrow(texts, map_chunks(digest), spec)
