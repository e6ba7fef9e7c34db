"""Token counts by heap-and-linked-list byte-pair merging (operator 10).

A text's count is its number of initial symbols minus its merges, plus the further bytes of
symbols that the vocabulary lacks; no identifier is made.  Two characters that stand side by
side in no piece can never be merged together, so a text falls apart between them into
segments that merge on their own, and each distinct segment is merged once per chunk.
"""

import heapq
from functools import cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow
from lyrascope.llm.text import Words, encode, flat, map_chunks, sums

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"

# Segments whose counts a Python worker keeps (about 100 bytes each).
KEPT = 1_000_000


class Merger:
    """Merge ranks of a sentencepiece BPE vocabulary and counts by merging."""

    def __init__(self, model: str):
        pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        ids = [
            i
            for i in range(pieces.get_piece_size())
            if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i))
        ]
        self.rank = {pieces.id_to_piece(i): round(-pieces.get_score(i)) for i in ids}
        # By bytes, whether a piece may hold both side by side.  Bytes of characters beyond
        # ASCII are taken to be joined, but for the space after them if no piece has it.
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        spelt = [piece.replace(MARK, " ") for piece in self.rank]
        for a, b in {pair for piece in spelt for pair in pairwise(piece)}:
            if max(a, b) < "\x80":
                self.joined[ord(a), ord(b)] = True
        for single in " \n":
            if not any(single in piece.lstrip(" ") for piece in spelt):
                self.joined[128:, ord(single)] = False
        self.known: dict[bytes, int] = {}

    def count(self, segment: str) -> int:
        """Tokens of one segment: pop the best adjacent pair until none is left."""
        rank, n = self.rank.get, len(segment)
        bits = n.bit_length()
        mask, wide = (1 << bits) - 1, 2 * bits
        # An agenda entry is one integer: rank, start, stop.  It is void once its symbols have
        # been merged with others, that is if no two symbols span just start to stop.
        agenda = []
        for i in range(n - 1):
            r = rank(segment[i : i + 2])
            if r is not None:
                agenda.append(r << wide | i << bits | i + 2)
        end = list(range(1, n + 2))  # end of the symbol that starts here, 0 once merged away
        before = list(range(-1, n))  # start of the symbol before the one that starts here
        heapq.heapify(agenda)
        merges = 0
        while agenda:
            entry = heappop(agenda)
            start, stop = entry >> bits & mask, entry & mask
            middle = end[start]
            if not middle or middle >= stop or end[middle] != stop:
                continue
            merges += 1
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                r = rank(segment[start : end[stop]])
                if r is not None:
                    heappush(agenda, r << wide | start << bits | end[stop])
            left = before[start]
            if left >= 0:
                r = rank(segment[left:stop])
                if r is not None:
                    heappush(agenda, r << wide | left << bits | stop)
        if merges == n - 1:
            return 1
        # A symbol that is no piece is spelt in bytes.
        spelt = sum(
            len(c.encode()) - 1
            for i, c in enumerate(segment)
            if end[i] == i + 1 and c not in self.rank
        )
        return n - merges + spelt

    def counts(self, segments: pa.Array) -> np.ndarray:
        known, made = self.known, np.empty(len(segments), np.int64)
        if len(known) > KEPT:
            known.clear()
        for i, raw in enumerate(segments.to_pylist()):
            n = known.get(raw)
            if n is None:
                n = self.count(raw.decode().replace(" ", MARK))
                if len(raw) < 64:
                    known[raw] = n
            made[i] = n
        return made


@cache
def merger(model: str) -> Merger:
    return Merger(model)


def segments(texts: pa.Array, joined: np.ndarray) -> Words:
    """Segments of every text, cut where no piece joins two bytes."""
    # The library puts a space before every text that is not empty.
    full = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    offsets, data = flat(full)
    first = np.ones(len(data), bool)
    first[1:] = ~joined[data[:-1], data[1:]]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    return encode(offsets, starts, np.diff(np.r_[starts, len(data)]), data)


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of documents (doc_id, text).

    One narrow map without a shuffle.  NULL and empty texts have 0 bytes and tokens, a NULL
    doc_id stays, repeated rows are counted each, further columns are left out.
    """

    def count(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(chunk.column("text"), "")
        own = merger(model)
        found = segments(texts, own.joined)
        each = own.counts(found.distinct)
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                pc.binary_length(texts).cast(pa.int64()),
                pa.array(sums(each[found.codes], found.offsets)),
            ],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text"),
        map_chunks(count),
        "doc_id long, n_bytes long, n_tokens long",
    ).withColumn("over_limit", F.col("n_tokens") > limit)
