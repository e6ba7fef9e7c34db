"""Token ids in fixed-width bit-packed blocks (operator 7).

File format: a Parquet folder, one file per range of doc_id, one row per block of whole
documents.  A row has the file's number, the block's number, ``first`` (ids of the file before
the block), the ids' width in bits, the documents' ids and token counts, whose running sums are
the documents' offsets, and ``payload``: all ids of the block, ``bits`` each, the lowest bit
first.  Any id of a block is found by arithmetic, and blocks are read alone.  Parquet is the
container so that Spark's commit protocol covers lost executors and any file system will do.
"""

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow
from lyrascope.llm.text import chunks, gather, sums, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

TOKENIZER = "word_bpe_49k.json"
END_ID = 2

# Words whose ids a Python worker keeps (about 150 bytes each).
KEPT = 800_000

# ASCII words that are coded in one call.
JOINED = 1000

BLOCK = (
    "file int, block int, first long, bits int, doc_ids array<long>, counts array<long>, "
    "payload binary"
)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits % 8 == 0:
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return raw[:, : bits // 8].tobytes()
    planes = (ids[:, None] >> np.arange(bits)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only their own bytes are looked at."""
    n = stop - start
    low, high = start * bits // 8, -(-stop * bits // 8)
    raw = np.frombuffer(payload, np.uint8, high - low, low)
    if bits % 8 == 0:
        ids = np.zeros((n, 4), np.uint8)
        ids[:, : bits // 8] = raw.reshape(n, bits // 8)
        return ids.view("<u4").ravel()
    skip = start * bits - low * 8
    planes = np.unpackbits(raw, bitorder="little")[skip : skip + n * bits].reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class WordEncoder:
    """Ids of words that are coded alone, with ``before`` in front of each.

    That gives the ids of whole texts for tokenizers that drop white space.
    """

    def __init__(self, name: str, before: str = ""):
        self.before = before
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # The ids of a tokenizer may have gaps; the width follows from the largest one.
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.size = largest + 1
        self.bits = int(largest).bit_length()
        self._forget()

    def _forget(self) -> None:
        # A word's number, and by number the places of its ids in one long list.
        self.known: dict[bytes, int] = {}
        self.starts, self.values = array("q", [0]), array("i")

    def ids(self, distinct: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with the given codes, and the number of ids of each."""
        raw = distinct.to_pylist()
        if len(self.values) > 4 * KEPT:
            self._forget()
        self._learn([w for w in raw if w not in self.known])
        number = np.array([self.known[w] for w in raw], np.int64)
        # The lists grow later on, so they are copied.
        return gather(np.array(self.starts), np.array(self.values), number[codes])

    def _learn(self, new: list[bytes]) -> None:
        """Add the ids of new words; those in ASCII are coded many at a time.

        Set apart by spaces they are coded like alone, and a token's place tells its word.
        """
        plain = [w for w in new if w.isascii()]
        other = [w for w in new if not w.isascii()]
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            coded = self.tokenizer.encode(" " + b" ".join(part).decode(), add_special_tokens=False)
            # A word begins with the space before it.
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            places = np.array([begin for begin, _ in coded.offsets], np.int64)
            ends = np.searchsorted(places, starts[1:], "left")
            self._add(part, coded.ids, ends)
        made = self.tokenizer.encode_batch_fast(
            [self.before + w.decode() for w in other], add_special_tokens=False
        )
        lists = [coded.ids for coded in made]
        self._add(other, [i for ids in lists for i in ids], np.cumsum([len(ids) for ids in lists]))

    def _add(self, new: list[bytes], ids: list[int], ends: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts.extend((ends + len(self.values)).astype(np.int64).tolist())
        self.values.extend(ids)

    @property
    def cut(self) -> np.ndarray:
        """Where words may be cut: the tokenizer always parts a letter from these signs."""
        cut = np.zeros((256, 256), bool)
        letters = [*range(65, 91), *range(97, 123)]
        cut[np.ix_(letters, [ord(c) for c in ".,:;!?#$%&*()"])] = True
        return cut


@cache
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


def encode_texts(texts: pa.Array, encoder: WordEncoder, end_id: int):
    """Ids of all texts, each with the end id, and the number of ids of each text."""
    found = words(texts, cut=encoder.cut)
    ids, lengths = encoder.ids(found.distinct, found.codes)
    counts = sums(lengths, found.offsets)
    ids = np.insert(ids, np.cumsum(counts), end_id)
    return ids, counts + 1


def write_ids(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID
) -> None:
    """Write the ids of documents (doc_id, text) to ``path`` in ascending doc_id order.

    NULL doc_ids come first, rows of one doc_id by text; a NULL or empty text is the end id
    alone; other columns are left out.  Texts are shuffled once, by ranges of doc_id.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = word_encoder(tokenizer), 0
        file = TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            ids, counts = encode_texts(chunk.column("text"), encoder, end_id)
            row = {
                "file": file,
                "block": number,
                "first": first,
                "bits": encoder.bits,
                "doc_ids": chunk.column("doc_id").to_pylist(),
                "counts": counts.tolist(),
                "payload": pack(ids, encoder.bits),
            }
            first += len(ids)
            yield pa.RecordBatch.from_pylist([row], SCHEMA)

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    map_arrow(ordered, blocks, BLOCK).write.parquet(path)


SCHEMA = pa.schema(
    [
        ("file", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.cumsum(row["counts"])
            starts = ends - row["counts"]
            ids = unpack(row["payload"], row["bits"], 0, int(ends[-1])).astype("<u4")
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([row["file"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["first"], pa.int64()),
                    "n_tokens": pa.array(row["counts"], pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)],
                        pa.int64(),
                    ),
                }
            )


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in files of ``write_ids``."""
    in_block = F.expr("aggregate(counts, 0L, (total, n) -> total + n)")
    totals = blocks.groupBy("file").agg(F.sum(in_block).alias("n"))
    # One row per file, so the running sum is over few rows.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = map_arrow(
        blocks, _digests, "file int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return read.join(bases, "file").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id and ids of every document, unpacked in numpy block by block."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, sum(row["counts"]))
                offsets = pa.array(np.r_[0, np.cumsum(row["counts"])], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"]
                )

    return map_arrow(blocks, documents, "doc_id long, ids array<int>")
