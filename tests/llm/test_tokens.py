"""Token counts, bit packing and merge-dropout against the libraries themselves."""

import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lyrascope.llm import bit_packing, bpe_counts, merge_dropout
from lyrascope.llm.shared import new_path
from tests.llm.data import by_id, documents, frame

PIECES = sentencepiece.SentencePieceProcessor(
    model_file=public_tokenizers.path("piece_bpe_32k.model")
)


def test_counts_are_the_librarys(spark):
    got = by_id(bpe_counts.count_tokens(frame(spark), limit=100))
    for doc_id, text, *_ in documents():
        text = text or ""
        n = len(PIECES.encode(text))
        row = got[doc_id]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (
            len(text.encode()),
            n,
            n > 100,
        )


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    packed = bit_packing.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (bit_packing.unpack(packed, bits, 0, 1001) == ids).all()
    assert (bit_packing.unpack(packed, bits, 333, 777) == ids[333:777]).all()


def test_files_have_the_librarys_ids_in_order(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = new_path(spark, "ids")
    bit_packing.write_ids(frame(spark), path)
    blocks = spark.read.parquet(path)
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in bit_packing.read_digests(blocks).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    assert sum(len(r["ids"]) for r in bit_packing.read_ids(blocks).collect()) == start


def test_no_documents_make_no_ids(spark):
    path = new_path(spark, "ids")
    bit_packing.write_ids(frame(spark, []), path)
    blocks = spark.read.schema(bit_packing.BLOCK).parquet(path)
    assert bit_packing.read_digests(blocks).count() == 0
    assert bpe_counts.count_tokens(frame(spark, [])).count() == 0
    assert merge_dropout.digests(frame(spark, [])).count() == 0


def test_without_dropout_the_ids_are_the_librarys():
    texts = [t or "" for _, t, *_ in documents() if "▁" not in (t or "")]
    ids, counts = merge_dropout.encode_texts(pa.array(texts), np.arange(len(texts)), dropout=0.0)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == PIECES.encode(text)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_every_segmentation_decodes_to_its_text(spark, dropout):
    coded = merge_dropout.encode_documents(frame(spark), dropout=dropout)
    got = by_id(merge_dropout.decode_documents(coded))
    for doc_id, text, *_ in documents():
        assert got[doc_id]["text"] == (text or "")
    assert all(r["lossless"] for r in merge_dropout.digests(frame(spark), dropout=dropout).collect())


def test_segmentations_vary_by_document_and_come_back_for_their_seed():
    texts = pa.array(["some words that are split in several ways " * 20] * 2)
    keys = np.array([1, 2])
    one, counts = merge_dropout.encode_texts(texts, keys, dropout=0.3)
    again, _ = merge_dropout.encode_texts(texts, keys, dropout=0.3)
    other, _ = merge_dropout.encode_texts(texts, keys, seed=2, dropout=0.3)
    assert one.tolist() == again.tolist() != other.tolist()
    assert one[: counts[0]].tolist() != one[counts[0] :].tolist()


def skipped_merges(symbols, own, dropout, vocabulary):
    """One merge after the other: the best-ranked pair left, the first of equal ones."""
    parts = [(i, s) for i, s in enumerate(symbols)]
    while True:
        best = None
        for k in range(len(parts) - 1):
            (place, a), (_, b) = parts[k], parts[k + 1]
            piece = vocabulary.merges.get(a << 32 | b)
            if piece is None or merge_dropout.draw_one(own, place, piece) < dropout:
                continue
            rank = (int(vocabulary.order[piece]), place)
            if best is None or rank < best[0]:
                best = rank, k, piece
        if best is None:
            return [s for _, s in parts]
        _, k, piece = best
        parts[k : k + 2] = [(parts[k][0], piece)]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_skipped_merges_equal_a_plain_loop(monkeypatch, dropout):
    own = merge_dropout.vocabulary(merge_dropout.MODEL)
    texts = [" internationalization", " é日本 x", " " + "ab" * 40, " " + "thethe" * 25, " a", "q" * 90]
    distinct = pa.array([t.encode() for t in texts], pa.large_binary())
    codes = np.repeat(np.arange(len(texts)), 3)
    variants = np.tile(np.arange(3), len(texts))
    made = {}
    for long in (0, 64, 1 << 20):
        monkeypatch.setattr(merge_dropout, "LONG", long)
        lengths, values = own.segment(distinct, codes, variants, 5, dropout)
        made[long] = lengths.tolist(), values.tolist()
    assert made[0] == made[64] == made[1 << 20]
    offsets, first = own.symbols(distinct)
    names = [zlib.crc32(t.encode()) for t in texts]
    expected = []
    for code, variant in zip(codes.tolist(), variants.tolist()):
        key = np.array([names[code] << 20 ^ 5 << 8 ^ variant], np.uint64)
        drawn = int(merge_dropout.mix(key)[0])
        symbols = first[offsets[code] : offsets[code + 1]].tolist()
        expected += skipped_merges(symbols, drawn, dropout, own)
    assert made[64][1] == expected


def test_a_long_unspaced_text_is_encoded_in_time():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("etaoinshr"), 200_000))
    start = time.perf_counter()
    ids, counts = merge_dropout.encode_texts(pa.array([text]), np.array([1]))
    assert time.perf_counter() - start < 30
    data, _ = merge_dropout.vocabulary(merge_dropout.MODEL).decode(ids, counts)
    assert data.tobytes().decode() == text
