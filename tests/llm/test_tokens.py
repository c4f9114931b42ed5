"""BPE encoding and decoding, and packing, against the tokenizers library and exact accounting."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from messy_rows import ROWS
from tokenizers import Tokenizer

from reelgrid.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdefgh  '\n\t.,!0129éñüß漢字Ωж́\x1c\x85²½ABÉİΣ\xa0<|>"
    out = []
    for _ in range(n):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        t += "<|endoftext|>" * (rng.random() < 0.1) + "aaaaaaa" * rng.randint(0, 40) * (rng.random() < 0.1) + "'re don't" * (rng.random() < 0.1)
        out.append(t)
    return out


def test_encoder_equals_library(library):
    voc = bpe.Vocabulary(BYTES)
    for t in [*texts(3000, 1), "", "x" * 100_000, " ".join(f"w{i}" for i in range(5000))]:
        assert voc.encode([t])[0].tolist() == library[BYTES].encode(t, add_special_tokens=False).ids


def test_every_code_point_splits_as_the_library_does(library):
    voc = bpe.Vocabulary(BYTES)
    points = [i for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    for i in points:
        t = f"a{chr(i)}b {chr(i)}  1{chr(i)}{chr(i)}.{chr(i)}"
        assert voc.encode([t])[0].tolist() == library[BYTES].encode(t, add_special_tokens=False).ids, hex(i)


def test_pairs_are_compatible_exactly_if_merging_keeps_them(library):
    voc = bpe.Vocabulary(BYTES)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50256, (2, 4000))
    fine = voc.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), fine.tolist()):
        assert (voc.merged(voc.text[x] + voc.text[y]) == [x, y]) == ok


def test_round_trip_of_messy_rows(messy, library):
    ids = bpe.encode_documents(messy, BYTES)
    back = bpe.decode_documents(ids, BYTES, keep=("n_tokens",))
    got = sorted(((r.doc_id or 0, r.text, r.n_tokens) for r in back.collect()))
    want = sorted((i or 0, t or "", len(library[BYTES].encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert got == want


def test_bytes_that_are_no_text(spark):
    ids = bpe.Vocabulary(BYTES).byte_id[[0xE4, 0x41]].astype("<u4").tobytes()
    rows = spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode_documents(rows, BYTES).collect()}
    assert got == {1: "\ufffdA", 2: None}


def test_empty_table(nothing):
    assert bpe.encode_documents(nothing, BYTES).count() == 0
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_pieces_equal_library(messy, library):
    got = {}
    for r in packing.token_pieces(messy, WORDS, 4096).filter("doc_id IS NOT NULL").collect():
        got.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, zlib.crc32(bytes(r.ids)))
    for i, t in ROWS:
        if i is not None:
            ids = np.array(library[WORDS].encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            cut = {k: ids[a : a + 4096] for k, a in enumerate(range(0, len(ids), 4096))}
            assert got[i] == {k: (k * 4096, len(c), zlib.crc32(c.tobytes())) for k, c in cut.items()}


def test_word_encoder_equals_library(library):
    pieces = packing.Pieces(WORDS)
    for t in texts(3000, 2):
        assert pieces.encode([t])[0].tolist() == library[WORDS].encode(t, add_special_tokens=False).ids, repr(t)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_messy_pieces_have_places(messy):
    rows = packing.pack_documents(messy, WORDS, capacity=64).collect()
    check_places(rows, 64)
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id == 6}) == max(r.piece for r in rows if r.doc_id == 6) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101 if seed else 11, 5000)
    if seed == 3:
        lengths[:2000] = 40
    histogram = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))))
    plan = packing.plan(histogram, 100)
    held = {}
    for times, pattern in plan:
        assert sum(pattern) <= 100 and times > 0
        for n in pattern:
            held[n] = held.get(n, 0) + times
    assert held == histogram
    least = -(-int(lengths.sum()) // 100)
    assert sum(t for t, _ in plan) <= (1.01 * least if seed < 3 else 1.1 * least)


def test_complements_of_one_two_and_three():
    counts = np.zeros(101, np.int64)
    counts[[30, 20, 25, 15]] = [1, 2, 2, 1]
    index = packing.SumIndex(counts)
    assert index.complement(30, 15) == (15,)
    assert index.complement(30, 40) == (25, 15)
    assert index.complement(30, 65) == (25, 25, 15)
    assert index.complement(30, 30) is None
    assert index.complement(20, 20) == (20,)


def test_hot_length_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 7)] * 3000 + [(i, 9) for i in range(500)] + [(None, 5)], "doc_id long, length long")
    got = packing.pack(rows, 64).collect()
    assert len(got) == 3501
    check_places(got, 64)


def test_wrong_lengths_raise(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 70)], "doc_id long, length long"), 64)


def test_digest_of_ids(spark, library):
    ids = bpe.encode_documents(frame_of(spark, "some text here"), BYTES).first().ids
    want = np.array(library[BYTES].encode("some text here", add_special_tokens=False).ids, "<u4").tobytes()
    assert hashlib.sha256(bytes(ids)).digest() == hashlib.sha256(want).digest()


def frame_of(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")
