"""Packing and binary output against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import binary, coder, packing
from lectern.llm.tokens import Encoder, encoder
from lectern.session import checkpointed
from tests.llm.conftest import odd_rows

FILES = [("word_bpe_49k.json", True, 1), ("byte_bpe_50k.json", False, 0)]


def plain(file, end, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    tokenizer.encode_special_tokens = True
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("file,drops,end", FILES)
def test_ids_are_those_of_the_library(file, drops, end):
    rng = random.Random(7)
    parts = ["a", "B", "é", " ", "\n", "'s", "1", "!", "ß", "\t", "中", "\u2009", "\u0301", "<|", "|>", "  ", "word", "<|endoftext|>"]
    texts = [r.text for r in odd_rows()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    got = encoder(file, drops).batch(texts, end)
    assert [g.tolist() for g in got] == plain(file, end, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_of_any_text(texts):
    for file, drops, end in FILES:
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        assert [g.tolist() for g in encoder(file, drops).batch(texts, end)] == plain(file, end, texts)


def test_differencing_fills_windows():
    rng = np.random.default_rng(3)
    lengths = np.append(rng.integers(1, 512, 3000), [2048, 2048])
    window, offset = packing.pack_group(lengths, 2048)
    loads = np.bincount(window, weights=lengths)
    assert loads.max() <= 2048 and loads.mean() > 0.99 * 2048
    for w in range(len(loads)):
        at = np.flatnonzero(window == w)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.cumsum(lengths[at]) - lengths[at]).all()


def test_window_count_rises_when_capacity_is_exceeded():
    window, _ = packing.pack_group(np.array([6, 6, 6]), 10)
    assert len(set(window)) == 3


def test_pack_odd_rows(odd):
    got = [tuple(r) for r in packing.pack_documents(odd).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    rows = odd.collect()
    ids = plain(*FILES[0][::2], [r.text for r in rows])
    assert sum(g[2] for g in got) == sum(map(len, ids))
    by_doc = {(r.doc_id, len(i)): np.array(i, "<u4") for r, i in zip(rows, ids, strict=True)}
    for doc, start, length, crc, total, _, _ in got:
        assert zlib.crc32(by_doc[doc, total][start : start + length].tobytes()) == crc
    ends = {}
    for *_, length, _, _, seq, offset in sorted(got, key=lambda g: (g[5], g[6])):
        assert offset == ends.get(seq, 0)
        ends[seq] = offset + length
    assert max(ends.values()) <= 2048


def test_pack_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_sequences_hold_the_ids(odd):
    docs = checkpointed(odd.where("doc_id is not null and doc_id <> 9"))
    placed = checkpointed(packing.pack_documents(docs))
    got = sum(sorted(len(r.ids) for r in packing.sequences(docs, placed).collect()))
    assert got == placed.agg({"length": "sum"}).first()[0]


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for blocks in ([], [np.array([], int)], [rng.integers(0, 65536, n) for n in (1, 5, 700, 2, 0, 77)], [np.zeros(900, int), np.full(300, 65535), np.tile([1, 2, 3], 400)], [np.minimum(rng.geometric(0.02, 3000), 65535)]):
        found = coder.decode(coder.encode(blocks), [len(b) for b in blocks])
        assert all(np.array_equal(a, b) for a, b in zip(blocks, found, strict=True))


def test_coder_compresses_what_repeats():
    block = np.tile(np.random.default_rng(2).integers(0, 50_000, 64), 32)
    assert len(coder.encode([block])[0]) < len(block)


def test_coder_narrows_once_an_id(monkeypatch):
    """However an id is coded, its lane's range is narrowed once (up to six times before)."""
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.geometric(0.02, n), 65535) for n in (300, 200, 7)]
    steps = []
    for kind in (coder._Writer, coder._Reader):
        monkeypatch.setattr(kind, "narrow", lambda self, start, size, plain=kind.narrow: (steps.append(len(size)), plain(self, start, size)))
    found = coder.decode(coder.encode(blocks), [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, found, strict=True)) and sum(steps) == 2 * 507


def test_blocks_decode_in_other_company():
    """A block's payload does not depend on the blocks coded beside it, nor does reading it."""
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.3, n).clip(1, 65535) for n in (2048, 40, 2048, 1, 0, 900)]
    payloads = coder.encode(blocks)
    assert payloads == [coder.encode([b])[0] for b in blocks]
    assert all(np.array_equal(coder.decode([p], [len(b)])[0], b) for p, b in zip(payloads, blocks, strict=True))


def test_coder_on_text(spark):
    """Bytes an id of real text in blocks of 2,048."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    ids = np.concatenate(encoder(FILES[1][0]).batch(texts, 0))
    blocks = [ids[i : i + 2048] for i in range(0, len(ids) - 2047, 2048)]
    assert sum(map(len, coder.encode(blocks))) < 1.12 * 2048 * len(blocks)


def test_marks_after_a_word_are_words_of_their_own():
    enc = Encoder(public_tokenizers.path(FILES[1][0]), False)
    texts = [" ".join(f"{w}{m}" for w in ("one", "two", "three", "four")) for m in ("", ".", ",", "!!", "'s", "...", "$%")]
    assert [g.tolist() for g in enc.batch(texts, 0)] == plain(*FILES[1][::2], texts)
    assert len(enc.keys) <= 2 * 4 + 6


def test_joined_crc():
    a, b = b"left part" * 99, b"and the right" * 1001
    assert binary.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_binary_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(binary, "LANES", 8)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.start) for r in binary.round_trip(odd).collect()))
    rows = odd.collect()
    ids = plain(*FILES[1][::2], [r.text for r in rows])
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids, strict=True))
    assert [g[:4] for g in got] == want
    starts = sorted((g[4], g[2]) for g in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert [g[1] for g in sorted(got, key=lambda g: g[4])] == sorted(g[1] for g in got)


def test_binary_files_and_pieces(spark, odd, tmp_path):
    binary.write_ids(odd, str(tmp_path / "ids"))
    stored = binary.read_blocks(spark, str(tmp_path / "ids"))
    n = sum(len(r.ids) for r in binary.pieces(stored).collect())
    assert n == sum(map(len, plain(*FILES[1][::2], [r.text for r in odd.collect()])))


def test_binary_format_is_that_of_any_size(spark):
    """Blocks hold 2,048 ids but for the last of a part, however small the part; recurring ids take far less than two bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    stored = binary.blocks(docs.coalesce(1)).collect()
    last = {}
    for r in stored:
        last[r.part] = max(last.get(r.part, 0), r.block)
    assert all(r.n_ids == binary.BLOCK for r in stored if r.block < last[r.part]) and all(0 < r.n_ids <= binary.BLOCK for r in stored)
    assert sum(len(r.payload) for r in stored) < 1.7 * sum(r.n_ids for r in stored)


def test_binary_nothing(none):
    assert binary.round_trip(none).count() == 0


def test_wrong_checksum_is_found(spark, odd):
    broken = binary.blocks(odd).selectExpr("part", "block", "n_ids", "crc32 + 1 AS crc32", "payload", "docs")
    with pytest.raises(Exception, match="checksum"):
        binary.document_digests(broken).collect()
