"""Token counts, word BPE and token files against the tokenizers library."""

import lzma
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from custlens.llm import queries, range_coder, token_files, tokens, word_bpe

from .conftest import SF

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)

TEXTS = st.text(st.sampled_from(list("abzAZ09'’ \t\n\r\x0b\x0c\x1c\x85  éÉßΣςİǅñ́日😀<|>_-.,!")) | st.characters(codec="utf-8"),
                max_size=60)
SPECIAL = st.lists(TEXTS | st.sampled_from(["<|endoftext|>", "<|startoftext|>", " don't I'LL we've", "   "]), max_size=5).map("".join)


def byte_ids(text):
    return BYTE_LIB.encode(text or "", add_special_tokens=False).ids


def word_ids(text):
    return WORD_LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(SPECIAL, max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(BYTE, False).encode(texts)]
    assert got == [byte_ids(t) for t in texts]
    assert list(tokens.encoder(BYTE, True).encode(texts)) == [len(x) for x in got]


@settings(max_examples=300, deadline=None)
@given(st.lists(SPECIAL, max_size=4))
def test_word_bpe_is_the_library_both_ways(texts):
    codec = word_bpe.codec(WORD)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == word_ids(t)
        assert codec.decode(ids).decode() == WORD_LIB.decode(word_ids(t), skip_special_tokens=False)


def test_word_bpe_on_every_character():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars[i:i + 50]) + " " + " ".join(chars[i:i + 50]) for i in range(0, len(chars), 50)]
    lib = WORD_LIB.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.frombuffer(x, "<u4").tolist() == e.ids for x, e in zip(word_bpe.codec(WORD).encode(texts), lib, strict=True))


@pytest.mark.parametrize("limit", [1, 700])
def test_memory_of_pieces_is_bounded(monkeypatch, limit):
    monkeypatch.setattr(tokens, "KEPT_CHARS", limit)
    monkeypatch.setattr(word_bpe, "KEPT_WORDS", limit)
    texts = [f"w{i} x{i} y{i % 3} " + "z" * (i % 90) for i in range(300)]
    for _ in range(3):
        enc = tokens.PieceEncoder(BYTE, True)
        assert [n for t in texts for n in enc.encode([t])] == [len(byte_ids(t)) for t in texts]
        assert enc.chars <= limit + max(map(len, texts))
        c = word_bpe.codec(WORD)
        assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in c.encode([t])] == [word_ids(t) for t in texts]
        assert len(c.known) + len(c.by_word) <= limit + 20


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = tokens.token_counts(odd_docs, BYTE, 6).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(byte_ids(r.text)), len(byte_ids(r.text)) > 6) for r in odd_docs.collect()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert tokens.token_counts(no_docs, BYTE, 6).collect() == []


def test_round_trip_of_odd_rows(odd_docs, no_docs):
    got = word_bpe.round_trip(odd_docs, WORD).collect()
    want = []
    for r in odd_docs.collect():
        ids = word_ids(r.text)
        want.append((r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     sha256(WORD_LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert word_bpe.round_trip(no_docs, WORD).collect() == []
    back = word_bpe.decode_documents(word_bpe.encode_documents(odd_docs, WORD), WORD)
    assert sorted(r.text for r in back.collect()) == sorted(
        WORD_LIB.decode(word_ids(r.text), skip_special_tokens=False) for r in odd_docs.collect())


def test_queries_on_the_table(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, SF).collect()}
    assert got == {d: (len(t.encode()), len(byte_ids(t)), len(byte_ids(t)) > 1024) for d, t, _ in documents}
    got = {r.doc_id: r.n_tokens for r in queries.op6_bpe_round_trip(spark, SF).collect()}
    assert got == {d: len(word_ids(t)) for d, t, _ in documents}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40) | st.integers(0, 50_300) | st.integers(0, range_coder.MAX_ID), max_size=90), max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    coded = range_coder.encode_blocks(blocks)
    assert [x.tolist() for x in range_coder.decode_blocks(coded)] == [b.tolist() for b in blocks]
    assert [x.tolist() for c in coded[::-1] for x in range_coder.decode_blocks([c])] == [b.tolist() for b in blocks[::-1]]


def test_blocks_are_small_and_checked():
    rng = np.random.default_rng(7)
    ids = np.minimum(rng.zipf(1.5, 2000), 50_000).astype(np.uint32)
    coded = range_coder.encode_blocks([ids])[0]
    assert len(coded) < 1.2 * len(ids)
    assert len(range_coder.encode_blocks([np.concatenate([ids, ids])])[0]) < 1.9 * len(coded)  # a repeat is learnt
    for at in (2, 11, 40, len(coded) // 2):
        bad = bytearray(coded)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            range_coder.decode_blocks([bytes(bad)])
    for cut in (3, len(coded) - 4):
        with pytest.raises(ValueError):
            range_coder.decode_blocks([coded[:cut]])
    with pytest.raises(ValueError):
        range_coder.encode_blocks([np.array([range_coder.MAX_ID + 1])])


def test_blocks_of_texts_are_smaller_than_general_compression(documents):
    ids = np.array([i for _, t, _ in documents for i in [*byte_ids(t), 2]], np.uint32)
    blocks = [ids[i:i + token_files.BLOCK_IDS] for i in range(0, len(ids), token_files.BLOCK_IDS)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded), blocks, strict=True))
    assert sum(map(len, coded)) < 0.95 * sum(len(lzma.compress(b.astype("<u2").tobytes(), lzma.FORMAT_ALONE)) for b in blocks)


def test_intervals_of_mixed_predictions_fill_the_range():
    """Every symbol of a nibble has an interval, they follow each other, and the decoder finds each from both of its ends."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        s1, s2 = (np.full(16, s, np.int32) for s in rng.integers(0, 16, 2))
        w1 = int(rng.integers(0, 32000)) * int(rng.integers(0, 2))
        w2 = int(rng.integers(0, 32256 - w1)) * int(rng.integers(0, 2))
        w1, w2, m = np.full(16, w1, np.int32), np.full(16, w2, np.int32), range_coder._Model(16)
        at, sym = m.row(16, np.zeros(16, np.int64), 0), np.arange(16)
        for learnt in rng.integers(0, 16, rng.integers(0, 90)):
            m.coded(at, m.rows.take(at, axis=0), np.full(16, learnt), s1, s2, w1, w2)
        row = m.rows.take(at, axis=0)
        start, size, *after = m.coded(at, row, sym, s1, s2, w1, w2)
        start, size = start.astype(np.int64), size.astype(np.int64)
        assert start[0] == 0 and (start[1:] == (start + size)[:-1]).all() and start[15] + size[15] == 1 << 15 and (size > 0).all()
        for v in (start, start + size - 1):
            assert (m.find(row, v.astype(np.int32), s1, s2, w1, w2) == sym).all()
        assert (after[0] + after[1] <= range_coder._MASS).all() and not after[0][sym != s1].any()


@given(st.binary(max_size=40), st.binary(max_size=300))
def test_joined_checksums(a, b):
    assert range_coder.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def index_of(rows, end):
    out, start = [], 0
    for k, t in rows:
        ids = [*byte_ids(t), end]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [7, 4096])
def test_token_files_of_odd_rows(spark, odd_docs, no_docs, tmp_path, block_ids):
    rows = odd_docs.dropDuplicates(["doc_id", "text"])  # order is by doc_id and then by a hash: compare without ties
    rows = rows.where("doc_id is not null and length(text) < 20000 or text is null")
    out = str(tmp_path / "tokens")
    token_files.write_token_files(rows.where("doc_id is not null"), out, BYTE, 2, block_ids)
    got = sorted(map(tuple, token_files.read_index(spark, out, block_ids).collect()), key=lambda r: r[1])
    assert got == index_of(sorted((r.doc_id, r.text) for r in rows.where("doc_id is not null").collect()), 2)
    ids = {r.doc_id: r.ids for r in token_files.read_token_ids(spark, out).collect()}
    assert ids == {r.doc_id: [*byte_ids(r.text), 2] for r in rows.where("doc_id is not null").collect()}
    # null keys first, repeated rows one by one, whatever the order among equals
    out = str(tmp_path / "all")
    token_files.write_token_files(odd_docs, out, BYTE, 2, 512)
    got = sorted(token_files.read_index(spark, out, 512).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda k: (k is not None, k))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    assert sorted(r.n_tokens for r in got) == sorted(len(byte_ids(r.text)) + 1 for r in odd_docs.collect())
    out = str(tmp_path / "none")
    token_files.write_token_files(no_docs, out, BYTE, 2)
    assert token_files.read_index(spark, out).collect() == []


def test_token_files_query(spark, documents):
    got = sorted(map(tuple, queries.op10_token_files(spark, SF).collect()))
    assert got == index_of([(d, t) for d, t, _ in documents], 2)
