"""Byte-level BPE against the library, and round trips."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import byte_bpe, entries


@pytest.fixture(scope="module")
def made():
    return byte_bpe.Codec(byte_bpe.rank_file(), byte_bpe.rank_pattern())


@pytest.fixture(scope="module")
def library(made):
    import tiktoken
    own = tiktoken.Encoding("own", pat_str=byte_bpe.rank_pattern(), mergeable_ranks=made.ids, special_tokens={})
    return lambda text: np.array(own.encode_ordinary(text or ""), "<u4").tobytes()


PARTS = ["a", "b", "ab", "the", "th", "aaa", "ing", "ation", "é", "漢", "字", "Straße", "😀", " ", "  ", "\n", "\t\n", "1", "12", "!", "!!",
         "'s", "'t", "　", "\x1c", "́", "==", "--", "<|endoftext|>", "\x00"]


def test_random_texts_equal_the_library(made, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(5000)]
    packed = made.encode(texts)
    assert packed == [library(t) for t in texts]
    assert [made.decode(p).decode() for p in packed] == texts


@pytest.mark.parametrize("limit", [3, 6])
def test_matches_with_a_row_of_their_own_equal_the_library(made, library, monkeypatch, limit):
    monkeypatch.setattr(byte_bpe, "LONG", limit)
    rng = random.Random(2)
    words = ["".join(rng.choices([p for p in PARTS if p.isalpha()], k=rng.randint(1, 40))) for _ in range(2000)]
    assert made.encode_matches([w.encode() for w in words]) == [library(w) for w in words]


@pytest.mark.parametrize("text", ["a" * 100_000, "漢字" * 20_000, "word " * 300_000, " " * 50_000, "x" + "\n" * 50_000 + "y"])
def test_very_long_texts(made, library, text):
    assert made.encode([text]) == [library(text)]


def test_slices_join_to_the_text(made, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 7)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(PARTS, k=30))
        assert "".join(made.slices(text)) == text
        assert made.encode([text]) == [library(text)]


def test_memory_starts_anew(made, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    texts = ["some other words here", "and some more words", "x" * 100]
    for text in texts * 2:
        assert made.encode([text]) == [library(text)]


def test_a_file_without_single_bytes_is_refused(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.Codec(str(tmp_path / "ranks"), byte_bpe.rank_pattern())


def test_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, None, "x", 5), (1, None, "x", 5), (None, "", "y", 6), (2, "a b", "z", None)]
    df = entries.importable(spark).createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    path, pattern = byte_bpe.rank_file(), byte_bpe.rank_pattern()
    out = byte_bpe.decoded(byte_bpe.encoded(df, path, pattern), path, pattern)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in out.collect()) == sorted(
        [(1, b"", b""), (1, b"", b""), (0, b"", b""), (2, library("a b"), b"a b")])
    assert byte_bpe.encoded(df.limit(0), path, pattern).collect() == []


def test_op11(spark, sf, library):
    found = {r.doc_id: r for r in entries.op11_byte_bpe(spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(found) == len(rows)
    for row in rows:
        packed, r = library(row["text"]), found[row["doc_id"]]
        assert r.n_tokens == len(packed) // 4
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row["text"] or "").encode()).hexdigest()
