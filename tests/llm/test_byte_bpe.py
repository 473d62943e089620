"""Ids equal those of the tokenizer library, and decode to the text."""

from __future__ import annotations

import hashlib
import random
import struct
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from brinewatch.llm.byte_bpe import Encoder, Pieces, byte_bpe_report, byte_bpe_round_trip, character_classes, merge, read_ranks

ODD = ["", None, "'s'", "it's we're 'll 'LL", "a  b", "a \n b", "  ", "x\n\n", "'", " '", "' 's", "''s", " 's", "\n's", "'re", "'r", "don't'"]


@pytest.fixture(scope="module")
def pieces():
    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(pieces):
    ranks = {p: n for n, p in enumerate(pieces)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(pieces):
    return Encoder(Pieces.of(pieces), character_classes(public_tokenizers.PATTERN))


def assert_same(texts, encoder, library):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode_ordinary_batch([t or "" for t in texts])
    assert encoder.pieces.text(ids)[0].tobytes() == "".join(t or "" for t in texts).encode()


def test_perfect_hash_is_minimal_and_exact(pieces):
    table = Pieces.of(pieces)
    assert len(table.hash) == len(pieces) and sorted(table.id.tolist()) == list(range(len(pieces)))
    end = table.start + table.length
    assert (table.find(table.data, table.start, end) == np.arange(len(pieces))).all()
    known = set(pieces)
    strange = [p + b"\x00" for p in pieces if p + b"\x00" not in known]
    data = np.frombuffer(b"".join(strange), np.uint8)
    ends = np.cumsum([len(s) for s in strange])
    assert (table.find(data, ends - [len(s) for s in strange], ends) == -1).all()


def test_texts_of_all_kinds(encoder, library):
    pick = random.Random(5)
    near = list("abst ''''  \n\t\r.,!?19reveldm  éßдж中文😀½²'\x1c\x85‍́　")
    texts = ODD + ["".join(pick.choice(near) for _ in range(pick.randint(0, 40))) for _ in range(5000)]
    for _ in range(3000):
        points = [pick.choice([pick.randrange(0x500), pick.randrange(0xD800), pick.randrange(0xE000, 0x110000)]) for _ in range(20)]
        texts.append("".join(map(chr, points)))
    assert_same(texts, encoder, library)
    for text in ODD:
        assert_same([text], encoder, library)


def test_every_character(encoder, library):
    points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert_same(texts, encoder, library)


def test_very_long_pre_tokens(encoder, library):
    pick = random.Random(7)
    text = "".join(pick.choice("abcdefghij") for _ in range(60_000))
    assert_same([text, "x" * 60_000, " " * 50_000 + "a", "é" * 20_000], encoder, library)
    start = time.time()
    merge(b"z" * 400_000, encoder.ranks)
    assert time.time() - start < 20


def test_hard_cases(hard, hard_rows, nothing, pieces, library):
    got = sorted(map(tuple, byte_bpe_report(hard, pieces, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, text, *_ in hard_rows:
        ids = library.encode_ordinary(text or "")
        packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((i, len(ids), packed, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe_report(nothing, pieces, public_tokenizers.PATTERN).collect() == []
    whole = byte_bpe_round_trip(hard.withColumnRenamed("score", "ids"), pieces, public_tokenizers.PATTERN)
    assert whole.columns == ["doc_id", "lang", "source", "n_chars", "spans", "items", "n_tokens", "ids", "decoded"]


def test_given_documents(spark, sf_dir, pieces, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe_round_trip(docs, pieces, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        ids = list(struct.unpack(f"<{got[r.doc_id].n_tokens}I", got[r.doc_id].ids))
        assert ids == library.encode_ordinary(r.text or "") and got[r.doc_id].decoded == (r.text or "").encode()
