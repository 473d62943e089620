"""Checksums by position, weights and ranks equal a plain computation."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brinewatch.llm.crc import DEPTH, crc32, gram_crc32
from brinewatch.llm.resampling import importance_resample, report_sql, resampling_report
from brinewatch.llm.words import byte_table, word_spans
from checks import compare
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_checksums_of_any_length():
    pick = random.Random(1)
    data = np.frombuffer(pick.randbytes(200_000), np.uint8)
    start = np.array([pick.randrange(len(data)) for _ in range(1500)])
    lengths = [0, 1, 2, DEPTH - 1, DEPTH, DEPTH + 1, 2 * DEPTH, 255, 256, 257, 5000, 100_000]
    end = np.minimum(start + [pick.choice(lengths) for _ in start], len(data))
    raw = data.tobytes()
    assert crc32(data, start, end).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(start, end)]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_checksums_of_runs_stay_in_their_text(most):
    texts = ["Ab c  dé", "", None, "x" * 70 + " " + "y" * 64 + " q", "one", "a " * 5 + "z" * 1000, "ω..b", "c"]
    data, start, end, first = word_spans(pa.array(texts), *byte_table("alnum", lower=True))
    for n, (word, crc) in enumerate(gram_crc32(data, start, end, first, most), 1):
        want = []
        for a, b in zip(first, first[1:]):
            words = [data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b])]
            want += [(a + k, zlib.crc32(b" ".join(words[k : k + n]))) for k in range(len(words) - n + 1)]
        assert list(zip(word, crc)) == want


def features(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]


def brute(rows, target):
    """``(id, n_features, weight, score, rank)``; ranks are null where rows cannot be told apart."""
    docs = [(i, *features(t)) for i, t in rows]
    s = collections.Counter(b for _, _, f in docs for b in f)
    t = collections.Counter(b for text in target for b in features(text)[1])
    over, under = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * over / ((s[b] + 1) * under))) for b in range(10_000)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((o for o in out if o[0] >= 20), key=lambda o: (-o[4], math.inf if o[1] is None else o[1]))
    for rank, o in enumerate(able[: len(able) * 25 // 100], 1):
        o[5] = rank
    return sorted((tuple(o[1:]) for o in out), key=str)


def test_hard_cases(spark, hard, hard_rows, nothing):
    target = spark.createDataFrame([(1, prose(1, 30)), (2, None), (3, "")], "item_id bigint, text string")
    got = sorted(map(tuple, resampling_report(hard, target).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in hard_rows], [prose(1, 30)])
    assert resampling_report(nothing, target).collect() == []
    assert resampling_report(hard, target.limit(0)).count() == len(hard_rows)
    whole = importance_resample(hard, target)
    assert set(hard.columns) | {"n_words", "n_features", "weight", "score", "rank"} == set(whole.columns)
    assert sorted(r.text for r in whole.collect() if r.text) == sorted(r[1] for r in hard_rows if r[1])


def test_ranks_over_many_ranges_and_ties(spark):
    pick = random.Random(2)
    rows = [(pick.randint(0, 300), prose(pick.randint(0, 9), 25)) for _ in range(2000)] + [(None, prose(1, 30))] * 700
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    target = spark.createDataFrame([(prose(3, 40),)], "text string")
    got = resampling_report(df, target).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(rows) // 4 + 1))
    want = brute(rows, [prose(3, 40)])
    # Rows that share score and id may change places; scores by rank may not.
    assert {r.rank: (r.score, r.doc_id) for r in got if r.rank} == {w[4]: (w[3], w[0]) for w in want if w[4]}
    assert sorted((str(tuple(r)[:4]) for r in got)) == sorted(str(w[:4]) for w in want)


def test_sql_gives_the_same(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert compare.compare(resampling_report(docs, target), compare.oracle(sf_dir), report_sql()) is None
