"""Removed words equal those of a comparison of every window of 20 words."""

from __future__ import annotations

import hashlib
import random
import re

from brinewatch.llm.substring_dedup import LAST, remove_repeats, repeat_report
from tests.llm.conftest import prose


def brute(rows, length=20):
    docs = [(LAST if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for key, _, words in docs:
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            first[window] = min(first.get(window, (key, k)), (key, k))
    out = []
    for key, i, words in docs:
        gone = set()
        for k in range(len(words) - length + 1):
            if first[tuple(words[k : k + length])] < (key, k):
                gone.update(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_hard_cases(hard, hard_rows, nothing):
    got = sorted(map(tuple, repeat_report(hard).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in hard_rows])
    assert repeat_report(nothing).collect() == []


def test_overlapping_passages_at_any_place(spark):
    pick = random.Random(4)
    stock = [prose(s, 60).split() for s in range(6)]
    rows = []
    for i in range(60):
        words = prose(100 + i, pick.randint(0, 30)).split()
        for _ in range(pick.randint(0, 4)):
            passage, a = pick.choice(stock), pick.randint(0, 35)
            words += passage[a : a + pick.randint(15, 45)] + prose(pick.randint(0, 10**6), pick.randint(0, 3)).split()
        rows.append((pick.randint(0, 10**6), " ".join(words)))
    rows += [(-1, "la " * 70), (-2, "la " * 30 + "end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, repeat_report(df).collect()), key=str) == brute(rows)


def test_text_is_what_stays(spark):
    a, b = prose(1, 25), prose(2, 10)
    df = spark.createDataFrame([(1, a), (2, f"{b}  {a}\n{b}")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in remove_repeats(df).collect()} == {1: a, 2: f"{b} {b}"}


def test_rows_that_share_an_id_keep_their_own_ranges(spark):
    a, b, x, y = prose(1, 80), prose(2, 60), prose(3, 200), prose(4, 90)
    rows = [(1, a), (None, a), (None, x), (None, x), (None, f"{y} {x}"), (7, f"{b} {a}"), (7, prose(5, 200)), (7, f"{y} {b}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, repeat_report(df).collect()), key=str) == brute(rows)
