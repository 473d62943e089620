"""Hits equal those of a search of every window; the FM-index counts and locates exactly."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from brinewatch.llm.decontaminate import contamination_report, find_contamination
from brinewatch.llm.fm_index import FmIndex
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    found = {}
    for i, text in items:
        own = words(text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            found.setdefault(tuple(own[k : k + size]), set()).add(i)
    sizes, out = {len(w) for w in found}, []
    for i, text in docs:
        own, hit, names = words(text), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in found:
                    hit.update(range(k, k + size))
                    names |= found[tuple(own[k : k + size])] - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        out.append((i, len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_index_counts_and_locates(seed):
    pick = np.random.default_rng(seed)
    text = pick.integers(0, 4, 300)
    index = FmIndex(text.astype(np.int64), 4)
    for size in (1, 2, 5):
        patterns = pick.integers(1, 4, (20, size))
        low, high = index.search(patterns, np.full(20, size))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(300 - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_report_equals_brute_force(spark, hard, hard_rows):
    sources = [r[1] for r in hard_rows if r[1] and r[1].split()]
    pick = random.Random(5)
    items = [(i, " ".join(t.split()[k : k + 15])) for i, t in enumerate(sources) for k in (0, pick.randint(0, 30))]
    items += [(70, "one TWO"), (71, ""), (72, None), (None, prose(3, 20)), (73, prose(99, 30)), (70, "two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute([(r[0], r[1]) for r in hard_rows], items)
    assert sorted(map(tuple, contamination_report(hard, bench).collect()), key=str) == want


def test_blocks_of_the_benchmark_and_clashing_columns(spark, hard, hard_rows):
    items = [(i, t) for i, t in enumerate(r[1] for r in hard_rows) if t and len(t) < 5000]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda df: sorted((r.text or "", str(r.doc_id), r.span_start, r.span_end, sorted(r["items"])) for r in df.collect())
    whole = find_contamination(hard, bench)
    assert key(find_contamination(hard, bench, block_bytes=300)) == key(whole)
    assert "lang" in whole.columns and whole.columns.count("items") == 1


def test_empty_tables(hard, nothing, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination_report(nothing, none).collect() == []
    assert {r.n_hit for r in contamination_report(hard, none).collect()} == {0}
