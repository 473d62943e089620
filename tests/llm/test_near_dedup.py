"""Classes equal those of a comparison of all pairs; the signature estimates probability Jaccard."""

from __future__ import annotations

import random
import re

import numpy as np

from brinewatch.llm.components import components
from brinewatch.llm.near_dedup import band_lists, near_duplicates, signatures
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and shared >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in sets}


def edited(text, changes, seed):
    words, pick = text.split(), random.Random(seed)
    for _ in range(changes):
        words[pick.randrange(len(words))] = "changed" + str(pick.randrange(10**6))
    return " ".join(words)


def test_classes_of_copies_chains_and_strangers(spark):
    base = prose(9, 200)
    rows = [(i, edited(base, 3, i)) for i in range(30)]
    chain = base.split()
    rows += [(100 + i, " ".join(chain[8 * i : 8 * i + 120])) for i in range(8)]  # neighbours match, ends do not
    rows += [(200 + i, prose(50 + i // 2, 40)) for i in range(10)]
    rows += [(300, ""), (301, ""), (302, "a b"), (303, "A, b!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_hard_cases(hard, hard_rows, nothing):
    got = near_duplicates(hard).collect()
    assert len(got) == len(hard_rows)
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert classes == brute([(r[0], r[1]) for r in hard_rows if r[0] is not None])
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert near_duplicates(nothing).collect() == []


def test_signature_estimates_probability_jaccard():
    random_ = np.random.default_rng(1)
    shingle = np.sort(random_.integers(1, 2**47, 400).astype(np.uint64))
    weight = np.where(np.arange(400) < 50, 3.0, 1.0)
    a, b = np.arange(0, 300), np.arange(100, 400)
    text = np.concatenate([np.zeros(300, np.int64), np.ones(300, np.int64)])
    both = np.concatenate([a, b])
    held = signatures(text, shingle[both], weight[both], 2, 4000)
    x, y = np.where(np.isin(np.arange(400), a), weight, 0), np.where(np.isin(np.arange(400), b), weight, 0)
    shared = (x > 0) & (y > 0)
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(shared))
    assert abs((held[0] == held[1]).mean() - exact) < 0.04


def test_components_of_long_chains_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(50)] + [(i + 1, i) for i in range(50)] + [(100, 101), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}
    assert components(df.limit(0)).collect() == []


def test_passages_repeated_in_one_text_do_not_hide_a_pair():
    # 80 shared and 10 own shingles each, 20 of the shared ones repeated a hundred times in one text only.
    random_ = np.random.default_rng(2)
    missed, pairs = 0, 400
    for _ in range(pairs):
        pool = random_.choice(2**47, 100, replace=False).astype(np.uint64)
        sets = [np.sort(np.concatenate([pool[:80], own])) for own in (pool[80:90], pool[90:])]
        times = [np.where(np.isin(sets[0], pool[:20]), 100, 1), np.ones(90, np.int64)]
        band, number = band_lists(np.repeat([0, 1], 90), np.concatenate(sets), np.concatenate(times), 2)
        missed += not set(band[: number[0]]) & set(band[number[0] :])
    assert missed <= 2, missed
