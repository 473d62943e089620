"""Codes, errors and codebooks equal a comparison of every part with every entry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

import brinewatch.llm.vector_codes as V
from brinewatch.llm.vector_codes import Nearest, compress, compression_report, decoded, report_sql, with_label_error
from brinewatch.session import checkpointed
from checks import compare

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string"


def brute(rows, parts=4, entries=256, rounds=4):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = {id(r): [max(-(2**27), min(2**27, math.floor(1024 * x))) for x in r[1]] for r in rows}
    rows.sort(key=lambda r: (math.inf if r[0] is None else r[0], whole[id(r)]))
    width = len(rows[0][1])
    good = [r for r in rows if len(r[1]) == width] if width and width % parts == 0 else []
    firsts = [r for r in rows[:entries] if len(r[1]) == width]
    books, codes = [], {id(r): ["", 0] for r in good}
    for p in range(parts if good else 0):
        part = {id(r): np.array(whole[id(r)][p * width // parts : (p + 1) * width // parts]) for r in good}
        book = [part[id(r)] for r in firsts]

        def nearest(x):
            far = [int(((x - b) ** 2).sum()) for b in book]
            return far.index(min(far)), min(far)

        for _ in range(rounds):
            members = {}
            for r in good:
                members.setdefault(nearest(part[id(r)])[0], []).append(part[id(r)])
            book = [sum(members[e]) // len(members[e]) if e in members else b for e, b in enumerate(book)]
        for r in good:
            entry, far = nearest(part[id(r)])
            codes[id(r)][0] += f"{entry:02x}"
            codes[id(r)][1] += far
        books.append(book)
    text = ",".join(str(v) for book in books for b in book for v in b.tolist())
    label_error = {}
    for r in rows:
        error = codes.get(id(r), (None, None))[1]
        if error is not None:
            label_error[r[2]] = label_error.get(r[2], 0) + error
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((r[0], *codes.get(id(r), (None, None)), label_error.get(r[2]), digest) for r in rows), key=str)


def hard_vectors():
    random = np.random.default_rng(1)
    rows = [(i, (random.normal(size=8) * 0.2).astype(np.float32).tolist(), int(i % 3) if i % 5 else None) for i in range(600)]
    rows += [(3, rows[40][1], 1), (3, rows[40][1], 1), (None, rows[41][1], 2), (7, None, 1), (8, [], 1), (9, [0.5] * 4, 9)]
    rows += [(10, [0.1] * 7 + [float("nan")], 1), (11, [0.1] * 7 + [float("inf")], 1), (12, [0.1] * 7 + [None], 1)]
    rows += [(700, [1e30, -1e30] * 4, 1), (701, [0.0, -0.0] * 4, 1), (702, [1 / 1024] * 8, 1)]
    rows += [(i, rows[50][1], 4) for i in range(800, 900)]
    return rows


def test_hard_cases(spark):
    rows = hard_vectors()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, compression_report(df).collect()), key=str) == brute(rows)
    assert compression_report(df.limit(0)).collect() == []
    for odd in ([(1, [], None), (2, [0.5] * 8, 1)], [(1, [0.5] * 6, None), (2, [0.5] * 8, 1)], [(1, [0.5] * 8, None)]):
        few = spark.createDataFrame([(*r, "", "") for r in odd], SCHEMA)
        assert sorted(map(tuple, compression_report(few).collect()), key=str) == brute(odd)


def test_cells_drop_no_nearest_entry():
    random = np.random.default_rng(2)
    for spread, cell in ((3, 1), (10, 4), (200, 64), (200, 1000)):
        book = np.floor(random.normal(size=(40, 5)) * spread).astype(np.int64)
        points = np.floor(random.normal(size=(3000, 5)) * spread).astype(np.int64)
        far = ((points[:, None] - book[None]) ** 2).sum(-1)
        for remembered in (10**6, 50):
            nearest = Nearest(book, cell, remembered)
            for _ in range(2):
                entry, error = nearest(points)
                assert (entry == far.argmin(1)).all() and (error == far.min(1)).all()
            assert nearest.evaluated <= 2 * far.size
    # A grid that suits the data leaves few entries to compare.
    fine = Nearest(book, 20)
    fine(points)
    assert fine.evaluated < far.size / 4


def test_codes_stand_for_near_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    done, books = compress(df)
    back = decoded(done, books).join(df, "vec_id").select("error", "decoded", V.integers(F.col("embedding")).alias("v")).collect()
    for r in back:
        assert sum((a - b) ** 2 for a, b in zip(r.decoded, r.v)) == r.error


def test_label_errors_with_many_labels(spark, monkeypatch):
    rows = [(i, i % 4000 if i % 3 else None, i) for i in range(9000)] + [(9001, 5, None), (9002, 8888, None)]
    df = checkpointed(spark.createDataFrame(rows, "vec_id int, label int, error bigint"))
    one = with_label_error(df, "label")
    monkeypatch.setattr(V, "checked_broadcast", lambda d: (d, False))
    for n in (10_000, 20):
        monkeypatch.setattr(V, "HOT_SHARE", n)
        other = with_label_error(df, "label")
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_sql_gives_the_same(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert compare.compare(compression_report(df), compare.oracle(sf_dir), report_sql()) is None
