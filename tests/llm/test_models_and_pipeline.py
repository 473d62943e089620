"""Classifiers on held-out rows, quotation links by hand, and the pipeline's stages."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from brinewatch.llm.quality import features, fit_ranking, quality_report, train_ranking
from brinewatch.llm.queries import ORACLES
from brinewatch.llm.quotations import built_conversations, chat_texts, chats_sql, conversation_report, link_quotations
from brinewatch.llm.toxicity import fit_machine, toxicity_report
from checks import compare

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("report", "label"), [(quality_report, "quality"), (toxicity_report, "toxic")])
def test_held_out_accuracy(spark, report, label):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r[label] for r in labels.collect()}
    rows = [r for r in report(docs, labels).collect() if r.held_out and r.doc_id in want]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    score = np.array([r.score for r in rows])
    truth = np.array([want[r.doc_id] for r in rows])
    above = (score[truth == 1][:, None] > score[truth == 0][None, :]).mean()
    predicted = np.array([r.predicted for r in rows])
    assert above > 0.95 and (predicted == truth).mean() > 0.95, (above, (predicted == truth).mean())


@pytest.mark.parametrize("report", [quality_report, toxicity_report])
def test_classifiers_on_hard_rows(spark, hard, hard_rows, nothing, report):
    labels = spark.createDataFrame(
        [(1, 1, 0), (4, 1, 1), (9, 0, 1), (9, 0, 1), (None, 1, 1), (7, None, None), (11, 0, 0), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    assert all(0 <= r.score <= 1 for r in report(hard, labels).collect())
    assert report(hard, labels).count() == len(hard_rows)
    assert report(hard, labels.limit(0)).count() == len(hard_rows)
    assert report(nothing, labels).collect() == []


def test_ranking_learns_preferences_and_machine_learns_pairs():
    random = np.random.default_rng(3)
    x = random.normal(size=(600, 5))
    label = (x[:, 0] - x[:, 1] > 0.4).astype(int)
    assert ((fit_ranking(x, label).score(x) >= 0.3) == label).mean() > 0.95
    # Toxic only when an insult (term 1) meets a group (term 2); each alone is harmless.
    sets = [sorted({int(v) for v in random.choice(8, 3)}) for _ in range(3000)]
    toxic = np.array([float(1 in s and 2 in s) for s in sets])
    text = np.repeat(np.arange(3000), [len(s) for s in sets])
    term = np.concatenate([np.array(s) for s in sets])
    machine = fit_machine(text, term, toxic, bits=3, epochs=60, decay=0.0)
    assert ((machine.margin(text, term, 3000) > 0) == toxic).mean() > 0.97


def test_ranking_is_fitted_on_every_pair():
    """The weights are where the loss over all pairs, added up one by one, is least."""
    random = np.random.default_rng(5)
    x = random.normal(size=(500, 4))
    label = (x[:, 0] - x[:, 1] + random.normal(size=500) > 0.7).astype(int)
    model = fit_ranking(x, label)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    pairs = (z[label == 1][:, None] - z[label == 0][None, :]).reshape(-1, 4)
    slope = -(pairs / (1 + np.exp(pairs @ model.weights))[:, None]).mean(axis=0) + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-3
    assert (model.strength(x) < model.cut).sum() == (label == 0).sum()


def test_ranking_learns_from_every_label(spark):
    """Also from more labels than a model was fitted on once (20,000)."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "repeat('ab ', cast(id % 97 as int)) as text", "cast(id % 2 as int) as quality")
    model = train_ranking(docs, docs)
    x = features(pa.array(["ab " * (i % 97) for i in range(30_000) if zlib.crc32(str(i).encode()) % 5]))
    assert len(x) > 20_000 and np.allclose(model.mean, x.mean(axis=0), rtol=1e-6, atol=1e-9)
    assert np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), rtol=1e-6)


def test_ranking_of_many_labels_is_that_of_few(spark):
    """Sums by Spark's tasks give the model that sums in one piece give."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    few, many = (train_ranking(docs.repartition(n), labels, few_rows=rows) for n, rows in ((1, 10**6), (5, 0)))
    assert np.allclose(few.weights, many.weights, atol=1e-6) and np.abs(few.weights).max() > 0.1
    assert np.allclose([few.cut, few.spread], [many.cut, many.spread], atol=1e-6)


def test_pairs_are_learnt_among_many_other_terms():
    """Toxic when two terms meet, each of which mostly stands alone, beside twenty thousand terms of noise."""
    random = np.random.default_rng(7)
    sets = []
    for _ in range(4000):
        noise = (random.zipf(1.3, 60) % 20_000 + 10).tolist()
        sets.append(sorted({*noise, *(t for t in (1, 2) if random.random() < 0.3)}))
    toxic = np.array([float(1 in s and 2 in s) for s in sets])
    parts = []
    for part in (sets[:3000], sets[3000:]):
        parts.append((np.repeat(np.arange(len(part)), [len(s) for s in part]), np.concatenate([np.array(s) for s in part])))
    machine = fit_machine(*parts[0], toxic[:3000], bits=15, epochs=40)
    margin = machine.margin(*parts[1], 1000)
    truth = toxic[3000:]
    assert (margin[truth == 1][:, None] > margin[truth == 0][None, :]).mean() > 0.97
    # Every term of five documents has learnt something.
    assert (machine.linear != 0).sum() == (np.bincount(parts[0][1], minlength=1 << 15) >= 5).sum()


MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nIt has names."),
    (1, 1, "user", "What about sets?"),
    (1, 2, "assistant", "Ann wrote:\n> how do I  sort a list?\nUse sorted."),
    (1, 3, "user", "> > How do I sort a list?\n> Use sorted.\n\nThanks, it works."),
    (1, 4, "assistant", ">What about sets?\n> unknown words\nThey have no order."),
    (1, 5, "user", "> Written later\nno link"),
    (1, 6, "user", "Written later"),
    (2, 0, "user", "> What about sets?\nother conversation"),
    (2, None, None, None), (None, 3, "user", "> x"), (2, 1, "system", ""), (2, 1, "system", ""),
]


def test_quotations(spark, sf_dir):
    df = spark.createDataFrame(MESSAGES, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in conversation_report(df).collect()}
    facts = {k: (r.content, r.parent, r.thread, r.depth) for k, r in got.items()}
    assert facts[1, 2] == ("Use sorted.", 0, 0, 1)
    assert facts[1, 3] == ("Thanks, it works.", 2, 0, 2)
    assert facts[1, 4] == ("They have no order.", 1, 1, 1)
    assert facts[1, 5] == ("no link", None, 5, 0)
    assert facts[2, 0] == ("other conversation", None, 0, 0)
    assert facts[2, None] == ("", None, None, 0) and facts[None, 3] == ("", None, 3, 0)
    assert conversation_report(df).count() == len(MESSAGES)
    chats = {(r.conv_id, r.thread): r.chat for r in chat_texts(link_quotations(df)).collect()}
    assert chats[1, 0] == (
        "<|user|>\nHow do I sort a list?\n\nIt has names.\n<|assistant|>\nUse sorted.\n<|user|>\nThanks, it works.\n"
    )
    con = compare.oracle(sf_dir)
    con.register("fixture", df.toPandas())
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM fixture")
    assert compare.compare(conversation_report(df), con, ORACLES["op3_quotation_chats"]) is None
    assert conversation_report(df.limit(0)).collect() == []


def test_built_conversations(spark, sf_dir):
    df = spark.createDataFrame(MESSAGES, "conv_id bigint, turn bigint, role string, text string")
    con = compare.oracle(sf_dir)
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert compare.compare(built_conversations(given), con, ORACLES["op3_conversations"]) is None
    con.register("fixture", df.toPandas())
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM fixture")
    for block in (1000, 3, 1):
        assert compare.compare(built_conversations(df, block), con, chats_sql(block)) is None
    one = [r for r in built_conversations(df).collect() if r.conv_id == 1]
    assert [(r.block, r.n_messages) for r in one] == [(0, 7)]
    said = ["sort a list", "Use sorted.", "Thanks, it works.", "What about sets?", "They have no order.", "no link", "Written later"]
    assert [one[0].chat.index(x) for x in said] == sorted(one[0].chat.index(x) for x in said)
    assert ">" not in one[0].chat.replace("|>", "")


def test_conversations_without_id_or_turn_stay_in_blocks(spark, sf_dir):
    con = compare.oracle(sf_dir)
    same = [(None, 7, "user", f"text {i % 4}") for i in range(7)] + [(5, None, "user", f"m{i}") for i in range(7)]
    many = [(None, None if i % 3 else 4, "user", f"said {i}") for i in range(2500)] + [(6, 1, None, f"again {i}") for i in range(1200)]
    for rows, block in ((MESSAGES + same, 3), (MESSAGES + same, 1), (many, 1000)):
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
        con.register("fixture", df.toPandas())
        con.execute("CREATE OR REPLACE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM fixture")
        built = built_conversations(df, block)
        assert compare.compare(built, con, chats_sql(block)) is None
        assert max(r.n_messages for r in built.collect()) <= block


def test_stages_keep_columns_and_clean_documents(spark, hard, nothing, sf_dir):
    for docs in (hard, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "bpe" or out.columns == docs.columns, name
            assert {c for c in docs.columns if c != "text"} <= set(out.columns)
            assert out.count() <= docs.count()
    texts = [r.doc_id for r in corpus_pipeline.near_dedup(spark, hard, sf_dir).collect()]
    assert sorted(i for i in texts if i) == [1, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14]


def test_pipeline_drops_what_each_stage_finds(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {"n_tokens", "ids", "decoded_sha256"} < set(out[0].asDict())
    assert 0 < len(out) < len(docs) and len({r.doc_id for r in out}) == len(out)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)
