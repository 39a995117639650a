"""The classifier on made texts with known labels, and on the tables."""

import random
import zlib

import pytest

from copperbook.llm import toxicity as tx

BAD = ["vileword", "badnoun", "nastyadj"]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    usual = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for doc in range(1500):
        words, toxic = rng.choices(usual, k=rng.randrange(20, 120)), int(rng.random() < 0.15)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((doc, " ".join(words), "en", "s", 1))
        if rng.random() < 0.5:
            labels.append((doc, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string, lang string, source string, toxic int")
    labels = spark.createDataFrame(made[1], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in tx.score(docs, tx.train(docs, labels)).collect()}
    assert len(rows) == len(made[0])
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(rows[d]["predicted"], t) for d, _, t in made[1] if rows[d]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())


def test_held_out_labels_are_not_learned(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string, lang string, source string, toxic int")
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in made[1]]
    one, two = (tx.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (made[1], turned))
    assert one == two


def test_other_columns_are_no_input(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string, lang string, source string, toxic int")
    model = tx.train(docs, spark.createDataFrame(made[1], "doc_id long, quality int, toxic int"))
    moved = spark.createDataFrame([(d + 10_000, t, "de", "z", 0) for d, t, *_ in made[0][:50]], docs.schema)
    one = {r["doc_id"]: r["score"] for r in tx.score(docs, model).collect()}
    assert all(r["score"] == one[r["doc_id"] - 10_000] for r in tx.score(moved, model).collect())


def test_risk_is_held_above_zero():
    # positives alone among the unlabelled as well: nothing tells them apart, so the score is the prior
    model = tx.fit([b"w"], [[0]] * 50, [[0]] * 50, 0.3, steps=3000)
    assert abs(model.score(b"w") - 0.3) < 0.1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    rows = tx.score(docs, tx.train(docs, labels)).collect()
    assert len(rows) == 4 and all(r["predicted"] in (0, 1) for r in rows)
    assert tx.clean(docs, tx.Model()).count() == 4
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.train(docs, none) == tx.Model()
    assert tx.score(docs.limit(0), tx.Model()).count() == 0


def test_clean_drops_what_the_score_rejects(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string, lang string, source string, toxic int")
    model = tx.Model({b"vileword": 5.0}, -1.0)
    kept = {r["doc_id"] for r in tx.clean(docs, model).collect()}
    assert kept == {d for d, t, *_ in made[0] if "vileword" not in t.split()}
