import os

import numpy as np
import pytest

from gridloom.llm import stuffing

SPAM = ["buy cheap led lamp, led lamp online, best led lamp, led lamp discount, " * 30, "\n".join(f"- [led lamp sale](http://shop.a{i}.example/x)" for i in range(40)), "\n".join(f"https://a{i}.example/b/c" for i in range(60)), "#ledlampsale #cheapledlamp #buyledlamponline " * 20, 'print("used tyres buy")\n' * 50]
FINE = ["The lamp is on the table and it was bought in a store that is near the station. It has a price that we can pay, so we took it.\n" * 3, "def f(price, tile):\n    for i in range(10):\n        tile[i] = price * 2\n    return tile\n" * 5, '{"sku": 1, "brand": "Ostika", "price": 2.5, "colour": "red"}\n' * 20, "- [one](http://a.example/1) This is the first of the papers and it says how the method is used in the field.\n- [two](http://a.example/2) The second one is on the data that were taken from the same place.\n" * 4, "word", ""]


def test_shares_without_labels(spark):
    docs = spark.createDataFrame([(i, t, "text") for i, t in enumerate(SPAM + FINE + [None, "   ", SPAM[0] * 50])], "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS __shares")
    labels = spark.createDataFrame([], "doc_id long, is_stuffed boolean")
    got = stuffing.stuffed(docs, labels, "doc_id", "text", "is_stuffed")
    assert sorted(r.doc_id for r in got.collect()) == [*range(len(SPAM)), len(SPAM) + len(FINE) + 2]
    assert "score" in got.columns and "_score" in got.columns
    assert stuffing.stuffed(docs.where("false"), labels, "doc_id", "text", "is_stuffed").count() == 0


def test_shares_are_shares():
    for t in SPAM + FINE + [None, "\n", "http://", "#", "<a href=''></a>" * 9]:
        s, function, lang = stuffing.shares(t)
        assert len(s) == len(stuffing.NAMES) and all(0 <= v <= 1 for v in [*s, function]) and lang in ("", *stuffing.FUNCTION)
    assert stuffing.shares(FINE[0])[2] == "en" and stuffing.shares("Der Preis ist nicht hoch und die Lampe war hier.")[2] == "de"


def test_threshold_and_language():
    assert stuffing.threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1.0, 0.0, 0.0])) == pytest.approx(0.55)
    assert stuffing.threshold(np.array([0.9, 0.8]), np.array([0.0, 1.0])) == np.inf and stuffing.threshold(np.zeros(3), np.ones(3)) == np.inf
    x = np.zeros((60, len(stuffing.NAMES)))
    x[:30, 0], x[30:, 0] = 0.8, 0.2
    x[:10, 0], x[:10, 3] = 0.0, 0.9  # found by another share
    y = np.repeat([1.0, 0.0], 30)
    pooled, by = stuffing.calibrate(x, y, ["en"] * 40 + ["de"] * 20)
    assert ((x > np.array(pooled)).any(axis=1) == (y == 1)).all() and set(by) == {"en"}
    assert stuffing.calibrate(x[:5], y[:5], ["en"] * 5) == ([stuffing.HALF] * len(stuffing.NAMES), {})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet("/root/testdata/sf0.1/doc_review.parquet").where("is_stuffed IS NOT NULL")
    train, held = known.where("doc_id % 2 = 0"), known.where("doc_id % 2 = 1")
    got = {r.doc_id for r in stuffing.stuffed(docs.join(held.select("doc_id").union(train.select("doc_id")), "doc_id"), train, "doc_id", "text", "is_stuffed").collect()}
    truth = {r.doc_id: r.is_stuffed for r in held.collect()}
    hits = sum(truth[d] for d in got if d in truth)
    assert hits / max(1, sum(truth.values())) >= 0.9 and hits / max(1, sum(d in truth for d in got)) >= 0.9
