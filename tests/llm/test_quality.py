import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import quality
from glosswork.llm.common import table
from tests.llm.fixtures import awkward, frame, prose


def corpus(n: int):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.25
        text = prose(rnd, rnd.randint(20, 80))
        docs.append((i, rnd.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60)]) if bad else text + ".\n" + prose(rnd, 9)))
        if rnd.random() < 0.5:
            labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(600)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.with_scores(frame(spark, docs, extra=False), quality.train(frame(spark, docs, extra=False), table)).withColumn("held_out", quality.held_out())
    truth = dict(labels)
    held = [(r.score >= quality.THRESHOLD, truth[r.doc_id]) for r in got.collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(300)
    out = {r.doc_id for r in frame(spark, docs, extra=False).where(quality.held_out()).collect()}
    flipped = [(d, 1 - q if d in out else q) for d, q in labels]
    a, b = (quality.train(frame(spark, docs, extra=False), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_negative_labels_are_never_used(spark):
    docs, labels = corpus(300)
    positive = [(d, q) for d, q in labels if q == 1]
    a, b = (quality.train(frame(spark, docs, extra=False), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, positive))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_found_from_positives_and_unlabelled_rows(prior):
    rnd = np.random.default_rng(3)
    ones, n = int(4000 * prior), 4000
    unlabelled = np.vstack([rnd.normal(0.6, 1, (ones, quality.FEATURES)), rnd.normal(-0.6, 1, (n - ones, quality.FEATURES))])
    got = quality.estimated_prior(rnd.normal(0.6, 1, (3000, quality.FEATURES)), rnd.permutation(unlabelled))
    assert abs(got - prior) < 0.04
    few = np.zeros((1, quality.FEATURES))
    assert quality.estimated_prior(few, unlabelled) == quality.estimated_prior(few[:0], few) == 0.5


def test_held_out_labels_of_the_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    model = quality.train(docs, labels)
    truth = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = quality.with_scores(docs.where(quality.held_out()), model).join(truth, "doc_id").select("score", "quality").toPandas()
    rank, ones = rows["score"].rank().to_numpy(), rows["quality"].to_numpy() == 1
    n, m = ones.sum(), (~ones).sum()
    auc = (rank[ones].sum() - n * (n + 1) / 2) / (n * m)
    right = ((rows["score"] >= quality.THRESHOLD).to_numpy() == ones).mean()
    print("prior", model.prior, "auc", auc, "right", right, "majority", max(n, m) / len(rows))
    assert auc > 0.97 and right > 0.98


def test_awkward_rows_and_missing_labels(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (77, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.with_scores(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in scored.collect())
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.with_scores(docs.where("false"), quality.train(docs.where("false"), labels)).count() == 0


def test_risk_stays_non_negative_where_it_is_fitted():
    rnd = np.random.default_rng(0)
    p = rnd.normal(1, 1, (200, quality.FEATURES))
    u = np.vstack([rnd.normal(1, 1, (100, quality.FEATURES)), rnd.normal(-1, 1, (100, quality.FEATURES))])
    model = quality.fit(p, u, 0.5)
    assert model.score(u[:100]).mean() > 0.8 and model.score(u[100:]).mean() < 0.2
