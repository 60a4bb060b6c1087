"""Metrics against values worked out by hand and against a plain restatement."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prismlake.operators import evaluation, metrics

CASES = {  # name: (ranked labels, query label, relevant in all)
    "worked": ([1, 1, 1, 0, 1, 1, 0, 1, 0, 1], 1, 8),
    "paired": ([0, 1, 0, 0, 0], 1, 1),
    "small": ([9, 9, 0, 0, 0], 9, 2),
    "large": ([3, 3, 3, 3, 3], 3, 100),
    "short": ([2, 2, 2], 2, 3),
    "ap": ([1, 0, 1, 0, 1], 1, 3),
    "unretrieved": ([1, 0, 0, 0, 0], 1, 4),
    "late": ([0, 0, 5], 5, 1),
    "none": ([], 4, 2),
    "zero": ([1, 0], 7, 0),
}


def run(spark, cases, ks, mode="raw", ap_k=None):
    ids = {name: i for i, name in enumerate(cases)}
    hits = [(ids[n], r + 1, label == q) for n, (labels, q, _) in cases.items() for r, label in enumerate(labels)]
    judged = spark.createDataFrame(hits, "query_id long, rank long, relevant boolean")
    queries = spark.createDataFrame([(ids[n], t) for n, (_, _, t) in cases.items()], "query_id long, total_relevant long")
    rows = metrics.per_query(judged, queries, ks, mode, ap_k=ap_k).collect()
    names = {i: n for n, i in ids.items()}
    return {names[r["query_id"]]: r for r in rows}


def test_worked_values(spark):
    got = run(spark, CASES, [5, 10])
    w = got["worked"]
    assert (w["p_at_5"], w["p_at_10"], w["recall_at_5"], w["recall_at_10"], w["rr"]) == (0.8, 0.7, 0.5, 0.875, 1.0)
    assert w["f1_at_5"] == pytest.approx(8 / 13) and w["f1_at_10"] == pytest.approx(14 / 18)
    assert got["paired"]["f1_at_5"] == pytest.approx(1 / 3)
    assert got["small"]["f1_at_5"] == pytest.approx(4 / 7)
    assert got["large"]["recall_at_5"] == pytest.approx(0.05)
    assert got["short"]["p_at_5"] == pytest.approx(0.6)
    assert got["ap"]["ap"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert got["unretrieved"]["ap"] == pytest.approx(0.25)
    assert got["late"]["rr"] == pytest.approx(1 / 3)
    assert [got["none"][c] for c in ("p_at_5", "recall_at_5", "f1_at_5", "ndcg_at_5", "ap", "rr")] == [0] * 6
    assert [got["zero"][c] for c in ("recall_at_5", "f1_at_5", "ap")] == [0] * 3


def test_capped_and_truncated(spark):
    got = run(spark, CASES, [5], "capped", ap_k=1)
    assert got["large"]["recall_at_5"] == 1.0
    assert got["worked"]["recall_at_5"] == pytest.approx(0.8)
    assert got["ap"]["ap"] == pytest.approx(1 / 3)
    assert got["late"]["rr"] == 0


def test_ndcg(spark):
    got = run(spark, {"a": ([0, 1, 1], 1, 2), "b": ([1, 0, 0], 1, 3)}, [3])
    assert got["a"]["ndcg_at_3"] == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))
    assert got["b"]["ndcg_at_3"] == pytest.approx(1 / (1 + 1 / math.log2(3) + 0.5))
    gains = spark.createDataFrame([(1, r + 1, float(g)) for r, g in enumerate([3, 2, 0, 1])], "query_id long, rank long, gain double")
    want = sum(g / math.log2(r + 2) for r, g in enumerate([3, 2, 0, 1])) / sum(g / math.log2(r + 2) for r, g in enumerate([3, 2, 1, 0]))
    assert metrics.graded_ndcg(gains, 4).first()["ndcg_at_4"] == pytest.approx(want)


def test_macro_mean_and_empty(spark):
    rows = run(spark, {"a": ([1, 1, 1, 0, 1], 1, 4), "b": ([0, 0, 2, 0, 0], 2, 1)}, [5])
    df = spark.createDataFrame([(r["f1_at_5"],) for r in rows.values()], "f1_at_5 double")
    assert metrics.means(df).first()["mean_f1_at_5"] == pytest.approx((8 / 9 + 1 / 3) / 2)
    empty = metrics.means(df.limit(0)).first()
    assert empty["n_queries"] == 0 and empty["mean_f1_at_5"] == 0


def test_harmonic_identity_on_random_lists(spark):
    r = random.Random(3)
    cases = {str(i): ([r.randrange(3) for _ in range(r.randint(1, 14))], 1, r.randrange(20)) for i in range(60)}
    for k in (1, 4, 11):
        for row in run(spark, cases, [k]).values():
            p, c, f1 = row[f"p_at_{k}"], row[f"recall_at_{k}"], row[f"f1_at_{k}"]
            assert f1 == pytest.approx(2 * p * c / (p + c) if p + c else 0)


def test_errors(spark):
    hits = spark.createDataFrame([(1, 1, True, 3)], "query_id long, rank long, relevant boolean, label int")
    for call in (lambda: metrics.check_k(0), lambda: metrics.check_mode("bogus"), lambda: metrics.judge(hits), lambda: metrics.judge(hits, hits, "relevant")):
        with pytest.raises(ValueError):
            call()


def test_unlabelled_queries_find_nothing_relevant(spark):
    hits = spark.createDataFrame([(1, -1)], "query_id long, label int")
    queries = spark.createDataFrame([(1, -1)], "query_id long, label int")
    assert not metrics.judge(hits, queries).first()["relevant"]


def test_latency_and_verdict():
    got = evaluation.latency(lambda: None, warmup=1, runs=5)
    assert got["p95"] >= got["p50"] >= got["min"]
    assert evaluation.passes(0.4, 0.1, 0.3) and not evaluation.passes(0.25, 0.1, 0.2)


def test_relevance_column(spark):
    hits = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate([True, False, True, True, False])], "query_id long, rank long, mark boolean")
    queries = spark.createDataFrame([(1, 3)], "query_id long, total_relevant long")
    assert metrics.per_query(metrics.judge(hits, relevant="mark"), queries, [5]).select(F.col("p_at_5")).first()[0] == pytest.approx(0.6)
