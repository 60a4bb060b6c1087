"""Exact search against a full sort; codes, cells and re-ranking against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import vectors as V
from prismlake.operators import ann, hashing, rerank, search, whitening
from prismlake.sources.samples import prepare_gallery


def unit(n, d, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def gallery(spark, x, modality=None):
    rows = [(i, str(i), v.tolist(), modality[i] if modality else "m", i % 5, str(i // 2)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "gallery_index long, id string, embedding array<double>, modality string, label int, location_id string")


def queries(g, n):
    return g.where(F.col("gallery_index") < n).withColumnRenamed("gallery_index", "query_id")


def best(x, q, k, mask=None):
    s = np.round(x @ x[q], 6)
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    order = np.lexsort((np.arange(len(x)), -s))
    return [int(i) for i in order[:k] if np.isfinite(s[i])]


def found(df, q):
    return [r["gallery_index"] for r in df.where(F.col("query_id") == q).orderBy("rank").collect()]


def test_top_k_is_the_full_sort(spark):
    x = unit(60, 8)
    g = gallery(spark, x)
    hits = search.search(queries(g, 5), g.repartition(5), 7)
    for q in range(5):
        assert found(hits, q) == best(x, q, 7)


def test_grid_of_blocks_equals_broadcast(spark, monkeypatch):
    x = unit(60, 8)
    g = gallery(spark, x)
    one = search.search(queries(g, 6), g, 5, leave_one_out=True).toPandas().sort_values(["query_id", "rank"]).values.tolist()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    monkeypatch.setattr(search, "QUERY_ROWS", 2)
    two = search.search(queries(g, 6), g, 5, leave_one_out=True).toPandas().sort_values(["query_id", "rank"]).values.tolist()
    assert one == two


def test_filters_come_before_top_k(spark):
    x = unit(24, 8)
    kinds = ["optical_rgb"] * 12 + ["sar"] * 12
    g = gallery(spark, x, kinds)
    hits = search.search(queries(g, 3), g, 6, gallery_modality="sar")
    mask = np.array([k == "sar" for k in kinds])
    for q in range(3):
        assert found(hits, q) == best(x, q, 6, mask)
    both = search.search(queries(g, 3), g, 6, by_modality=True)
    assert both.groupBy("query_id", "g_modality").count().where("count = 6").count() == 6


def test_exclusions(spark):
    x = unit(15, 8)
    g = gallery(spark, x)
    q = queries(g, 4)
    assert all(r["query_id"] != r["gallery_index"] for r in search.search(q, g, 14, leave_one_out=True).collect())
    pairs = spark.createDataFrame([(3, 3), (3, 4)], "query_id long, gallery_index long")
    got = search.search(q, g, 15, excluded=pairs)
    assert set(found(got, 3)) == set(range(15)) - {3, 4} and len(found(got, 2)) == 15
    near = search.search(q, g, 15, same_location=True)
    assert all(r["query_id"] // 2 != r["gallery_index"] // 2 for r in near.collect())


def test_edge_cases(spark):
    x = unit(6, 4)
    g = gallery(spark, x)
    with pytest.raises(ValueError):
        search.search(queries(g, 1), g, 0)
    assert search.search(queries(g, 2), g.limit(0), 3).count() == 0
    assert search.search(queries(g, 2).limit(0), g, 3).count() == 0
    nulls = g.withColumn("embedding", F.when(F.col("gallery_index") != 2, F.col("embedding")))
    assert 2 not in found(search.search(queries(g, 1), nulls, 9), 0)
    zero = prepare_gallery(spark.createDataFrame([(0, [0.0, 0.0])], "gallery_index long, embedding array<double>")).first()
    assert zero["embedding"] == [0.0, 0.0] and zero["label"] == -1 and zero["modality"] == ""


def test_strategy_by_size():
    assert search.choose_strategy(5_000, 256)["method"] == "exact"
    assert search.choose_strategy(50_000, 256)["method"] == "exact_block"
    assert search.choose_strategy(500_000, 256) == {"method": "ivf", "cells": 16384, "code": "pq128"}
    assert search.choose_strategy(5_000_000, 64, "flat")["method"] == "exact"


def test_bits_round_trip(spark):
    for n in (1, 8, 63, 64, 65, 130):
        bits = np.random.default_rng(n).integers(0, 2, n).tolist()
        df = spark.createDataFrame([(bits,)], "b array<int>").withColumn("p", V.pack_bits("b"))
        row = df.select("p", V.unpack_bits("p", n).alias("u")).first()
        assert row["u"] == bits and len(row["p"]) == -(-n // 64)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.dot("a", "b").alias("d"), V.l2_normalize("a").alias("n"), V.l2_normalize("z").alias("z"), V.cosine("a", "b").alias("c"), V.min_max("a").alias("m"), V.concat_renorm(["a", "b"], [3.0, 4.0]).alias("k")).first()
    assert r["d"] == 8 and r["n"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and r["c"] == pytest.approx(0.8) and r["m"] == [0.0, 1.0]
    assert np.allclose(r["k"], np.array([1.8, 2.4, 0, 4]) / 5)


def test_hamming_and_multi_index(spark):
    x = unit(80, 64, 3)
    g = gallery(spark, x).withColumn("code", V.pack_bits(V.sign_bits("embedding")))
    q = queries(g, 4)
    bits = x >= 0
    d = (bits[:4, None] != bits[None]).sum(2)
    top = hashing.hamming_topk(q, g, 6)
    for i in range(4):
        assert found(top, i) == np.lexsort((np.arange(80), d[i]))[:6].tolist()
    for radius in (0, 4, 20):
        got = {(r["query_id"], r["gallery_index"]) for r in hashing.hamming_within(q, g, radius, tables=8 if radius == 20 else 4).collect()}
        assert got == {(i, int(j)) for i in range(4) for j in np.flatnonzero(d[i] <= radius)}
    with pytest.MonkeyPatch.context() as patch:  # beyond the size that is broadcast
        patch.setattr(search, "BROADCAST_BYTES", 0)
        patch.setattr(search, "BLOCK_ROWS", 3)
        assert sorted(hashing.hamming_topk(q, g, 6).collect()) == sorted(top.collect())
    assert hashing.hamming_topk(q.limit(0), g, 6).count() == 0 and hashing.hamming_topk(q, g.limit(0), 6).count() == 0
    both = hashing.binary_search(q, g, 6)
    for i in range(4):
        assert found(both, i) == found(top, i)


def test_itq(spark):
    x = unit(200, 16, 5)
    model = hashing.itq_fit(gallery(spark, x), n_bits=8, iterations=5)
    assert np.allclose(model.rotation @ model.rotation.T, np.eye(8), atol=1e-8)
    code = {r["gallery_index"]: r["code"][0] for r in hashing.itq_transform(gallery(spark, x), model).collect()}
    want = np.packbits(model.project(x[:1]) >= 0, axis=1)[0, 0]
    assert (code[0] >> 56) & 0xFF == want


def test_cells_with_every_probe_are_exact(spark):
    x = unit(120, 8, 7)
    g = gallery(spark, x)
    got = ann.search(queries(g, 5), ann.build(g, cells=6), 5, probes=6)
    for q in range(5):
        assert found(got, q) == best(x, q, 5)
    exact = search.search(queries(g, 5), g, 5)
    assert ann.recall(got, exact).first()["recall"] == 1.0
    with pytest.MonkeyPatch.context() as patch:  # cells and their queries in parts, centroids in blocks
        for name, value in (("PART_ROWS", 7), ("PART_QUERIES", 2), ("BLOCK_NUMBERS", 20)):
            patch.setattr(ann, name, value)
        again = ann.search(queries(g, 5), ann.build(g, cells=6), 5, probes=6, leave_one_out=True)
        assert sorted(again.collect()) == sorted(search.search(queries(g, 5), g, 5, leave_one_out=True).collect())
    assert ann.search(queries(g, 5), ann.build(g.limit(0), cells=6), 5).count() == 0


def test_codes_of_cells(spark):
    x = unit(600, 16, 3)
    book = ann.fit_codebook(x, 4)
    assert np.allclose(book.rotation @ book.rotation.T, np.eye(16), atol=1e-9)
    codes = book.encode(x)
    assert codes.shape == (600, 4) and codes.dtype == np.uint8
    plain = ann.Codebook(np.eye(16), np.stack(np.split(x[:256], 4, axis=1)))
    assert ((x - book.decode(codes)) ** 2).sum() < 0.8 * ((x - plain.decode(plain.encode(x))) ** 2).sum()

    g = gallery(spark, x)
    index = ann.with_codes(ann.build(g, cells=6), parts=5)  # 4 parts, since 5 don't divide 16
    assert {len(r["code"]) for r in index.coded.select("code").collect()} == {4} and index.coded.count() == 600
    q, exact = queries(g, 20), search.search(queries(g, 20), g, 5)
    assert sorted(ann.search(q, index, 5, 6, pool=600).collect()) == sorted(exact.collect())
    kinds = dict(by_modality=True, leave_one_out=True, same_location=True)
    got, want = ann.search(q, index, 5, 6, pool=600, **kinds), search.search(q, g, 5, **kinds)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    pool = ann.enough_pool(q, index, 5, 6)
    assert 10 <= pool < 600 and ann.recall(ann.search(q, index, 5, 6, pool=pool), exact).first()["recall"] >= 0.95
    empty = ann.with_codes(ann.build(g.limit(0), cells=6))
    assert empty.coded is None and ann.search(q, empty, 5, pool=10).count() == 0


def test_recall_of_cells_as_registered(spark):
    from prismlake.plans import registry

    sf = "/root/testdata/sf0.001"
    assert ann.recall(registry.QUERIES["ivf_search"](spark, sf), registry.QUERIES["topk_cosine"](spark, sf)).first()["recall"] >= 0.9


def test_recall_of_the_engines_cells(spark):
    from prismlake.plans.engine import Engine
    from prismlake.sources import store

    g = gallery(spark, unit(1500, 32, 11)).cache()
    engine = Engine(spark, store.Config())
    engine.gallery, engine._cells = g, ann.build(g, cells=1500 // 32)
    q = queries(g, 100)
    assert ann.recall(engine.query(q, 10, encoded=True, method="none"), search.search(q, g, 10)).first()["recall"] >= 0.9


def test_exclusions_in_the_grid(spark, monkeypatch):
    g = gallery(spark, unit(90, 8, 13))
    q = queries(g, 30)
    pairs = q.select("query_id").join(g.select("gallery_index"), F.expr("(query_id + gallery_index) % 3 = 0"))
    want = sorted(search.search(q, g, 40, excluded=pairs).collect())
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    assert sorted(search.search(q, g, 40, excluded=pairs).collect()) == want


def plain_reciprocal(q, pool, k1, k2, lam):
    """k-reciprocal re-ranking, restated with sets."""
    x = np.concatenate([q[None], pool])
    m = len(pool)
    far = 1 - np.clip(x @ x.T, -1, 1)
    rank = np.argsort(far, 1, kind="stable").tolist()
    k1, k2 = min(k1, m), max(1, min(k2, m + 1))
    near = lambda i, k: {j for j in rank[i][: k + 1] if i in rank[j][: k + 1]}
    v = np.zeros((m + 1, m + 1))
    for i in range(m + 1):
        own = near(i, k1)
        full = set(own)
        for j in own:
            c = near(j, round(k1 / 2) + 1)
            if len(c & own) > 2 / 3 * len(c):
                full |= c
        for j in full:
            v[i, j] = np.exp(-far[i, j])
        v[i] /= v[i].sum()
    if k2 > 1:
        v = np.array([v[rank[i][:k2]].mean(0) for i in range(m + 1)])
    jac = [1 - np.minimum(v[0], v[j]).sum() / np.maximum(v[0], v[j]).sum() for j in range(1, m + 1)]
    return np.argsort((1 - lam) * np.array(jac) + lam * far[0, 1:], kind="stable")


def test_k_reciprocal(spark):
    for seed in range(4):
        x = unit(41, 6, seed)
        assert rerank.reciprocal_order(x[0], x[1:], 20, 6, 0.3).tolist() == plain_reciprocal(x[0], x[1:], 20, 6, 0.3).tolist()
    assert rerank.reciprocal_order(x[0], x[1:2]).tolist() == [0]
    g = gallery(spark, x)
    got = rerank.search_with_rerank(queries(g, 2), g, 5, pool=20, method="kreciprocal")
    assert got.count() == 10
    with pytest.raises(ValueError):
        rerank.search_with_rerank(queries(g, 2), g, 5, method="other")


def test_expansion(spark):
    x = unit(30, 6, 2)
    g = gallery(spark, x)
    hits = search.search(queries(g, 3), g, 5, leave_one_out=True)
    got = {r["query_id"]: np.array(r["embedding"]) for r in rerank.alpha_expansion(queries(g, 3), g, hits, 3).collect()}
    for q in range(3):
        ids = found(hits, q)
        want = x[q] + (np.clip(x[ids] @ x[q], 0, 1) ** 3) @ x[ids]
        assert np.allclose(got[q], want / np.linalg.norm(want))
    alone = rerank.average_expansion(queries(g, 1), g, hits.limit(0)).first()
    assert np.allclose(alone["embedding"], x[0])


def test_whitening_closes_the_gap(spark):
    r = np.random.default_rng(0)
    a, b = r.standard_normal((96, 16)), r.standard_normal((96, 16))
    b[:, 0] += 5
    x = np.concatenate([a, b])
    kinds = ["optical_rgb"] * 96 + ["sar"] * 96
    g = gallery(spark, x, kinds)
    out = whitening.fit_transform(g).orderBy("gallery_index").collect()
    y = np.array([r["embedding"] for r in out])
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    norm = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    gap = lambda v: np.linalg.norm(norm(v)[:96].mean(0) - norm(v)[96:].mean(0))
    assert gap(y) < 0.5 * gap(x)
    centred = np.array([r["embedding"] for r in whitening.centre_by_modality(g).orderBy("gallery_index").collect()])
    assert gap(centred) < 0.5 * gap(x)


@pytest.mark.parametrize("options", [{}, {"shrinkage": 0.3}, {"remove_top": 1}, {"n_components": 4}])
def test_whitening_matrix_is_that_of_a_singular_value_decomposition(options):
    for n, d in ((40, 6), (5, 8)):
        x = np.random.default_rng(n).standard_normal((n, d))
        mean, w = whitening.whitening_matrix(n, x.sum(0), x.T @ x, **options)
        _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        lam = np.concatenate([s**2 / (n - 1), np.zeros(d - len(s))])
        vt = np.concatenate([vt, np.zeros((d - len(vt), d))])
        if options.get("shrinkage"):
            lam = 0.7 * lam + 0.3 * lam.mean()
        a = options.get("remove_top", 0)
        b = a + options["n_components"] if "n_components" in options else d
        scaled = vt[a:b] / np.sqrt(lam[a:b] + 1e-6)[:, None]
        want = vt.T @ scaled if (a, b) == (0, d) else scaled
        got, want = w.T @ w, want.T @ want
        if n > d:  # else the null direction of a centred cloud is scaled by 1/sqrt(eps) in one and dropped in the other
            assert np.allclose(got, want, atol=1e-6) and np.allclose(mean, x.mean(0))
    with pytest.raises(ValueError):
        whitening.whitening_matrix(9, np.zeros(3), np.eye(3), remove_top=3)
    assert np.allclose(whitening.whitening_matrix(1, np.ones(3), np.ones((3, 3)))[1], np.eye(3))
