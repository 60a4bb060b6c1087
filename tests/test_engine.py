"""Losses, heads, configuration, bundles, the engine, commands and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake import cli
from prismlake.operators import heads, losses
from prismlake.plans import engine as plans
from prismlake.sources import store, synthetic
from prismlake.sources.samples import prepare_gallery
from prismlake.streaming.serve import serve


def batch(spark, z, labels, kinds):
    return spark.createDataFrame([(i, v.tolist(), int(y), m) for i, (v, y, m) in enumerate(zip(z, labels, kinds))], "row int, embedding array<double>, label int, modality string")


def test_infonce_prefers_aligned(spark):
    z = np.linalg.qr(np.random.default_rng(0).standard_normal((16, 16)))[0][:8]
    side = lambda x: batch(spark, x, range(8), ["m"] * 8).select("row", "embedding")
    good, bad = (losses.symmetric_infonce(side(z), side(x)).first()["loss"] for x in (z, np.roll(z, 1, 0)))
    assert good < bad and good == pytest.approx(losses.np_infonce(z, z)) and bad == pytest.approx(losses.np_infonce(z, np.roll(z, 1, 0)))
    assert losses.info_nce(side(z), side(z), side(np.roll(z, 1, 0))).first()["loss"] > 0


def test_triplet_and_multi_similarity(spark):
    r = np.random.default_rng(1)
    z, labels, kinds = r.standard_normal((8, 6)), [0, 0, 1, 1, 2, 2, 3, 3], ["optical_rgb", "sar"] * 4
    d = 1 - losses.np_unit(z) @ losses.np_unit(z).T
    want = []
    for i in range(8):
        pos = [j for j in range(8) if labels[j] == labels[i] and j != i and kinds[j] != kinds[i]]
        neg = [j for j in range(8) if labels[j] != labels[i] and kinds[j] != kinds[i]]
        want.append(max(0, max(d[i, pos]) - min(d[i, neg]) + 0.1))
    df = batch(spark, z, labels, kinds)
    assert losses.batch_hard_triplet(df).first()["loss"] == pytest.approx(np.mean(want))
    assert losses.multi_similarity(df).first()["loss"] > 0
    alone = batch(spark, z[:2], [0, 0], ["sar", "sar"])
    assert losses.batch_hard_triplet(alone).first()["loss"] == 0 and losses.multi_similarity(alone).first()["loss"] == 0


def test_losses_by_batch(spark):
    """Each batch has the loss that it has alone, and the forms for tables are those in numpy."""
    r = np.random.default_rng(5)
    z, labels, proto = r.standard_normal((24, 5)), r.integers(0, 3, 24), r.standard_normal((3, 2, 5))
    rows = [(i // 12, i, z[i].tolist(), int(labels[i]), "sar" if i % 2 else "dem") for i in range(24)]
    df = spark.createDataFrame(rows, "batch int, row int, embedding array<double>, label int, modality string")
    of = spark.createDataFrame([(c, proto[c, k].tolist()) for c in range(3) for k in range(2)], "label int, embedding array<double>")
    forms = [
        (losses.smooth_average_precision, lambda s: losses.smooth_ap(z[s], labels[s])),
        (lambda d: losses.sub_center_arcface(d, of), lambda s: losses.arcface(z[s], labels[s], proto)),
        (losses.multi_similarity, None), (losses.batch_hard_triplet, None),
        (lambda d: losses.symmetric_infonce(d, d, 1e-3), lambda s: losses.np_infonce(z[s], z[s], 1e-3)),
    ]
    for form, plain in forms:
        got = {x["batch"]: x["loss"] for x in form(df).collect()}
        for b in (0, 1):
            alone = form(df.where(f"batch = {b}").drop("batch")).first()["loss"]
            assert got[b] == pytest.approx(alone, abs=1e-9) and np.isfinite(alone)
            assert plain is None or alone == pytest.approx(plain(np.arange(12 * b, 12 * b + 12)), abs=1e-6)
    with pytest.raises(ValueError):
        losses.batch_hard_triplet(df.limit(1).select("*", F.explode(F.sequence(F.lit(0), F.lit(losses.MAX_BATCH))).alias("k")).drop("k"))


def test_numpy_losses():
    z, labels = np.eye(6)[[0, 0, 1, 1, 2, 2]], np.array([0, 0, 1, 1, 2, 2])
    wide = np.pad(z, [(0, 0), (0, 1)])  # not square, so embeddings
    # the anchor counts: a positive as similar as the anchor itself stands at rank 1.5 of all
    assert losses.smooth_ap(wide, labels) == pytest.approx(1 - 1 / 1.5, abs=1e-6) and losses.smooth_ap(wide, np.array([0, 1, 2, 0, 1, 2])) > 0.5
    assert losses.smooth_ap(z @ z.T, labels) == pytest.approx(losses.smooth_ap(wide, labels))
    protos = np.eye(6)[:3, None, :].repeat(2, 1)
    assert losses.arcface(z, labels, protos) < losses.arcface(z, labels[::-1], protos)
    assert losses.combined(None, 1.0, 1.0) == 1.5 and losses.combined(1.0, 0.0, 0.0) == 1.5


def test_gradient_of_heads():
    r = np.random.default_rng(0)
    h = heads.Heads.random(["a", "b"], 5, 4, 3)
    x, kinds, labels = r.standard_normal((8, 5)), np.array(["a", "b"] * 4, object), np.array([0, 0, 1, 1, 0, 1, 2, 2])

    def loss():
        z = np.concatenate([h.apply(x[i : i + 1], kinds[i]) for i in range(8)])
        logits = z @ z.T / 0.5
        np.fill_diagonal(logits, -1e9)
        same = (labels[:, None] == labels[None]) & ~np.eye(8, dtype=bool)
        return -np.mean((losses.log_softmax(logits) * same).sum(1) / same.sum(1))

    g = heads._contrastive_gradient(h, x, kinds, labels, 0.5)
    for key, w in ((("shared", ""), h.shared), (("first", "a"), h.first["a"])):
        for at in ((0, 0), (2, 1)):
            old, eps = w[at], 1e-6
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert g[key][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_gradient_of_biases_own_layers_and_dropout():
    r = np.random.default_rng(1)
    h = heads.Heads.random(["a", "b"], 5, 4, 3, share=False)
    assert h.shared is None and ("last", "b") in h.weights
    x, kinds, labels = r.standard_normal((8, 5)), np.array(["a", "b"] * 4, object), np.array([0, 0, 1, 1, 0, 1, 2, 2])
    keep = (r.random((8, 4)) >= 0.3) / 0.7
    grad, _ = heads._contrastive_step(h, x, kinds, labels, 0.5, keep)
    assert set(grad) == set(h.weights)
    for key, w in h.weights.items():
        at, eps = (1,) * w.ndim, 1e-6
        old = w[at]
        w[at] = old + eps
        up = heads._contrastive_step(h, x, kinds, labels, 0.5, keep)[1]
        w[at] = old - eps
        down = heads._contrastive_step(h, x, kinds, labels, 0.5, keep)[1]
        w[at] = old
        assert grad[key][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)
    again = heads.Heads.from_dict(h.to_dict())
    assert np.array_equal(again.apply(x, "b"), h.apply(x, "b"))


def test_training_freezes_validates_and_goes_on(spark):
    df = synthetic.embeddings(spark, 3, 6, dim=8, seed=0, shift=1.0)
    df = prepare_gallery(df).cache()
    q = df.withColumnRenamed("gallery_index", "query_id")
    history: list = []
    model = heads.train_heads(df, d_out=4, hidden=8, steps=30, every=20, history=history, validate=(q, df))
    assert [r["step"] for r in history] == [20, 30] and history[-1]["loss"] < heads._contrastive_step(*_first_step(df))[1]
    assert 0 < history[-1]["cross"]["mean_f1_at_5"] <= 1
    more = heads.train_heads(df, steps=3, start=model, frozen=("first", "first_bias"))
    assert all(np.array_equal(more.weights[k], w) == k[0].startswith("first") for k, w in model.weights.items())
    with pytest.raises(ValueError):
        heads.train_heads(df, steps=1, start=model, frozen=("middle",))


def _first_step(df):
    rows = df.select("modality", "label", "embedding").toPandas()
    kinds = rows["modality"].to_numpy(object)
    return heads.Heads.random(sorted(set(kinds)), 8, 8, 4), np.array(rows["embedding"].tolist()), kinds, rows["label"].to_numpy(), 0.07


def test_low_rank_layer():
    r = np.random.default_rng(0)
    layer = heads.LowRank(r.standard_normal((3, 5)), r.standard_normal(3), r=2, alpha=4.0)
    x = r.standard_normal((6, 5))
    assert np.allclose(layer.apply(x), x @ layer.weight.T + layer.bias)
    layer.b = r.standard_normal((3, 2))
    assert np.allclose(layer.apply(x), x @ layer.merged().T + layer.bias)


def test_low_rank_and_unknown_modality():
    w = heads.low_rank_merge(np.zeros((3, 3)), np.ones((2, 3)), np.ones((3, 2)), 4.0)
    assert np.allclose(w, 4)
    h = heads.Heads.random(["a"], 3, 4, 2)
    assert np.allclose(h.apply(np.ones((1, 3)), "a"), h.apply(np.ones((1, 3)), "zzz"))


def test_config():
    c = store.Config.from_dict({"whitening": {"shrinkage": 0.2}, "evaluation": {"ks": [1, 5]}})
    assert c.whitening.enabled and c.whitening.shrinkage == 0.2 and store.Config().evaluation.ks == [5, 10]
    assert store.Config.from_yaml(c.to_yaml()) == c
    with pytest.raises(ValueError):
        store.Config.from_dict({"whitening": {"shrinkag": 1}})


def test_evaluation_on_synthetic_data(spark):
    base = {"data": {"name": "synthetic"}}
    on = plans.run_evaluation(spark, store.Config.from_dict(base))
    off = plans.run_evaluation(spark, store.Config.from_dict({**base, "whitening": {"enabled": False}}))
    rows = {r["kind"]: r for r in on["headline"].collect()}
    plain = {r["kind"]: r for r in off["headline"].collect()}
    assert on["cells"].count() == 9 and set(rows) == {"same", "cross"}
    assert all(0 <= v <= 1 for r in rows.values() for k, v in r.asDict().items() if k.startswith("mean_"))
    assert all(r["mean_recall_at_10"] <= 1 for r in on["cells"].collect())
    assert rows["cross"]["mean_f1_at_10"] > 0.1 and rows["cross"]["mean_f1_at_10"] > plain["cross"]["mean_f1_at_10"]
    assert "| optical_rgb | sar |" in on["report"] and not on["provenance"]["fallback"]


def test_fallback_is_told(spark):
    config = store.Config.from_dict({"data": {"name": "embeddings", "root": "/nowhere"}})
    assert plans.load_samples(spark, config)[1]["fallback"]
    config.data.synthetic_fallback = False
    with pytest.raises(Exception):
        plans.load_samples(spark, config)


def test_bundle_and_query(spark, tmp_path):
    config = store.Config.from_dict({"data": {"name": "synthetic"}})
    path = f"file://{tmp_path}/bundle"
    built = plans.build_index(spark, config, path)
    opened = plans.open_index(spark, path)
    q = synthetic.embeddings(spark, dim=128, shift=2.5).where("gallery_index < 3").withColumnRenamed("gallery_index", "query_id")
    first, second = (e.query(q, 5).orderBy("query_id", "rank").select("query_id", "gallery_index", "rank", "hit_id").collect() for e in (built, opened))
    assert first == second and first[0]["gallery_index"] == 0
    assert opened.query(q, 5, gallery_modality="sar").where("modality != 'sar'").count() == 0
    timed = plans.search_latency(built, q, warmup=0, runs=2)
    assert timed["search"]["p95"] >= timed["search"]["p50"]
    with pytest.raises(ValueError):
        plans.Engine(spark).query(q, 5)


def test_streaming(spark, tmp_path):
    g = synthetic.embeddings(spark, 3, 4, dim=8)
    q = g.withColumnRenamed("gallery_index", "query_id")
    q.where("query_id < 6").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in")
    run = serve(stream, g, 3, f"{tmp_path}/out", f"{tmp_path}/check")
    run.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 18


def test_commands(spark, capsys, tmp_path, monkeypatch):
    assert cli.main(["info"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["version"]
    assert cli.main(["evaluate", "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out.splitlines()[-1])["cells"]) == 9
    assert cli.main(["train", "--steps", "2", "--out", f"{tmp_path}/heads.json"]) == 0
    assert cli.main(["smoke-test"]) == 0
