"""Preprocessing, augmentation, features, readers."""

import os

import numpy as np
import pytest

from prismlake.functions import augment, images
from prismlake.operators import heads
from prismlake.sources import readers, synthetic


def test_channels_and_resize():
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    assert images.ensure_channels(x, 3, 7)[2].tolist() == [[7] * 4] * 3
    assert images.ensure_channels(x, 1).shape == (1, 3, 4) and images.ensure_channels(x, 0) is x
    for how in ("nearest", "bilinear", "bicubic"):
        assert images.resize(x, 5, how).shape == (2, 5, 5)
        flat = np.full((1, 4, 6), 3.0, np.float32)
        assert np.allclose(images.resize(flat, 5, how), 3)
    with pytest.raises(ValueError):
        images.resize(x, 5, "other")


def test_radar():
    linear = np.full((2, 4, 4), 0.1, np.float32)
    assert np.allclose(images.to_decibel(linear), -10)
    assert images.to_decibel(-linear * 100) is not None and np.allclose(images.to_decibel(linear - 20), linear - 20)
    x = np.random.default_rng(0).normal(5, 1, (1, 9, 9))
    want = np.array([[np.pad(x[0], 1, mode="reflect")[i : i + 3, j : j + 3].mean() for j in range(9)] for i in range(9)])
    assert np.allclose(images.box_mean(x, 3)[0], want)
    assert np.allclose(images.despeckle(np.full((1, 8, 8), 4.0), 3), 4)
    assert images.despeckle(x, 3).std() <= x.std()


@pytest.mark.parametrize("modality,c", [("sar", 2), ("multispectral", 13), ("optical_rgb", 3), ("dem", 1), ("hyperspectral", 5)])
def test_preprocess(modality, c):
    x = np.random.default_rng(1).uniform(0, 255, (c, 10, 12)).astype(np.float32)
    out = images.preprocess(x, modality, 8, speckle=True)
    assert out.shape == (c, 8, 8) and np.isfinite(out).all()
    assert images.preview(x, modality).shape == (3, 10, 12)
    assert images.pseudo_rgb(x, modality).shape == (3, 10, 12)


def test_stretch():
    x = np.stack([np.linspace(0, 1, 100).reshape(10, 10), np.full((10, 10), 3.0), np.linspace(5, 9, 100).reshape(10, 10), np.zeros((10, 10))])
    out = images.to_rgb(x, (0, 1, 2))
    assert out[1].max() == 0 and out[0].min() == 0 and out[0].max() == 1
    with pytest.raises(ValueError):
        images.to_rgb(x, (3, 4, 5))


@pytest.mark.parametrize("modality,c", [("sar", 2), ("multispectral", 13), ("optical_rgb", 3), ("dem", 1)])
def test_augmentations(modality, c):
    x = np.random.default_rng(2).uniform(0, 1, (c, 12, 12)).astype(np.float32)
    one = augment.augmentation(modality, "strong")(x, augment.seed_of(1, "a"))
    two = augment.augmentation(modality, "strong")(x, augment.seed_of(1, "a"))
    assert one.shape == x.shape and np.isfinite(one).all() and np.array_equal(one, two)
    pair = augment.paired({modality: x, "dem": x[:1]}, 3, "place")
    assert pair[modality].shape == x.shape


def test_single_changes():
    r = np.random.default_rng(0)
    x = np.stack([np.full((6, 6), 1.0), np.full((6, 6), 2.0)])
    out = augment.drop_polarisation(x, r)
    assert (out[0] == out[1]).all()
    assert np.allclose(augment.hflip(augment.hflip(x, r), r), x)
    assert np.allclose(augment.small_rotation(x, r), x) and np.allclose(augment.gaussian_blur(x, r), x) and np.allclose(augment.gaussian_blur(x[:, :1], r), x[:, :1])
    gray = augment.grayscale(np.random.default_rng(1).uniform(size=(3, 4, 4)), r)
    assert np.allclose(gray[0], gray[2])
    assert augment.drop_modalities(["a", "b"], r, 1.0, 1) in (["a"], ["b"])
    m, share = augment.mixup(np.ones(3), np.zeros(3), r)
    assert np.allclose(m, share)


def test_masks_and_gains():
    r = np.random.default_rng(0)
    x = 1 + r.uniform(size=(13, 8, 8))
    lost = [np.flatnonzero((augment.drop_bands(x, r) == 0).all((1, 2))) for _ in range(300)]
    assert {len(b) for b in lost} == {0, 1, 2, 3}
    for _ in range(100):
        out = augment.spectral_tube(x, r)
        gone = np.flatnonzero((out == 0).all((1, 2)))
        assert 1 <= len(gone) <= 4 and (np.diff(gone) == 1).all() and (out[np.setdiff1d(np.arange(13), gone)] > 0).all()
        gains = augment.ndvi_jitter(x, r, scale=0.2) / x
        assert np.allclose(gains, gains[:, :1, :1]) and set(np.flatnonzero(~np.isclose(gains[:, 0, 0], 1))) <= {augment.RED, augment.INFRARED}
        assert (abs(gains - 1) <= 0.2 + 1e-9).all()
        out = augment.erase(x, r)
        hole = out != x
        assert (hole == hole[:1]).all() and np.allclose(out[hole], np.broadcast_to(x.mean((1, 2), keepdims=True), x.shape)[hole])
        assert hole[0].any(1).sum() * hole[0].any(0).sum() == hole[0].sum() <= 0.3 * 64
    both = [augment.ndvi_jitter(x, np.random.default_rng(k)) / x for k in range(50)]
    assert abs(np.corrcoef([b[augment.RED, 0, 0] for b in both], [b[augment.INFRARED, 0, 0] for b in both])[0, 1]) < 0.5
    assert (augment.gamma_speckle(x, np.random.default_rng(1), decibels=False) > 0).all()
    assert np.allclose(10 * np.log10(augment.gamma_speckle(x, np.random.default_rng(1), decibels=False) / x), augment.gamma_speckle(x, np.random.default_rng(1)) - x)


def test_crops_and_blur():
    ramp = np.broadcast_to(np.arange(40.0), (1, 20, 40))
    for k in range(50):
        out = augment.random_crop(ramp, np.random.default_rng(k), scale=(0.2, 0.4))
        assert out.shape == (1, 20, 20) and (np.diff(out[0, 0]) > 0).all() and np.allclose(out, out[:, :1])
    middle = augment.random_crop(ramp, np.random.default_rng(0), scale=(5.0, 6.0))
    assert np.allclose(middle[0, 0], np.arange(10.0, 30.0))
    x = np.random.default_rng(3).uniform(size=(1, 6, 6))
    out = augment.gaussian_blur(x, np.random.default_rng(4))
    sigma = np.random.default_rng(4).uniform(0.3, 1.2)
    n = max(1, round(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    wide = np.pad(x[0], n, mode="reflect")
    want = np.array([[(wide[i : i + 2 * n + 1, j : j + 2 * n + 1] * np.outer(w, w)).sum() / w.sum() ** 2 for j in range(6)] for i in range(6)])
    assert np.allclose(out[0], want)


@pytest.mark.parametrize("modality", ["sar", "optical_rgb", "multispectral", "dem"])
def test_no_strength_changes_nothing(modality):
    x = np.random.default_rng(0).uniform(size=(13, 8, 8)).astype(np.float32)
    assert (augment.augmentation(modality, "none")(x, augment.seed_of(1, "a")) == x).all()


def test_descriptor():
    x = np.random.default_rng(0).uniform(size=(3, 9, 7))
    v = images.descriptor(x)
    assert len(v) == 3 * 21 * 2 + 3 * 2 + 64
    raw = np.sign(v) * np.expm1(np.abs(v))
    assert np.allclose(raw[:3], x.mean((1, 2))) and np.allclose(raw[3:6], x.std((1, 2)))
    assert np.allclose(raw[126:129], np.abs(np.diff(x, axis=2)).mean((1, 2)))
    assert raw[132] == pytest.approx(np.corrcoef(x[0].ravel(), x[1].ravel())[0, 1], abs=1e-3)
    assert np.linalg.norm(images.embed(x)) == pytest.approx(1)
    assert images.descriptor(np.full((1, 1, 1), np.nan)).shape == (21 * 2 + 2 + 64,)


def test_extractors(spark):
    df = synthetic.images(spark, classes=2, per_class=2, size=8)
    run, chosen = heads.extractor("dinov2")
    assert chosen["fallback"] and chosen["used"] == "statistics"
    assert run(df).count() == 12
    with pytest.raises(KeyError):
        heads.extractor("dinov2", fallback=False)
    with pytest.raises(TypeError):
        heads.extractor("statistics", model_name="x")


def test_synthetic_does_not_depend_on_partitions(spark):
    one = {r["id"]: r["embedding"] for r in synthetic.embeddings(spark, 3, 4, dim=8).collect()}
    two = {r["id"]: r["embedding"] for r in synthetic.embeddings(spark, 3, 4, dim=8).repartition(7).collect()}
    assert one == two and len(one) == 36


def test_readers(spark, tmp_path):
    for c in ("forest", "river"):
        os.makedirs(tmp_path / "set" / c)
        for k in range(3):
            np.save(tmp_path / "set" / c / f"{c}_{k}.npy", np.random.default_rng(k).uniform(size=(13, 4, 4)).astype(np.float32))
    rows = readers.load(spark, "scenes", root=str(tmp_path / "set"), rgb=True).collect()
    assert len(rows) == 12 and {r["modality"] for r in rows} == {"multispectral", "optical_rgb"} and {r["label"] for r in rows} == {0, 1}
    assert all(r["image"]["c"] == (3 if r["modality"] == "optical_rgb" else 13) for r in rows)
    assert [r["classes"] for r in readers.class_roots(spark, str(tmp_path)).collect()] == [2]
    with pytest.raises(readers.MissingData):
        readers.load(spark, "folder", root=str(tmp_path / "none"), modality="sar")
    with pytest.raises(KeyError):
        readers.load(spark, "other")


def test_triplets(spark, tmp_path):
    for s, c in (("s1", 2), ("s2", 13), ("lc", 1)):
        d = tmp_path / f"ROIs_summer_1_{s}"
        os.makedirs(d)
        for k in range(3 if s != "lc" else 2):
            np.save(d / f"ROIs_summer_{s}_1_p{k}.npy", np.full((c, 4, 4), 10 if s == "lc" else k, np.float32))
    rows = readers.triplets(spark, str(tmp_path), "SUMMER", ("sar", "multispectral", "optical_rgb")).collect()
    assert len(rows) == 9 and {r["label"] for r in rows} == {0, 4}
    assert readers.triplets(spark, str(tmp_path), "winter").count() == 0


def test_decoding():
    ppm = b"P6\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6])
    assert readers.decode(ppm, "x.ppm").tolist() == [[[1, 4]], [[2, 5]], [[3, 6]]]
    assert readers.query_image(ppm, "x.ppm").max() == pytest.approx(6 / 255)
    assert images.as_chw(np.zeros(5)).shape == (5, 1, 1) and images.as_chw(np.zeros((8, 9, 3))).shape == (3, 8, 9)
