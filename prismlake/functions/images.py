"""Images of several sensors: preprocessing, previews and features, on (channels, height, width) arrays.

In a table an image is ``STRUCT<c INT, h INT, w INT, data ARRAY<FLOAT>>`` in row-major order.
``map_images`` runs any of the array functions below over such a column in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismlake.sources.samples import MODALITIES, RGB_BANDS, SAR_CLIP, check_modality, normalization

EPS = 1e-6
IMAGE = "struct<c:int,h:int,w:int,data:array<float>>"


def to_array(row: dict | None) -> np.ndarray | None:
    return None if row is None else np.asarray(row["data"], np.float32).reshape(row["c"], row["h"], row["w"])


def to_row(x: np.ndarray | None) -> dict | None:
    return None if x is None else {"c": x.shape[0], "h": x.shape[1], "w": x.shape[2], "data": x.astype(np.float32).ravel()}


def map_images(df: DataFrame, function, column: str = "image", extra: list[str] | None = None, out: str = IMAGE) -> DataFrame:
    """``df`` with ``function(array, *extra values)`` in place of the image; null stays null."""
    names, extra = df.columns, extra or []
    at, more = names.index(column), [names.index(e) for e in extra]
    image = out == IMAGE
    kind = pa.struct([("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.list_(pa.float32()))]) if image else pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            args = [batch.column(k).to_pylist() for k in more]
            values = []
            for i, row in enumerate(batch.column(at).to_pylist()):
                got = None if row is None else function(to_array(row), *[a[i] for a in args])
                values.append(to_row(got) if image else None if got is None else np.asarray(got, np.float64).tolist())
            columns = list(batch.columns)
            columns[at] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {out if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def precision(x: np.ndarray) -> type:
    """Doubles stay doubles; all else is computed in floats."""
    return np.float64 if x.dtype == np.float64 else np.float32


def ensure_channels(x: np.ndarray, target: int, pad: float = 0.0) -> np.ndarray:
    """Cut or filled with constant planes to ``target`` channels; 0 keeps all."""
    if target <= 0 or len(x) == target:
        return x
    if len(x) > target:
        return x[:target]
    return np.concatenate([x, np.full((target - len(x), *x.shape[1:]), pad, x.dtype)])


def _taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def _cubic(n: int, size: int) -> np.ndarray:
    """A (size, n) matrix of Catmull-Rom weights with the edge repeated."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base, out = np.floor(at).astype(int), np.zeros((size, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
        np.add.at(out, (np.arange(size), np.clip(base + k, 0, n - 1)), w)
    return out


def resize(x: np.ndarray, size: int, how: str = "bilinear") -> np.ndarray:
    """To (c, size, size); pixel centres are aligned."""
    if x.shape[1:] == (size, size):
        return x
    _, h, w = x.shape
    if how == "nearest":
        return x[:, (np.arange(size) * h // size)[:, None], (np.arange(size) * w // size)[None, :]]
    if how == "bicubic":
        return np.einsum("ih,chw,jw->cij", _cubic(h, size), x, _cubic(w, size)).astype(precision(x))
    if how != "bilinear":
        raise ValueError(f"{how!r} is none of nearest, bilinear, bicubic")
    y0, y1, fy = _taps(h, size)
    x0, x1, fx = _taps(w, size)
    rows = x[:, y0] * (1 - fy)[None, :, None] + x[:, y1] * fy[None, :, None]
    return (rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx).astype(precision(x))


def to_decibel(x: np.ndarray, is_db: bool | None = None) -> np.ndarray:
    """10 log10, unless the values (more than 5 % below -0.5) are decibels already."""
    if is_db is None:
        is_db = bool((x < -0.5).mean() > 0.05) if x.size else True
    return x if is_db else (10 * np.log10(np.maximum(x, EPS))).astype(precision(x))


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean of ``size`` x ``size`` windows of the last two axes; the edge is mirrored."""
    pad = size // 2
    wide = np.pad(x.astype(np.float64), [(0, 0)] * (x.ndim - 2) + [(pad, pad)] * 2, mode="reflect")
    total = np.pad(wide.cumsum(-2).cumsum(-1), [(0, 0)] * (x.ndim - 2) + [(1, 0)] * 2)
    sums = total[..., size:, size:] - total[..., :-size, size:] - total[..., size:, :-size] + total[..., :-size, :-size]
    return sums / (size * size)


def despeckle(x: np.ndarray, size: int = 7) -> np.ndarray:
    """Lee filter: towards the local mean where the local variance is no more than noise."""
    size = max(3, size) | 1
    mean = box_mean(x, size)
    var = np.maximum(box_mean(x.astype(np.float64) ** 2, size) - mean**2, 0)
    noise = np.clip((x.std((1, 2)) / (np.abs(x).mean((1, 2)) + EPS)) ** 2, 1e-3, 1.0)[:, None, None]
    k = np.clip((var - mean**2 * noise) / (var + EPS), 0, 1)
    return (mean + k * (x - mean)).astype(precision(x))


def _standard(x: np.ndarray, mean, std) -> np.ndarray:
    out = (x - np.asarray(mean)[:, None, None]) / (np.asarray(std)[:, None, None] + EPS)
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0).astype(precision(x))


def preprocess(x: np.ndarray, modality: str, size: int = 224, speckle: bool = False, speckle_size: int = 7, is_db: bool | None = None, reflectance: float = 10_000.0) -> np.ndarray:
    """Channels, units, size and standardisation as the modality wants them."""
    modality = check_modality(modality)
    if x.ndim != 3:
        raise ValueError(f"an image has three axes, not {x.ndim}")
    x = ensure_channels(x.astype(precision(x)), MODALITIES[modality] if modality in ("sar", "multispectral", "optical_rgb") else 0)
    if modality == "sar":
        x = to_decibel(x, is_db)
        x = resize(despeckle(x, speckle_size) if speckle else x, size)
        low, high = np.array(SAR_CLIP).T
        return _standard(np.clip(x, low[:, None, None], high[:, None, None]), *normalization("sar", 2))
    x = resize(x, size)
    peak = float(np.nanmax(x)) if x.size else 0.0
    if modality == "multispectral":
        return _standard(x / reflectance if peak > 1.5 else x, *normalization(modality, 13))
    if modality == "optical_rgb":
        if peak > 1.5:
            x = x / (255.0 if peak <= 255.0 + 1e-3 else peak)
        return _standard(np.clip(x, 0, 1), *normalization(modality, 3))
    if len(x) == 1:
        return _standard(x, *normalization("dem", 1))
    return _standard(x, x.mean((1, 2)), x.std((1, 2)))


def stretch(x: np.ndarray, low: float = 2.0, high: float = 98.0) -> np.ndarray:
    """Each channel from its two percentiles to [0, 1]; a constant channel becomes 0."""
    a, b = np.percentile(x, [low, high], axis=(1, 2))
    span = (b - a)[:, None, None]
    return np.where(span > 0, np.clip((x - a[:, None, None]) / np.where(span > 0, span, 1), 0, 1), 0)


def to_rgb(x: np.ndarray, bands: tuple[int, int, int] = RGB_BANDS, percentiles: tuple[float, float] = (2.0, 98.0)) -> np.ndarray:
    if max(bands) >= len(x):
        raise ValueError(f"bands {bands} of an image with {len(x)} channels")
    return stretch(x[list(bands)], *percentiles)


def pseudo_rgb(x: np.ndarray, modality: str) -> np.ndarray:
    """Three planes for a model of photographs."""
    if modality == "sar" and len(x) >= 2:
        return np.stack([x[0], x[1], x[0] / (np.abs(x[1]) + EPS)])
    if modality == "multispectral" and len(x) > max(RGB_BANDS):
        return x[list(RGB_BANDS)]
    return np.repeat(x[:1], 3, 0) if len(x) < 3 else x[:3]


def preview(x: np.ndarray, modality: str) -> np.ndarray:
    """Three planes of 0 to 255 to look at."""
    if modality == "sar":
        x = ensure_channels(x, 2)
        planes = np.stack([x[0], x[1], x[0] - x[1]])
    elif modality == "multispectral" and len(x) > max(RGB_BANDS):
        planes = x[list(RGB_BANDS)]
    else:
        planes = np.repeat(x[:1], 3, 0) if len(x) < 3 else x[:3]
    return np.floor(stretch(planes) * 255 + 0.5).astype(np.float32)


def as_chw(x: np.ndarray) -> np.ndarray:
    """Axes of a decoded array: a vector becomes (n, 1, 1), height-width-channels is turned."""
    x = np.asarray(x, np.float32)
    if x.ndim == 1:
        return x[:, None, None]
    if x.ndim == 2:
        return x[None]
    if x.ndim != 3:
        raise ValueError(f"an image has one to three axes, not {x.ndim}")
    return x.transpose(2, 0, 1) if x.shape[2] <= 16 < x.shape[0] or (x.shape[2] in (1, 3, 4) and x.shape[0] not in (1, 2, 3, 4, 13)) else x


# features ---------------------------------------------------------------------------------


def _cells(n: int, g: int) -> list[tuple[int, int]]:
    edge = [n * k // g for k in range(g + 1)]
    return [(a, max(b, a + 1)) for a, b in zip(edge, edge[1:])]


def descriptor(x: np.ndarray, grids: tuple[int, ...] = (1, 2, 4), pairs: int = 64) -> np.ndarray:
    """Cell means and deviations on several grids, gradient energy, channel correlations, log-scaled."""
    x = np.nan_to_num(np.asarray(x, np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    out = []
    for g in grids:
        for y0, y1 in _cells(x.shape[1], g):
            for x0, x1 in _cells(x.shape[2], g):
                cell = x[:, y0:y1, x0:x1].reshape(len(x), -1)
                out += [cell.mean(1) if cell.size else np.zeros(len(x)), cell.std(1) if cell.size else np.zeros(len(x))]
    for axis in (2, 1):
        out.append(np.abs(np.diff(x, axis=axis)).mean((1, 2)) if x.shape[axis] > 1 else np.zeros(len(x)))
    flat = x.reshape(len(x), -1)
    flat = (flat - flat.mean(1, keepdims=True)) / (flat.std(1, keepdims=True) + EPS)
    corr = (flat @ flat.T / flat.shape[1])[np.triu_indices(len(x), 1)][:pairs]
    out.append(np.pad(corr, (0, pairs - len(corr))))
    v = np.concatenate(out)
    return np.sign(v) * np.log1p(np.abs(v))


def projection(width: int, dim: int, seed: int = 1234) -> np.ndarray:
    """A fixed Gaussian projection for descriptors of this width."""
    return np.random.default_rng([seed, width]).standard_normal((width, dim)) / np.sqrt(dim)


def embed(x: np.ndarray, dim: int = 256, seed: int = 1234, grids: tuple[int, ...] = (1, 2, 4)) -> np.ndarray:
    v = descriptor(x, grids)
    y = v @ projection(len(v), dim, seed)
    return y / max(float(np.sqrt(y @ y)), 1e-12)
