"""Random changes of images for training; every function takes (image, generator).

A generator is seeded from the row (``seed_of``), so results do not depend on partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from prismlake.functions.images import despeckle, resize

Change = Callable[[np.ndarray, np.random.Generator], np.ndarray]

#: Magnitude of the changes, and how likely geometric and photometric ones are.
STRENGTH = {"none": (0.0, 0.0, 0.0), "light": (0.5, 0.5, 0.3), "medium": (1.0, 0.7, 0.5), "strong": (1.5, 0.9, 0.8)}
#: Weights of red, green and blue in the luma.
LUMA = np.array([0.299, 0.587, 0.114])
#: Places of red and near infrared among the thirteen bands.
RED, INFRARED = 3, 7


def seed_of(seed: int, row_id: str, epoch: int = 0) -> np.random.Generator:
    return np.random.default_rng([seed, epoch, zlib.crc32(str(row_id).encode())])


def chain(*changes: Change) -> Change:
    def run(x, rng):
        for change in changes:
            x = change(x, rng)
        return x.astype(np.float32)

    return run


def sometimes(change: Change, p: float) -> Change:
    return lambda x, rng: change(x, rng) if rng.random() < p else x


# radar (decibels) -------------------------------------------------------------------------


def gamma_speckle(x, rng, looks=(1, 2, 4, 8), decibels=True):
    """Speckle of mean one that multiplies intensities, and so adds to decibels."""
    n = rng.choice(looks)
    field = np.maximum(rng.gamma(n, 1 / n, x.shape), 1e-6)
    return x + 10 * np.log10(field) if decibels else x * field


def additive_speckle(x, rng, sigma=1.0):
    return x + rng.normal(0, sigma, x.shape)


def decibel_jitter(x, rng, shift=1.5, scale=0.05):
    gain = 1 + rng.uniform(-scale, scale, (len(x), 1, 1))
    return x * gain + rng.uniform(-shift, shift, (len(x), 1, 1))


def drop_polarisation(x, rng):
    """One channel is replaced by a copy of another."""
    if len(x) < 2:
        return x
    out, (lost, kept) = x.copy(), rng.permutation(len(x))[:2]
    out[lost] = x[kept]
    return out


def random_despeckle(x, rng, size=7):
    return despeckle(x, size) if min(x.shape[1:]) > size // 2 else x


# optical ----------------------------------------------------------------------------------


def color_jitter(x, rng, brightness=0.3, contrast=0.3, saturation=0.2):
    x = x + rng.uniform(-brightness, brightness)
    mean = x.mean((1, 2), keepdims=True)
    x = mean + (x - mean) * (1 + rng.uniform(-contrast, contrast))
    if len(x) >= 3:
        gray = np.tensordot(LUMA, x[:3], 1)[None]
        x = np.concatenate([gray + (x[:3] - gray) * (1 + rng.uniform(-saturation, saturation)), x[3:]])
    return x


def grayscale(x, rng):
    if len(x) < 3:
        return x
    gray = np.tensordot(LUMA, x[:3], 1)
    return np.concatenate([np.repeat(gray[None], 3, 0), x[3:]])


def gaussian_blur(x, rng, sigmas=(0.3, 1.2)):
    """A Gaussian along either axis, the border mirrored."""
    sigma = rng.uniform(*sigmas)
    reach = max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (1, 2):
        n = x.shape[axis]
        places = _mirror(np.arange(-reach, n + reach), n)
        x = sum(w * np.take(x, places[i : i + n], axis) for i, w in enumerate(k))
    return x


def erase(x, rng, area=(0.02, 0.2), ratios=(0.3, 3.3)):
    """A rectangle of that share of the area takes the mean of its channel."""
    _, h, w = x.shape
    size, ratio = rng.uniform(*area) * h * w, rng.uniform(*ratios)
    eh, ew = min(h, round(np.sqrt(size * ratio))), min(w, round(np.sqrt(size / ratio)))
    out = x.copy()
    if eh and ew:
        y, z = rng.integers(0, h - eh + 1), rng.integers(0, w - ew + 1)
        out[:, y : y + eh, z : z + ew] = x.mean((1, 2), keepdims=True)
    return out


# multispectral ----------------------------------------------------------------------------


def drop_bands(x, rng, share=0.3):
    """Up to that share of the bands, one at least, may go to zero."""
    lost = rng.choice(len(x), int(rng.integers(0, max(1, int(len(x) * share)) + 1)), replace=False)
    out = x.copy()
    out[lost] = 0
    return out


def spectral_tube(x, rng, shares=(0.1, 0.3)):
    """A block of neighbouring bands goes to zero as a whole."""
    c = len(x)
    bands = min(c, max(1, round(rng.uniform(*shares) * c)))
    first = rng.integers(0, c - bands + 1)
    out = x.copy()
    out[first : first + bands] = 0
    return out


def band_gain(x, rng, gain=0.1, bias=0.05):
    n = (len(x), 1, 1)
    return x * (1 + rng.uniform(-gain, gain, n)) + rng.uniform(-bias, bias, n)


def ndvi_jitter(x, rng, red=RED, infrared=INFRARED, scale=0.1):
    """Red and near infrared get a gain each, by which vegetation looks another."""
    if len(x) <= max(red, infrared):
        return x
    out = x.copy()
    for band in (infrared, red):
        out[band] = x[band] * (1 + rng.uniform(-scale, scale))
    return out


# geometry ---------------------------------------------------------------------------------


def hflip(x, rng):
    return x[:, :, ::-1]


def vflip(x, rng):
    return x[:, ::-1]


def rot90(x, rng):
    return np.rot90(x, int(rng.integers(4)), (1, 2))


def _mirror(at: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * (n - 1))
    return np.where(at > n - 1, 2 * (n - 1) - at, at)


def small_rotation(x, rng, degrees=12.0):
    """Bilinear, the edge mirrored."""
    _, h, w = x.shape
    a = np.deg2rad(rng.uniform(-degrees, degrees))
    yy, xx = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = _mirror(cy + (yy - cy) * np.cos(a) - (xx - cx) * np.sin(a), h)
    sx = _mirror(cx + (yy - cy) * np.sin(a) + (xx - cx) * np.cos(a), w)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), sy - y0, sx - x0
    return x[:, y0, x0] * (1 - fy) * (1 - fx) + x[:, y1, x0] * fy * (1 - fx) + x[:, y0, x1] * (1 - fy) * fx + x[:, y1, x1] * fy * fx


def random_crop(x, rng, scale=(0.6, 1.0), ratios=(0.85, 1.18), size=None, tries=10):
    """A window of that share of the area and ratio of its sides, brought to a square of ``size``
    (the image's height); the square in the middle if no window drawn fits."""
    _, h, w = x.shape
    ch = cw = min(h, w)
    y, z = (h - ch) // 2, (w - cw) // 2
    for _ in range(tries):
        area, ratio = h * w * rng.uniform(*scale), np.exp(rng.uniform(*np.log(ratios)))
        wide, high = round(np.sqrt(area * ratio)), round(np.sqrt(area / ratio))
        if 0 < wide <= w and 0 < high <= h:
            z, y = rng.integers(0, w - wide + 1), rng.integers(0, h - high + 1)
            ch, cw = high, wide
            break
    return resize(x[:, y : y + ch, z : z + cw], size or h)


def geometric(strength: str = "medium") -> Change:
    """Flips, quarter turns, a small rotation and a crop, in this order."""
    m, p, _ = STRENGTH[strength]
    turn, crop = (lambda x, r: small_rotation(x, r, 12.0 * m)), (lambda x, r: random_crop(x, r, (1 - 0.4 * m, 1.0)))
    return chain(sometimes(hflip, p), sometimes(vflip, p), sometimes(rot90, p), sometimes(turn, 0.4 * p), sometimes(crop, 0.5 * p))


def photometric(modality: str, strength: str = "medium") -> Change:
    """What the sensor may do to an image; each change has a likelihood of its own."""
    m, _, p = STRENGTH[strength]
    if modality == "sar":
        changes = [(gamma_speckle, p), (lambda x, r: additive_speckle(x, r, 1.0 * m), 0.6 * p), (lambda x, r: decibel_jitter(x, r, 1.5 * m), p), (drop_polarisation, 0.4 * p), (random_despeckle, 0.3 * p)]
    elif modality == "optical_rgb":
        changes = [(lambda x, r: color_jitter(x, r, 0.3 * m, 0.3 * m, 0.2 * m), p), (grayscale, 0.3 * p), (lambda x, r: gaussian_blur(x, r, (0.3, max(0.3, 1.2 * m))), 0.5 * p), (erase, 0.5 * p)]
    elif modality == "multispectral":
        changes = [(drop_bands, 0.6 * p), (spectral_tube, 0.5 * p), (lambda x, r: band_gain(x, r, 0.1 * m, 0.05 * m), p), (lambda x, r: ndvi_jitter(x, r, scale=0.1 * m), 0.4 * p)]
    else:
        changes = [(lambda x, r: band_gain(x, r, 0.05 * m, 0.03 * m), p)]
    return chain(*[sometimes(change, likely) for change, likely in changes])


def augmentation(modality: str, strength: str = "medium") -> Change:
    """Photometric changes, then geometric ones."""
    return chain(photometric(modality, strength), geometric(strength))


def paired(images: dict[str, np.ndarray], seed: int, row_id: str, epoch: int = 0, strength: str = "medium") -> dict[str, np.ndarray]:
    """Images of one place: the same geometry for all, other changes for each modality."""
    out = {}
    for modality, x in images.items():
        same = seed_of(seed, row_id, epoch)
        own = seed_of(seed + 1, f"{row_id}/{modality}", epoch)
        out[modality] = photometric(modality, strength)(geometric(strength)(x, same), own)
    return out


def drop_modalities(names: list[str], rng: np.random.Generator, p: float = 0.3, keep: int = 1) -> list[str]:
    """Names that survive, ``keep`` at least."""
    left = [n for n in names if rng.random() >= p]
    missing = [n for n in names if n not in left]
    while len(left) < min(keep, len(names)):
        left.append(missing.pop(int(rng.integers(len(missing)))))
    return [n for n in names if n in left]


def mixup(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, alpha: float = 0.4) -> tuple[np.ndarray, float]:
    """A mixture of two vectors or images, and the share of the first."""
    share = float(rng.beta(alpha, alpha))
    return share * a + (1 - share) * b, share
