"""Feature extractors by name, ensembles, projection heads, low-rank updates, and their training."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import images
from prismlake.functions.vectors import concat_renorm, l2_normalize
from prismlake.operators import evaluation
from prismlake.operators.losses import log_softmax, np_unit

EXTRACTORS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}
ALIASES: dict[str, str] = {}


#: Extractors that need a deep-learning library and weights; asked for, they fall back and say why.
UNAVAILABLE = {name: "needs torch and pretrained weights" for name in ("dofa", "croma", "openclip", "remoteclip", "dinov2", "timm")}


def register(name: str, *aliases: str):
    def add(factory):
        EXTRACTORS[name] = factory
        ALIASES.update(dict.fromkeys(aliases, name))
        return factory

    return add


def extractor(name: str, fallback: bool = True, **options) -> tuple[Callable[[DataFrame], DataFrame], dict]:
    """A function from samples with an image to samples with an embedding, and what was chosen.

    A name that needs a library or weights that aren't there gives the ``statistics`` extractor
    if ``fallback``; the result says so. Unknown options are an error.
    """
    key = ALIASES.get(name.lower(), name.lower())
    if key in EXTRACTORS:
        return EXTRACTORS[key](**options), {"asked": name, "used": key, "fallback": False}
    if not fallback:
        raise KeyError(f"{name!r} {UNAVAILABLE.get(key, 'is not known')}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS["statistics"](), {"asked": name, "used": "statistics", "fallback": True, "because": UNAVAILABLE.get(key, "not known")}


@register("statistics", "fallback", "hashfeat", "offline", "numpy")
def statistics(dim: int = 256, seed: int = 1234, grids: tuple[int, ...] = (1, 2, 4)):
    """Pooled statistics with a fixed projection: needs no weights."""

    def run(df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c != "image"]
        out = images.map_images(df, lambda x: images.embed(x, dim, seed, grids), out="array<double>")
        return out.select(*names, F.col("image").alias("embedding"))

    return run


@register("precomputed", "flatten")
def precomputed():
    """The image's own values, or an embedding that is there already, at unit length."""

    def run(df: DataFrame) -> DataFrame:
        source = "embedding" if "embedding" in df.columns else "image.data"
        keep = [c for c in df.columns if c not in ("image", "embedding")]
        return df.select(*keep, l2_normalize(F.col(source)).alias("embedding"))

    return run


def ensemble(members: list[DataFrame], key: str = "id", weights: list[float] | None = None) -> DataFrame:
    """key, embedding: members joined by key, concatenated with weights; rows that all members have."""
    out = members[0].select(key, F.col("embedding").alias("_e0"))
    for i, m in enumerate(members[1:], 1):
        out = out.join(m.select(key, F.col("embedding").alias(f"_e{i}")), key)
    return out.select(key, concat_renorm([f"_e{i}" for i in range(len(members))], weights).alias("embedding"))


def joint(df: DataFrame, a: str = "sar", b: str = "optical_rgb", weights: list[float] | None = None) -> DataFrame:
    """location_id, embedding: one vector for each place that both modalities have seen."""
    side = lambda m: df.where((F.col("modality") == m) & F.col("location_id").isNotNull()).groupBy("location_id").agg(F.min_by("embedding", "gallery_index").alias("embedding"))
    return ensemble([side(a), side(b)], "location_id", weights)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


class Heads:
    """A linear layer for each modality, GELU, and a last linear layer that all share or, without
    ``share``, one for each modality; unit length at the end.

    ``weights`` maps (layer, modality) to an array: "first", "first_bias", and "shared",
    "shared_bias" (modality "") or "last", "last_bias". A modality without a head takes the first
    one's.
    """

    def __init__(self, weights: dict[tuple[str, str], np.ndarray]):
        self.weights = weights

    @staticmethod
    def random(modalities: list[str], d_in: int, hidden: int, d_out: int, seed: int = 0, share: bool = True) -> "Heads":
        r = np.random.default_rng(seed)
        layers = [("first", m, d_in, hidden) for m in modalities] + [("shared", "", hidden, d_out)] * share + [("last", m, hidden, d_out) for m in modalities] * (not share)
        out = {}
        for name, m, n, size in layers:
            out[name, m], out[f"{name}_bias", m] = r.standard_normal((n, size)) / np.sqrt(n), np.zeros(size)
        return Heads(out)

    @property
    def first(self) -> dict[str, np.ndarray]:
        return {m: w for (name, m), w in self.weights.items() if name == "first"}

    @property
    def shared(self) -> np.ndarray | None:
        return self.weights.get(("shared", ""))

    def keys(self, modality: str) -> tuple[tuple[str, str], tuple[str, str]]:
        """The first and the last layer of a modality."""
        known = self.first
        m = modality if modality in known else next(iter(known))
        return ("first", m), ("shared", "") if self.shared is not None else ("last", m)

    def linear(self, x: np.ndarray, key: tuple[str, str]) -> np.ndarray:
        return x @ self.weights[key] + self.weights[f"{key[0]}_bias", key[1]]

    def apply(self, x: np.ndarray, modality: str) -> np.ndarray:
        first, last = self.keys(modality)
        return np_unit(self.linear(gelu(self.linear(x, first)), last))

    def to_dict(self) -> dict[str, dict[str, list]]:
        """Lists by layer and modality, for JSON."""
        out: dict[str, dict[str, list]] = {}
        for (name, m), w in self.weights.items():
            out.setdefault(name, {})[m] = w.tolist()
        return out

    @staticmethod
    def from_dict(d: dict[str, dict[str, list]]) -> "Heads":
        return Heads({(name, m): np.array(w) for name, of in d.items() for m, w in of.items()})


def project(df: DataFrame, heads: Heads) -> DataFrame:
    """``df`` with its embeddings passed through the head of their modality."""
    names = df.columns
    at, mod = names.index("embedding"), names.index("modality")
    shared = df.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            kinds = np.array(batch.column(mod).to_pylist(), object)
            out: list = [None] * len(x)
            for m in set(kinds.tolist()):
                on = np.flatnonzero(kinds == m)
                for i, y in zip(on.tolist(), shared.value.apply(x[on], m).tolist()):
                    out[i] = y
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in df.schema)
    return df.where("embedding is not null").mapInArrow(run, schema)


def low_rank_merge(weight: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """W + alpha / r B A, for A of r rows."""
    return weight + (alpha / len(a)) * (b @ a)


class LowRank:
    """A layer that stays as it is plus an update of rank ``r`` that is learned: x W' + b + alpha / r x A' B'.

    B starts at zero, so that the update does; ``alpha`` is ``r`` if not given.
    """

    def __init__(self, weight: np.ndarray, bias: np.ndarray | None = None, r: int = 8, alpha: float | None = None, seed: int = 0):
        self.weight, self.bias, self.alpha = weight, bias, float(r if alpha is None else alpha)
        self.a = np.random.default_rng(seed).standard_normal((r, weight.shape[1])) / np.sqrt(weight.shape[1])
        self.b = np.zeros((weight.shape[0], r))

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.weight.T + (self.alpha / len(self.a)) * (x @ self.a.T) @ self.b.T
        return out if self.bias is None else out + self.bias

    def merged(self) -> np.ndarray:
        return low_rank_merge(self.weight, self.a, self.b, self.alpha)


def train_heads(
    df: DataFrame,
    d_out: int = 64,
    hidden: int = 128,
    steps: int = 200,
    batch: int = 256,
    rate: float = 0.01,
    temperature: float = 0.07,
    sample: int = 20_000,
    seed: int = 0,
    dropout: float = 0.1,
    share: bool = True,
    start: Heads | None = None,
    frozen: tuple[str, ...] = (),
    validate: tuple[DataFrame, DataFrame] | None = None,
    every: int = 50,
    history: list | None = None,
) -> Heads:
    """Heads trained with a supervised contrastive loss and Adam on at most ``sample`` labelled rows.

    The sample (the rows with the least hash) and the weights go through the driver, since no
    library for distributed training is at hand; the bound is the parameter. ``start`` is trained
    on, in a copy; layers named in ``frozen`` stay as they are. ``history`` gets a row of each ``every``
    steps and of the last: step, loss and, with ``validate`` (queries, gallery), the means of
    the evaluation by kind.
    """
    rows = df.where("label >= 0 and embedding is not null").orderBy(F.xxhash64(F.lit(seed), "gallery_index"), "gallery_index").limit(sample).select("modality", "label", F.col("embedding").cast("array<double>")).toArrow()
    x = np.array(rows.column("embedding").to_pylist())
    kinds, labels = np.array(rows.column("modality").to_pylist(), object), np.array(rows.column("label").to_pylist())
    heads = Heads.random(sorted(set(kinds.tolist())), x.shape[1], hidden, d_out, seed, share) if start is None else Heads({k: w.copy() for k, w in start.weights.items()})
    unknown = set(frozen) - {name for name, _ in heads.weights}
    if unknown:
        raise ValueError(f"no layer is named {', '.join(sorted(unknown))}")
    rng, masks = np.random.default_rng(seed), np.random.default_rng([seed, 1])
    moment = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in heads.weights.items()}
    for step in range(1, steps + 1):
        i = rng.choice(len(x), min(batch, len(x)), replace=False)
        width = heads.weights[heads.keys("")[0]].shape[1]
        keep = (masks.random((len(i), width)) >= dropout) / (1 - dropout) if dropout else None
        grad, loss = _contrastive_step(heads, x[i], kinds[i], labels[i], temperature, keep)
        for k, g in grad.items():
            if k[0] in frozen:
                continue
            m, v = moment[k]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            heads.weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if history is not None and (step % every == 0 or step == steps):
            scores = {}
            if validate is not None:
                found = evaluation.evaluate(project(validate[0], heads), project(validate[1], heads))["headline"]
                scores = {r["kind"]: {n: r[n] for n in found.columns if n.startswith("mean_")} for r in found.collect()}
            history.append({"step": step, "loss": loss, **scores})
    return heads


def _contrastive_gradient(heads: Heads, x: np.ndarray, kinds: np.ndarray, labels: np.ndarray, temperature: float) -> dict:
    return _contrastive_step(heads, x, kinds, labels, temperature)[0]


def _contrastive_step(heads: Heads, x: np.ndarray, kinds: np.ndarray, labels: np.ndarray, temperature: float, keep: np.ndarray | None = None) -> tuple[dict, float]:
    """Gradients of all layers that the rows touch, and the loss; ``keep`` scales hidden values."""
    on = {m: np.flatnonzero(kinds == m) for m in set(kinds.tolist())}
    keys = {m: heads.keys(m) for m in on}
    first, last = (next(heads.weights[k[at]] for k in keys.values()) for at in (0, 1))
    h, y = np.zeros((len(x), first.shape[1])), np.zeros((len(x), last.shape[1]))
    for m, rows in on.items():
        h[rows] = heads.linear(x[rows], keys[m][0])
    a = gelu(h) if keep is None else gelu(h) * keep
    for m, rows in on.items():
        y[rows] = heads.linear(a[rows], keys[m][1])
    length = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    z = y / length
    logits = z @ z.T / temperature
    np.fill_diagonal(logits, -1e9)
    same = (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    n = np.maximum(same.sum(1, keepdims=True), 1)
    has = same.any(1, keepdims=True)
    log_share, with_same = log_softmax(logits), max(int(has.sum()), 1)
    d = (np.exp(log_share) - same / n) * has / with_same / temperature
    dz = (d + d.T) @ z
    dy = (dz - (dz * z).sum(1, keepdims=True) * z) / length
    t = np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3))
    slope = 0.5 * (1 + t) + 0.5 * h * (1 - t * t) * np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * h * h)
    if keep is not None:
        slope *= keep
    out: dict = {}

    def add(key, left, right):
        for k, g in ((key, left.T @ right), ((f"{key[0]}_bias", key[1]), right.sum(0))):
            out[k] = out[k] + g if k in out else g

    for m, rows in on.items():
        add(keys[m][1], a[rows], dy[rows])
        add(keys[m][0], x[rows], (dy[rows] @ heads.weights[keys[m][1]].T) * slope[rows])
    return out, float(-((log_share * same).sum(1) / n[:, 0]).sum() / with_same)
