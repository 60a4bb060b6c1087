"""The engine: extract, whiten, index, search, evaluate, in the order a configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators import ann, evaluation, heads, rerank, splits, whitening
from prismlake.operators.search import choose_strategy, search, with_hit_columns
from prismlake.runtime import stage_table
from prismlake.sources import readers, store, synthetic
from prismlake.sources.samples import derived_samples, prepare_gallery


class Engine:
    """Holds a configuration, an optional whitener and heads, and the indexed gallery."""

    def __init__(self, spark: SparkSession, config: store.Config | None = None, projection: heads.Heads | None = None):
        self.spark, self.config, self.projection = spark, config or store.Config(), projection
        self.extract, self.extractor = heads.extractor(self.config.extractor)
        self.whitener: whitening.Whitener | None = None
        self.gallery: DataFrame | None = None
        self.strategy: dict = {}
        self._cells: ann.CellIndex | None = None
        self._probes: dict[int, tuple[int, int | None]] = {}  # by k: probes, and the pool if there are codes

    def encode(self, samples: DataFrame, whiten: bool = True) -> DataFrame:
        """Samples with unit embeddings: extractor, head, then whitener."""
        out = self.extract(samples)
        if self.projection is not None:
            out = heads.project(out, self.projection)
        return whitening.transform(out, self.whitener) if whiten and self.whitener is not None else out

    def fit_whitener(self, samples: DataFrame) -> None:
        w = self.config.whitening
        if w.enabled:
            self.whitener = whitening.fit(self.encode(samples, whiten=False), w.by_modality, n_components=w.n_components, remove_top=w.remove_top, shrinkage=w.shrinkage)

    def index(self, samples: DataFrame) -> None:
        """Encode once and keep the result as a stored table, for any number of searches."""
        self.gallery = stage_table(prepare_gallery(self.encode(samples)), "gallery")
        size = self.gallery.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
        self.strategy = choose_strategy(size["n"], size["d"] or 0, self.config.search.strategy)
        if self.strategy["method"] == "ivf":
            self._probes = {}
            self._cells = ann.with_codes(ann.build(self.gallery, min(self.strategy["cells"], max(1, size["n"] // 32))), int(self.strategy["code"].removeprefix("pq")))

    def query(self, queries: DataFrame, k: int, encoded: bool = False, method: str | None = None, **filters) -> DataFrame:
        """Hits of samples (or, ``encoded``, of embeddings) with the gallery's columns."""
        if self.gallery is None:
            raise ValueError("index a gallery first")
        q = queries if encoded else self.encode(queries)
        method = method or self.config.search.rerank
        if self._cells is not None and method == "none" and "excluded" not in filters:
            if k not in self._probes:  # measured by the first queries
                probes = ann.enough_probes(q, self._cells, k, self.config.search.probes)
                self._probes[k] = probes, None if self._cells.coded is None else ann.enough_pool(q, self._cells, k, probes)
            probes, pool = self._probes[k]
            hits = ann.search(q, self._cells, k, probes, pool=pool, **filters)
        else:
            hits = rerank.search_with_rerank(q, self.gallery, k, self.config.search.pool, method, **filters)
        return with_hit_columns(hits, self.gallery)

    def evaluate(self, queries: DataFrame) -> dict[str, DataFrame]:
        e = self.config.evaluation
        per_query = stage_table(evaluation.query_metrics(self.encode(queries), self.gallery, e.ks, e.mode, e.same_location), "query-metrics")
        cells = evaluation.matrix(per_query)
        return {"cells": cells, "headline": evaluation.headline(cells)}


def load_samples(spark: SparkSession, config: store.Config) -> tuple[DataFrame, dict]:
    """Samples and where they come from; synthetic ones stand in only if the configuration allows it, and then say so."""
    d = config.data

    def made() -> DataFrame:
        return synthetic.embeddings(spark, d.classes, d.per_class, dim=d.dim, seed=config.seed, shift=d.shift)

    if d.name == "synthetic":
        return made(), {"asked": d.name, "used": "synthetic", "fallback": False}
    try:
        if d.name == "embeddings":
            return prepare_gallery(derived_samples(spark.read.parquet(d.root))), {"asked": d.name, "used": d.root, "fallback": False}
        return readers.load(spark, d.name, root=d.root), {"asked": d.name, "used": d.root, "fallback": False}
    except Exception as e:
        if not d.synthetic_fallback:
            raise
        return made(), {"asked": d.name, "used": "synthetic", "fallback": True, "because": str(e).splitlines()[0][:200]}


def run_evaluation(spark: SparkSession, config: store.Config | None = None) -> dict:
    """Load, split, fit, index, evaluate: cells, headline, a report and the provenance."""
    config = config or store.Config()
    samples, provenance = load_samples(spark, config)
    parts = stage_table(splits.query_gallery_split(samples, config.data.query_fraction, by_modality=True, balanced=config.data.balanced, seed=config.seed), "split")
    gallery = parts.where("part = 'gallery'").drop("part")
    queries = parts.where("part = 'query'").drop("part").withColumnRenamed("gallery_index", "query_id")
    engine = Engine(spark, config)
    engine.fit_whitener(gallery.unionByName(queries.withColumnRenamed("query_id", "gallery_index")) if config.whitening.fit_on_queries else gallery)
    engine.index(gallery)
    out = engine.evaluate(queries)
    return {**out, "report": evaluation.report(out["cells"], out["headline"], config.evaluation.ks), "provenance": {**provenance, "extractor": engine.extractor, "strategy": engine.strategy}}


def build_index(spark: SparkSession, config: store.Config, path: str) -> Engine:
    """Index all samples of a dataset and save the bundle."""
    samples, _ = load_samples(spark, config)
    engine = Engine(spark, config)
    engine.fit_whitener(samples)
    engine.index(samples)
    store.save_bundle(spark, path, config, engine.gallery, engine.whitener)
    return engine


def open_index(spark: SparkSession, path: str) -> Engine:
    config, gallery, whitener = store.load_bundle(spark, path)
    engine = Engine(spark, config)
    engine.gallery, engine.whitener = gallery, whitener
    return engine


def search_latency(engine: Engine, queries: DataFrame, k: int = 10, **runs) -> dict:
    """Encoding and search are timed apart."""
    encoded = stage_table(engine.encode(queries), "latency-queries")
    return {"encode": evaluation.latency(lambda: engine.encode(queries).count(), **runs), "search": evaluation.latency(lambda: search(encoded, engine.gallery, k).count(), **runs)}
