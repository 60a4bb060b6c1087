"""Galleries, models and configurations on disk: a bundle is a folder of Parquet and JSON."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators.hashing import Itq
from prismlake.operators.whitening import Whitener


def save_gallery(gallery: DataFrame, path: str) -> None:
    """Partitioned by modality, so that a search in one modality reads that folder only."""
    gallery.write.mode("overwrite").partitionBy("modality").parquet(path)


def load_gallery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _write_json(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", "true").text(path).first()["value"].strip()


def save_whitener(spark: SparkSession, model: Whitener, path: str) -> None:
    _write_json(spark, path, model.to_json())


def load_whitener(spark: SparkSession, path: str) -> Whitener:
    return Whitener.from_json(_read_json(spark, path))


def save_itq(spark: SparkSession, model: Itq, path: str) -> None:
    _write_json(spark, path, json.dumps({k: getattr(model, k).tolist() for k in ("mean", "projection", "rotation")}))


def load_itq(spark: SparkSession, path: str) -> Itq:
    return Itq(**{k: np.array(v) for k, v in json.loads(_read_json(spark, path)).items()})


def save_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


@dataclasses.dataclass
class Data:
    name: str = "embeddings"
    root: str = ""
    query_fraction: float = 0.2
    balanced: bool = True
    synthetic_fallback: bool = True
    classes: int = 10
    per_class: int = 20
    dim: int = 128
    shift: float = 2.5


@dataclasses.dataclass
class Whitening:
    enabled: bool = True
    by_modality: bool = True
    n_components: int | None = None
    remove_top: int = 0
    shrinkage: float = 0.9
    fit_on_queries: bool = False


@dataclasses.dataclass
class Search:
    strategy: str = "auto"
    rerank: str = "none"
    pool: int = 200
    probes: int = 8


@dataclasses.dataclass
class Evaluation:
    ks: list[int] = dataclasses.field(default_factory=lambda: [5, 10])
    mode: str = "raw"
    same_location: bool = True


@dataclasses.dataclass
class Config:
    """Unknown keys are an error, so that a misspelt option isn't lost."""

    extractor: str = "precomputed"
    seed: int = 0
    data: Data = dataclasses.field(default_factory=Data)
    whitening: Whitening = dataclasses.field(default_factory=Whitening)
    search: Search = dataclasses.field(default_factory=Search)
    evaluation: Evaluation = dataclasses.field(default_factory=Evaluation)

    @staticmethod
    def from_dict(values: dict) -> "Config":
        def fill(kind, given: dict):
            known = {f.name: f for f in dataclasses.fields(kind)}
            if extra := set(given) - set(known):
                raise ValueError(f"unknown options: {', '.join(sorted(extra))}")
            parts = {"data": Data, "whitening": Whitening, "search": Search, "evaluation": Evaluation} if kind is Config else {}
            return kind(**{k: fill(parts[k], v or {}) if k in parts else v for k, v in given.items()})

        return fill(Config, values or {})

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @staticmethod
    def from_yaml(text: str) -> "Config":
        import yaml

        return Config.from_dict(yaml.safe_load(text))

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)


def save_bundle(spark: SparkSession, path: str, config: Config, gallery: DataFrame, whitener: Whitener | None) -> None:
    save_gallery(gallery, f"{path}/gallery")
    _write_json(spark, f"{path}/config", json.dumps(config.to_dict()))
    if whitener is not None:
        save_whitener(spark, whitener, f"{path}/whitener")


def load_bundle(spark: SparkSession, path: str) -> tuple[Config, DataFrame, Whitener | None]:
    config = Config.from_dict(json.loads(_read_json(spark, f"{path}/config")))
    whitener = load_whitener(spark, f"{path}/whitener") if config.whitening.enabled else None
    return config, load_gallery(spark, f"{path}/gallery").withColumn("modality", F.coalesce(F.col("modality").cast("string"), F.lit(""))), whitener
