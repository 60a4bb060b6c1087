"""The driver's tables as samples, queries and galleries; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.runtime import table
from prismlake.sources.samples import derived_samples, is_query, prepare_gallery


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_gallery(derived_samples(table(spark, sf_dir, "embeddings")))


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("gallery_index", "query_id")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, gallery): disjoint locations."""
    rows = samples(spark, sf_dir)
    return as_queries(rows.where(is_query())), rows.where(~is_query())


def held_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, gallery): the queries are in the gallery, so that exclusions matter."""
    rows = samples(spark, sf_dir)
    return as_queries(rows.where(is_query())), rows


def probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, gallery): every row whose number is divisible by 100, against all rows."""
    rows = samples(spark, sf_dir)
    return as_queries(rows.where("gallery_index % 100 = 0")), rows


#: Common table expressions for DuckDB.
BASE = """
samples as (
  select gallery_index, cast(gallery_index as varchar) as id, label, modality, cast(place as varchar) as location_id, place,
    list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) as u, e
  from (select vec_id as gallery_index, embedding::double[] as e, label, vec_id // 3 as place,
    case vec_id % 3 when 0 then 'optical_rgb' when 1 then 'multispectral' else 'sar' end as modality from embeddings))"""
_QUERIES = ",\nqueries as (select gallery_index as query_id, * exclude (gallery_index) from samples where "
SAMPLES = BASE + _QUERIES + "place % 10 < 3)"
SPLIT = SAMPLES + ",\ngallery as (select * from samples where place % 10 >= 3)"
PROBE = BASE + _QUERIES + "gallery_index % 100 = 0),\ngallery as (select * from samples)"
HELD_IN = SAMPLES + ",\ngallery as (select * from samples)"


def scored(where: str = "true") -> str:
    return f"scored as (select q.query_id, g.gallery_index, g.modality as g_modality, g.label, q.modality as q_modality, q.label as query_label, round(list_inner_product(q.u, g.u), 6) as score from queries q, gallery g where {where})"


def top(k: int, by: str = "query_id") -> str:
    return f"hits as (select * from (select *, row_number() over (partition by {by} order by score desc, gallery_index) - 1 as rank from scored) where rank < {k})"
