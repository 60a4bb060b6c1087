"""Relational helpers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.operators import splits, tables
from prismlake.plans.views import SAMPLES, samples
from prismlake.runtime import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select doc_id, source, cast(dense_rank() over (order by source) - 1 as int) as class_index from documents")
def class_codes(spark, sf):
    return tables.encode_classes(table(spark, sf, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "class_index")


@query("with c as (select source, cast(n_chars % 7 as int) as v, count(*) as n from documents where n_chars % 7 <> 0 group by all) select source, v from (select *, row_number() over (partition by source order by n desc, v) as rn from c) where rn = 1")
def majority_vote(spark, sf):
    docs = table(spark, sf, "documents").select("source", (F.col("n_chars") % 7).cast("int").alias("v"))
    return tables.majority(docs, "source", "v")


@query("select o_orderkey, case cast(o_orderkey % 20 as int) when 1 then 1 when 2 then 1 when 3 then 1 when 4 then 1 when 5 then 1 when 6 then 2 when 7 then 2 when 8 then 3 when 9 then 3 when 10 then 4 when 11 then 5 when 12 then 6 when 13 then 7 when 14 then 6 when 15 then 8 when 16 then 9 when 17 then 10 else 0 end as cover from orders")
def remapped_cover(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tables.remap(F.col("o_orderkey") % 20).alias("cover"))


@query("select page_id, regexp_extract(regexp_replace('S1_roi_' || page_id || '_p' || (page_id % 9) || '.tif', '\\.[^.]*$', ''), '([^_]+_[^_]+)$', 1) as key from pages")
def patch_keys(spark, sf):
    name = F.concat(F.lit("x/S1_roi_"), F.col("page_id"), F.lit("_p"), F.col("page_id") % 9, F.lit(".tif"))
    return table(spark, sf, "pages").select("page_id", tables.patch_key(name, ["s1"]).alias("key"))


@query("select d.doc_id, d.n_chars, coalesce(l.quality, -1) as quality from documents d join (select doc_id from documents where lang = 'en') e using (doc_id) left join labels l using (doc_id)")
def paired_patches(spark, sf):
    docs = table(spark, sf, "documents")
    as_patch = lambda df, *cols: df.select(F.lit("r").alias("roi"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), *cols)
    cover = as_patch(table(spark, sf, "labels"), F.col("quality"))
    out = tables.paired_patches(as_patch(docs, "doc_id", "n_chars"), as_patch(docs.where("lang = 'en'")), cover)
    return out.select("doc_id", "n_chars", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("with kv as (select lang as key, sum(n_chars) as s from documents group by lang), n as (select count(*) as c from documents) select key, round(s / c, 6) as mean from kv, n")
def mean_of_logs(spark, sf):
    logs = table(spark, sf, "documents").select(F.create_map("lang", F.col("n_chars").cast("double")).alias("m"))
    return tables.mean_logs(logs, "m").withColumn("mean", F.round("mean", 6))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events where value is not null group by event_type")
def latency_percentiles(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    out = e.groupBy("event_type").agg(p.alias("p"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "mean", "least", "most")


@query(f"with {SAMPLES}, c as (select label, count(*) as n, count(distinct modality) as n_modalities from samples group by label having count(*) >= 2) select label, n, n_modalities from c where n_modalities >= 2 or not exists (select 1 from c where n_modalities >= 2)")
def eligible_classes(spark, sf):
    return splits.eligible_classes(samples(spark, sf))

