"""Losses, heads and the whole evaluation pipeline as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.functions.vectors import rounded
from prismlake.operators import evaluation, heads, losses, whitening
from prismlake.plans.views import SAMPLES, held_in, samples

QUERIES, ORACLES = {}, {}

#: All rows, in batches of 96, and all locations, in batches of 40.
BATCH = f"{SAMPLES}, batch as (select cast(gallery_index // 96 as int) as batch, gallery_index as row, u, label, modality from samples)"
PAIRED = f"""{SAMPLES}, paired as (select cast(place // 40 as int) as batch, place as row, u, modality from samples),
s as (select a.batch, a.row as i, b.row as j, list_inner_product(a.u, b.u) / 0.07 as z from paired a join paired b on a.batch = b.batch where a.modality = 'optical_rgb' and b.modality = 'sar')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _batch(spark, sf):
    return samples(spark, sf).withColumn("batch", F.expr("cast(gallery_index div 96 as int)")).withColumnRenamed("gallery_index", "row")


def _side(spark, sf, modality):
    place = F.col("location_id").cast("int")
    return samples(spark, sf).where(F.col("modality") == modality).select(F.floor(place / 40).cast("int").alias("batch"), place.alias("row"), "embedding")


def _loss(df):
    return df.select("batch", F.round("loss", 5).alias("loss"))


def _entropy(key: str) -> str:
    return f"select batch, avg(l) as x from (select batch, {key}, ln(sum(exp(z))) - sum(z) filter (i = j) as l from s group by batch, {key}) group by batch"


@query(f"with {PAIRED}, r as ({_entropy('i')}), c as ({_entropy('j')}) select batch, round((r.x + c.x) / 2, 5) as loss from r join c using (batch)")
def symmetric_infonce(spark, sf):
    return _loss(losses.symmetric_infonce(_side(spark, sf, "optical_rgb"), _side(spark, sf, "sar")))


@query(f"with {PAIRED} select batch, round(x, 5) as loss from ({_entropy('i')})")
def info_nce(spark, sf):
    return _loss(losses.info_nce(_side(spark, sf, "optical_rgb"), _side(spark, sf, "sar")))


@query(f"with {BATCH}, d as (select a.batch, a.row, a.label = b.label as same, a.modality <> b.modality as far, 1 - list_inner_product(a.u, b.u) as d from batch a join batch b on a.batch = b.batch and a.row <> b.row), e as (select batch, row, coalesce(max(d) filter (same and far), max(d) filter (same)) as p, coalesce(min(d) filter (not same and far), min(d) filter (not same)) as n from d group by batch, row) select batch, round(coalesce(avg(greatest(p - n + 0.1, 0)) filter (p is not null and n is not null), 0), 5) as loss from e group by batch")
def batch_hard_triplet(spark, sf):
    return _loss(losses.batch_hard_triplet(_batch(spark, sf)))


@query(f"with {BATCH}, d as (select a.batch, a.row, a.label = b.label as same, list_inner_product(a.u, b.u) as s from batch a join batch b on a.batch = b.batch and a.row <> b.row), e as (select row, max(s) filter (not same) as hn, min(s) filter (same) as lp from d group by row), t as (select batch, row, ln(1 + coalesce(sum(exp(-2 * (s - 0.5))) filter (same and s - 0.1 < hn), 0)) as p, ln(1 + coalesce(sum(exp(50 * (s - 0.5))) filter (not same and s + 0.1 > lp), 0)) as n from d join e using (row) where hn is not null and lp is not null group by batch, row) select batch, round(coalesce(avg(p / 2 + n / 50) filter (p > 0 and n > 0), 0), 5) as loss from batch left join t using (batch, row) group by batch")
def multi_similarity(spark, sf):
    return _loss(losses.multi_similarity(_batch(spark, sf)))


def _prototypes(rows):
    """The mean of each class in each modality: several for a class."""
    long = rows.select("label", "modality", F.posexplode("embedding").alias("k", "x")).groupBy("label", "modality", "k").agg(F.avg("x").alias("x"))
    return long.groupBy("label", "modality").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("embedding"))


@query(f"""with {BATCH},
w as (select label as c, list(x order by k) as w from (select label, modality, k, avg(x) as x from (select label, modality, unnest(u) as x, generate_subscripts(u, 1) as k from samples) group by all) group by label, modality),
cosines as (select b.batch, b.row, b.label, w.c, greatest(least(max(list_inner_product(b.u, w.w) / sqrt(list_inner_product(w.w, w.w))), 1), -1) as x from batch b, w group by all),
z as (select batch, row, label = c as own, 64 * case when label <> c then x when x > cos(pi() - 0.5) then cos(acos(x) + 0.5) else x - sin(pi() - 0.5) * 0.5 end as z from cosines),
top as (select batch, row, max(z) as m from z group by batch, row)
select batch, round(avg(l), 5) as loss from (select batch, row, any_value(m) + ln(sum(exp(z - m))) - max(z) filter (own) as l from z join top using (batch, row) group by batch, row) group by batch""")
def sub_center_arcface(spark, sf):
    return _loss(losses.sub_center_arcface(_batch(spark, sf), _prototypes(samples(spark, sf))))


@query(f"""with {BATCH},
s as (select a.batch, a.row as q, b.row as i, list_inner_product(a.u, b.u) as s, a.label = b.label and a.row <> b.row as pos from batch a join batch b on a.batch = b.batch),
ranks as (select x.batch, x.q, x.i, 1 + coalesce(sum(1 / (1 + exp(-(y.s - x.s) / 0.01))), 0) as everyone, 1 + coalesce(sum(1 / (1 + exp(-(y.s - x.s) / 0.01))) filter (y.pos), 0) as positives
  from s x left join s y on y.batch = x.batch and y.q = x.q and y.i <> x.i where x.pos group by x.batch, x.q, x.i),
ap as (select batch, q, avg(positives / everyone) as ap from ranks group by batch, q)
select batch, round(coalesce(avg(1 - ap), 0), 5) as loss from (select distinct batch from batch) left join ap using (batch) group by batch""")
def smooth_average_precision(spark, sf):
    return _loss(losses.smooth_average_precision(_batch(spark, sf)))


@query()
def projected_headline(spark, sf):
    q, g = held_in(spark, sf)
    model = heads.train_heads(g, d_out=16, hidden=32, steps=20)
    q, g = heads.project(q, model), heads.project(g, model)
    whitener = whitening.fit(g, shrinkage=0.1)
    return evaluation.evaluate(whitening.transform(q, whitener), whitening.transform(g, whitener), [5, 10])["headline"]


@query(f"with {SAMPLES}, p as (select a.location_id, list_concat(a.u, b.u) as v from samples a join samples b on a.location_id = b.location_id where a.modality = 'sar' and b.modality = 'optical_rgb') select location_id, [round(x / sqrt(list_inner_product(v, v)), 6) for x in v] as embedding from p")
def joint_embeddings(spark, sf):
    return heads.joint(samples(spark, sf)).select("location_id", rounded("embedding").alias("embedding"))
