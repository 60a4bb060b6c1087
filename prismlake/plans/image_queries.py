"""Images, bands and features as queries; the image of a row is its vector as 4 x 4 x 4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import augment, images
from prismlake.operators import heads
from prismlake.plans.views import samples
from prismlake.runtime import table
from prismlake.sources import samples as model
from prismlake.sources import synthetic

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def image_rows(spark, sf) -> DataFrame:
    image = F.struct(F.lit(4).alias("c"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.col("raw").cast("array<float>").alias("data"))
    raw = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gallery_index"), F.col("embedding").alias("raw"))
    return samples(spark, sf).drop("embedding").join(raw, "gallery_index").withColumn("image", image).drop("raw")


PIXELS = """px as (select vec_id, cast((k - 1) // 16 as int) as band, (k - 1) % 16 // 4 as y, (k - 1) % 4 as x, v
  from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from embeddings))"""


def _pixels(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", F.expr("k div 16").cast("int").alias("band"), F.expr("k % 16 div 4").alias("y"), F.expr("k % 4").alias("x"), F.col("v").cast("double").alias("v"))


@query(f"with {PIXELS} select vec_id, band, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as deviation from px group by all")
def band_statistics(spark, sf):
    return _pixels(spark, sf).groupBy("vec_id", "band").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"))


@query(f"with {PIXELS}, p as (select vec_id, band, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from px where band < 3 group by all) select px.vec_id, cast(px.band as int) as band, px.y, px.x, round(least(greatest((v - lo) / (hi - lo), 0), 1), 5) as v from px join p on px.vec_id = p.vec_id and px.band = p.band where hi > lo")
def percentile_stretch(spark, sf):
    rows = images.map_images(image_rows(spark, sf).select("gallery_index", "image"), lambda x: images.stretch(x[:3].astype("float64")).ravel(), out="array<double>")
    out = rows.select(F.col("gallery_index").alias("vec_id"), F.posexplode("image").alias("k", "v"))
    return out.select("vec_id", F.expr("k div 16").cast("int").alias("band"), F.expr("cast(k % 16 div 4 as bigint)").alias("y"), F.expr("cast(k % 4 as bigint)").alias("x"), F.round("v", 5).alias("v"))


@query(f"with {PIXELS}, d as (select vec_id, band, abs(v - lag(v) over (partition by vec_id, band, y order by x)) as dx, abs(v - lag(v) over (partition by vec_id, band, x order by y)) as dy from px) select vec_id, band, round(avg(dx), 6) as dx, round(avg(dy), 6) as dy from d group by all")
def gradient_energy(spark, sf):
    from pyspark.sql import Window

    rows = _pixels(spark, sf)
    side = lambda a, b: F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("vec_id", "band", a).orderBy(b)))
    return rows.withColumn("dx", side("y", "x")).withColumn("dy", side("x", "y")).groupBy("vec_id", "band").agg(F.round(F.avg("dx"), 6).alias("dx"), F.round(F.avg("dy"), 6).alias("dy"))


@query(f"with {PIXELS} select a.vec_id, a.band as band_a, b.band as band_b, round(corr(a.v, b.v), 6) as correlation from px a join px b on a.vec_id = b.vec_id and a.y = b.y and a.x = b.x and a.band < b.band group by all")
def channel_correlation(spark, sf):
    a = _pixels(spark, sf).withColumnsRenamed({"band": "band_a", "v": "va"})
    b = _pixels(spark, sf).withColumnsRenamed({"band": "band_b", "v": "vb"})
    return a.join(b, ["vec_id", "y", "x"]).where("band_a < band_b").groupBy("vec_id", "band_a", "band_b").agg(F.round(F.corr("va", "vb"), 6).alias("correlation"))


@query(f"with {PIXELS} select vec_id, cast(band as int) as band, y, x, round(10 * log10(greatest(abs(v), 1e-6)), 4) as db from px")
def decibels(spark, sf):
    v = F.abs("v")
    return _pixels(spark, sf).select("vec_id", "band", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round(10 * F.log10(F.greatest(v, F.lit(1e-6))), 4).alias("db"))


@query("select modality, channels from (values ('optical_rgb', 3), ('multispectral', 13), ('sar', 2), ('hyperspectral', 0), ('dem', 1)) t(modality, channels)")
def modality_channels(spark, sf):
    return model.modality_table(spark)


@query("""select modality, band, name, mean, std, clip_lo, clip_hi from (values
  ('optical_rgb', 0, 'R', 0.485, 0.229, null, null), ('optical_rgb', 1, 'G', 0.456, 0.224, null, null), ('optical_rgb', 2, 'B', 0.406, 0.225, null, null),
  ('multispectral', 0, 'B1', 0.13, 0.045, null, null), ('multispectral', 1, 'B2', 0.11, 0.05, null, null), ('multispectral', 2, 'B3', 0.1, 0.055, null, null), ('multispectral', 3, 'B4', 0.095, 0.07, null, null),
  ('multispectral', 4, 'B5', 0.11, 0.07, null, null), ('multispectral', 5, 'B6', 0.16, 0.08, null, null), ('multispectral', 6, 'B7', 0.185, 0.09, null, null), ('multispectral', 7, 'B8', 0.195, 0.095, null, null),
  ('multispectral', 8, 'B8A', 0.205, 0.1, null, null), ('multispectral', 9, 'B9', 0.13, 0.06, null, null), ('multispectral', 10, 'B10', 0.04, 0.03, null, null), ('multispectral', 11, 'B11', 0.155, 0.09, null, null), ('multispectral', 12, 'B12', 0.105, 0.075, null, null),
  ('sar', 0, 'VV', -11.5::double, 5.0::double, -23.0::double, 0.0::double), ('sar', 1, 'VH', -18.0, 5.0, -28.0, -5.0), ('dem', 0, 'elevation', 500.0, 700.0, null, null)) t(modality, band, name, mean, std, clip_lo, clip_hi)""")
def band_statistics_dimension(spark, sf):
    return model.band_table(spark)


def _planes(spark, sf, run, digits: int, side: int = 4) -> DataFrame:
    """gallery_index, band, y, x, v: the pixels of ``run(image, modality)``, computed in doubles."""
    rows = images.map_images(image_rows(spark, sf).select("gallery_index", "modality", "image"), lambda x, m: run(x.astype("float64"), m).ravel(), extra=["modality"], out="array<double>")
    out = rows.select("gallery_index", F.posexplode("image").alias("k", "v"))
    return out.select("gallery_index", F.expr(f"k div {side * side}").cast("int").alias("band"), F.expr(f"cast(k % {side * side} div {side} as bigint)").alias("y"), F.expr(f"cast(k % {side} as bigint)").alias("x"), (F.round("v", digits) + 0.0).alias("v"))


#: Channels, decibels, size and units step by step; each pixel of the result mixes four of the image.
PREPROCESSED = f"""with {PIXELS},
bands as (select * from (values {", ".join(f"('{m}', {k}, {mean}::double, {std}::double)" for m in ("optical_rgb", "multispectral", "sar") for k, (_, mean, std) in enumerate(model.BAND_STATS[m]))}) t(modality, band, mean, std)),
chosen as (select i.vec_id, b.modality, b.band, b.mean, b.std, px.y, px.x, px.v from (select vec_id, case vec_id % 3 when 0 then 'optical_rgb' when 1 then 'multispectral' else 'sar' end as modality from embeddings) i
  join bands b on b.modality = i.modality join px on px.vec_id = i.vec_id and px.band = least(b.band, 3)),
filled as (select * exclude (v), case when band > 3 then 0.0 else v end as v from chosen),
radar as (select vec_id, avg(cast(v < -0.5 as int)) > 0.05 as is_db from filled where modality = 'sar' group by vec_id),
units as (select f.* exclude (v), case when f.modality = 'sar' and not r.is_db then 10 * log10(greatest(v, {images.EPS!r}::double)) else v end as v from filled f left join radar r using (vec_id)),
taps as (select i, cast(floor(spot) as int) + s as place, case s when 0 then 1 - (spot - floor(spot)) else spot - floor(spot) end as w from (select i, least(greatest((i + 0.5) / 2 - 0.5, 0), 3)::double as spot from range(8) t(i)), range(2) u(s)),
sized as (select vec_id, modality, band, mean, std, a.i as y, b.i as x, sum(v * a.w * b.w) as v from units join taps a on a.place = units.y join taps b on b.place = units.x group by all),
peaks as (select vec_id, max(v) as peak from sized group by vec_id),
scaled as (select sized.* exclude (v), case modality when 'sar' then case band when 0 then least(greatest(v, -23), 0) else least(greatest(v, -28), -5) end
    when 'multispectral' then case when peak > 1.5 then v / 10000 else v end
    else least(greatest(case when peak > 1.5 then v / case when peak <= 255.001 then 255 else peak end else v end, 0), 1) end as v from sized join peaks using (vec_id))
select vec_id as gallery_index, band, y, x, round((v - mean) / (std + {images.EPS!r}::double), 6) + 0.0 as v from scaled"""


@query(PREPROCESSED)
def preprocessed_images(spark, sf):
    return _planes(spark, sf, lambda x, m: images.preprocess(x, m, 8), 6, side=8)


def _planes_sql(third: str) -> str:
    """The three planes of an image by its modality; ``third`` is the last of a radar image."""
    return f"""{PIXELS},
wide as (select vec_id as gallery_index, vec_id % 3 as m, y, x, max(v) filter (band = 0) as b0, max(v) filter (band = 1) as b1, max(v) filter (band = 2) as b2, max(v) filter (band = 3) as b3 from px group by all),
planes as (
  select gallery_index, 0 as band, y, x, case m when 1 then b3 else b0 end as v from wide union all
  select gallery_index, 1, y, x, case m when 1 then b2 else b1 end from wide union all
  select gallery_index, 2, y, x, case m when 0 then b2 when 1 then b1 else {third} end from wide)"""


@query(f"""with {_planes_sql('b0 - b1')}, p as (select gallery_index, band, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from planes group by all)
select gallery_index, band, y, x, case when hi > lo then floor(least(greatest((v - lo) / (hi - lo), 0), 1) * 255 + 0.5) else 0.0 end as v from planes join p using (gallery_index, band)""")
def image_previews(spark, sf):
    return _planes(spark, sf, images.preview, 0)


@query(f"with {_planes_sql(f'b0 / (abs(b1) + {images.EPS!r}::double)')} select gallery_index, band, y, x, round(v, 6) + 0.0 as v from planes")
def pseudo_rgb_images(spark, sf):
    return _planes(spark, sf, images.pseudo_rgb, 6)


#: The filter pixel by pixel: nine neighbours, of which those beyond the edge are mirrored.
LEE = f"""with {PIXELS},
near as (select p.vec_id, p.band, p.y, p.x, p.v, n.v as w from px p, range(-1, 2) dy(i), range(-1, 2) dx(j)
  join px n on n.vec_id = p.vec_id and n.band = p.band and n.y = 3 - abs(3 - abs(p.y + i)) and n.x = 3 - abs(3 - abs(p.x + j))),
local as (select vec_id, band, y, x, v, avg(w) as mean, greatest(avg(w * w) - avg(w) ** 2, 0) as var from near group by all),
noise as (select vec_id, band, least(greatest((stddev_pop(v) / (avg(abs(v)) + {images.EPS!r}::double)) ** 2, 0.001), 1) as noise from px group by all)
select vec_id as gallery_index, band, y, x, round(mean + least(greatest((var - mean ** 2 * noise) / (var + {images.EPS!r}::double), 0), 1) * (v - mean), 6) + 0.0 as v from local join noise using (vec_id, band)"""


@query(LEE)
def despeckled_images(spark, sf):
    return _planes(spark, sf, lambda x, m: images.despeckle(x, 3), 6)


@query()
def augmented_images(spark, sf):
    return images.map_images(image_rows(spark, sf), lambda x, m, i: augment.augmentation(m)(x, augment.seed_of(7, i)), extra=["modality", "id"])


@query()
def statistic_features(spark, sf):
    run, _ = heads.extractor("statistics", dim=64)
    return run(image_rows(spark, sf))


@query()
def ensemble_features(spark, sf):
    run, _ = heads.extractor("statistics", dim=32)
    flat, _ = heads.extractor("precomputed")
    rows = image_rows(spark, sf)
    return heads.ensemble([run(rows), flat(rows)], weights=[0.5, 1.0])


@query()
def synthetic_images(spark, sf):
    return synthetic.images(spark, classes=4, per_class=3, size=16)


@query()
def synthetic_embeddings(spark, sf):
    return synthetic.embeddings(spark, classes=5, per_class=6, dim=32)
