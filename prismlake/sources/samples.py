"""The data model: modalities, their dimension tables, and galleries of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.vectors import l2_normalize

#: Modality and number of channels (0: any).
MODALITIES = {"optical_rgb": 3, "multispectral": 13, "sar": 2, "hyperspectral": 0, "dem": 1}

#: Bands, means, deviations and clip windows used to standardise images.
BAND_STATS = {
    "optical_rgb": [("R", 0.485, 0.229), ("G", 0.456, 0.224), ("B", 0.406, 0.225)],
    "multispectral": [
        ("B1", 0.130, 0.045), ("B2", 0.110, 0.050), ("B3", 0.100, 0.055), ("B4", 0.095, 0.070), ("B5", 0.110, 0.070), ("B6", 0.160, 0.080), ("B7", 0.185, 0.090),
        ("B8", 0.195, 0.095), ("B8A", 0.205, 0.100), ("B9", 0.130, 0.060), ("B10", 0.040, 0.030), ("B11", 0.155, 0.090), ("B12", 0.105, 0.075),
    ],
    "sar": [("VV", -11.5, 5.0), ("VH", -18.0, 5.0)],
    "dem": [("elevation", 500.0, 700.0)],
}
SAR_CLIP = [(-23.0, 0.0), (-28.0, -5.0)]
RGB_BANDS = (3, 2, 1)

SAMPLE_COLUMNS = ["gallery_index", "id", "embedding", "modality", "label", "location_id"]


def check_modality(name: str) -> str:
    """The name of a modality; anything else is an error."""
    value = str(getattr(name, "value", name)).lower()
    if value not in MODALITIES:
        raise ValueError(f"{name!r} is none of {', '.join(MODALITIES)}")
    return value


def modality_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODALITIES.items()), "modality string, channels int")


def band_table(spark: SparkSession) -> DataFrame:
    """modality, band (from 0), name, mean, std, clip_lo, clip_hi: a dimension of a few rows."""
    rows = []
    for modality, bands in BAND_STATS.items():
        for k, (name, mean, std) in enumerate(bands):
            low, high = SAR_CLIP[k] if modality == "sar" else (None, None)
            rows.append((modality, k, name, mean, std, low, high))
    return spark.createDataFrame(rows, "modality string, band int, name string, mean double, std double, clip_lo double, clip_hi double")


def normalization(modality: str, channels: int) -> tuple[list[float], list[float]]:
    """Means and deviations; zeros and ones if the modality has none for so many channels."""
    bands = BAND_STATS.get(modality, [])
    if len(bands) != channels:
        return [0.0] * channels, [1.0] * channels
    return [b[1] for b in bands], [b[2] for b in bands]


def prepare_gallery(df: DataFrame, normalize: bool = True) -> DataFrame:
    """A gallery with every column of the model: label -1, modality "" and id by default.

    ``gallery_index`` must be there: row order means nothing here, so the caller numbers rows.
    """
    if "gallery_index" not in df.columns:
        raise ValueError("number the rows: gallery_index is missing")
    have = set(df.columns)
    pick = {
        "gallery_index": F.col("gallery_index").cast("long"),
        "id": F.col("id").cast("string") if "id" in have else F.col("gallery_index").cast("string"),
        "embedding": l2_normalize("embedding") if normalize else F.col("embedding"),
        "modality": F.coalesce(F.col("modality"), F.lit("")) if "modality" in have else F.lit(""),
        "label": F.coalesce(F.col("label").cast("int"), F.lit(-1)) if "label" in have else F.lit(-1),
        "location_id": F.col("location_id").cast("string") if "location_id" in have else F.lit(None).cast("string"),
    }
    return df.select(*[c.alias(n) for n, c in pick.items()])


def derived_samples(embeddings: DataFrame) -> DataFrame:
    """The driver's ``embeddings`` as samples of three modalities that share locations."""
    name = F.element_at(F.array(F.lit("optical_rgb"), F.lit("multispectral"), F.lit("sar")), (F.col("vec_id") % 3 + 1).cast("int"))
    return embeddings.select(
        F.col("vec_id").alias("gallery_index"),
        F.col("vec_id").cast("string").alias("id"),
        "embedding",
        name.alias("modality"),
        F.col("label").cast("int").alias("label"),
        F.expr("cast(vec_id div 3 as string)").alias("location_id"),
    )


def is_query():
    """The default split: whole locations, three of ten."""
    return F.expr("cast(location_id as bigint) % 10 < 3")
