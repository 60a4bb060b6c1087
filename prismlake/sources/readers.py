"""Image folders and single files as samples.

Files come through Spark's ``binaryFile`` source, so listing and reading are distributed and
any store that Spark reads will do. ``.npy`` arrays and binary PPM/PGM rasters are decoded
here; TIFF, PNG and JPEG need ``rasterio`` or ``PIL`` and give a clear error without them.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.images import IMAGE, as_chw, to_array, to_rgb, to_row
from prismlake.operators.splits import balanced_subset
from prismlake.operators.tables import encode_classes, majority, paired_patches, patch_key, remap
from prismlake.runtime import ship
from prismlake.sources.samples import check_modality

#: Endings of raster files.
ENDINGS = "{npy,ppm,pgm,tif,tiff,png,jpg,jpeg}"


class MissingData(FileNotFoundError):
    """A dataset that isn't where it should be; says what to do."""


def decode(content: bytes, path: str) -> np.ndarray:
    """Bytes of a raster file as a (channels, height, width) array of floats."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "npy":
        return as_chw(np.load(io.BytesIO(content), allow_pickle=False))
    if content[:2] in (b"P5", b"P6"):
        head, at = [], 2
        while len(head) < 3:
            end = at + 1
            while content[at : at + 1].isspace():
                at += 1
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            head.append(int(content[at:end]))
            at = end
        w, h, _ = head
        c = 3 if content[:2] == b"P6" else 1
        return np.frombuffer(content, np.uint8, w * h * c, at + 1).reshape(h, w, c).transpose(2, 0, 1).astype(np.float32)
    try:
        if ending in ("tif", "tiff"):
            from rasterio.io import MemoryFile

            with MemoryFile(content) as f, f.open() as raster:
                return raster.read().astype(np.float32)
        from PIL import Image

        return as_chw(np.asarray(Image.open(io.BytesIO(content))))
    except ImportError as e:
        raise ImportError(f"to decode {path} install rasterio (TIFF) or Pillow (PNG, JPEG)") from e


def query_image(content: bytes, path: str) -> np.ndarray:
    """An image to search with; values of 0 to 255 are brought to 0 to 1."""
    x = decode(content, path)
    return x / 255.0 if x.size and x.shape[1:] != (1, 1) and 1.5 < float(x.max()) <= 255.0 else x


def files(spark: SparkSession, root: str, endings: str = ENDINGS) -> DataFrame:
    """path, content of every raster below ``root``."""
    ship(spark)
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{endings}").load(root).select("path", "content")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingData(f"no folder {root}: download the dataset and give its place as root") from e
        raise


def decoded(df: DataFrame, function=None) -> DataFrame:
    """``df(path, content, ...)`` with ``image`` in place of content."""
    names = df.columns
    at, where = names.index("content"), names.index("path")
    kind = pa.struct([("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            made = []
            for content, path in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist()):
                x = decode(content, path)
                made.append(to_row(function(x) if function else x))
            columns = list(batch.columns)
            columns[at] = pa.array(made, kind)
            yield pa.RecordBatch.from_arrays(columns, [*names[:at], "image", *names[at + 1 :]])

    schema = ", ".join(f"`{'image' if f.name == 'content' else f.name}` {IMAGE if f.name == 'content' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """``root/<class>/<file>`` as path, content, class_name, label."""
    rows = files(spark, root).withColumn("class_name", F.element_at(F.split("path", "/"), -2))
    return encode_classes(rows, "class_name").withColumnRenamed("class_index", "label")


def folder_samples(spark: SparkSession, root: str, modality: str, function=None, location: Column | None = None) -> DataFrame:
    """A class folder as samples; ``location`` is an expression of ``path``."""
    check_modality(modality)
    rows = class_folders(spark, root).withColumn("location_id", (location if location is not None else F.lit(None)).cast("string"))
    return decoded(rows, function).select(F.col("path").alias("id"), "image", F.lit(modality).alias("modality"), "label", "location_id")


def derive_rgb(samples: DataFrame) -> DataFrame:
    """Each multispectral sample, and beside it the optical one made from its bands."""
    kinds = F.explode(F.array(F.lit("multispectral"), F.lit("optical_rgb")))
    twice = samples.where("modality = 'multispectral'").withColumn("_as", kinds)
    names = twice.columns
    at, kind = names.index("image"), names.index("_as")

    def run(batches):
        for batch in batches:
            made = [to_row(to_rgb(to_array(r))) if k == "optical_rgb" else r for r, k in zip(batch.column(at).to_pylist(), batch.column(kind).to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(made, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = twice.mapInArrow(run, twice.schema)
    return out.withColumn("modality", F.col("_as")).withColumn("id", F.when(F.col("_as") == "optical_rgb", F.concat("id", F.lit("#rgb"))).otherwise(F.col("id"))).drop("_as")


def scenes(spark: SparkSession, root: str, variant: str = "ms", rgb: bool = False) -> DataFrame:
    """Scene classification folders: multispectral stacks or photographs; one place per file stem."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = folder_samples(spark, root, "multispectral" if variant == "ms" else "optical_rgb", location=stem)
    return derive_rgb(rows) if rgb and variant == "ms" else rows


def triplets(spark: SparkSession, root: str, season: str | None = None, modalities: tuple[str, ...] = ("sar", "multispectral"), limit: int | None = None) -> DataFrame:
    """Patches of two sensors and a land-cover map: folders ``<roi>_s1``, ``<roi>_s2``, ``<roi>_lc``.

    A patch needs both sensors; its label is the most frequent land cover that isn't 0, or 0.
    """
    rows = files(spark, root)
    if season:
        rows = rows.where(F.lower("path").contains(season.lower()))
    folder = F.element_at(F.split("path", "/"), -2)
    rows = rows.withColumn("sensor", F.element_at(F.split(folder, "_"), -1)).withColumn("roi", F.regexp_replace(folder, "_[^_]*$", "")).withColumn("key", patch_key(F.col("path"), ["s1", "s2", "lc"]))
    side = lambda s: rows.where(F.col("sensor") == s).select("roi", "key", F.col("path").alias(s))
    chosen = paired_patches(side("s1"), side("s2"), side("lc"), limit)
    cover = decoded(rows.where("sensor = 'lc'").select("path", "content")).select("path", F.explode("image.data").alias("v")).withColumn("v", F.col("v").cast("int"))
    label = majority(cover, "path", "v").select(F.col("path").alias("lc"), remap(F.col("v")).alias("label"))
    labelled = chosen.join(label, "lc", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    kinds = {"sar": "s1", "multispectral": "s2"}
    views = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(kinds[m]).alias("path")) for m in modalities if m in kinds]))
    wanted = labelled.withColumn("_v", views).select("roi", "key", "label", "_v.*")
    out = decoded(rows.select("path", "content").join(wanted, "path"))
    out = out.select(F.concat_ws("/", "roi", "key", "modality").alias("id"), "image", "modality", "label", F.concat_ws("/", "roi", "key").alias("location_id"))
    return derive_rgb(out).unionByName(out.where("modality != 'multispectral'")) if "optical_rgb" in modalities else out


def class_roots(spark: SparkSession, root: str) -> DataFrame:
    """Folders with two sub-folders or more that hold rasters: candidates for a class folder."""
    parts = F.split("path", "/")
    rows = files(spark, root).select(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/").alias("folder"), F.element_at(parts, -2).alias("child")).distinct()
    return rows.groupBy("folder").agg(F.count("*").alias("classes")).where("classes >= 2")


def subset(samples: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    numbered = samples if "gallery_index" in samples.columns else samples.withColumn("gallery_index", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return balanced_subset(numbered, rows, ["label", "modality"], seed)


LOADERS = {"folder": folder_samples, "scenes": scenes, "triplets": triplets}


def load(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in LOADERS:
        raise KeyError(f"no dataset {name!r}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, **options)
