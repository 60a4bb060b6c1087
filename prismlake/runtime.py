"""Session construction, the shared staging folder, and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "prismlake", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where a local session has no ``spark.checkpoint.dir`` (tests) is a temporary folder of
    this machine chosen and recorded in the session. On a cluster that is an error: every
    executor would write to its own disk.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="prismlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never handed out twice."""
    return f"{shared_dir(spark)}/prismlake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    The driver serves the archive itself, so nobody has to install the package on the cluster.
    """
    context = spark.sparkContext
    if getattr(context, "_prismlake_shipped", False):
        return
    context._prismlake_shipped = True
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="prismlake-"), "prismlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("prismlake", os.path.relpath(path, root)))
    context.addPyFile(archive)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def few_files(spark: SparkSession, rows: int, per_file: int = 1_000_000) -> int:
    """How many tasks should write ``rows`` rows: two for each core, more if files got large."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_file))


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_in_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``mapInArrow`` for any names of columns: inside, columns go by position, named c0, c1, ..."""
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)


def text_files(docs: DataFrame, split_bytes: int = 8 << 20) -> int:
    """How many tasks should go through whole texts: two for each core, more by the bytes of the
    table, so that no task grows with it."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * spark.sparkContext.defaultParallelism, min(-(-size // split_bytes), 1 << 20))


def stage_table(df: DataFrame, name: str, codec: str = "snappy", files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage with files that survive the loss of an executor, and keeps an
    expensive input from being computed once for each of its consumers. The shuffle files
    behind the table are released as soon as it is written. ``files``: at most so many tasks
    write, each going through several partitions one after the other.
    """
    spark = df.sparkSession
    ship(spark)
    path = staging_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.coalesce(files) if files else df).write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """``df`` dealt over all cores if it is too small for its files to be; else as it is.

    A table of many splits keeps every core busy without a shuffle of its rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split_bytes else df


def bounded_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep an Arrow batch of long texts small; never raises a limit the session has set lower."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or bare path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else os.path.abspath(uri)


def open_store(uri: str):
    """(pyarrow filesystem, path in it) for a URI; runs on executors as well as the driver."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
