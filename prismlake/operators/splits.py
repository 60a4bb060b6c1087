"""Splits, balanced subsets and pairings of samples, as windows and joins.

Random order is the order of a hash of the row's number and a seed that any SQL engine can
compute, so a split depends on neither partitioning nor engine. Ties of the hash go by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER, SEED_STEP, MODULUS = 2654435761, 2246822519, 4294967296


def hash_order(seed: int = 0) -> list[Column]:
    return [(F.col("gallery_index") * F.lit(MULTIPLIER) + F.lit(seed * SEED_STEP % MODULUS)) % F.lit(MODULUS), F.col("gallery_index")]


def _numbered(df: DataFrame, by: list[str], seed: int) -> DataFrame:
    group = Window.partitionBy(*by)
    return df.withColumn("_rn", F.row_number().over(group.orderBy(*hash_order(seed)))).withColumn("_n", F.count("*").over(group))


def stratified_split(df: DataFrame, query_fraction: float = 0.2, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``part``: of each class of n rows max(1, round(n f)), n - 1 at most, are queries."""
    rows = _numbered(df, by or ["label"], seed)
    queries = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(query_fraction))), F.col("_n") - 1)
    return rows.withColumn("part", F.when(F.col("_rn") <= queries, "query").otherwise("gallery")).drop("_rn", "_n")


def balance(df: DataFrame, by: list[str], within: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Each class keeps as many rows as the smallest one (of each ``within`` group) has."""
    rows = _numbered(df, by, seed)
    smallest = F.min("_n").over(Window.partitionBy(*within)) if within else None
    if smallest is None:
        least = rows.agg(F.min("_n").alias("_m"))
        return rows.join(F.broadcast(least)).where("_rn <= _m").drop("_rn", "_n", "_m")
    return rows.withColumn("_m", smallest).where("_rn <= _m").drop("_rn", "_n", "_m")


def query_gallery_split(df: DataFrame, query_fraction: float = 0.2, by_modality: bool = False, balanced: bool = True, seed: int = 0) -> DataFrame:
    """The default split; with ``balanced`` the gallery's classes are cut to one size."""
    by = ["modality", "label"] if by_modality else ["label"]
    rows = stratified_split(df, query_fraction, by, seed)
    if not balanced:
        return rows
    gallery = balance(rows.where("part = 'gallery'"), by, ["modality"] if by_modality else None, seed)
    return rows.where("part = 'query'").unionByName(gallery)


def exact_count_split(df: DataFrame, gallery: int, queries: int, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """min(gallery, n - 1) rows of each class to the gallery, then min(queries, rest) queries."""
    rows = _numbered(df, by or ["label"], seed)
    g = F.least(F.lit(gallery), F.col("_n") - 1)
    q = F.least(F.lit(queries), F.col("_n") - g)
    return rows.where(F.col("_rn") <= g + q).withColumn("part", F.when(F.col("_rn") <= g, "gallery").otherwise("query")).drop("_rn", "_n")


def balanced_subset(df: DataFrame, rows: int, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``rows`` rows, taken in turn from each class."""
    by = by or ["label", "modality"]
    return _numbered(df, by, seed).orderBy("_rn", *by, "gallery_index").limit(rows).drop("_rn", "_n")


def same_modal_split(df: DataFrame, modality: str, query_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    return stratified_split(df.where(F.col("modality") == modality), query_fraction, ["label"], seed)


def cross_modal_split(df: DataFrame, query_modality: str, gallery_modality: str, query_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Queries of one modality, the gallery of another."""
    rows = stratified_split(df.where(F.col("modality").isin(query_modality, gallery_modality)), query_fraction, ["modality", "label"], seed)
    query = (F.col("part") == "query") & (F.col("modality") == query_modality)
    return rows.where(query | ((F.col("part") == "gallery") & (F.col("modality") == gallery_modality)))


def cross_modal_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of modality a and of modality b at one location; rows without a location pair with nothing."""
    side = lambda m, name: df.where(F.col("modality") == m).select("location_id", F.col("gallery_index").alias(name))
    return side(a, "a_index").join(side(b, "b_index"), "location_id")


def by_location(df: DataFrame) -> DataFrame:
    """One row per location with a sorted array of row numbers for each modality."""
    from prismlake.sources.samples import MODALITIES

    wide = df.where("location_id is not null").groupBy("location_id").pivot("modality", list(MODALITIES)).agg(F.sort_array(F.collect_list("gallery_index")))
    return wide


def pooled_gallery(df: DataFrame, exclude: DataFrame) -> DataFrame:
    """``df`` without the ids that ``exclude`` lists."""
    return df.join(exclude.select("id").distinct(), "id", "left_anti")


def disjoint_pairs(df: DataFrame) -> DataFrame:
    """Pairs of rows of different modality at one location, each row in one pair at most.

    Greedy in the order of modality, then gallery_index: each row that is still free takes the
    first later one that is free and of another modality. Free rows that wait are therefore
    always of one modality, and the next modality's rows take them in order; so which ranks
    meet follows from the counts of the modalities alone, one small array a location.
    """
    rows = df.where("location_id is not null and modality is not null").select("location_id", "modality", "gallery_index")
    counts = rows.groupBy("location_id", "modality").agg(F.count("*").alias("n")).groupBy("location_id").agg(F.sort_array(F.collect_list(F.struct("modality", "n"))).alias("kinds"))
    link = "array<struct<a:string,a_from:bigint,b:string,b_from:bigint,times:bigint>>"
    start = F.struct(F.lit("").alias("kind"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("left"), F.array().cast(link).alias("links"))

    def step(state: Column, kind: Column) -> Column:
        """The rows of ``kind`` meet ``left`` waiting rows of ``state.kind``, from rank ``first`` on."""
        times = F.least(state["left"], kind["n"])
        met = F.struct(state["kind"].alias("a"), state["first"].alias("a_from"), kind["modality"].alias("b"), F.lit(0).cast("long").alias("b_from"), times.alias("times"))
        links = F.when(times > 0, F.array_append(state["links"], met)).otherwise(state["links"])
        waits = state["left"] > times
        after = lambda old, new: F.when(waits, old).otherwise(new)
        return F.struct(after(state["kind"], kind["modality"]).alias("kind"), after(state["first"] + times, times).alias("first"), after(state["left"], kind["n"]).alias("was"), links.alias("links")).withField("left", after(state["left"] - times, kind["n"] - times)).dropFields("was")

    def ordered(state: Column) -> Column:
        return F.struct(state["kind"].alias("kind"), state["first"].alias("first"), state["left"].alias("left"), state["links"].alias("links"))

    plan = counts.select("location_id", F.explode(F.aggregate("kinds", start, lambda s, k: ordered(step(s, k)))["links"]).alias("l")).select("location_id", "l.*")
    rank = F.row_number().over(Window.partitionBy("location_id", "modality").orderBy("gallery_index")) - 1
    numbered = rows.withColumn("rank", rank)

    def side(name: str) -> DataFrame:
        kind, low = F.col(name), F.col(f"{name}_from")
        of = plan.select("location_id", "a", "b", kind.alias("modality"), low.alias("low"), "times")
        met = numbered.join(of, ["location_id", "modality"]).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("times")))
        return met.select("location_id", "a", "b", (F.col("rank") - F.col("low")).alias("turn"), F.col("gallery_index").alias(f"{name}_index"))

    return side("a").join(side("b"), ["location_id", "a", "b", "turn"]).select("location_id", "a_index", "b_index")


def eligible_classes(df: DataFrame, min_size: int = 2, multimodal: bool = True) -> DataFrame:
    """Labels with ``min_size`` rows; only those of two modalities or more, if there is one."""
    classes = df.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("modality").alias("n_modalities")).where(F.col("n") >= min_size)
    if not multimodal:
        return classes
    some = F.max(F.col("n_modalities") >= 2).over(Window.partitionBy(F.lit(0)))  # one row per label
    return classes.withColumn("_some", some).where("n_modalities >= 2 or not _some").drop("_some")


def _drawn(seed: int, *cols: Column) -> Column:
    """A number below 2**32 from whole numbers, the same on any engine."""
    out = F.lit(seed * SEED_STEP % MODULUS)
    for k, c in enumerate(cols):
        out = out + F.pmod(c.cast("long"), F.lit(65_536)) * F.lit((MULTIPLIER * (2 * k + 1)) % MODULUS)
    return out % F.lit(MODULUS)


def pk_batches(df: DataFrame, p: int = 16, k: int = 4, batches: int = 1, seed: int = 0, epoch: int = 0, min_size: int = 2, multimodal: bool = True) -> DataFrame:
    """Batches of P classes with K rows each, spread over the modalities of the class.

    An epoch numbers the classes, and the rows of each (class, modality), once in hashed order.
    A batch takes the next P classes; ``place`` of a class takes the modality ``place mod m`` of
    its m modalities from a drawn one on, so quotas differ by one at most, and the next rows
    from a drawn one on; a modality with too few rows starts over (replacement). One row per
    (batch, label, place), and the same for the same seed and epoch.
    """
    stream = seed + 1_000_003 * epoch
    classes = eligible_classes(df, min_size, multimodal).select("label")
    order = Window.partitionBy(F.lit(0)).orderBy(_drawn(stream, F.col("label")), "label")  # one row per label
    classes = classes.withColumn("_c", F.row_number().over(order) - 1).withColumn("_classes", F.count("*").over(Window.partitionBy(F.lit(0))))
    taken = df.sparkSession.range(batches * p).select((F.col("id") / p).cast("int").alias("batch"), F.col("id").alias("_turn"), (F.col("id") % p).alias("_i"))
    number = classes.agg(F.count("*").alias("_n"))
    chosen = taken.join(F.broadcast(number)).where("_i < _n").withColumn("_c", F.col("_turn") % F.col("_n")).join(classes, "_c").select("batch", "label")
    members = df.where("modality is not null").select("label", "modality", "gallery_index")
    pool = Window.partitionBy("label", "modality").orderBy(*hash_order(stream))
    members = members.withColumn("_pick", (F.row_number().over(pool) - 1).cast("long"))
    kinds = members.groupBy("label", "modality").agg(F.count("*").alias("_pool"))
    own = Window.partitionBy("label").orderBy("modality")
    kinds = kinds.withColumn("_m", F.row_number().over(own) - 1).withColumn("_mods", F.count("*").over(Window.partitionBy("label")))
    slots = chosen.join(kinds, "label").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    slots = slots.where((F.col("place") + _drawn(stream, F.col("batch"), F.col("label"))) % F.col("_mods") == F.col("_m"))
    slots = slots.withColumn("_pick", (_drawn(stream, F.col("label"), F.col("batch"), F.col("_m")) + F.floor(F.col("place") / F.col("_mods"))) % F.col("_pool"))
    return slots.join(members, ["label", "modality", "_pick"]).select("batch", "label", "place", "modality", "gallery_index")
