"""Partitioning helpers: joins on hot keys, positions, stored tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in HOT_SHARE. No table can have
# HOT_SHARE or more such keys, whatever its size, so the list of hot keys may be
# broadcast.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, salts) of the hot keys of ``df``: at most HOT_SHARE - 1 rows.

    Counts are combined before the shuffle. ``salts`` is the number of parts that
    brings each part of the key down to about one HOT_SHARE-th of the rows.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter(F.col("n") * HOT_SHARE > total).select(
        key, F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("salts")
    )


def splits_hot_partitions(spark: SparkSession) -> bool:
    on = lambda name: spark.conf.get(name).lower() == "true"
    return on("spark.sql.adaptive.enabled") and on("spark.sql.adaptive.skewJoin.enabled")


def join_on_skewed_key(
    many: DataFrame,
    few: DataFrame,
    key: str,
    spread_by: Sequence[str] = ("commit", "path"),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join where some keys of ``many`` may hold a large share of its rows.

    Adaptive execution splits the partitions of hot keys at run time from the sizes
    it has measured, with no pass over the data. Where the session has that turned
    off, hot keys are counted and salted: rows of a hot key are dealt over salts by
    a hash of ``spread_by``, and the ``few`` side repeats only its hot rows, once per
    salt. ``hot`` may bring the result of ``hot_keys`` where ``many`` is joined more
    than once.
    """
    if splits_hot_partitions(many.sparkSession):
        return many.join(few, key)
    hot = F.broadcast(hot_keys(many, key) if hot is None else hot)
    deal = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    left = many.join(hot, key, "left").withColumn("salt", deal).drop("salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    right = few.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def dense_positions(
    df: DataFrame, group: str, order: Sequence[F.Column | str], name: str = "pos",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """0, 1, 2, ... within ``group`` in ``order``, without one task per group.

    Rows are range-partitioned by (group, order) and sorted, numbered inside each range,
    and moved by the number of the group's rows in earlier ranges. They move once; the
    ranges are stored, so a retried task cannot see other ranges. ``keep`` names the columns
    that are stored and returned, ``group`` among them; with it they are ``settled``.
    """
    ranged = (
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.spark_partition_id())
    )
    ranged = settled(ranged.select(*keep, "_place", "_range")) if keep else stored(ranged)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = stored(
        ranged.groupBy(group, "_range")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        ranged.join(starts, [group, "_range"])
        .withColumn(name, (F.col("_start") + F.col("_place") - F.col("_first")).cast("long"))
        .drop("_range", "_place", "_first", "_start")
    )


def running_totals(
    df: DataFrame, group: str, order: Sequence[F.Column | str], value: str, name: str
) -> DataFrame:
    """``df`` plus the sum of ``value`` over the rows before each in its ``group``.

    Like ``dense_positions``, by sums inside ranges and of the ranges before.
    """
    ranged = reliable(
        df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    upto = Window.unboundedPreceding
    sums = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(upto, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(value).over(inside.rowsBetween(upto, -1)), F.lit(0))
    return (
        ranged.withColumn("_own", own)
        .join(starts, [group, "_range"])
        .withColumn(name, (F.col("_start") + F.col("_own")).cast("long"))
        .drop("_range", "_own", "_start")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Without either a cluster is refused, for other machines could not read what one
    writes; in local mode a folder in the warehouse will do.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again, so that plans know its true
    size. The folder ``leaksieve/<application id>`` there may go with the application.
    ``options`` are the writer's."""
    spark = df.sparkSession
    app = f"{shared_folder(spark).rstrip('/')}/leaksieve/{spark.sparkContext.applicationId}"
    path = f"{app}/stored-{uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle goes as soon as they end, not when the driver happens to collect
    its garbage."""
    before = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREES) if before is None else spark.conf.set(_FREES, before)


def settled(df: DataFrame) -> DataFrame:
    """``stored``, for tables that fill disks: smaller, and ``freeing``."""
    with freeing(df.sparkSession):
        return stored(df, compression="zstd")


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` or ``settled`` wrote. Only for those whose readers have all
    been stored themselves: a DataFrame that reads one of them fails from now on."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
