"""Helpers shared by the operators: tables in the shared folder, names, words."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what stands between words.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers by the thousand rows, not ten thousand: that many
    texts of some KB, in and out, beside a worker and in the JVM, are most of what a task
    holds. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines see.

    Where it is unset, the context's checkpoint folder; in local mode at last the
    warehouse. A cluster without any of them is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if sc.master.startswith("local[") or sc.master == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    raise ValueError("set spark.checkpoint.dir to a folder that all machines share")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: what comes after survives lost executors, is computed from
    stored rows, and is planned with the true size. The folder of an application,
    ``<shared>/leaksieve/<application id>``, may go when its results are written.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/leaksieve/{app}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Remove tables that ``saved`` wrote. Only for those whose readers have all been
    stored themselves: a DataFrame that reads one of them fails from now on."""
    for df in stored:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate values that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column | str) -> Column:
    """The words of a text, natively; a null or blank text has none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(t, F.lit("")), SEPARATORS), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for null. Only the ends of a split can be empty."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(t, F.lit("")), SEPARATORS)
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return (F.size(parts) - ends).cast("long")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
