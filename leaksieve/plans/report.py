"""Reports (O1-O4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.layout import stored
from leaksieve.schema import LEAK_COLUMNS

# The SARIF envelope.
SARIF_SCHEMA = "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json"
SARIF_VERSION = "2.1.0"


def json_rows(leaks: DataFrame) -> DataFrame:
    """O1: each leak as one JSON object (column ``json``)."""
    return leaks.select(F.to_json(F.struct(*LEAK_COLUMNS)).alias("json"))


def sarif_rows(leaks: DataFrame) -> DataFrame:
    """O3: each leak as one SARIF result object (column ``json``)."""
    region = F.struct(
        F.col("line_number").alias("startLine"),
        F.struct(F.col("line").alias("text")).alias("snippet"),
    )
    place = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.struct(F.concat("rule", F.lit(" detected!")).alias("text")).alias("message"),
        F.struct(
            "commit",
            "offender",
            "date",
            "author",
            "email",
            F.col("commit_message").alias("commitMessage"),
            "repo",
        ).alias("properties"),
        F.array(place).alias("locations"),
    )
    return leaks.select(F.to_json(result).alias("json"))


def csv_rows(leaks: DataFrame) -> DataFrame:
    """O2: the report columns in report order."""
    return leaks.select(*LEAK_COLUMNS)


def csv_lines(leaks: DataFrame) -> DataFrame:
    """O2: each leak as one CSV record (column ``csv``). A value with a comma, a quote or
    a line end is quoted, and its quotes are doubled."""

    def field(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        doubled = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.rlike(value, F.lit('[",\\n\\r]')), doubled).otherwise(value)

    return leaks.select(F.concat_ws(",", *[field(c) for c in LEAK_COLUMNS]).alias("csv"))


def write_json_lines(leaks: DataFrame, path: str, mode: str = "error") -> None:
    """O1 as JSON lines, the form to use for large results."""
    leaks.select(*LEAK_COLUMNS).write.mode(mode).json(path)


def write_csv(leaks: DataFrame, path: str, mode: str = "error") -> None:
    """O2: CSV with a header; quotes are doubled, line ends stay as they are."""
    csv_rows(leaks).write.mode(mode).option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _write_document(rows: DataFrame, head: str, foot: str, path: str, mode: str) -> None:
    """Write a JSON array between ``head`` and ``foot`` as ordered text parts.

    No task holds the whole array: the parts in name order, put one after the other,
    are the document. The rows are computed once and stored with a number each; all but
    the least numbered carry the comma before them.
    """
    body = stored(
        rows.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("at"), "json")
    )
    first = body.agg(F.min("at")).scalar()
    comma = F.when(F.col("at") == first, "").otherwise(",")
    ends = rows.sparkSession.range(2).select(
        (F.col("id") * 2).cast("int").alias("part"),
        F.lit(0).cast("long").alias("at"),
        F.when(F.col("id") == 0, head).otherwise(foot).alias("value"),
    )
    ends.unionByName(body.select("part", "at", F.concat(comma, F.col("json")).alias("value"))).orderBy(
        "part", "at"
    ).select("value").write.mode(mode).text(path)


def write_json_document(leaks: DataFrame, path: str, mode: str = "error") -> None:
    """O1: one JSON array."""
    _write_document(json_rows(leaks), "[", "]", path, mode)


def write_sarif(
    leaks: DataFrame,
    path: str,
    tool_name: str = "leaksieve",
    tool_version: str = "v1.0.0",
    mode: str = "error",
) -> None:
    """O3: one SARIF 2.1.0 document with one run; tool name and version are parameters."""
    head, foot = sarif_envelope(tool_name, tool_version)
    _write_document(sarif_rows(leaks), head, foot, path, mode)


def sarif_envelope(tool_name: str, tool_version: str) -> tuple[str, str]:
    import json

    driver = json.dumps({"name": tool_name, "semanticVersion": tool_version, "rules": []})
    head = (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}",'
        f'"runs":[{{"tool":{{"driver":{driver}}},"results":['
    )
    return head, "]}]}"


def write_report(leaks: DataFrame, path: str, kind: str = "json", mode: str = "error") -> None:
    """The report of a format name; an unknown name means JSON."""
    writers = {"csv": write_csv, "sarif": write_sarif}
    writers.get(kind, write_json_document)(leaks, path, mode=mode)


def with_ids(leaks: DataFrame, after: int = 0) -> DataFrame:
    """An id above ``after`` for each row: unique and rising, but with gaps, so
    that no single task has to number all rows."""
    return leaks.select(
        (F.monotonically_increasing_id() + F.lit(after + 1)).alias("id"), *LEAK_COLUMNS
    )


def append_to_table(leaks: DataFrame, table: str = "leaks") -> None:
    """Append to a table, which is made where it is missing."""
    spark = leaks.sparkSession
    last = 0
    if spark.catalog.tableExists(table):
        last = spark.table(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    with_ids(leaks, last).write.mode("append").saveAsTable(table)


def append_to_jdbc(
    leaks: DataFrame, url: str, table: str = "leaks", batch_size: int = 5000, **options: str
) -> None:
    """Append to a database table in batches; the database gives the ids."""
    leaks.select(*LEAK_COLUMNS).write.mode("append").format("jdbc").options(
        url=url, dbtable=table, batchsize=str(batch_size), **options
    ).save()
