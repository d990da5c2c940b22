"""Commits, trees and blobs derived from ``events`` and ``documents``.

Each event is a commit of the repository named by its type; its tree holds three
documents, so that all documents are in some tree and the work grows with both
tables. The same model in SQL is below each function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.operators.layout import stored
from leaksieve.sources.worktree import blob_object_id


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PATH = (
    "concat('/', source, '/', lang, '/', CASE WHEN doc_id % 17 = 0 THEN '.cache/' ELSE '' END,"
    " doc_id, CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.pdf' ELSE '.txt' END)"
)


def spread(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """Give a source that has fewer splits than the cluster has cores enough
    partitions; a source with many splits is left alone (no shuffle)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, *keys)


def files(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select(F.expr(_PATH).alias("path"), F.col("text").alias("content"))


FILES = f"""
files AS (SELECT doc_id, {_PATH} AS path, text AS content, md5(text) AS blob_id FROM documents)"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).scalar()
    return events.select(
        F.col("event_type").alias("repo"),
        F.md5(F.col("event_id").cast("string")).alias("commit"),
        F.concat(F.lit("user"), "user_id").alias("author"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("email"),
        F.col("props").alias("commit_message"),
        # The event times are UTC wall-clock times.
        F.from_utc_timestamp(
            F.date_trunc("second", "ts").cast("timestamp"), F.current_timezone()
        ).alias("commit_ts"),
        ((F.col("user_id") % 25 - 12) * 60).cast("int").alias("offset_minutes"),
        (last - F.col("event_id")).alias("pos"),
    )


COMMITS = """
commits AS (SELECT event_type AS repo, md5(CAST(event_id AS VARCHAR)) AS commit,
  concat('user', user_id) AS author, concat('user', user_id, '@example.com') AS email,
  props AS commit_message, date_trunc('second', ts) AS commit_ts,
  CAST((user_id % 25 - 12) * 60 AS INTEGER) AS offset_minutes,
  (SELECT max(event_id) FROM events) - event_id AS pos FROM events)"""


def refs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("event_type", "user_id")
        .agg(F.max("event_id").alias("event_id"))
        .select(
            F.col("event_type").alias("repo"),
            F.concat(F.lit("refs/heads/"), "event_type", F.lit("/"), "user_id").alias("ref_name"),
            F.md5(F.col("event_id").cast("string")).alias("commit"),
        )
    )


REFS = """
refs AS (SELECT event_type AS repo, concat('refs/heads/', event_type, '/', user_id) AS ref_name,
  md5(CAST(max(event_id) AS VARCHAR)) AS commit FROM events GROUP BY event_type, user_id)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    count = docs.agg(F.max("doc_id") + 1).scalar()
    held = table(spark, sf, "events").select(
        F.col("event_type").alias("repo"),
        F.md5(F.col("event_id").cast("string")).alias("commit"),
        F.col("event_id"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"),
    )
    named = spread(docs.select("doc_id", "source", "lang", "text"), "doc_id").select(
        "doc_id", F.expr(_PATH).alias("path"), F.md5("text").alias("blob_id")
    )
    return (
        held.withColumn("doc_id", (F.col("event_id") * 3 + F.col("slot")) % count)
        .join(named, "doc_id")
        .select("repo", "commit", "path", "blob_id")
    )


ENTRIES = """
entries AS (SELECT e.event_type AS repo, md5(CAST(e.event_id AS VARCHAR)) AS commit,
  f.path, f.blob_id
  FROM (SELECT event_type, event_id, unnest([0, 1, 2]) AS slot FROM events) e
  JOIN files f ON f.doc_id = (e.event_id * 3 + e.slot) % (SELECT max(doc_id) + 1 FROM documents))"""


def nested_trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(commits with their root's ``tree_id``, trees) that hold the same files as ``entries``.

    A tree's id is a digest of its sorted entries, so equal folders are one tree; folders
    are made from the deepest level up, once for all commits with the same files.
    """
    file = F.struct("path", "blob_id")
    held = entries(spark, sf).groupBy("repo", "commit").agg(F.array_sort(F.collect_set(file)).alias("files"))
    held = stored(held.withColumn("list", F.md5(F.to_json("files"))))
    flat = (
        held.groupBy("list").agg(F.any_value("files").alias("files"))
        .select("list", F.explode("files").alias("file")).select("list", "file.*")
        .withColumn("parts", F.split(F.substring("path", 2, 1 << 20), "/"))
    )
    depth = F.size("parts").alias("depth")
    blob = [F.lit("blob").alias("kind"), F.col("blob_id").alias("child")]
    rows = stored(flat.select("list", "parts", depth, *blob))
    levels = []
    for level in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        entry = F.struct(F.element_at("parts", -1).alias("name"), "kind", "child")
        folder = F.slice("parts", 1, level - 1).alias("parts")
        made = (
            rows.filter(F.col("depth") == level)
            .groupBy("list", folder)
            .agg(F.array_sort(F.collect_set(entry)).alias("held"))
            .withColumn("child", F.md5(F.to_json("held")))
        )
        made = stored(made)
        levels.append(made.select(F.col("child").alias("tree_id"), F.explode("held").alias("e")))
        at = [F.lit(level - 1).alias("depth"), F.lit("tree").alias("kind")]
        above = made.select("list", "parts", *at, "child")
        rows = rows.filter(F.col("depth") < level).unionByName(above)
    trees = reduce(DataFrame.unionByName, levels).distinct().select("tree_id", "e.*")
    roots = stored(rows.select("list", F.col("child").alias("tree_id")))
    return held.select("repo", "commit", "list").join(roots, "list").drop("list"), trees


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs as they lie in ``documents``: equal texts are there more than once."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.md5("text").alias("blob_id"), F.col("text").alias("content"))


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
        .groupBy(F.md5("text").alias("blob_id"))
        .agg(F.any_value("text").alias("content"))
    )


BLOBS = """
blobs AS (SELECT DISTINCT blob_id, content FROM files)"""


def parents(spark: SparkSession, sf: str) -> DataFrame:
    """A history with merges: commit e has the parents 2e+1, 2e+2 and 2e+3."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).scalar()
    return (
        events.select("event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
        .withColumn("up", F.col("event_id") * 2 + F.col("k"))
        .filter(F.col("up") <= last)
        .select(
            F.md5(F.col("event_id").cast("string")).alias("commit"),
            F.md5(F.col("up").cast("string")).alias("parent"),
        )
    )


PARENTS = """
parents AS (SELECT md5(CAST(event_id AS VARCHAR)) AS commit, md5(CAST(up AS VARCHAR)) AS parent
  FROM (SELECT event_id, event_id * 2 + unnest([1, 2, 3]) AS up FROM events)
  WHERE up <= (SELECT max(event_id) FROM events))"""


def history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(commits, parents): one long line with merges and forks, shared by two
    repositories. Commit e has the parent e-1, and every fifth e-7 as well."""
    commits_ = commits(spark, sf)
    shared = commits_.withColumn("repo", F.explode(F.array(F.lit("fork"), F.lit("main"))))
    up = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(1)))
    parents_ = (
        table(spark, sf, "events")
        .select("event_id", F.explode(up).alias("back"))
        .withColumn("up", F.col("event_id") - F.col("back"))
        .select(
            F.md5(F.col("event_id").cast("string")).alias("commit"),
            F.md5(F.col("up").cast("string")).alias("parent"),
        )
    )
    return shared, parents_


def lanes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, parents, heads) of a history in 16 lanes, in two repositories.

    Commit e has the parent e - 16, the first 15 after the root have the root. Lane 0 is
    the main line; each of its commits merges one of the lanes 1 to 8, in turn. The other
    lanes are not merged. HEAD of ``main`` is the end of lane 0, that of ``fork`` a commit
    of lane 9 in the middle.
    """
    events = table(spark, sf, "events").select("event_id", "user_id")
    e = F.col("event_id")
    commit = lambda at: F.md5(at.cast("string"))
    commits_ = events.select(
        F.explode(F.array(F.lit("fork"), F.lit("main"))).alias("repo"), commit(e).alias("commit"),
        F.concat(F.lit("user"), "user_id").alias("author"),
    )
    before = F.greatest(e - 16, F.lit(0))
    merged = F.when((e % 16 == 0) & (e > 0), e - 15 + (e / 16).cast("long") % 8)
    ups = F.array_compact(F.array(F.when(e > 0, before), merged))
    parents_ = events.select("event_id", F.posexplode(ups).alias("nth", "up")).select(
        commit(e).alias("commit"), commit(F.col("up")).alias("parent"), "nth"
    )
    end = events.agg(F.max("event_id")).scalar()
    heads_ = events.select(
        F.when(e % 16 == 0, "main").when((e % 16 == 9) & (e <= end / 2), "fork").alias("repo"), "event_id"
    ).filter("repo IS NOT NULL").groupBy("repo").agg(commit(F.max("event_id")).alias("commit"))
    return commits_, parents_, heads_


LANES = """
lane_commits AS (SELECT unnest(['fork', 'main']) AS repo, md5(CAST(event_id AS VARCHAR)) AS commit,
  concat('user', user_id) AS author FROM events),
lane_parents AS (SELECT md5(CAST(e AS VARCHAR)) AS commit, md5(CAST(up AS VARCHAR)) AS parent FROM (
  SELECT event_id AS e, greatest(event_id - 16, 0) AS up FROM events WHERE event_id > 0
  UNION ALL SELECT event_id, event_id - 15 + event_id // 16 % 8 FROM events
  WHERE event_id % 16 = 0 AND event_id > 0)),
lane_heads AS (SELECT 'main' AS repo, md5(CAST(max(event_id) AS VARCHAR)) AS commit FROM events
    WHERE event_id % 16 = 0
  UNION ALL SELECT 'fork', md5(CAST(max(event_id) AS VARCHAR)) FROM events
    WHERE event_id % 16 = 9 AND event_id <= (SELECT max(event_id) FROM events) / 2)"""


def worktree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(HEAD's entries, files with bytes) of a working tree of the documents.

    Every seventh file has a further line, every eleventh is gone, every thirteenth is
    new, and all of one source lie in a submodule.
    """
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    doc, path = F.col("doc_id"), F.expr(_PATH)
    raw = F.encode("text", "UTF-8")
    tracked = docs.filter((doc % 13 != 0) & (F.col("source") != "src4")).select(
        path.alias("path"), blob_object_id(raw).alias("blob_id"), F.lit("blob").alias("kind")
    )
    module = docs.filter("source = 'src4'").select(
        F.lit("/src4").alias("path"), F.sha1(F.lit(b"src4")).alias("blob_id"), F.lit("commit").alias("kind")
    ).distinct()
    more = F.concat(F.col("text"), F.lit("\ntoken mail1@mail2.example.net"))
    content = F.when(doc % 7 == 0, F.encode(more, "UTF-8")).otherwise(raw)
    files_ = docs.filter(doc % 11 != 0).select(
        F.substring(path, F.lit(2), F.length(path)).alias("path"), content.alias("content")
    )
    return tracked.unionByName(module), files_


WORKTREE = f"""
tree_files AS (SELECT doc_id, substr({_PATH}, 2) AS path, text FROM documents WHERE source <> 'src4'),
head AS (SELECT path, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS id
  FROM tree_files WHERE doc_id % 13 <> 0),
work AS (SELECT *, sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS id
  FROM (SELECT path, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'token mail1@mail2.example.net'
    ELSE text END AS content FROM tree_files WHERE doc_id % 11 <> 0))"""


def encoded_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files of bytes: every third in Latin-1, the others in UTF-8."""
    text = F.col("content")
    latin = F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.expr(_PATH).alias("path"), F.col("text").alias("content")
    )
    return docs.select(
        "path", F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode(text, "UTF-8")).alias("content")
    )


DECODED = f"""
decoded AS (SELECT {_PATH} AS path,
  CASE WHEN doc_id % 3 = 0 THEN regexp_replace(regexp_replace(text, '[^\\x00-\\x{{FF}}]', '?', 'g'),
    '[^\\x00-\\x7F]', chr(65533), 'g') ELSE text END AS content,
  doc_id % 3 <> 0 OR NOT regexp_matches(text, '[\\x{{80}}-\\x{{FF}}]') AS valid FROM documents)"""


_ALLOW = (
    "CASE WHEN c_custkey % 3 = 0 THEN named_struct('paths', array(concat('/', c_name), '(doc)$'),"
    " 'commits', array(concat('c', c_nationkey)), 'regex_target', 'line',"
    " 'regexes', array('^x', concat('c', c_nationkey)),"
    " 'stopwords', array(c_mktsegment)) END"
)


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rules table that grows: one rule per customer, ids repeated by segment."""
    return table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS pos",
        "c_mktsegment AS id",
        "c_name AS description",
        "c_name AS regex",
        "array(c_name) AS keywords",
        f"{_ALLOW} AS allowlist",
        "CASE WHEN c_custkey % 4 = 0 THEN 1 END AS secret_group",
        "CASE WHEN c_custkey % 5 = 0 THEN 3.5D END AS entropy",
        "CASE WHEN c_custkey % 7 = 0 THEN concat(c_name, '$') END AS path",
        "array(c_mktsegment, 't') AS tags",
    )


# All ten columns, lists joined and the allowlist taken apart.
RULES = """
rules AS (SELECT CAST(c_custkey AS INTEGER) AS pos, c_mktsegment AS id, c_name AS description,
  c_name AS regex, c_name AS keywords, c_custkey % 3 = 0 AS has_allowlist,
  CASE WHEN c_custkey % 3 = 0 THEN concat('/', c_name, ',(doc)$') END AS allow_paths,
  CASE WHEN c_custkey % 3 = 0 THEN concat('c', c_nationkey) END AS allow_commits,
  CASE WHEN c_custkey % 3 = 0 THEN 'line' END AS allow_target,
  CASE WHEN c_custkey % 3 = 0 THEN concat('^x,c', c_nationkey) END AS allow_regexes,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS allow_stopwords,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 END AS INTEGER) AS secret_group,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 3.5 END AS DOUBLE) AS entropy,
  CASE WHEN c_custkey % 7 = 0 THEN concat(c_name, '$') END AS path,
  concat(c_mktsegment, ',t') AS tags FROM customer)"""
