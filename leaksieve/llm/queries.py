"""One query per operator on the test tables, and the pipeline, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm import (
    alignment,
    credentials,
    decontam,
    embedding,
    langid,
    manifest,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    sql,
    toxicity,
    url_filter,
)
from leaksieve.llm.common import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _bucket(modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op1_mixing(spark, sf_dir):
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# Fixed values: (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op2_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(pages, rules).drop("url")


@query
def op3_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_bucket(4) == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op5_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_bucket(3) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


# The test queries' key; a job passes its own secret.
PII_KEY = b"documents"


@query
def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY)


@query
def op7_decontam(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contained_items(docs, items)


@query
def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_credentials(spark, sf_dir):
    found = credentials.scan_credentials(table(spark, sf_dir, "documents"))
    strong = F.filter("spans", lambda s: s["strong"])
    count = lambda kind: F.size(F.filter(strong, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(credentials.listed(strong), 256).alias("base_sha256"),
        credentials.listed(F.col("spans")).alias("spans"),
    )


@query
def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_manifest(spark, sf_dir):
    built = manifest.build(
        table(spark, sf_dir, "documents"),
        changed=("text", manifest.lower_ascii(F.col("text"))),
        is_changed=_bucket(3) == 0,
    )
    return manifest.prove(built).withColumnRenamed("id", "doc_id")


# Where the tokenizers' files are on every machine.
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op12_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), *TOKENIZERS)


@query
def op13_embedding(spark, sf_dir):
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op2_urls"] = sql.urls(URL_RULES)
SQL["op3_quality"] = sql.quality_rules()
SQL["op7_decontam"] = sql.CONTAINED
