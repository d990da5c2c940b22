"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target in words. A document of the source is wanted ``target /
source_size`` times: the whole part is given, the fraction is its inclusion
probability. The flight phase (Deville and Tille, 2004; in the sequential form of
Chauvet and Tille, 2006) takes three undecided documents at a time and moves their
probabilities along the null space of the two balancing equations, the number of
documents and the number of words, until one of them is 0 or 1. Both totals stay exact
all the way, and two documents at most stay undecided.

A source is dealt into chunks of about ``CHUNK`` documents by a hash. Each chunk flies on
its own and leaves two documents at most; these form the chunks of the next level, until
a source has one chunk. That one holds back some documents of all sizes from the flight;
with the two that the flight leaves they are the landing problem of ``LANDING`` documents
at most, solved by trying all outcomes, so a source of many documents meets its target to
a few words. (Probabilities of those few documents are not kept; all others are.) Levels
grow with the logarithm of the corpus, and no task holds more than a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.llm.common import fresh, saved, word_count

CHUNK = 4096
LANDING = 16


@dataclass(frozen=True)
class Mix:
    """Sources in the order of their names, nulls last, weigh ``weights`` in turn and
    share ``share`` times all words; no target exceeds ``cap`` times its source."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    cap: float = 2.0
    seed: int = 0


# --------------------------------------------------------------------- targets


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 by source, nulls last, without one task for all sources."""
    by = F.col("source").asc_nulls_last()
    ranges = saved(
        sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return (
        ranges.withColumn("inside", inside)
        .join(starts, "part")
        .withColumn("rank", F.col("start") + F.col("inside"))
        .drop("part", "start", "inside")
    )


def source_targets(units: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size), one row per source.

    The level at which ``min(cap * size, level * weight)`` adds up to the whole share is
    found from below: what capped sources leave is dealt to the others by weight, until
    no further one is above its cap.
    """
    sources = units.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    weight = F.get(weights, (F.col("rank") % len(mix.weights)).cast("int"))
    ranked = saved(_ranked(sources).withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * mix.cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = 0.0, -1
    while total:
        over = cap <= F.col("weight") * level
        capped, fixed, open_weight = ranked.agg(
            F.sum(F.when(over, 1).otherwise(0)),
            F.sum(F.when(over, cap).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
        ).first()
        if capped == capped_before or not open_weight:
            level = level if open_weight else float("inf")
            break
        level, capped_before = (mix.share * total - fixed) / open_weight, capped
    return saved(
        ranked.select(
            "source", "n_docs", "source_size",
            F.least(cap.cast("double"), F.col("weight") * level).alias("target"),
        ),
        "mix-targets",
    )


# ---------------------------------------------------------------------- flight


def flight(p: list[float], sizes: list[float], uniform, land: bool) -> None:
    """Move the probabilities ``p`` in place until at most two are strictly between 0
    and 1, or none with ``land``. ``uniform()`` gives numbers from [0, 1)."""
    tiny = 1e-9

    def move(units: list[int], u: tuple[float, ...]) -> list[int]:
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(units, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(units, u) if x)
        step = up if uniform() * (up + down) < down else -down
        left = []
        for i, x in zip(units, u):
            p[i] += step * x
            if p[i] < tiny:
                p[i] = 0.0
            elif p[i] > 1 - tiny:
                p[i] = 1.0
            else:
                left.append(i)
        return left

    undecided: list[int] = []
    held = _spread(len(p), LANDING - 2) if land else set()
    for i in range(len(p)):
        if not 0 < p[i] < 1 or i in held:
            continue
        undecided.append(i)
        while len(undecided) == 3:
            a, b, c = (sizes[k] for k in undecided)
            # The null space of the rows (1, 1, 1) and (a, b, c).
            u = (c - b, a - c, b - a)
            undecided = move(undecided, u if any(u) else (1.0, -1.0, 0.0))
    if land:
        landing(p, sizes, sorted(undecided + [i for i in held if 0 < p[i] < 1]))


def _spread(n: int, k: int) -> set[int]:
    """``k`` of ``n`` places at even distances, all if there are no more."""
    return set(range(n)) if n <= k else {i * (n - 1) // (k - 1) for i in range(k)}


def landing(p: list[float], sizes: list[float], units: list[int]) -> None:
    """Decide the last units, ``LANDING`` at most: of all outcomes that whose number of
    words, and then of documents, is nearest to what the probabilities promise."""
    import numpy as np

    if not units:
        return
    s = np.array([sizes[i] for i in units])
    q = np.array([p[i] for i in units])
    outcomes = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    miss = np.abs(outcomes @ s - q @ s) + 1e-3 * np.abs(outcomes.sum(axis=1) - q.sum())
    for i, x in zip(units, outcomes[int(np.argmin(miss))]):
        p[i] = float(x)


def _fly(seed: int, level: int):
    def run(group):
        import random

        group = group.sort_values(["size", "tie", "uid"], ascending=[False, True, True])
        first = group.iloc[0]
        name = "null" if first["source"] is None else "=" + first["source"]
        key = f"{seed}/{level}/{first['chunk']}/{name}"
        p = group["p"].tolist()
        flight(p, group["size"].astype(float).tolist(), random.Random(crc32(key.encode())).random,
               bool(first["land"]))
        return group.assign(p=p)[["uid", "doc_id", "size", "source", "tie", "p"]]

    return run


def decide(units: DataFrame, targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(uid, doc_id, size, source, p) with ``p`` 0.0 or 1.0: which fraction was drawn.

    ``units`` is a stored table (uid, doc_id, size, source); ``uid`` tells repeated rows
    apart.
    """
    wanted = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    t = targets.select(F.col("source").alias("of"), "n_docs", wanted.alias("wanted"))
    # Repeats of one id share a hash; an id of more rows than a chunk is spread by row.
    often = (
        units.groupBy(F.col("doc_id").alias("often_id"))
        .agg(F.count(F.lit(1)).alias("times"))
        .filter(F.col("times") > CHUNK)
    )
    tie = F.xxhash64("doc_id", F.lit(mix.seed))
    own_row = F.when(F.col("times").isNotNull(), F.xxhash64("uid")).otherwise(F.lit(0))
    rest = (
        units.join(t, F.col("source").eqNullSafe(F.col("of")))
        .join(often, F.col("doc_id").eqNullSafe(F.col("often_id")), "left")
        .select(
            "uid", "doc_id", "size", "source", F.xxhash64(tie, own_row).alias("tie"),
            (F.col("wanted") - F.floor("wanted")).alias("p"),
            F.col("n_docs").alias("n"),
        )
    )
    schema = units.select("uid", "doc_id", "size", "source").schema
    schema = schema.add("tie", "long").add("p", "double")
    done, level = [], 0
    while True:
        chunks = F.ceil(F.col("n") / CHUNK)
        flown = (
            rest.withColumn("chunk", F.pmod("tie", chunks))
            .withColumn("land", chunks <= 1)
            .drop("n")
            .groupBy("source", "chunk")
            .applyInPandas(_fly(mix.seed, level), schema)
        )
        flown = saved(flown, "mix-level")
        open_units = flown.filter("p > 0 AND p < 1")
        done.append(flown.filter("p = 0 OR p = 1").drop("tie"))
        left = saved(open_units.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = left.withColumnRenamed("source", "of")
        rest = open_units.join(left, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        rest = rest.withColumn("tie", F.xxhash64("tie", F.lit(level)))
        level += 1


def mix_units(units: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(uid, doc_id, size, source, source_size, target, copies) of a stored table
    (uid, doc_id, size, source)."""
    targets = source_targets(units, mix)
    drawn = decide(units, targets, mix)
    wanted = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    return drawn.join(t, F.col("source").eqNullSafe(F.col("of"))).select(
        "uid", "doc_id", "size", "source", "source_size", "target",
        (F.floor(wanted) + F.col("p")).cast("int").alias("copies"),
    )


def _units(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id",
        word_count("text").alias("size"), "source",
    )


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per document.

    ``size`` is the number of words (0 for null and blank texts), ``taken`` is ``size``
    times ``copies``. A null source is a source of its own. Sources without words have
    target 0 and take nothing. Repeated rows are decided one by one. Equal tables laid
    out alike give equal results, whatever tasks are retried. An empty table gives an
    empty result.
    """
    return mix_units(saved(_units(docs), "mix-units"), mix).select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def resample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; columns unchanged.

    Rows of equal id, size and source share what their group takes: each gets the same
    number of copies, the first ones one more. The texts move once and no copy of them is
    written.
    """
    units = saved(_units(docs), "mix-units")
    identity = F.xxhash64("doc_id", "size", "source")
    taken = saved(
        mix_units(units, mix)
        .groupBy(identity.alias("key"))
        .agg(F.sum("copies").alias("taken"), F.count(F.lit(1)).alias("among"))
        .filter("taken > 0"),
        "mix-taken",
    )
    size, key, total, among, nth, copy = fresh(
        docs, "size", "key", "taken", "among", "nth", "copy"
    )
    taken = taken.toDF(key, total, among)
    rows = docs.withColumn(size, word_count("text")).withColumn(
        key, F.xxhash64("doc_id", size, "source")
    )
    # Equal keys share a partition after the join, so the window moves nothing.
    turn = F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "source", size))
    each = F.floor(F.col(total) / F.col(among)) + (F.col(nth) <= F.col(total) % F.col(among)).cast("int")
    repeated = (
        rows.join(taken, key)
        .withColumn(nth, turn)
        .withColumn(copy, each)
        .filter(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int"))))
    )
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
