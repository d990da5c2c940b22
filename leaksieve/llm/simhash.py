"""Near-duplicates by SimHash fingerprints, candidates by pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of ``SEGMENTS`` segments. If two
fingerprints differ in at most ``d`` bits, some segment starts a chain in which, for
every length ``l``, the first ``l`` segments together differ in at most
``l * d / SEGMENTS`` bits. With nine segments and two bits the first four segments of
that chain are equal, and the first eight differ in one bit at most: the four are the
key of a candidate bucket, the eight prune its pairs, and the full Hamming distance
decides.

A bucket of more than ``bucket_cap`` fingerprints is not compared pair by pair. Its
fingerprints are linked exactly through their centres instead: two of them differ in
at most two bits iff some value differs from each in at most one. A centre has 65
values around it, so no group is larger than that, and nothing is lost.

Only distinct fingerprints are compared; copies ride along with theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leaksieve.llm.common import fresh, saved
from leaksieve.llm.components import connected_components

BITS = 64
SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 9
BUCKET_CAP = 64


def fingerprints(texts, shingle: int = SHINGLE, seed: int = SEED):
    """Arrow array of fingerprints (as signed 64-bit numbers) of an Arrow array of texts."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        data = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(lower)
        parts = data.split()  # splits at the bytes 0x20 and 0x09 to 0x0D
        if not parts:
            continue
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        k = min(shingle, len(parts))
        starts = np.concatenate(([0], ends[: len(parts) - k] + 1)).tolist()
        stops = ends[k - 1 :].tolist()
        counts = np.zeros(BITS, np.int64)
        n = len(starts)
        for i in range(0, n, 1 << 16):
            some = range(i, min(n, i + (1 << 16)))
            h = np.fromiter(
                (digest(line[starts[j] : stops[j]], seed) for j in some), "<u8", len(some)
            )
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return pa.array(out.view(np.int64))


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` plus ``name``; every column goes through Arrow, no row moves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = [*batch.columns, fingerprints(batch.column(text))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return docs.mapInArrow(run, schema)


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chain_masks(segments: int = SEGMENTS, max_distance: int = MAX_DISTANCE) -> list[list[tuple[int, int]]]:
    """For each start: (bits of the first l segments, their budget), l = 1 .. segments."""
    at = [BITS * i // segments for i in range(segments + 1)]
    masks = [((1 << (at[i + 1] - at[i])) - 1) << at[i] for i in range(segments)]
    out = []
    for start in range(segments):
        chain, union = [], 0
        for l in range(1, segments + 1):
            union |= masks[(start + l - 1) % segments]
            chain.append((union, l * max_distance // segments))
        out.append(chain)
    return out


def _keys(fps: DataFrame, chains) -> DataFrame:
    """(start, key, fp): the segments that must be equal, once per start."""
    keys = []
    for start, chain in enumerate(chains):
        mask = [m for m, budget in chain if budget == 0][-1]
        keys.append(
            F.struct(
                F.lit(start).alias("start"),
                F.col("fp").bitwiseAND(F.lit(_long(mask))).alias("key"),
            )
        )
    return fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.start", "k.key", "fp")


def _within_budgets(x: Column, start: Column, chains) -> Column:
    """Each prefix of the chain that begins at ``start`` keeps to its budget.

    Of prefixes with equal budgets the longest implies the others.
    """
    tests = []
    for s, chain in enumerate(chains):
        longest = {budget: mask for mask, budget in chain if budget > 0}
        ok = [F.bit_count(x.bitwiseAND(F.lit(_long(m)))) <= b for b, m in longest.items()]
        tests.append((start == s) & reduce(lambda p, q: p & q, ok))
    return reduce(lambda p, q: p | q, tests)


def links(
    fps: DataFrame,
    max_distance: int = MAX_DISTANCE,
    segments: int = SEGMENTS,
    bucket_cap: int = BUCKET_CAP,
) -> DataFrame:
    """(a, b): edges that connect all values of ``fp`` as distances up to two would.

    Every pair of a bucket within the cap is there if it is a link; in larger buckets
    each value is linked to the least of each of its groups.
    """
    if max_distance != 2:
        raise ValueError("the exact way for large buckets is that of distance two")
    chains = chain_masks(segments, max_distance)
    keys = _keys(fps, chains)
    counts = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = saved(keys.join(counts, ["start", "key"]), "simhash-buckets")
    few = shared.filter(F.col("n") <= bucket_cap).select("start", "key", "fp")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = few.alias("l").join(
        few.alias("r"),
        (F.col("l.start") == F.col("r.start"))
        & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.fp") < F.col("r.fp"))
        & _within_budgets(x, F.col("l.start"), chains)
        & (F.bit_count(x) <= max_distance),
    )
    pairs = near.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    many = shared.filter(F.col("n") > bucket_cap).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_long(1 << i))) for i in range(BITS)])
    centred = (
        many.select("fp", F.explode(flips).alias("centre"))
        .groupBy("centre")
        .agg(F.collect_set("fp").alias("around"))  # 65 at most
        .filter(F.size("around") > 1)
        .select(F.array_min("around").alias("a"), F.explode("around").alias("b"))
        .filter("a != b")
    )
    return pairs.unionByName(centred)


def classes(marked: DataFrame, fp: str, row: Column) -> DataFrame:
    """(fp, head, least): ``head`` is the least ``row`` of the component of ``fp``.

    ``marked`` may hold any number of rows per fingerprint; they are combined before
    they move. Null rows do not count.
    """
    fps = saved(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(row).alias("least")), "simhash-fps")
    roots = connected_components(links(fps.select("fp")), "a", "b")
    member = saved(
        fps.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least"),
        "simhash-members",
    )
    heads = member.groupBy("root").agg(F.min("least").alias("head"))
    moved = member.join(heads, "root").select("fp", "head")
    return saved(
        fps.join(moved, "fp", "left").select("fp", F.coalesce("head", "least").alias("head")),
        "simhash-classes",
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    Null, empty and blank texts have fingerprint zero and are linked like any other.
    Repeated rows stay. A null id is never a component's id unless all its ids are null.
    An empty table gives an empty result. Other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = saved(with_fingerprint(narrow, "text", "fp").select("doc_id", "fp"), "simhash-docs")
    heads = classes(marked, "fp", F.col("doc_id"))
    return marked.join(heads, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head").alias("component_id"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the least id, nulls last; columns unchanged.

    Of repeated rows with that id and fingerprint one stays. Fingerprints are computed
    twice, once to find the rows that stay and once to pick them, so that no copy of the
    texts is written; they move once.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = saved(with_fingerprint(narrow, "text", "fp").select("doc_id", "fp"), "simhash-docs")
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("fp").alias("f"))
    heads = classes(marked, "fp", row).select("head").distinct()
    fp, key, head, held, nth = fresh(docs, "fp", "key", "head", "held", "nth")
    keep = heads.select(F.xxhash64("head.f", "head.d").alias(key), F.col("head").alias(head))
    rows = with_fingerprint(docs, text, fp).withColumn(key, F.xxhash64(fp, doc_id))
    same = (F.col(f"{head}.f") == F.col(fp)) & F.col(f"{head}.d").eqNullSafe(F.col(doc_id))
    # Equal keys share a partition after the join, so the window moves nothing. The test
    # comes after it, or it would become a key of the join.
    first = Window.partitionBy(key, fp, doc_id).orderBy(F.desc(held))
    return (
        rows.join(keep, key)
        .withColumn(held, same)
        .withColumn(nth, F.row_number().over(first))
        .filter((F.col(nth) == 1) & F.col(held))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
