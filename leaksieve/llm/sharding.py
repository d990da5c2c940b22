"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by a hash of the text, then a hash of the id, then the row, so equal
texts are neighbours and the order is otherwise random. Splitters are found by counting:
probes (a sample of keys) are sent out, every task counts the rows and bytes between
them, and the sums tell exactly how many bytes lie below each probe. Where no probe is
near enough to a wanted boundary, new probes are drawn from the interval that holds it.
Then the rows are exchanged once.

Each shard is cut into buckets, the units of parallel work; their splitters are found in
the same way with a loose tolerance. The counts below a splitter are the first slot of
its bucket, so slots are dense without a task that sees a whole shard.

A text with many copies is kept in one shard where a boundary beside it is within
``GROUP_TOLERANCE``; else the ids split it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.llm.common import fresh, saved

SHARDS = 8
BUCKET_BYTES = 64 << 20
MAX_BUCKETS = 1024  # of a shard
PROBES = 32  # per splitter and round
TOLERANCE = 0.001  # of a shard's bytes
GROUP_TOLERANCE = 0.005
INNER_TOLERANCE = 0.25  # of a bucket's bytes

_LOW = -(1 << 63)


@dataclass(frozen=True)
class Splitters:
    """Sorted keys; ``rows[i]`` rows lie below key ``i``. Key ``i`` begins bucket ``i + 1``."""

    keys: list[tuple[int, int, int]]
    rows: list[int]
    bytes: list[int]
    per_shard: int


def key_columns(text: str, doc_id: str) -> list:
    """The three parts of a row's key; the last tells repeated rows apart."""
    return [
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        F.xxhash64(F.col(doc_id)),
        F.monotonically_increasing_id(),
    ]


def _comparable(a, b, c):
    """24 bytes per key whose order is that of the three signed numbers."""
    import numpy as np

    parts = np.stack([np.asarray(x, np.int64) for x in (a, b, c)], axis=1)
    flipped = parts.view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(flipped.astype(">u8")).view("S24").ravel()


def _packed(keys: list[tuple[int, int, int]]):
    import numpy as np

    if not keys:
        return np.zeros(0, "S24")
    a, b, c = (np.array([k[i] for k in keys], np.int64) for i in range(3))
    return _comparable(a, b, c)


def _below(keys: list[tuple[int, int, int]]):
    """Arrow UDF: number of ``keys`` (sorted) at or below a row's key."""
    packed = _packed(keys)

    @F.arrow_udf("int")
    def run(a, b, c):
        import numpy as np
        import pyarrow as pa

        own = _comparable(*(x.to_numpy(zero_copy_only=False) for x in (a, b, c)))
        return pa.array(np.searchsorted(packed, own, "right").astype(np.int32))

    return run("k1", "k2", "k3")


def _count(rows: DataFrame, probes: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Exact rows and bytes below each probe."""
    counted = (
        rows.select(_below(probes).alias("at"), "size")
        .groupBy("at")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
        .collect()
    )
    n, b = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in counted:
        n[r["at"]], b[r["at"]] = r["n"], r["b"]
    for i in range(1, len(n)):
        n[i] += n[i - 1]
        b[i] += b[i - 1]
    return n[:-1], b[:-1]


def _sample(rows: DataFrame, share: float, salt: int) -> list[tuple[int, int, int]]:
    if share < 1:
        drawn = F.pmod(F.xxhash64("k3", "k2", F.lit(salt)), F.lit(1 << 30))
        rows = rows.filter(drawn < int(share * (1 << 30)))
    return [tuple(r) for r in rows.select("k1", "k2", "k3").collect()]


def find_splitters(
    rows: DataFrame,
    shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    tolerance: float = TOLERANCE,
) -> Splitters:
    """Splitters for a stored table (k1, k2, k3, size).

    What comes to the driver are probes and their counts, ``PROBES`` per splitter and
    round, whatever the number of rows.
    """
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    per_shard = min(MAX_BUCKETS, max(1, -(-total // (shards * bucket_bytes))))
    n = shards * per_shard
    if not n_rows:
        return Splitters([], [], [], per_shard)
    goals = {j: total * j / n for j in range(1, n)}
    near = {
        j: total / shards * tolerance if j % per_shard == 0 else total / n * INNER_TOLERANCE
        for j in goals
    }
    ends = ((_LOW,) * 3, ((1 << 63) - 1,) * 3)
    known = {ends[0]: (0, 0), ends[1]: (n_rows, total)}
    open_goals, scope, in_scope, salt = set(goals), rows, n_rows, 0
    chosen: dict[int, tuple] = {}
    while open_goals:
        share = min(1.0, PROBES * len(open_goals) / in_scope)
        probes = sorted(set(_sample(scope, share, salt)) - known.keys())
        salt += 1
        if probes:
            for key, r, b in zip(probes, *_count(rows, probes)):
                known[key] = (r, b)
        keys = sorted(known)
        below = [known[k][1] for k in keys]
        waiting = {}
        for j in sorted(open_goals):
            i = _last_at_or_below(below, goals[j])
            best = min(keys[i : i + 2], key=lambda k: abs(known[k][1] - goals[j]))
            inside = known[keys[i + 1]][0] - known[keys[i]][0] if i + 1 < len(keys) else 0
            # One row at most: no key lies between, so the nearer end is the best.
            if abs(known[best][1] - goals[j]) <= near[j] or inside <= 1:
                chosen[j] = best
            else:
                waiting[j] = (keys[i], keys[i + 1], inside)
        open_goals = set(waiting)
        if open_goals:
            gaps = sorted({(lo, hi, r) for lo, hi, r in waiting.values()})
            edges = sorted({k for lo, hi, _ in gaps for k in (lo, hi)})
            wanted = [i + 1 for i, k in enumerate(edges) if k in {lo for lo, _, _ in gaps}]
            scope = rows.filter(_below(edges).isin(wanted))
            in_scope = sum(r for _, _, r in gaps)
    # Prefer boundaries between texts to boundaries within one.
    outer = [j for j in goals if j % per_shard == 0]
    beside = {j: [(chosen[j][0], _LOW, _LOW), (chosen[j][0] + 1, _LOW, _LOW)] for j in outer
              if _LOW < chosen[j][0] < (1 << 63) - 1}
    probes = sorted({k for ks in beside.values() for k in ks} - known.keys())
    if probes:
        for key, r, b in zip(probes, *_count(rows, probes)):
            known[key] = (r, b)
    for j, ks in beside.items():
        best = min(ks, key=lambda k: abs(known[k][1] - goals[j]))
        if abs(known[best][1] - goals[j]) <= max(GROUP_TOLERANCE * total / shards, near[j]):
            chosen[j] = best
    keys = sorted(chosen[j] for j in goals)
    return Splitters(keys, [known[k][0] for k in keys], [known[k][1] for k in keys], per_shard)


def _last_at_or_below(values: list, goal: float) -> int:
    """Index of the last value <= goal; values rise and begin with 0."""
    from bisect import bisect_right

    return max(0, bisect_right(values, goal) - 1)


def place(rows: DataFrame, s: Splitters, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds ``shard`` and ``slot`` to a table with k1, k2, k3: the one exchange."""
    packed = _packed(s.keys)
    per_shard, starts = s.per_shard, [0, *s.rows]

    @F.arrow_udf("struct<bucket:int,shard:int,start:long>")
    def run(a, b, c):
        import numpy as np
        import pyarrow as pa

        own = _comparable(*(x.to_numpy(zero_copy_only=False) for x in (a, b, c)))
        bucket = np.searchsorted(packed, own, "right")
        shard = bucket // per_shard
        first = np.array(starts, np.int64)
        start = first[bucket] - first[shard * per_shard]
        return pa.StructArray.from_arrays(
            [pa.array(bucket.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(start)],
            names=["bucket", "shard", "start"],
        )

    (at,) = fresh(rows, "at")
    placed = rows.withColumn(at, run("k1", "k2", "k3"))
    (bucket,) = fresh(placed, "bucket")
    placed = placed.withColumn(bucket, F.col(f"{at}.bucket")).repartition(bucket)
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy("k1", "k2", "k3")) - 1
    return placed.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col(f"{at}.shard").alias(shard),
        (F.col(f"{at}.start") + inside).cast("long").alias(slot),
    )


def text_bytes(text: str):
    """Bytes of a text (none for null) and one for its end."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of (doc_id, text).

    ``size`` is the UTF-8 length plus 1. Null texts count and are ordered as empty ones.
    Repeated rows have slots of their own. Fewer rows than shards leave shards empty; an
    empty table gives an empty result.
    """
    k1, k2, k3 = key_columns("text", "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(
        docs.select(
            "doc_id", text_bytes("text").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            k1.alias("k1"), k2.alias("k2"), k3.alias("k3"),
        ),
        "shard-keys",
    )
    return place(rows, find_splitters(rows, shards)).drop("k1", "k2", "k3")


def shard_texts(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``. Columns of ``docs`` with a name that is
    used here (k1, k2, k3, size, shard, slot) are carried along and given back."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    k1, k2, k3 = key_columns(names["text"], names["doc_id"])
    rows = saved(
        plain.select(
            "*", text_bytes(names["text"]).alias("size"),
            k1.alias("k1"), k2.alias("k2"), k3.alias("k3"),
        ),
        "shard-texts",
    )
    s = find_splitters(rows.select("k1", "k2", "k3", "size"), shards)
    shard, slot = fresh(docs, "shard", "slot")
    return place(rows, s, shard, slot).select(
        *[F.col(n).alias(c) for c, n in names.items()], shard, slot
    )
