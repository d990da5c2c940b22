"""Near-duplicate embeddings by collision-counting projections.

Vectors of length one within a cosine ``c`` are at most ``d = sqrt(2 - 2c)`` apart, so
on a random line their projections differ by a normal number of deviation ``d`` at most.
All vectors that meet are projected on ``LINES`` lines; each line is sorted, and a pair
collides on a line if one lies in the window of half-width ``d`` centred on the other.
A pair at distance ``d`` collides on a binomial number of lines; the least count that
all but ``MISS`` of such pairs reach is asked for, and pairs that reach it are verified
by their cosine in double precision.

Who meets is decided by a net of further projections: ``bands`` times, vectors with one
label share a bucket if ``depth`` projections, shifted at random and cut into cells of
``CELL * d``, all agree. Depth grows with the logarithm of the largest label, so that
some ``MATES`` unrelated vectors share a bucket, and bands are as many as leave ``MISS``
of the pairs at distance ``d`` apart in all of them. Recall is the same at every size.

Equal vectors are one vector with a number of copies. A bucket of more than ``PART``
vectors is dealt into parts, and pairs of parts meet in tasks of their own, so no task
holds more than two parts. A pair that meets in several buckets counts in the first.
Tasks return partial counts and one edge per vector, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, erf, exp, log, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, NumericType

from leaksieve.llm.common import saved
from leaksieve.llm.components import connected_components

COSINE = 0.98
LINES = 32
MISS = 2e-4
CELL = 8.0
MATES = 512
PART = 1024
STRIP = 256
SEED = 13


def same_cell(distance: float, cell: float) -> float:
    """Chance that two points at ``distance`` fall in one cell of a randomly shifted line."""
    r = cell / distance
    return erf(r / sqrt(2)) - sqrt(2 / pi) / r * (1 - exp(-r * r / 2))


def least_count(lines: int = LINES, miss: float = MISS) -> int:
    """Collisions that pairs at the limit reach on all but ``miss`` of the occasions.

    The window is as wide as a deviation of the difference.
    """
    p = erf(1 / sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


@dataclass(frozen=True)
class Net:
    """How vectors are brought together."""

    cosine: float
    depth: int
    bands: int
    lines: int = LINES
    seed: int = SEED

    @property
    def distance(self) -> float:
        return sqrt(2 - 2 * self.cosine)

    @classmethod
    def of(cls, n: int, cosine: float = COSINE, miss: float = MISS, mates: int = MATES) -> Net:
        """The net for at most ``n`` vectors that may be linked with each other."""
        d = sqrt(2 - 2 * cosine)
        far, near = same_cell(sqrt(2), CELL * d), same_cell(d, CELL * d)
        depth = ceil(log(n / mates) / -log(far)) if n > mates else 0
        bands = ceil(log(miss) / log(1 - near**depth)) if depth else 1
        return cls(cosine, depth, bands)

    def lines_of(self, size: int):
        import numpy as np

        return np.random.default_rng([self.seed, 1]).standard_normal((size, self.lines))

    def buckets(self, unit):
        """One number per row and band."""
        import numpy as np

        rng = np.random.default_rng([self.seed, 2])
        n = self.depth * self.bands
        shift = rng.random(n)
        lines = rng.standard_normal((unit.shape[1], n))
        cells = np.floor(unit @ lines / (CELL * self.distance) + shift).astype(np.int64)
        key = np.zeros((len(unit), self.bands), np.uint64)
        for k in range(self.depth):
            part = cells[:, k * self.bands : (k + 1) * self.bands].astype(np.uint64)
            key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def units(column, kind: str):
    """Rows of an Arrow binary column of vectors of one size, in doubles, at length one."""
    import numpy as np

    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def collisions(a, b, width: float):
    """(len(a), len(b)) counts of the lines on which a row of ``b`` lies in the window
    centred on a row of ``a``. Both are projections, a column per line."""
    import numpy as np

    count = np.zeros(len(a) * len(b), np.uint8)
    for x, y in zip(a.T, b.T):
        order = np.argsort(y, kind="stable")
        line = y[order]
        low = np.searchsorted(line, x - width, "left")
        size = np.searchsorted(line, x + width, "right") - low
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(start[-1]) + np.repeat(low - start[:-1], size)
        count[np.repeat(np.arange(len(x)) * len(y), size) + order[at]] += 1  # no cell twice
    return count.reshape(len(a), len(b))


def linked(x, y, net: Net) -> Iterator[tuple]:
    """(i, j) arrays of the rows of ``x`` and ``y`` (at length one) that are links."""
    import numpy as np

    lines, least, d = net.lines_of(x.shape[1]), least_count(net.lines), net.distance
    q = y @ lines
    for s in range(0, len(x), STRIP):
        some = x[s : s + STRIP]
        i, j = np.nonzero(collisions(some @ lines, q, d) >= least)
        near = (some @ y.T)[i, j] >= net.cosine
        yield i[near] + s, j[near]


def _roots(n: int, a, b):
    """Of each of ``n`` rows the least row that the edges (a, b) connect it to."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]


def _kind(df: DataFrame, embedding: str) -> str:
    kind = df.schema[embedding].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, NumericType):
        raise TypeError(f"{embedding} is no array of numbers")
    return "<f4" if isinstance(kind.elementType, FloatType) else "<f8"


def _vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vec): ``vec`` holds the bytes of a usable vector, else null."""
    kind = _kind(df, embedding)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("vec").cast(pa.large_list(pa.float64()))
            flat = lists.flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # one zero only
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ptr = np.concatenate(([0], np.cumsum(size)))
            upto = lambda v: np.concatenate(([0], np.cumsum(v)))
            usable = (np.diff(upto(~np.isfinite(x))[ptr]) == 0) & (np.diff(upto(x != 0)[ptr]) > 0)
            usable &= batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            x = x.astype(kind)
            vec = [x[i:j].tobytes() if ok else None for i, j, ok in zip(ptr, ptr[1:], usable)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(vec, pa.binary())],
                names=["vec_id", "label", "vec"],
            )

    rows = df.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").alias("vec")
    )
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    return rows.mapInArrow(run, f"{', '.join(kinds)}, vec binary")


def _nodes(vectors: DataFrame, net: Net, kind: str) -> DataFrame:
    """(node, label, size, vec, copies, least, keys): each different vector of a label once."""
    distinct = vectors.filter("vec IS NOT NULL").groupBy("label", "vec").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    names = ["label", "vec", "copies", "least"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size = np.array([len(v) for v in batch.column("vec").to_pylist()], np.int64)
            keys = np.zeros((len(size), net.bands), np.int64)
            for one in np.unique(size):
                at = np.flatnonzero(size == one)
                keys[at] = net.buckets(units(batch.column("vec").take(pa.array(at)), kind))
            ptr = np.arange(0, keys.size + 1, net.bands, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ptr), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(size), lists], names=[*names, "size", "keys"]
            )

    fields = [f"{c} {distinct.schema[c].dataType.simpleString()}" for c in names]
    keyed = distinct.select(*names).mapInArrow(run, f"{', '.join(fields)}, size long, keys array<long>")
    return saved(keyed.withColumn("node", F.monotonically_increasing_id()), "emb-nodes")


BUCKET = ["label", "size", "band", "key"]


def _meetings(nodes: DataFrame, part: int) -> DataFrame:
    """Rows of ``nodes`` once per task that compares them: BUCKET, i, j and own part."""
    spread = nodes.select("node", "label", "size", F.posexplode("keys").alias("band", "key"))
    shared = spread.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = spread.join(shared, BUCKET).withColumn("parts", parts).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = placed.withColumn("other", other).select(
        "node", *BUCKET, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )
    return met.join(nodes.select("node", "vec", "copies", "keys"), "node")


def _compare(meetings: DataFrame, net: Net, kind: str) -> DataFrame:
    """(node, links, root): partial counts, and a node that each is connected to."""

    def compared(key, table):
        import numpy as np
        import pyarrow as pa

        band, i, j = (key[k].as_py() for k in (2, 4, 5))
        mine = table.column("mine").to_numpy()
        n = len(mine)
        x = units(table.column("vec"), kind)
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(n, -1)[:, :band]
        copies, node = table.column("copies").to_numpy(), table.column("node").to_numpy()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, a_side, b_side = np.zeros(n, np.int64), [], []
        for a, b in linked(x[left], x[right], net):
            a, b = left[a], right[b]
            new = np.ones(len(a), bool) if i != j else a < b
            for k in range(band):  # met before
                new &= keys[a, k] != keys[b, k]
            a, b = a[new], b[new]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            a_side.append(a)
            b_side.append(b)
        a = np.concatenate(a_side) if a_side else np.zeros(0, np.int64)
        b = np.concatenate(b_side) if b_side else a
        root = _roots(n, a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})

    return meetings.groupBy(*BUCKET, "i", "j").applyInArrow(compared, "node long, links long, root long")


def near_duplicates(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    net: Net | None = None,
    part: int = PART,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``.

    Rows are linked if labels are equal and not null and the cosine is at least
    ``cosine``. Vectors that are null, empty or zero, or hold nulls or values that are
    not finite, and vectors of different sizes, are not linked. Repeated rows are vectors
    of their own. A null id is kept but is no component's id unless all its ids are
    null; it is never ``kept``. An empty table gives an empty result; other columns are
    not read.
    """
    kind = _kind(df, embedding)
    if net is None:
        most = df.filter(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{label}`").alias("l")).count()
        net = Net.of(most.agg(F.max("count")).first()[0] or 0, cosine)
    vectors = _vectors(df, vec_id, embedding, label)
    nodes = _nodes(vectors, net, kind)
    found = saved(_compare(_meetings(nodes, part), net, kind), "emb-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = connected_components(found, "node", "root").select("node", F.col("root").alias("group"))
    member = saved(
        nodes.select("node", "label", "vec", "copies", "least")
        .join(links, "node", "left")
        .join(member, "node", "left")
        .withColumn("group", F.coalesce("group", "node")),
        "emb-members",
    )
    heads = member.groupBy("group").agg(F.min("least").alias("head"))
    judged = member.join(heads, "group").select(
        "label", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "head"
    )
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return vectors.join(judged, ["label", "vec"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
