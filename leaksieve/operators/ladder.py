"""Jumps along chains: far places of a long line in few rounds.

A chain table says for a node which one comes next. Level k of its ladder holds, for each
node, the nodes that are 1, 2, ... RADIX - 1 times RADIX**k steps ahead. Whoever spreads
something along chains goes up the levels once, each time from all that has been reached,
and so covers every distance; levels grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.layout import stored

RADIX = 8
SMALL = 1 << 16  # so many nodes of a chain table, at most, are folded in one task


class Ladder:
    """Levels (node, steps, ahead) of a chain table (node, next), made when asked for.

    ``next`` is one node or null. A chain must not lead back to itself.
    """

    def __init__(self, chain: DataFrame) -> None:
        self._levels: list[DataFrame] = []
        self._base = chain.select("node", F.col("next").alias("s1"))

    def level(self, k: int) -> DataFrame | None:
        """(node, steps, ahead): ``ahead`` is ``steps`` steps from ``node``; None where
        no chain is so long."""
        while len(self._levels) <= k:
            if self._base is None:
                return None
            hop = self._base.filter("s1 IS NOT NULL")
            table = hop
            for i in range(2, RADIX + 1):
                further = hop.select(F.col("node").alias(f"s{i - 1}"), F.col("s1").alias(f"s{i}"))
                table = table.join(further, f"s{i - 1}", "left")
            table = stored(table.select("node", *[f"s{i}" for i in range(1, RADIX + 1)]))
            size = RADIX ** len(self._levels)
            rungs = [
                F.struct(F.lit(i * size).cast("long").alias("steps"), F.col(f"s{i}").alias("ahead"))
                for i in range(1, RADIX)
            ]
            self._levels.append(
                table.select("node", F.explode(F.array(*rungs)).alias("r"))
                .select("node", "r.steps", "r.ahead").filter("ahead IS NOT NULL")
            )
            long = table.filter(f"s{RADIX} IS NOT NULL")
            self._base = None if long.isEmpty() else table.select("node", F.col(f"s{RADIX}").alias("s1"))
        return self._levels[k]


def _left_out(level: int) -> Column:
    """The nodes that leave a chain table in a round: a fixed coin shows heads for them and
    tails for the next one, so no two neighbours leave, and about a quarter does."""
    coin = lambda node: F.xxhash64(node, F.lit(level)).bitwiseAND(F.lit(1)) == 1
    return coin("node") & ~coin("next")


def _thinned(chain: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(levels, rows): a chain table of which at most ``SMALL`` rows are left, and for each
    round (gone, via): the rows that left, and (ahead, node) for a node that left between
    ``ahead``, which stayed, and its new next."""
    rows, levels = chain.select("node", "next").filter("next IS NOT NULL"), []
    while rows.count() > SMALL:
        out = _left_out(len(levels))
        gone = rows.filter(out)
        over = gone.select(F.col("node").alias("next"), F.col("next").alias("after"))
        kept = stored(rows.filter(~out).join(over, "next", "left").select("node", "next", "after"))
        via = kept.filter("after IS NOT NULL").select(F.col("node").alias("behind"), F.col("next").alias("node"))
        levels.append((gone, via))
        rows = kept.select("node", F.coalesce("after", "next").alias("next"))
    return levels, rows


def closure(chain: DataFrame, rest: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, node): all nodes that can be reached from the ``starts`` (root, node).

    Edges are those of the chain table (node, next) and of ``rest`` (node, next); nodes are
    longs. In turn, what is new climbs the chains, then takes one step by the other edges.
    Where chains have more than ``SMALL`` nodes, nodes leave them in rounds, a quarter each
    time; what is left is climbed by a ladder, then those that left are reached from the
    ones behind them, so work grows with the nodes. Rounds grow with the number of such
    turns on the way (merges within merges, for a history) and the logarithm of the
    number of nodes, not with the number of steps.
    """
    both = ["root", "node"]
    levels, rows = _thinned(chain)
    ladder = Ladder(rows)
    new, seen, top = stored(starts.select(*both).distinct()), None, None
    while True:
        left = []
        for gone, _ in levels:
            at = stored(new.join(gone, "node", "left").select(*both, "next"))
            left.append(at.filter("next IS NOT NULL").select(*both))
            new = at.select("root", F.coalesce("next", "node").alias("node")).distinct()
        new = stored(new) if levels else new
        reached, top, k = new, new if top is None else top.unionByName(new), 0
        # Where no jump of a level finds an unseen node, no longer one does: what has
        # been seen before this turn is closed.
        while (level := ladder.level(k)) is not None:
            ahead = new.join(level, "node").select("root", F.col("ahead").alias("node"))
            found = stored(ahead.distinct().join(top, both, "left_anti"))
            if found.isEmpty():
                break
            new, reached, top, k = new.unionByName(found), reached.unionByName(found), top.unionByName(found), k + 1
        for (_, via), own in zip(reversed(levels), reversed(left)):
            back = reached.withColumnRenamed("node", "behind").join(via, "behind").select(*both)
            reached = stored(reached.unionByName(back.unionByName(own).distinct()))
        # Chains that meet one seen before go on in it.
        found = stored(reached if seen is None else reached.distinct().join(seen, both, "left_anti"))
        seen = found if seen is None else seen.unionByName(found)
        aside = found.join(rest, "node").select("root", F.col("next").alias("node"))
        new = stored(aside.distinct().join(seen, both, "left_anti"))
        if new.isEmpty():
            return seen


def _earlier(at: Column, to: Column, steps: Column) -> Column:
    """The lesser of a place and one that lies ``steps`` ahead; null is none."""
    moved = F.struct(to["time"].alias("time"), (to["ahead"] - steps).alias("ahead"))
    return F.when(to.isNotNull() & (moved < at), moved).otherwise(at)


def _folded_in_a_task(rows: DataFrame) -> DataFrame:
    """(node, at) of at most ``SMALL`` rows (node, next, steps, at)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = {}
        for batch in batches:
            for node, next, steps, time, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                held[node] = (next, steps, time, ahead)
        done = {}
        for node in held:
            way = []
            while node in held and node not in done:
                way.append(node)
                node = held[node][0]
            place = done.get(node)
            for node in reversed(way):
                _, steps, time, ahead = held[node]
                to = (time, ahead) if place is None else min((time, ahead), (place[0], place[1] - steps))
                done[node] = place = to
        if done:
            columns = [list(done), [t for t, _ in done.values()], [a for _, a in done.values()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["node", "time", "ahead"]
            )

    flat = rows.select("node", "next", "steps", "at.time", "at.ahead").repartition(1)
    out = flat.mapInArrow(run, "node long, time long, ahead long")
    return out.select("node", F.struct("time", "ahead").alias("at"))


def folded(chain: DataFrame, places: DataFrame) -> DataFrame:
    """(node, at) of the nodes of a chain table (node, next): the least of a node's own place
    and, for each node ahead, that one's place with the steps to it taken off. The chain
    table may have ``steps``, else each next node is one step ahead.

    ``places`` is (node, at), at = (time, ahead); nodes are longs. Several nodes may have
    the same next. In each round about a quarter of the nodes leaves the table, handing
    its place and its next to those behind it; when ``SMALL`` are left they are folded in
    one task, then those that left get theirs, in reverse. Rows of all rounds together are
    about four times the nodes, whatever the length of the chains.
    """
    to = places.select(F.col("node").alias("next"), F.col("at").alias("to"))
    # The next one's place is taken over at once, so that ends need no row of their own.
    steps = (F.col("steps") if "steps" in chain.columns else F.lit(1)).cast("long").alias("steps")
    rows = stored(
        chain.select("node", "next", steps).join(places, "node").join(to, "next", "left").select(
            "node", "next", "steps", _earlier(F.col("at"), F.col("to"), F.col("steps")).alias("at"),
        )
    )
    levels = []
    while rows.count() > SMALL:
        out = _left_out(len(levels))
        gone = rows.filter(out)
        over = gone.select(
            F.col("node").alias("next"), F.col("next").alias("after"),
            F.col("steps").alias("more"), F.col("at").alias("to"),
        )
        levels.append(gone)
        rows = stored(
            rows.filter(~out).join(over, "next", "left").select(
                "node", F.coalesce("after", "next").alias("next"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                _earlier(F.col("at"), F.col("to"), F.col("steps")).alias("at"),
            )
        )
    known = _folded_in_a_task(rows)
    for gone in reversed(levels):
        ahead = known.select(F.col("node").alias("next"), F.col("at").alias("to"))
        back = gone.join(ahead, "next", "left").select(
            "node", _earlier(F.col("at"), F.col("to"), F.col("steps")).alias("at")
        )
        known = stored(known.unionByName(back))
    return known
