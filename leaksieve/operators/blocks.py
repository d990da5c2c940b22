"""Places in a history, block by block: neighbours in time share a task.

A node's place is (time, ahead), and the least counts of its own and of each child's with
the steps to it taken off. Blocks hold about ``SIZE`` edges in the order of time, so most
edges lie inside one. A task finds the places of its block as if there were no others, then
takes out the nodes without edges to other blocks, one by one: the ways through such a node
become edges of more steps between its neighbours. What is left is dealt to wider blocks,
and so on, until one task holds it; then places go back down, level by level. Rows of all
levels stay in proportion to the edges where time keeps neighbours together, however long
the ways are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.layout import discard, settled

SIZE = 1 << 16  # edges of a block, about; so many rows at most are left to the last task
SAMPLES = 32  # edges of each block that come to the driver, to choose bounds
WORTH = 0.8  # where a level leaves more than this part, blocks are given up

# Kinds of rows. VALUE: the place of x. EDGE: u steps from x up to y. FIRST: one step, with
# both own times. OUT, IN: x has an edge to, or from, another block. KNOWN: the last place of
# x. FOUND: likewise, as a result. OPEN: places in block x may still change. hx and hy are
# the homes of x and y, their blocks at the lowest level.
VALUE, EDGE, FIRST, OUT, IN, KNOWN, FOUND, OPEN = range(8)
_FIELDS = ["kind", "x", "y", "u", "v", "hx", "hy"]
_MADE = ", ".join(f"{c} long" for c in _FIELDS)


def moved(
    edges: DataFrame, nodes: DataFrame, otherwise: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """(node, time, ahead), stored: the places of all nodes that have another than their own,
    and perhaps of others, each node once.

    ``edges`` (r, node, ts, up, up_ts) are stored, one at least, of longs without null: from a
    child to its parent, with both own times, in the repository r. ``nodes`` (node, ts), stored
    too, has at least all of their nodes. Where time does not keep neighbours together,
    ``otherwise`` gets edges (node, up, steps) and places (node, at) and returns the last ones.
    """
    total = edges.count()
    rows, cuts, left, levels, known = _first_rows(edges, total), None, total, [], None
    if rows is None:
        if 2 * total < nodes.count():
            ups = edges.select(F.col("up").alias("node"), F.col("up_ts").alias("ts"))
            nodes = settled(edges.select("node", "ts").unionByName(ups).distinct())
        placed = nodes.select("node", _at(F.col("ts"), _long(0)))
        done = otherwise(edges.select("node", "up", _long(1).alias("steps")), placed)
        return settled(done.select("node", "at.time", "at.ahead"))
    while True:
        made = settled(rows.groupBy("block").applyInArrow(_solver(back=False), _MADE))
        levels.append((rows, cuts, made))
        rest = made.filter(F.col("kind").isin(VALUE, EDGE))
        sizes = rest.groupBy("hx").agg(F.count(F.lit(1)).alias("n")).collect()
        before, left = left, sum(s["n"] for s in sizes)
        if not left:
            break
        if left > max(SIZE, WORTH * before):
            known = _known_by(otherwise, rest)
            break
        cuts = _cuts(sorted((s["hx"], s["n"]) for s in sizes))
        rows = _wider(rest, cuts)
    old = []
    for rows, cuts, made in reversed(levels):
        found = made.filter(F.col("kind") == FOUND)
        if known is not None:
            given = known.withColumn("kind", _long(KNOWN)).select(_block(cuts, "hx").alias("block"), *_FIELDS)
            still = made.filter(F.col("kind") == OPEN).select(F.col("x").alias("block"))
            back = rows.join(still, "block", "left_semi").unionByName(given)
            back = settled(back.groupBy("block").applyInArrow(_solver(back=True), _MADE))
            found = found.unionByName(back)
        old += [made] if known is None else [made, back]
        known = found
    out = settled(known.select(F.col("x").alias("node"), F.col("u").alias("time"), F.col("v").alias("ahead")))
    discard(*old)
    return out


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _at(time: Column, ahead: Column) -> Column:
    return F.struct(time.alias("time"), ahead.alias("ahead")).alias("at")


def _first_rows(edges: DataFrame, total: int) -> DataFrame | None:
    """The edges dealt to blocks; None where most would lie between two blocks."""
    schema = f"block long, {_MADE}"
    if total <= SIZE:
        return edges.mapInArrow(_dealer([], []), schema)
    some = edges.sample(fraction=min(1.0, SAMPLES / SIZE), seed=1).toArrow()
    ends = sorted(zip(some["r"].to_pylist(), some["ts"].to_pylist()))[SAMPLES::SAMPLES]
    deal = _dealer([r for r, _ in ends], [t for _, t in ends])
    kinds = [k for b in deal(some.to_batches()) for k in b["kind"].to_pylist()]
    if kinds.count(FIRST) < kinds.count(OUT):
        return None
    return edges.mapInArrow(deal, schema)


def _dealer(bounds_r: list[int], bounds_t: list[int]) -> Callable[[Iterator], Iterator]:
    """From edges to rows of blocks. Bounds are (repository, time) in order; where several
    are equal, the nodes of that time are dealt among the blocks between them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        br, bt = np.array(bounds_r, "int64"), np.array(bounds_t, "int64")

        def block(r, t, node):
            low, high = np.searchsorted(br, r, "left"), np.searchsorted(br, r, "right")
            for repo in np.unique(r[low < high]):
                i, own = np.searchsorted(br, repo, "left"), r == repo
                times = bt[i : np.searchsorted(br, repo, "right")]
                low[own] = i + np.searchsorted(times, t[own], "left")
                high[own] = i + np.searchsorted(times, t[own], "right")
            between = high - low - 1
            return np.where(between > 0, low + 1 + node % np.maximum(between, 1), high)

        for batch in batches:
            r, x, t, y, s = (batch[c].to_numpy(zero_copy_only=False) for c in ("r", "node", "ts", "up", "up_ts"))
            bx, by = block(r, t, x), block(r, s, y)
            a = bx == by
            b = ~a
            none = lambda n: pa.nulls(n, pa.int64())
            n, m = int(a.sum()), int(b.sum())
            same = lambda value, n: pa.array(np.full(n, value, "int64"))
            parts = [
                [bx[a], same(FIRST, n), x[a], y[a], t[a], s[a], none(n), none(n)],
                [bx[b], same(OUT, m), x[b], y[b], same(1, m), t[b], bx[b], by[b]],
                [by[b], same(IN, m), y[b], none(m), s[b], none(m), none(m), none(m)],
            ]
            names = ["block", "kind", "x", "y", "u", "v", "hx", "hy"]
            for part in parts:
                columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in part]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _cuts(sizes: list[tuple[int, int]]) -> list[int]:
    """The first homes of all wider blocks but the first: blocks of up to ``SIZE`` rows, or
    of one home."""
    cuts, held = [], 0
    for home, n in sizes:
        if held and held + n > SIZE:
            cuts.append(home)
            held = 0
        held += n
    return cuts


def _block(cuts: list[int] | None, home: str) -> Column:
    if cuts is None:
        return F.col(home)
    if not cuts:
        return _long(0)
    firsts = F.array(*map(_long, cuts))
    return F.size(F.filter(firsts, lambda c: c <= F.col(home))).cast("long")


def _wider(rest: DataFrame, cuts: list[int]) -> DataFrame:
    """What a level has left, dealt to wider blocks."""
    kind, null = F.col("kind"), F.lit(None).cast("long")
    both = rest.withColumns({"bx": _block(cuts, "hx"), "by": _block(cuts, "hy")})

    def row(*fields):
        named = zip(["block", *_FIELDS], fields)
        return F.struct(*((F.col(f) if isinstance(f, str) else f).alias(name) for name, f in named))

    own = lambda k: row("bx", k, "x", "y", "u", "v", "hx", "hy")
    between = F.array(own(_long(OUT)), row("by", _long(IN), "y", null, null, null, "hy", null))
    inside = (kind == VALUE) | (F.col("bx") == F.col("by"))
    return both.select(F.explode(F.when(inside, F.array(own(kind))).otherwise(between)).alias("row")).select("row.*")


def _known_by(otherwise: Callable[[DataFrame, DataFrame], DataFrame], rest: DataFrame) -> DataFrame:
    """The last places of what a level has left, found by ``otherwise``."""
    of = lambda kind: rest.filter(F.col("kind") == kind)
    edges = of(EDGE).select(F.col("x").alias("node"), F.col("y").alias("up"), F.col("u").alias("steps"))
    placed = settled(of(VALUE).select(F.col("x").alias("node"), _at(F.col("u"), F.col("v"))))
    done = otherwise(edges, placed).select(F.col("node").alias("x"), F.col("at.time").alias("u"), F.col("at.ahead").alias("v"))
    null = F.lit(None).cast("long")
    homes = of(VALUE).select("x", "hx")
    return done.join(homes, "x").select(_long(FOUND).alias("kind"), "x", null.alias("y"), "u", "v", "hx", null.alias("hy"))


def _solver(back: bool) -> Callable:
    """What a task does with a block: on the way up places that nothing outside can change
    are FOUND, and the rest is handed on; on the way ``back`` the rest is KNOWN and what lies
    between is FOUND. Only places that differ from those of the rows are returned."""

    def run(table):
        import pyarrow as pa

        own, home, outs, inward, outward, last = {}, {}, {}, set(), {}, {}
        here = table["block"][0].as_py()
        for kind, x, y, u, v, hx, hy in zip(*(table[c].to_pylist() for c in _FIELDS)):
            if kind == FIRST:
                own[x], own[y] = (u, 0), (v, 0)
                outs.setdefault(x, {}).setdefault(y, 1)
            elif kind == EDGE:
                ways = outs.setdefault(x, {})
                ways[y] = max(u, ways.get(y, 0))
            elif kind == VALUE:
                own[x], home[x] = (u, v), hx
            elif kind == OUT:
                outward.setdefault(x, []).append((y, u, hx, hy))
                if v is not None:
                    own[x] = (v, 0)
            elif kind == IN:
                inward.add(x)
                if u is not None:
                    own[x] = (u, 0)
            else:
                last[x] = (u, v)
        ins = {}
        for x, ways in outs.items():
            for y, steps in ways.items():
                ins.setdefault(y, {})[x] = steps
        at = {x: min(place, last.get(x, place)) for x, place in own.items()}
        waiting = {x: len(ways) for x, ways in ins.items()}
        todo, order, free = [x for x in at if x not in ins], [], set(inward)
        while todo:
            x = todo.pop()
            order.append(x)
            time, ahead = at[x]
            for y, steps in outs.get(x, {}).items():
                to = (time, ahead - steps)
                if to < at[y]:
                    at[y] = to
                if x in free:
                    free.add(y)
                waiting[y] -= 1
                if not waiting[y]:
                    todo.append(y)
        if len(order) < len(at):
            raise ValueError("a commit is its own ancestor")
        made = [
            (FOUND, x, None, *at[x], home.get(x, here), None)
            for x in order
            if at[x] < own[x] and (x in free) == back
        ]
        if not back:
            if free:
                made.append((OPEN, here, None, None, None, None, None))
            # Of the free nodes those between others are taken out, the plainest first, as long
            # as that does not add edges.
            for x in order:
                if x not in free:
                    for y in outs.pop(x, {}):
                        del ins[y][x]
            todo = [x for x in order if x in free and x not in inward and x not in outward]
            for limit in (1, 2, 4, 16, 64, 64):
                stuck = []
                for x in todo:
                    came, went = ins.get(x, {}), outs.get(x, {})
                    pairs = len(came) * len(went)
                    if pairs > limit or pairs > len(came) + len(went) < sum(
                        y not in outs[c] for c in came for y in went
                    ):
                        stuck.append(x)
                        continue
                    for c, steps in came.items():
                        ways = outs[c]
                        del ways[x]
                        for y, more in went.items():
                            if c == y:
                                raise ValueError("a commit is its own ancestor")
                            if steps + more > ways.get(y, 0):
                                ways[y] = ins[y][c] = steps + more
                    for y in went:
                        del ins[y][x]
                    ins.pop(x, None)
                    outs.pop(x, None)
                todo = stuck
            for x in {*todo, *inward, *outward}:
                made.append((VALUE, x, None, *at[x], home.get(x, here), None))
                for y, steps in outs.get(x, {}).items():
                    made.append((EDGE, x, y, steps, None, home.get(x, here), home.get(y, here)))
            for x, ways in outward.items():
                made += [(EDGE, x, y, steps, None, hx, hy) for y, steps, hx, hy in ways]
        columns = zip(*made) if made else [[]] * len(_FIELDS)
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(_FIELDS, columns)})

    return run
