"""A Merkle manifest of a table as a tree of retained SHA-256 midstates.

Rows are leaves; groups of rows (say, one per language) are subtrees in the order of
their leaves, and the subroots are the leaves of the last tree. A node is the hash of
up to ``ARITY`` children. A parent hashes its children one after the other and keeps a
copy of the hash state before each of them, so a replaced child is folded by resuming
the copy of its slot with the replacement and the siblings to its right: what lies to
its left is not hashed again.

Leaves are hashed where the rows are read; only digests move. A task holds one block of
``BLOCK`` neighbours, that is ``LEVELS`` levels of a tree; a tier of blocks has 1 / BLOCK
of the rows of the tier below. Paths to the root go down the tiers the same way, one row
per block, so nothing grows with the table in a task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import saved
from leaksieve.operators.layout import dense_positions

ARITY = 8
LEVELS = 3
BLOCK = ARITY**LEVELS
HEX = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parent:
    """Digest of a run of children (hex digests), with the state before each slot."""

    def __init__(self, children: Sequence[bytes]) -> None:
        self.joined = b"".join(children)
        self.before = []
        state = sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        state = self.before[slot].copy()
        state.update(replacement + self.joined[(slot + 1) * HEX :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.joined[: slot * HEX] + self.joined[(slot + 1) * HEX :]


class Tree:
    """``levels`` levels above a run of digests, all parents with their states."""

    def __init__(self, digests: Sequence[bytes], levels: int) -> None:
        self.parents: list[list[Parent]] = []
        for _ in range(levels):
            runs = range(0, len(digests), ARITY)
            self.parents.append([Parent(digests[i : i + ARITY]) for i in runs])
            digests = [p.digest for p in self.parents[-1]]
        self.tops = list(digests)

    def way(self, leaf: int) -> Iterator[tuple[Parent, int]]:
        """(parent, slot) from a leaf to the top."""
        for level in self.parents:
            yield level[leaf // ARITY], leaf % ARITY
            leaf //= ARITY


def levels_above(n: int, most: int = LEVELS) -> int:
    """Levels until ``n`` nodes have become one, ``most`` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def pack(way) -> bytes:
    """A way as bytes: per level its slot, the number of siblings, and these."""
    return b"".join(
        bytes([slot, len(p.joined) // HEX - 1]) + bytes.fromhex(p.siblings(slot).decode())
        for p, slot in way
    )


def unpack(path: bytes, digest: bytes) -> list[tuple[Parent, int]]:
    """The parents above ``digest``, with their states; the reverse of ``pack``."""
    way, i = [], 0
    while i < len(path):
        slot, n = path[i], path[i + 1]
        run = path[i + 2 : i + 2 + 32 * n].hex().encode()
        run = run[: slot * HEX] + digest + run[slot * HEX :]
        parent = Parent([run[k : k + HEX] for k in range(0, len(run), HEX)])
        way.append((parent, slot))
        digest, i = parent.digest, i + 2 + 32 * n
    return way


def leaf(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of values: each ``-`` if null, else its UTF-8 byte count, ``:``, itself."""
    parts = []
    for column in columns:
        s = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _ordered(table):
    """Digests of a block in the order of their positions, and that order."""
    import numpy as np

    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    digests = table.column("digest").to_pylist()
    return [digests[i].hex().encode() for i in order], order


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.col("pos").bitwiseAND(~(BLOCK - 1))).groupBy("grp", "block")


def _tier_above(nodes: DataFrame) -> DataFrame:
    """(grp, pos, digest, n) of the tier above ``nodes`` of these columns."""

    def raised(key, table):
        import pyarrow as pa

        digests, _ = _ordered(table)
        n = table.column("n")[0].as_py()
        top = Tree(digests, levels_above(n)).tops[0]
        return pa.table(
            {
                "grp": [key[0].as_py()],
                "pos": pa.array([key[1].as_py() // BLOCK], pa.int64()),
                "digest": [bytes.fromhex(top.decode())],
                "n": pa.array([-(-n // BLOCK)], pa.int64()),
            }
        )

    return _blocks(nodes.select("grp", "pos", "digest", "n")).applyInArrow(
        raised, "grp string, pos long, digest binary, n long"
    )


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and all tiers above, until each group has one node."""
    tiers = [nodes]
    while not tiers[-1].filter("n > 1").isEmpty():
        tiers.append(saved(_tier_above(tiers[-1]), "merkle-tier"))
    return tiers


def _paths_below(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, pos, path, subroot, root) of ``nodes`` from those of the tier above."""

    def extended(key, table, above):
        import pyarrow as pa

        digests, order = _ordered(table)
        tree = Tree(digests, levels_above(table.column("n")[0].as_py()))
        path, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        return pa.table(
            {
                "grp": [key[0].as_py()] * len(order),
                "pos": table.column("pos").take(pa.array(order)),
                "path": [pack(tree.way(i)) + path for i in range(len(order))],
                "subroot": [subroot] * len(order),
                "root": [root] * len(order),
            }
        )

    above = paths.withColumn("block", F.col("pos") * BLOCK).groupBy("grp", "block")
    return _blocks(nodes.select("grp", "pos", "digest", "n")).cogroup(above).applyInArrow(
        extended, "grp string, pos long, path binary, subroot binary, root binary"
    )


@dataclass(frozen=True)
class Manifest:
    """``rows``: (row, id, digest, changed, grp, pos, n), the leaves; ``paths``: for each block of
    leaves, its (grp, pos) in the tier of blocks, the path from there to the root, and the roots."""

    rows: DataFrame
    paths: DataFrame

    def roots(self) -> DataFrame:
        """(grp, subroot, root), one row per group; ``grp`` is ``-`` or ``=`` and the value."""
        return self.paths.filter("pos = 0").select(
            "grp", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root")
        )


def _counted(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")


def build(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    changed: tuple[str, Column] | None = None,
    is_changed: Column | None = None,
) -> Manifest:
    """The manifest of ``docs``.

    ``changed`` names a column and what it holds in the rows of ``is_changed`` that are
    to be folded in as replacements. Rows are ordered by ``order``, nulls first, then by
    their digest; groups by UTF-8 bytes, null first. Null values are leaves' ``-``,
    repeated rows are leaves of their own, empty and very long texts are values as any
    other, other columns are not read. An empty table has no leaf and no root.
    """
    plain = [F.col(f"`{c}`") for c in columns]
    digest = F.unhex(leaf(plain))
    other = F.lit(None).cast("binary")
    if changed is not None:
        name, value = changed
        replaced = [value if c == name else F.col(f"`{c}`") for c in columns]
        other = F.when(F.coalesce(is_changed, F.lit(False)), F.unhex(leaf(replaced)))
    leaves = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{order}`").alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("grp"),
            digest.alias("digest"),
            other.alias("changed"),
        ),
        "merkle-leaves",
    )
    rows = saved(_counted(dense_positions(leaves, "grp", ["id", "digest", "row"])), "merkle-rows")
    tiers = _tiers(rows)
    if len(tiers) == 1:  # lone leaves only: their blocks are themselves
        tiers.append(saved(_tier_above(rows), "merkle-tier"))
    subroots = tiers[-1].select("grp", "digest")
    named = subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest")
    top = dense_positions(named, "all", ["name"]).withColumnRenamed("all", "grp")
    top = saved(_counted(top), "merkle-subroots")
    upper = _tiers(top)
    paths = upper[-1].select(
        "grp", "pos", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), F.col("digest").alias("root")
    )
    for tier in reversed(upper[:-1]):
        paths = saved(_paths_below(tier, paths), "merkle-paths")
    paths = (
        top.select("grp", "pos", "name", "digest")
        .join(paths, ["grp", "pos"])
        .select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    )
    for tier in reversed(tiers[1:-1]):
        paths = saved(_paths_below(tier, paths), "merkle-paths")
    return Manifest(rows, saved(paths, "merkle-block-paths"))


def prove(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per leaf.

    ``proof_sha256`` is the hash of the leaf's siblings, level by level to the root, left
    to right. ``folded_root`` resumes the retained states with the changed digest, or the
    leaf's own where nothing changed.
    """

    def proved(key, table, above):
        import pyarrow as pa

        digests, order = _ordered(table)
        tree = Tree(digests, levels_above(table.column("n")[0].as_py()))
        path, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        upper = unpack(path, tree.tops[0])
        beyond = b"".join(p.siblings(slot) for p, slot in upper)
        changed = table.column("changed").to_pylist()
        root = root.hex()
        proofs, folded = [], []
        for i, at in enumerate(order):
            proof = sha256()
            node = digests[i] if changed[at] is None else changed[at].hex().encode()
            for parent, slot in tree.way(i):
                proof.update(parent.siblings(slot))
                node = parent.fold(slot, node)
            proof.update(beyond)
            for parent, slot in upper:
                node = parent.fold(slot, node)
            proofs.append(proof.hexdigest())
            folded.append(node.decode())
        n = len(order)
        return pa.table(
            {
                "id": table.column("id").take(pa.array(order)),
                "leaf": [d.decode() for d in digests],
                "subroot": [subroot.hex()] * n,
                "root": [root] * n,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }
        )

    kind = manifest.rows.schema["id"].dataType.simpleString()
    above = manifest.paths.withColumn("block", F.col("pos") * BLOCK).groupBy("grp", "block")
    rows = manifest.rows.select("grp", "pos", "id", "digest", "changed", "n")
    return _blocks(rows).cogroup(above).applyInArrow(
        proved,
        f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
