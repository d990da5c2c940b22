"""Near-duplicates by Jaccard similarity of word shingles, through wide SimHash fingerprints.

Two texts of similarity 0.8 differ in some 15 % of the bits of a SimHash, so 64 bits tell
little and leave keys of five bits to pigeonring buckets. Here a fingerprint has 256 bits
(64 may differ, more than four standard deviations above what 0.8 gives), and texts meet
in ``BANDS`` buckets of ``ROWS`` minima of their shingles' hashes each. The pigeonring
then prunes: some segment of 32 bits must start a chain whose first ``l`` segments
together differ in at most ``8 l`` bits, for every ``l``. Pairs that pass take the full
Hamming check, and those that pass that are decided by the exact similarity of their
shingle sets. At similarity 0.8, 6 of 10,000 pairs share no bucket.

Only different texts are compared; copies ride along. In buckets of up to ``BUCKET_CAP``
texts every pair is tested. Larger buckets are dealt into parts, two of which meet in a
task; all pairs take the pigeonring and Hamming tests there, and a third one that errs on
one side only: a bitmap of ``BITS`` hashed shingles shows how many shingles of a text the
other one surely lacks. A minimum spanning forest of what is left, nearest pairs first,
goes to the exact test. A group of near copies thus
sends on a number of pairs that grows with its size and parts, not with its square. Where
pairs of a forest fail the exact test, their tasks send on further pairs between texts
that are not connected yet, nearest first and four times as many in each round, until
none is left: the groups are those of all pairs that share a bucket and pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from leaksieve.llm.common import discard, fresh, let, saved
from leaksieve.llm.components import connected_components
from leaksieve.llm.texthash import BASE, SpanHasher, blocks, gram_hashes, mixed, spans
from leaksieve.llm.url_filter import build_bloom

SHINGLE = 5
SIMILARITY = 0.8
LANES = 4  # of 64 bits
SEGMENTS = 8  # of 32 bits
SEGMENT_BUDGET = 8
BANDS = 14
ROWS = 4
BUCKET_CAP = 16
PART = 512
BITS = 2048  # of a text's bitmap of shingles; it prunes little beyond as many shingles
BLOCK_BYTES = 1 << 20
SLICE = 1 << 16
FAR = 0xFFFF  # the distance of pairs that are no candidates
BLANK = bytes(16)  # the key of all texts without a word
WANTED_FPP = 0.03  # of the filter of texts in a pair
WANTED_MAX = 1 << 23  # keys that filter is made for (8 MB); with more it lets more texts pass

FPS = [f"f{i}" for i in range(LANES)]
TASK = ["band", "bucket", "p", "q"]
SKETCH = [*FPS, "size", "bits"]


def shingle_sets(texts, size: int = SHINGLE) -> Iterator[tuple]:
    """(first row, row count, rows, hashes) for blocks of rows; pairs rise and differ.

    A-Z are lower-cased; a text of fewer than ``size`` words has one shingle, the whole.
    """
    import numpy as np

    lower = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
    inside = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
    hasher = SpanHasher()
    for first, count, data, offsets in blocks(texts, BLOCK_BYTES):
        data = lower[data]
        starts, ends, rows = spans(data, offsets, inside)
        h = hasher.hashes(data, starts, ends)
        words = np.bincount(rows, minlength=count)
        begin = np.cumsum(words) - words
        found_rows, found = [], []
        for k in range(1, size + 1):
            g = gram_hashes(h, k)
            if k < size:
                at = begin[words == k]
            else:
                at = np.flatnonzero(rows[: len(g)] == rows[k - 1 :]) if len(g) else begin[:0]
            found_rows.append(rows[at])
            found.append(g[at])
        r, g = np.concatenate(found_rows), np.concatenate(found)
        order = np.lexsort((g, r))
        r, g = r[order], g[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        yield first, count, r[new], g[new]


def _constants(n: int):
    import numpy as np

    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE))


def fingerprints(rows, hashes, count: int):
    """``count`` by ``LANES`` words: a bit is 1 if set in over half the row's hashes."""
    import numpy as np

    total = np.bincount(rows, minlength=count)
    out = np.zeros((count, LANES), np.uint64)
    for lane, salt in enumerate(_constants(LANES)):
        sums = np.zeros((count, 64), np.int64)
        for i in range(0, len(rows), SLICE):
            r, x = rows[i : i + SLICE], mixed(hashes[i : i + SLICE] + salt)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            runs = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            sums[r[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
        packed = np.packbits(sums * 2 > total[:, None], axis=1, bitorder="little")
        out[:, lane] = np.ascontiguousarray(packed).view("<u8")[:, 0]
    return out


def band_keys(rows, hashes):
    """(rows that have shingles, their ``BANDS`` bucket keys)."""
    import numpy as np

    runs = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    odd = _constants(BANDS * ROWS) | np.uint64(1)
    keys = np.zeros((len(runs), BANDS), np.uint64)
    for i, m in enumerate(odd):
        least = np.minimum.reduceat(hashes * m + (m >> np.uint64(7)), runs)
        band = i // ROWS
        keys[:, band] = mixed(keys[:, band] * np.uint64(BASE) + least)
    return rows[runs], keys


def bitmaps(rows, hashes, count: int):
    """``count`` by ``BITS / 8`` bytes: the shingles of a row, hashed to ``BITS`` bits."""
    import numpy as np

    shift = np.uint64(64 - (BITS.bit_length() - 1))
    held = np.zeros((count, BITS), bool)
    held[rows, (mixed(hashes) >> shift).astype(np.int64)] = True
    return np.packbits(held, axis=1)


def with_sketches(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, f0 .. f3, size, bits, bands); ``key`` is the MD5 of the text, or ``BLANK``.

    ``size`` counts the different shingles. A text without a word has no bitmap or bands.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def sketch(batch):
        import hashlib

        import numpy as np
        import pyarrow as pa

        texts = batch.column(1)
        n = len(texts)
        fps = np.zeros((n, LANES), np.uint64)
        sizes = np.zeros(n, np.int64)
        keys, bands, maps = [BLANK] * n, [None] * n, [None] * n
        for first, count, rows, hashes in shingle_sets(texts, size):
            if not len(rows):
                continue
            fps[first : first + count] = fingerprints(rows, hashes, count)
            sizes[first : first + count] = np.bincount(rows, minlength=count)
            bits = bitmaps(rows, hashes, count)
            held, buckets = band_keys(rows, hashes)
            for row, b in zip(held.tolist(), buckets.view(np.int64)):
                bands[first + row] = b
                maps[first + row] = bits[row].tobytes()
                keys[first + row] = hashlib.md5(texts[first + row].as_buffer()).digest()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(keys, pa.binary()),
                *[pa.array(fps[:, i].view(np.int64)) for i in range(LANES)],
                pa.array(sizes),
                pa.array(maps, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "key", *SKETCH, "bands"],
        )

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield sketch(batch.slice(i, 1000))

    schema = StructType(
        [
            StructField("doc_id", narrow.schema["doc_id"].dataType),
            StructField("key", BinaryType()),
            *[StructField(f, LongType()) for f in FPS],
            StructField("size", LongType()),
            StructField("bits", BinaryType()),
            StructField("bands", ArrayType(LongType())),
        ]
    )
    return narrow.mapInArrow(run, schema)


def text_key(text: str) -> Column:
    """The key of ``with_sketches``, natively."""
    t = F.coalesce(F.col(text), F.lit(""))
    word = t.rlike(r"[^\x20\x09-\x0D]")
    return F.when(word, F.unhex(F.md5(F.encode(t, "UTF-8")))).otherwise(F.lit(bytearray(BLANK)))


def _segments(x: list[Column]) -> list[Column]:
    low = F.lit(0xFFFFFFFF)
    halves = [[v.bitwiseAND(low), F.shiftrightunsigned(v, 32)] for v in x]
    return [F.bit_count(h) for pair in halves for h in pair]


def _some_chain(diffs: list, either, both):
    """Whether some segment starts a chain that keeps to every budget."""
    chains = []
    for s in range(SEGMENTS):
        total, ok = 0, None
        for l in range(1, SEGMENTS):
            total = total + diffs[(s + l - 1) % SEGMENTS]
            test = total <= l * SEGMENT_BUDGET
            ok = test if ok is None else both(ok, test)
        chains.append(ok)
    return reduce(either, chains)


def _native_pairs(few: DataFrame) -> DataFrame:
    """(a, b) of each bucket that pass the pigeonring and the Hamming check."""
    met = few.alias("l").join(
        few.alias("r"),
        (F.col("l.band") == F.col("r.band"))
        & (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col("l.key") < F.col("r.key")),
    )
    x = [F.col(f"l.{f}").bitwiseXOR(F.col(f"r.{f}")) for f in FPS]
    diffs = [d.cast("int").alias(f"d{i}") for i, d in enumerate(_segments(x))]
    pairs = met.select(F.col("l.key").alias("a"), F.col("r.key").alias("b"), *diffs)
    d = [F.col(f"d{i}") for i in range(SEGMENTS)]
    ring = _some_chain(d, lambda p, q: p | q, lambda p, q: p & q)
    return pairs.filter(ring & (reduce(lambda p, q: p + q, d) <= SEGMENTS * SEGMENT_BUDGET)).select("a", "b")


def distances(fps):
    """Matrix of Hamming distances, ``FAR`` for pairs that fail either test."""
    import numpy as np

    n = len(fps)
    halves = np.ascontiguousarray(fps).view("<u4").reshape(n, SEGMENTS)
    diffs = [
        np.bitwise_count(halves[:, None, s] ^ halves[None, :, s]).astype(np.uint16)
        for s in range(SEGMENTS)
    ]
    ring = _some_chain(diffs, np.logical_or, np.logical_and)
    total = reduce(np.add, diffs)
    return np.where(ring & (total <= SEGMENTS * SEGMENT_BUDGET), total, np.uint16(FAR))


def similar_at_most(maps, sizes, similarity: float):
    """Matrix of the pairs whose bitmaps leave that similarity possible; it has all that
    have it. Each bit that only one map has is a shingle that the other text lacks."""
    import numpy as np

    bits = np.unpackbits(maps, axis=1).astype(np.float32)
    lacks = bits.sum(axis=1)[:, None] - bits @ bits.T  # of row i's, those that j lacks
    common = sizes[:, None] - lacks
    common = np.minimum(common, common.T)
    return common * (1 + similarity) >= (sizes[:, None] + sizes[None, :]) * similarity - 1e-6


def forest(distance):
    """Edges (i, j) of a minimum spanning forest of the pairs that are not ``FAR``."""
    import numpy as np

    n = len(distance)
    best, via = np.full(n, FAR, np.uint16), np.full(n, -1)
    out, todo = [], np.ones(n, bool)
    for _ in range(n):  # Prim's algorithm; a row that nothing reaches starts a tree
        i = int(np.argmin(np.where(todo, best, np.uint32(FAR + 1))))
        todo[i] = False
        if best[i] != FAR:
            out.append((int(via[i]), i))
        nearer = distance[i] < best
        best = np.where(nearer, distance[i], best)
        via = np.where(nearer, i, via)
    return out


def _seats(many: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the larger buckets with their parts, sizes and bitmaps."""
    parts = F.ceil(F.col("n") / F.lit(PART)).cast("int")
    seats = many.withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    )
    return saved(seats.join(texts.select("key", "size", "bits"), "key"), "similar-seats")


def _meetings(seats: DataFrame) -> DataFrame:
    """Rows of a task (band, bucket, p, q): pairs within part p = q, or of p with q."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return seats.withColumn("other", other).select(
        *TASK[:2], F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        "part", "key", *SKETCH,
    )


def _group_distances(group, similarity: float):
    import numpy as np

    fps = np.stack([group[f].to_numpy(np.int64) for f in FPS], axis=1)
    maps = np.frombuffer(b"".join(group["bits"]), np.uint8).reshape(len(group), -1)
    distance = distances(fps)
    distance[~similar_at_most(maps, group["size"].to_numpy(np.int64), similarity)] = FAR
    part = group["part"].to_numpy()
    if group["p"].iloc[0] != group["q"].iloc[0]:
        distance[part[:, None] == part[None, :]] = FAR
    np.fill_diagonal(distance, FAR)
    return distance


def _named(group, pairs):
    import pandas as pd

    keys = [bytes(k) for k in group["key"]]
    rows = [sorted((keys[i], keys[j])) for i, j in pairs]
    return pd.DataFrame(rows, columns=["a", "b"])


def _forest_pairs(seats: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a forest of each task."""

    def run(group):
        return _named(group, forest(_group_distances(group, similarity)))

    return _meetings(seats).groupBy(*TASK).applyInPandas(run, "a binary, b binary")


def _further_pairs(
    seats: DataFrame, failed: DataFrame, roots: DataFrame, share: int, similarity: float
) -> DataFrame:
    """(a, b) of the tasks that hold a failed pair: a forest of the pairs that have not
    failed and are not connected, and the nearest of them, ``share`` times the texts."""
    at = seats.select(*TASK[:2], "key", "part")
    first = at.withColumnsRenamed({"key": "a", "part": "i"})
    second = at.withColumnsRenamed({"key": "b", "part": "j"})
    lost = saved(
        failed.join(first, "a").join(second, [*TASK[:2], "b"]).select(
            *TASK[:2], F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "a", "b"
        ),
        "similar-failed",
    )
    group = _meetings(seats).join(lost.select(*TASK).distinct(), TASK, "left_semi")
    group = group.join(roots.withColumnRenamed("node", "key"), "key", "left")
    group = group.withColumn("root", F.coalesce("root", "key"))

    def run(group, lost):
        import numpy as np

        distance = _group_distances(group, similarity)
        place = {bytes(k): i for i, k in enumerate(group["key"])}
        for a, b in zip(lost["a"], lost["b"]):
            i, j = place[bytes(a)], place[bytes(b)]
            distance[i, j] = distance[j, i] = FAR
        _, root = np.unique(np.array([bytes(r).hex() for r in group["root"]]), return_inverse=True)
        together = root[:, None] == root[None, :]
        distance[together] = FAR
        i, j = np.nonzero(np.triu(distance < FAR))
        nearest = np.argsort(distance[i, j], kind="stable")[: share * len(group)]
        pairs = set(zip(i[nearest].tolist(), j[nearest].tolist()))
        distance[together] = 0
        pairs |= {(min(e), max(e)) for e in forest(distance) if root[e[0]] != root[e[1]]}
        return _named(group, sorted(pairs))

    return group.groupBy(*TASK).cogroup(lost.groupBy(*TASK)).applyInPandas(run, "a binary, b binary")


def buckets(texts: DataFrame) -> DataFrame:
    """(band, bucket, n, key, f0 .. f3) of the buckets with ``n`` > 1 texts."""
    keys = texts.select("key", *FPS, F.posexplode("bands").alias("band", "bucket"))
    counts = keys.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return saved(keys.join(counts, ["band", "bucket"]), "similar-buckets")


def texts_of_pairs(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(key, text), one row for each text that is in a pair.

    A Bloom filter of their keys drops nearly all other texts where they are read, and
    copies become one before they move: what moves grows with the texts in pairs, and a
    text of many copies is no large group.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = saved(keys, "similar-wanted")
    held = build_bloom(wanted, min(wanted.count(), WANTED_MAX), WANTED_FPP, 0)
    few = docs.filter(let(text_key(text), held.holds))
    texts = few.select(text_key(text).alias("key"), F.col(text).alias("text"))
    return texts.dropDuplicates(["key"]).join(wanted, "key", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, text: str, similarity: float, size: int) -> DataFrame:
    """The pairs whose shingle sets have at least that Jaccard similarity, stored.

    Texts move once, and only the sets of those in a pair are stored, until it is done.
    """
    texts = texts_of_pairs(pairs, docs, text)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first, count, rows, hashes in shingle_sets(batch.column(1), size):
                ends = np.searchsorted(rows, np.arange(count + 1))
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, count), sets], names=["key", "shingles"]
                )

    sets = saved(texts.mapInArrow(run, "key binary, shingles array<long>"), "similar-sets")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    either = F.size("s") + F.size("t")
    near = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(common * (1 + similarity) >= either * similarity - 1e-9)
        .select("a", "b")
    )
    found = saved(near, "similar-links")
    discard(sets)
    return found


def links(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    bucket_cap: int = BUCKET_CAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, edges, roots): each different text with its least row, verified pairs of
    keys, and the root of each key that has a pair."""
    marked = saved(with_sketches(docs, doc_id, text, size), "similar-docs")
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    shape = F.struct(*SKETCH, "bands")
    texts = marked.groupBy("key").agg(F.min(row).alias("least"), F.any_value(shape).alias("s"))
    texts = saved(texts.select("key", "least", "s.*"), "similar-texts")
    discard(marked)
    shared = buckets(texts)
    few = _native_pairs(shared.filter(F.col("n") <= bucket_cap))
    seats = _seats(shared.filter(F.col("n") > bucket_cap), texts)
    woods = saved(_forest_pairs(seats, similarity).distinct(), "similar-forests")
    pairs = saved(few.unionByName(woods).distinct(), "similar-pairs")
    edges = verified(pairs, docs, text, similarity, size)
    roots = connected_components(edges, "a", "b")
    failed = saved(woods.join(edges, ["a", "b"], "left_anti"), "similar-failed")
    share = 1
    while not failed.isEmpty():
        share *= 4
        further = _further_pairs(seats, failed, roots, share, similarity)
        pairs = saved(further.distinct(), "similar-pairs")
        if pairs.isEmpty():
            break
        more = verified(pairs, docs, text, similarity, size)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = connected_components(edges, "a", "b")
        failed = failed.unionByName(pairs.join(more, ["a", "b"], "left_anti"))
    discard(shared, seats)
    return texts, edges, roots


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    bucket_cap: int = BUCKET_CAP,
) -> DataFrame:
    """One row of each group of similar texts: that with the least id, nulls last.

    Groups are connected components of pairs of at least ``similarity`` (0.75 or more: the
    fingerprints are set for 0.8). Null, empty and blank texts are one group. Of repeated
    rows with the id and text that stay one stays. Columns are unchanged, names that clash
    with intermediate ones too. An empty table gives an empty result.
    """
    if similarity < 0.75:
        raise ValueError("buckets and distance are set for similarities of 0.75 or more")
    texts, _, roots = links(docs, doc_id, text, similarity, size, bucket_cap)
    roots = roots.withColumnRenamed("node", "key")
    member = texts.select("key", "least").join(roots, "key", "left")
    full = F.struct("least.n", "least.d", "key")
    heads = member.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(full).alias("head"))
    keep = saved(heads.select("head.key", F.col("head.d").alias("id")), "similar-heads")
    discard(texts)
    key, own, head, id_, of, held, nth = fresh(
        docs, "key", "own", "head", "id", "of", "held", "nth"
    )
    rows = docs.withColumn(key, text_key(text)).withColumn(own, F.xxhash64(key, F.col(doc_id)))
    keep = keep.select(
        F.col("key").alias(head), F.col("id").alias(id_), F.xxhash64("key", "id").alias(of)
    )
    # Copies meet by text and id, so those of one text are dealt out. Equal keys share a
    # partition after the join, so the window moves nothing.
    first = Window.partitionBy(own, key).orderBy(F.desc(held))
    return (
        rows.join(keep, (F.col(own) == F.col(of)) & (F.col(key) == F.col(head)))
        .withColumn(held, F.col(id_).eqNullSafe(F.col(doc_id)))
        .withColumn(nth, F.row_number().over(first))
        .filter((F.col(nth) == 1) & F.col(held))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
