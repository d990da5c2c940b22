"""Benchmark decontamination: MinHash containment search, verified exactly.

Test items are short and documents may be long, so the similarity of the two sets says
nothing; what counts is the share of an item's shingles that a document holds. An item
is sketched by the shingles with the ``k`` least hashes (a bottom-k MinHash sketch) and a
document is looked up shingle by shingle. Items are partitioned by the number ``n`` of
their shingles: if a document holds the share ``t`` or more, at most ``n - ceil(t * n)``
are missing, so with ``k = missing + need`` at least ``need`` sketch shingles are found.
Small items take ``need`` 1, larger ones 2, 3 and 4, which prunes chance hits. So no
contained item is lost, at any length of the document. Candidates are then verified by
comparing the shingles themselves.

Words are runs of letters and digits (all characters beyond ASCII count as letters),
lower-cased. An item of fewer words than a shingle has one shingle, the whole; documents
are looked up by runs of as many words too, where there are such items.

Documents never move. The items are taken in blocks of at most ``block_bytes`` of text;
each block's sketches go to the workers, and more items mean more blocks, so what is
sent is bounded and nothing is left out. Items with equal texts are looked up once and
all of them returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.texthash import SpanHasher, blocks, gram_hashes, spans, word_bytes

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8 << 20


def shingle_set(text: str | None, size: int = SHINGLE, short: tuple[int, ...] = ()) -> frozenset[str]:
    """The distinct shingles of a text, as space-joined words, and its runs of as many
    words as ``short`` says."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found = list(_words(pc.utf8_lower(pa.array([text or ""], pa.string()))))[0]
    if not found:
        return frozenset()
    own = {" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}
    for k in short:
        own |= {" ".join(found[i : i + k]) for i in range(len(found) - k + 1)}
    return frozenset(own)


def _words(lowered) -> Iterator[list[str]]:
    """The words of each text of a lower-cased Arrow array."""
    inside = word_bytes()
    for _, n, data, offsets in blocks(lowered):
        starts, ends, rows = spans(data, offsets, inside)
        raw = data.tobytes()
        found = [[] for _ in range(n)]
        for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist()):
            found[r].append(raw[s:e].decode())
        yield from found


def needed_hits(n: int) -> int:
    """Sketch shingles that must be found, by the size class of an item."""
    return 1 if n < 16 else 2 if n < 64 else 3 if n < 256 else 4


@dataclass(frozen=True)
class Index:
    """Sketch hashes (sorted) with the place of their item, and the items."""

    hashes: object
    places: object
    needs: object
    ids: list
    texts: list[str]
    size: int
    containment: float
    short: tuple[int, ...]  # numbers of words of the items that are shorter than a shingle


def _text_grams(lowered, hasher, size: int, short: tuple[int, ...] | None = None) -> Iterator[tuple]:
    """(first row, row count, hashes, rows) of the shingles of a block of texts.

    Of a text with fewer words than a shingle that is the whole; with ``short``, of each
    text all runs of so many words instead.
    """
    import numpy as np

    inside = word_bytes()
    for first, count, data, offsets in blocks(lowered):
        starts, ends, row = spans(data, offsets, inside)
        h = hasher.hashes(data, starts, ends)
        grams = gram_hashes(h, size)
        at = row[: len(grams)]
        whole = at == row[size - 1 :] if len(grams) else np.zeros(0, bool)
        grams, at = [grams[whole]], [at[whole]]
        for k in short or ():
            some = gram_hashes(h, k)
            inner = row[: len(some)] == row[k - 1 :] if len(some) else np.zeros(0, bool)
            grams.append(some[inner])
            at.append(row[: len(some)][inner])
        if short is not None:
            yield first, count, np.concatenate(grams), np.concatenate(at)
            continue
        present, begin, length = np.unique(row, return_index=True, return_counts=True)
        for k in range(1, size):
            some = begin[length == k]
            if len(some):
                # The gram of k words from each such row's first word.
                grams.append(gram_hashes(np.append(h, np.zeros(size, np.uint64)), k)[some])
                at.append(row[some])
        yield first, count, np.concatenate(grams), np.concatenate(at)


def build_index(
    items: list[tuple], size: int = SHINGLE, containment: float = CONTAINMENT
) -> Index:
    """Sketches of (id, text) items; items without a word are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    share = Fraction(containment).limit_denominator(10_000)
    hasher = SpanHasher()
    hashes, places, ids, texts, needs = [], [], [], [], []
    lowered = pc.utf8_lower(pa.array([t for _, t in items], pa.large_string()))
    for first, count, grams, rows in _text_grams(lowered, hasher, size):
        order = np.argsort(rows, kind="stable")
        grams, rows = grams[order], rows[order]
        cut = np.searchsorted(rows, np.arange(count + 1))
        for r in range(count):
            own = np.unique(grams[cut[r] : cut[r + 1]])  # sorted: the least come first
            n = len(own)
            if not n:
                continue
            need = needed_hits(n)
            missing = n - ceil(share * n)
            k = min(n, missing + need)
            hashes.append(own[:k])
            places.append(np.full(k, len(ids), np.int64))
            needs.append(max(1, k - missing))
            item, text = items[first + r]
            ids.append(item)
            texts.append(text)
    if not ids:
        none = np.zeros(0, np.int64)
        return Index(none.astype(np.uint64), none, none, [], [], size, containment, ())
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(hashes, kind="stable")
    lengths = {len(w) for w in _words(lowered)}
    return Index(
        hashes[order], places[order], np.array(needs), ids, texts, size, containment,
        tuple(sorted(n for n in lengths if 0 < n < size)),
    )


def find_items(texts, index: Index, hasher, cache: dict) -> Iterator[tuple]:
    """(row, item place, n_shingles, n_found) for each item contained in a text."""
    import numpy as np
    import pyarrow.compute as pc

    if not index.ids:
        return
    share = Fraction(index.containment).limit_denominator(10_000)
    distinct, begin, length = np.unique(index.hashes, return_index=True, return_counts=True)
    maybe = np.zeros(1 << 16, bool)
    maybe[(distinct & np.uint64(0xFFFF)).astype(np.int64)] = True
    lowered = pc.utf8_lower(texts)
    for first, _, grams, rows in _text_grams(lowered, hasher, index.size, index.short):
        some = np.flatnonzero(maybe[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        grams, rows = grams[some], rows[some]
        at = np.minimum(np.searchsorted(distinct, grams), len(distinct) - 1)
        hit = distinct[at] == grams
        if not hit.any():
            continue
        pairs = np.unique(np.stack((rows[hit], at[hit])), axis=1)  # each sketch shingle once
        times = length[pairs[1]]
        row = np.repeat(pairs[0], times)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = index.places[np.repeat(begin[pairs[1]], times) + inner]
        found, counts = np.unique(np.stack((row, place)), axis=1, return_counts=True)
        enough = counts >= index.needs[found[1]]
        last, own = -1, frozenset()
        for r, p in found[:, enough].T.tolist():
            if r != last:
                last, own = r, shingle_set(texts[first + r].as_py(), index.size, index.short)
            if p not in cache:
                cache[p] = shingle_set(index.texts[p], index.size)
            n, held = len(cache[p]), len(cache[p] & own)
            if held >= share * n:
                yield first + r, p, n, held


def item_blocks(items: DataFrame, text: str, block_bytes: int) -> Iterator[list]:
    """(key, text) of the distinct texts in blocks of about ``block_bytes`` on the driver."""
    distinct = items.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    total = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ceil(total / block_bytes)
    for b in range(n):
        part = distinct
        if n > 1:
            part = distinct.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        rows = part.select("text", _key("text").alias("key")).orderBy("text").collect()
        yield [(r["key"], r["text"]) for r in rows]


def _key(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): every item whose distinct
    shingles a document holds to the share ``containment`` or more.

    Null and blank texts, of documents and of items, hold nothing. Repeated documents
    and repeated items give repeated rows, and an item may have no id. Without items or
    documents the result is empty.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = (
        f"doc_id {narrow.schema['doc_id'].dataType.simpleString()},"
        " key string, n_shingles int, n_found int, containment double"
    )
    found = narrow.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_text, block_bytes):
        part = narrow.mapInArrow(_finder(build_index(block, size, containment)), schema)
        found = found.unionByName(part)
    ids = items.select(_key(item_text).alias("key"), F.col(item_id).alias("item_id"))
    return found.join(ids, "key").select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def _finder(index: Index):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher, cache = SpanHasher(), {}
        for batch in batches:
            ids, texts = batch.columns
            rows = list(find_items(texts, index, hasher, cache))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r for r, _, _, _ in rows], pa.int64())),
                    pa.array([index.ids[p] for _, p, _, _ in rows], pa.string()),
                    pa.array([n for _, _, n, _ in rows], pa.int32()),
                    pa.array([m for _, _, _, m in rows], pa.int32()),
                    pa.array([m / n for _, _, n, m in rows], pa.float64()),
                ],
                names=["doc_id", "key", "n_shingles", "n_found", "containment"],
            )

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that hold an item; columns and other rows unchanged."""
    for block in item_blocks(items, "text", kw.pop("block_bytes", BLOCK_BYTES)):
        docs = docs.mapInArrow(_cleaner(build_index(block, **kw), text), docs.schema)
    return docs


def _cleaner(index: Index, text: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hasher, cache = SpanHasher(), {}
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, _, _, _ in find_items(batch.column(text), index, hasher, cache):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return run
