"""Alignment of two tokenizers by products of token-byte incidence matrices.

Each tokenizer gives a sparse matrix over the bytes of a text: a row per token, an entry
per byte that the token covers. ``A @ B.T``, formed row by row (Gustavson), has an entry
for each pair of tokens that overlap; its value is the number of bytes they share. Byte
offsets at which tokens of both end cut the tokens into groups; the product of the
token-group matrices links all tokens of one group.

Matrices are plain CSR arrays (row pointers, column indices). The texts of a block are
stacked, so one product serves many short texts; rows are multiplied in slices, so the
intermediate entries of a long text stay bounded.

Neither tokenizer joins the end of a word to a space after it, so a text is the sequence
of its chunks (a space, and all up to the next space after a word), and links and groups
lie within chunks. Products are formed once per different chunk that a task meets.

Corpus-wide counts of linked id pairs come from stored pairs per text, aggregated before
they move. The most frequent pairs, ``HEAVY_PAIRS`` at most, go to the tasks; rarer ones
are joined. Nothing is left out either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import saved

HEAVY_PAIRS = 1 << 20
BLOCK_BYTES = 1 << 20
SLICE = 1 << 20
# Chunks that a task keeps: at most so many, of so many characters.
KEPT_CHUNKS, KEPT_CHARS = 1 << 18, 80
# The counts of a chunk are one number, of so many bits a count, so one sum adds them all.
COUNTS, COUNT_BITS = 5, 48


class ByteLevel:
    """Byte-level BPE of a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        spec = json.loads(self.model.to_str())
        how = spec["pre_tokenizer"] or {}
        # The pattern of the byte-level split never joins a space to what is before it.
        self.cuts_at_spaces = how.get("type") == "ByteLevel" and how.get("use_regex", True)
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(self._alphabet())}
        self.pieces = [
            special[i] if i in special else bytes(byte_of[c] for c in self.model.id_to_token(i) or "")
            for i in range(max([*spec["model"]["vocab"].values(), *special]) + 1)
        ]

    @staticmethod
    def _alphabet() -> list[str]:
        """The character that stands for each byte: printable Latin-1 ones for
        themselves, the others for the characters from U+0100 on, in order."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        return [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in found]


class Pieces:
    """A SentencePiece model, which puts the space before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts_at_spaces = not any(re.search("[^▁]▁", s) for s in names)
        self.pieces = [
            bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode()
            for i, s in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _load(path: str):
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


@dataclass(frozen=True)
class Csr:
    """Row pointers, column indices and the number of columns; entries are ones."""

    ptr: object
    idx: object
    width: int

    @cached_property
    def transposed(self) -> Csr:
        import numpy as np

        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        ptr = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.idx, minlength=self.width), out=ptr[1:])
        if len(self.idx) and (np.diff(self.idx) < 0).any():
            rows = rows[np.argsort(self.idx, kind="stable")]
        return Csr(ptr, rows, len(self.ptr) - 1)


def covers(starts, ends, width: int) -> Csr:
    """Token i has entries at ``starts[i]`` up to ``ends[i]``."""
    import numpy as np

    size = ends - starts
    ptr = np.concatenate(([0], np.cumsum(size)))
    idx = np.arange(ptr[-1]) + np.repeat(starts - ptr[:-1], size)
    return Csr(ptr, idx, width)


def product(a: Csr, b: Csr, limit: int = SLICE) -> Iterator[tuple]:
    """(row, column, value) arrays of ``a @ b.T``, a slice of rows of ``a`` at a time.

    For each entry k of a row of ``a``, row k of ``b.T`` is added to the row of the
    product. A slice has about ``limit`` such additions, or those of a single row.
    """
    import numpy as np

    bt = b.transposed
    width = np.diff(bt.ptr)
    work = np.concatenate(([0], np.cumsum(width[a.idx])))[a.ptr]
    row, rows = 0, len(a.ptr) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(work, work[row] + limit, "right")) - 1)
        k = a.idx[a.ptr[row] : a.ptr[stop]]
        of = np.repeat(np.arange(row, stop), np.diff(a.ptr[row : stop + 1]))
        n = width[k]
        start = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(start[-1]) + np.repeat(bt.ptr[k] - start[:-1], n)
        key = np.repeat(of, n) * np.int64(b.ptr.shape[0]) + bt.idx[at]
        if (np.diff(key) < 0).any():
            key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        value = np.diff(np.concatenate((first, [len(key)])))
        key = key[first]
        yield key // b.ptr.shape[0], key % b.ptr.shape[0], value
        row = stop


@dataclass(frozen=True)
class Stack:
    """The tokens of some texts over their joined bytes."""

    count: int
    a_text: object  # text of each token
    b_text: object
    a_id: object
    b_id: object
    a_group: object
    b_group: object
    a_bytes: Csr
    b_bytes: Csr
    groups: object  # number of groups up to each text

    @cached_property
    def a_groups(self) -> Csr:
        return covers(self.a_group, self.a_group + 1, int(self.groups[-1]))

    @cached_property
    def b_groups(self) -> Csr:
        return covers(self.b_group, self.b_group + 1, int(self.groups[-1]))


_CUT = re.compile(r"(?<=\S)(?= .)", re.S)
_ODD = re.compile(r"\s ")


def chunks(text: str) -> list[str]:
    """``text`` in parts; a space stands before each, also the first.

    It is cut at spaces after a character that is no white space, but not at its end.
    """
    if " " in (text[:1], text[-1:]) or _ODD.search(text):
        return [c[1:] for c in _CUT.split(" " + text)]
    return text.split(" ")


class Aligner:
    """Both tokenizers, loaded once per task, and what is known of chunks."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import numpy as np

        self.a, self.b = _load(a_path), _load(b_path)
        self.a_len = np.array([len(p) for p in self.a.pieces], np.int64)
        self.b_len = np.array([len(p) for p in self.b.pieces], np.int64)
        # What is written for an id within a run, and for the last of a run.
        self._written = [
            *(f"{i}{s}" for s in ",|" for i in range(len(self.a_len))),
            *(f"{i}{s}" for s in ",;" for i in range(len(self.b_len))),
        ]
        self._cut = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        self._known: dict[str, tuple] = {}
        self._unkept: set[str] = set()  # chunks that some tokenizer does not spell

    def aligned(self, texts: list[bytes | None]) -> list[list[tuple]]:
        """For each text the results of its chunks, as ``_learned`` gives them; none where
        a text has no tokens."""
        plain = []
        for raw in texts:
            try:
                text = raw.decode() if raw else ""
            except UnicodeDecodeError:
                text = ""
            plain.append((chunks(text) if self._cut else [text]) if text else [])
        if len(self._known) > KEPT_CHUNKS:
            self._known.clear()
            self._unkept.clear()
        known = self._known
        new = list({c for parts in plain for c in parts if c not in known})
        here = self._learned(new)
        known.update((c, r) for c, r in here.items() if len(c) <= KEPT_CHARS)
        return [
            [known.get(c) or here[c] for c in parts] if self._unkept.isdisjoint(parts) else []
            for parts in plain
        ]

    def _learned(self, parts: list[str]) -> dict[str, tuple]:
        """(written groups, keys of all links as bytes, counts) of each."""
        import numpy as np

        out = {}
        for some, s in self._stacks(parts):
            n = s.count
            text, key = self.links(s)
            at = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).tolist()
            total = int(s.groups[-1])
            group = np.repeat(np.arange(n), np.diff(s.groups))
            both = np.bincount(s.a_group, minlength=total) * np.bincount(s.b_group, minlength=total)
            counts = np.stack(
                [
                    np.bincount(s.a_text, minlength=n), np.bincount(s.b_text, minlength=n), np.diff(s.groups),
                    np.diff(at), np.bincount(group, both, minlength=n).astype(np.int64),
                ],
                axis=1,
            )
            for part, w, i, j, c in zip(some, self.written(s), at, at[1:], counts.tolist()):
                out[part] = (w, key[i:j].tobytes(), sum(v << COUNT_BITS * k for k, v in enumerate(c)))
                if c[0] == 0:
                    self._unkept.add(part)
        return out

    def _stacks(self, parts: list[str]) -> Iterator[tuple[list[str], Stack]]:
        """Stacks of chunks. Those that end in no white space are encoded as one text,
        which cuts them apart again."""
        plain = [c for c in parts if not c[-1].isspace()] if self._cut else []
        runs = [plain[i : i + 4096] for i in range(0, len(plain), 4096)]
        while runs:
            run = runs.pop()
            raw = [c.encode() for c in run]
            s = self._joined(raw)
            if s is None and len(run) > 1:  # some chunk is not kept: look for it
                runs += [run[: len(run) // 2], run[len(run) // 2 :]]
            else:
                yield run, s or self.stack(raw)
        odd = [c for c in parts if c[-1].isspace() or not self._cut]
        for i in range(0, len(odd), 4096):
            yield odd[i : i + 4096], self.stack([c.encode() for c in odd[i : i + 4096]])

    def _joined(self, raw: list[bytes]) -> Stack | None:
        import numpy as np

        line = b" ".join(raw)
        text = line.decode()
        a, b = self.a.encode([text])[0], self.b.encode([text])[0]
        pa, pb = self.a.pieces, self.b.pieces
        if not b"".join([pa[t] for t in a]) == b" " + line == b"".join([pb[t] for t in b]):
            return None
        return self._stack(np.array([len(c) + 1 for c in raw], np.int64), a, b)

    def stack(self, texts: list[bytes | None]) -> Stack:
        """Texts that are null, empty, no UTF-8 or not kept by a tokenizer have no tokens."""
        import numpy as np

        usable, plain = [], []
        for i, raw in enumerate(texts):
            try:
                if raw:
                    plain.append(raw.decode())
                    usable.append(i)
            except UnicodeDecodeError:
                pass
        a_ids, b_ids = [], []
        sizes = np.zeros(len(texts), np.int64)
        some = zip(usable, self.a.encode(plain), self.b.encode(plain)) if plain else ()
        pa, pb = self.a.pieces, self.b.pieces
        for i, a, b in some:
            want = b" " + texts[i]
            if b"".join([pa[t] for t in a]) == want == b"".join([pb[t] for t in b]):
                sizes[i] = len(want)
                a_ids += a
                b_ids += b
        return self._stack(sizes, a_ids, b_ids)

    def _stack(self, sizes, a_ids: list[int], b_ids: list[int]) -> Stack:
        """Texts of ``sizes`` bytes, each covered whole by tokens of both."""
        import numpy as np

        a_id, b_id = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)))
        width = int(base[-1])
        a_end, b_end = np.cumsum(self.a_len[a_id]), np.cumsum(self.b_len[b_id])
        a_start, b_start = a_end - self.a_len[a_id], b_end - self.b_len[b_id]
        cut = np.zeros(width + 1, bool)
        cut[a_end] = True
        both = np.zeros(width + 1, bool)
        both[b_end] = True
        cut &= both
        upto = np.cumsum(cut)
        text = np.repeat(np.arange(len(sizes)), sizes)  # of each byte
        return Stack(
            len(sizes), text[a_start], text[b_start], a_id, b_id, upto[a_start], upto[b_start],
            covers(a_start, a_end, width), covers(b_start, b_end, width), upto[base],
        )

    def written(self, s: Stack) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        import numpy as np

        ends = lambda g: np.concatenate((g[1:] != g[:-1], [True]))[: len(g)]
        na, nb = len(self.a_len), len(self.b_len)
        code = np.empty(len(s.a_id) + len(s.b_id), np.int64)
        total = int(s.groups[-1])
        a_before = np.concatenate(([0], np.cumsum(np.bincount(s.a_group, minlength=total))))
        b_before = np.concatenate(([0], np.cumsum(np.bincount(s.b_group, minlength=total))))
        code[np.arange(len(s.a_id)) + b_before[s.a_group]] = s.a_id + na * ends(s.a_group)
        code[np.arange(len(s.b_id)) + a_before[s.b_group + 1]] = 2 * na + s.b_id + nb * ends(s.b_group)
        table = self._written
        at = (a_before + b_before)[s.groups].tolist()
        code = code.tolist()
        return ["".join([table[c] for c in code[i:j]])[:-1] for i, j in zip(at, at[1:])]

    def links(self, s: Stack) -> tuple:
        """(text, id of A and of B as one number) of each overlap link, in the order of texts."""
        import numpy as np

        parts = [(s.a_text[i], s.a_id[i] * len(self.b_len) + s.b_id[j]) for i, j, _ in product(s.a_bytes, s.b_bytes)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))


def _blocks(texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of rows of about ``limit`` bytes."""
    first, some, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.as_py()
        some.append(raw)
        size += len(raw or b"")
        if size >= limit:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some


def encode(docs: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = True) -> DataFrame:
    """``docs`` without ``text``, plus per row n_a, n_b, n_groups, n_links, n_group_links,
    groups (their SHA-256 if ``digest``, '' without tokens), and the linked id pairs as the
    arrays pair_a, pair_b, pair_n. No row moves."""

    names = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups", "pair_a", "pair_b", "pair_n"]
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are results")
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        aligner = Aligner(a_path, b_path)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rest = batch.select(kept)
            for first, texts in _blocks(batch.column(text)):
                found = aligner.aligned(texts)
                n = len(texts)
                total = [sum([r[2] for r in f]) for f in found]
                mask = (1 << COUNT_BITS) - 1
                counts = [pa.array([t >> COUNT_BITS * k & mask for t in total], pa.int64()) for k in range(COUNTS)]
                written = [";".join([r[0] for r in f]) for f in found]
                if digest:
                    written = [sha256(w.encode()).hexdigest() if w else "" for w in written]
                unique = [
                    np.unique(np.frombuffer(b"".join([r[1] for r in f]), np.int64), return_counts=True) for f in found
                ]
                ptr = pa.array(np.concatenate(([0], np.cumsum([len(k) for k, _ in unique]))), pa.int32())
                key, times = (np.concatenate(p) for p in zip(*unique))
                lists = (
                    pa.ListArray.from_arrays(ptr, pa.array(v, pa.int32()))
                    for v in (key // len(aligner.b_len), key % len(aligner.b_len), times)
                )
                yield pa.RecordBatch.from_arrays(
                    [*rest.slice(first, n).columns, *counts, pa.array(written, pa.string()), *lists],
                    names=[*kept, *names],
                )

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    fields += [f"{c} long" for c in names[:5]]
    fields += ["groups string", *(f"{c} array<int>" for c in names[6:])]
    plain = docs.withColumn(text, F.col(f"`{text}`").cast("binary"))
    return plain.mapInArrow(run, ", ".join(fields))


def token_links(
    docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, a_pos, b_pos, a_id, b_id, shared): the links of token occurrences.

    ``overlap``: tokens that share bytes, ``shared`` of them. ``group``: all tokens of
    one group, ``shared`` is 1; a text whose tokens never end together is one group, with
    all its pairs, which are made and sent on in slices.
    """
    if kind not in {"overlap", "group"}:
        raise ValueError(f"no links of kind {kind!r}")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for first, texts in _blocks(batch.column("text")):
                s = aligner.stack(texts)
                a_at = np.searchsorted(s.a_text, s.a_text)  # first token of the text
                b_at = np.searchsorted(s.b_text, s.b_text)
                a, b = (s.a_bytes, s.b_bytes) if kind == "overlap" else (s.a_groups, s.b_groups)
                for i, j, shared in product(a, b):
                    ids = batch.column("doc_id").take(pa.array(s.a_text[i] + first))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids, pa.array(i - a_at[i]), pa.array(j - b_at[j]),
                            pa.array(s.a_id[i], pa.int32()), pa.array(s.b_id[j], pa.int32()),
                            pa.array(shared, pa.int64()),
                        ],
                        names=["doc_id", "a_pos", "b_pos", "a_id", "b_id", "shared"],
                    )

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind_of = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        run, f"doc_id {kind_of}, a_pos long, b_pos long, a_id int, b_id int, shared long"
    )


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(a, b, n, best): rows of ``encoded`` in which the ids are linked, and whether no
    other id of B is linked with this id of A in more rows."""
    pairs = encoded.select(F.inline(F.arrays_zip("pair_a", "pair_b"))).toDF("a", "b")
    counts = saved(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return saved(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "align-best")


def _heavy_from(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs have that count or more."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("k"))
    total, least = 0, 64
    for e, k in sorted(((r["e"], r["k"]) for r in sizes.collect()), reverse=True):  # 63 rows at most
        total += k
        if total > limit:
            break
        least = e
    return 1 << least if least < 63 else (1 << 63) - 1


def align(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
    heavy_pairs: int = HEAVY_PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256),
    one row per row of ``docs``.

    Null and empty texts, texts that are no UTF-8 and those whose tokens do not spell
    them have no tokens: zeros and ''. Repeated rows, also of one id, are texts of their
    own and count each. A null id is kept. Other columns are not read. A task holds the
    tokens of one block of texts, or of one longer text. The files of both tokenizers are
    read on the workers.
    """
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")
    )
    encoded = saved(encode(narrow, a_path, b_path), "align-texts")
    counts = pair_counts(encoded)
    heavy_from = _heavy_from(counts, heavy_pairs)
    heavy = F.broadcast(counts.filter(F.col("n") >= heavy_from))  # heavy_pairs rows at most
    linked = encoded.select("row", F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n"))).toDF("row", "a", "b", "m")
    sums = lambda df: df.groupBy("row").agg(
        F.sum(F.col("m") * F.col("n")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
    )
    found = sums(linked.join(heavy, ["a", "b"]))
    light = counts.filter(F.col("n") < heavy_from)
    if not light.isEmpty():
        rest = linked.join(heavy.select("a", "b"), ["a", "b"], "left_anti")
        found = found.unionByName(sums(rest.join(light, ["a", "b"])))
        found = found.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return encoded.drop("pair_a", "pair_b", "pair_n").join(found, "row", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_group_links",
        zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"),
    )
