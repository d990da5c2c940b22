"""Language identification by multilingual mixture inference.

Each language has a table of letter-trigram probabilities, counted over all learnable
texts. A text is a mixture: every word comes from one language, and the likelihood of a
word is the product over its trigrams. Expectation-maximisation estimates the share of
each language. The set of languages is that of the largest penalised likelihood: a
language more must gain ``PENALTY * ln(words)``, or it is left out.

Counts are combined per task and per language before they move; the model has
``languages x BUCKETS`` numbers, so its size does not grow with the corpus. A text stays where it was read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.texthash import blocks, letter_bytes, spans

BUCKETS = 1 << 16
# Profiles are a table of BUCKETS numbers (256 KB) per language, which all tasks hold.
MAX_LANGUAGES = 1024
PENALTY = 2.0
ROUNDS = 12
# A word may speak for a language over another by so many nats at most: misspelt words
# and code would otherwise outweigh a whole text.
WORD_NATS = 10.0
UNDETERMINED = "und"


@dataclass(frozen=True)
class Profiles:
    """``logp[bucket, language]`` and the names of the languages, sorted."""

    languages: tuple[str, ...]
    logp: object


def _letters_only(data, inside):
    """The bytes with everything but letters as blanks."""
    import numpy as np

    return np.where(inside[data], data, np.uint8(32))


def _trigrams(data, offsets, buckets: int):
    """Bucket of the trigram around each byte; a blank stands before and after each row,
    so what a row gives does not depend on the rows beside it."""
    import numpy as np

    before, after = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    before[1:], after[:-1] = data[:-1], data[1:]
    first, last = offsets[:-1], offsets[1:]
    before[first[first < last]] = 32
    after[last[first < last] - 1] = 32
    code = before | (data.astype(np.uint32) << np.uint32(8)) | (after << np.uint32(16))
    h = code * np.uint32(2654435761)
    return (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def fit(docs: DataFrame, usable: Column, buckets: int = BUCKETS) -> Profiles:
    """Profiles from all rows of (doc_id, text, lang) for which ``usable`` is true.

    Rows with a null text or language do not count. More than ``MAX_LANGUAGES`` languages
    are refused: profiles of fewer buckets would be others.
    """
    import numpy as np

    learnable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable).select(
        "text", "lang"
    )
    names = learnable.select("lang").distinct().orderBy("lang")
    languages = tuple(r[0] for r in names.take(MAX_LANGUAGES + 1))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        inside = letter_bytes()
        at = {name: i for i, name in enumerate(languages)}
        total = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            texts, langs = batch.columns
            lang = np.array([at[x] for x in langs.to_pylist()], np.int64)
            for first, n, data, offsets in blocks(pc.utf8_lower(texts)):
                flag = inside[data]
                grams = _trigrams(_letters_only(data, inside), offsets, buckets)
                of = np.repeat(lang[first : first + n], np.diff(offsets))
                for i in np.unique(of):
                    total[i] += np.bincount(grams[flag & (of == i)], minlength=buckets)
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[i, b])],
            names=["language", "bucket", "n"],
        )

    counts = np.zeros((buckets, max(len(languages), 1)))
    if languages:
        rows = (
            learnable.mapInArrow(count, "language int, bucket int, n long")
            .groupBy("language", "bucket")
            .agg(F.sum("n").alias("n"))
            .toPandas()
        )
        counts[rows["bucket"].to_numpy(), rows["language"].to_numpy()] = rows["n"].to_numpy()
    smooth = counts + 0.5
    logp = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    return Profiles(languages, logp)


def _mixture(q, theta, starts, sizes, rounds):
    """EM over the words of many texts at once. ``q``: (word, language) likelihoods."""
    import numpy as np

    for _ in range(rounds):
        r = q * np.repeat(theta, sizes, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        theta = np.add.reduceat(r, starts, axis=0) / sizes[:, None]
    return theta


def _log_likelihood(q, theta, starts, sizes):
    import numpy as np

    return np.add.reduceat(np.log((q * np.repeat(theta, sizes, axis=0)).sum(axis=1)), starts)


def _select(q, theta, penalty: float, rounds: int):
    """Backward elimination for one text: drop the weakest language as long as that
    loses less than the penalty."""
    import numpy as np

    n = len(q)
    cost = penalty * np.log(n + 1)
    zero, size = np.zeros(1, np.int64), np.array([n])
    active = np.flatnonzero(theta > 1e-6)
    theta = theta[None, active] / theta[active].sum()
    best = _log_likelihood(q[:, active], theta, zero, size)[0]
    while len(active) > 1:
        keep = np.delete(np.arange(len(active)), int(np.argmin(theta[0])))
        fewer = active[keep]
        start = (theta[:, keep] + 1e-9) / (theta[:, keep] + 1e-9).sum()
        t = _mixture(q[:, fewer], start, zero, size, rounds)
        ll = _log_likelihood(q[:, fewer], t, zero, size)[0]
        if best - ll > cost:
            break
        active, theta, best = fewer, t, ll
    out = np.zeros(q.shape[1])
    out[active] = theta[0]
    return out


def proportions(texts, model: Profiles, penalty: float = PENALTY, rounds: int = ROUNDS):
    """(shares, has_letter): for each text the share of each language, zero outside the
    selected set; texts without a letter have none."""
    import numpy as np
    import pyarrow.compute as pc

    n_lang = max(len(model.languages), 1)
    shares = np.zeros((len(texts), n_lang))
    inside = letter_bytes()
    buckets = len(model.logp)
    for first, count, data, offsets in blocks(pc.utf8_lower(texts), 1 << 20):
        starts, ends, row = spans(data, offsets, inside)
        if not len(starts):
            continue
        grams = _trigrams(_letters_only(data, inside), offsets, buckets)
        flag = inside[data]
        # Sum of log-probabilities of each word: letters are contiguous within words.
        logs = model.logp[grams[flag]].astype(np.float64)
        lengths = ends - starts
        ll = np.add.reduceat(logs, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
        ll -= ll.max(axis=1, keepdims=True)
        q = np.exp(np.maximum(ll, -WORD_NATS))
        rows, at, sizes = np.unique(row, return_index=True, return_counts=True)
        theta = np.full((len(rows), n_lang), 1 / n_lang)
        theta = _mixture(q, theta, at, sizes, rounds)
        full = _log_likelihood(q, theta, at, sizes)
        single = np.add.reduceat(np.log(q), at, axis=0)
        best = single.argmax(axis=1)
        gain = full - single[np.arange(len(rows)), best]
        for k in range(len(rows)):
            # The full mixture bounds the likelihood of every set.
            if gain[k] <= penalty * np.log(sizes[k] + 1):
                shares[first + rows[k], best[k]] = 1
            else:
                some = slice(at[k], at[k] + sizes[k])
                shares[first + rows[k]] = _select(q[some], theta[k], penalty, rounds)
    return shares


def _no_letter(text: str | None) -> bool:
    return not text or not any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row of (doc_id, text).

    ``languages`` is the selected set as an array of (lang, share), largest share first.
    ``lang_pred`` is its head and ``score`` the head's share; equal shares go to the
    name that sorts first. Null texts, texts without a letter and all texts of an empty
    model are ``und`` with score 0 and an empty set. Repeated rows stay.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            ids, texts = batch.columns
            if model.languages:
                shares = proportions(texts, model)
            else:
                shares = np.zeros((len(texts), 1))
            known = shares.sum(axis=1) > 0
            # Runs beyond ASCII may hold no letter at all, such as dashes or emoji.
            for i in np.flatnonzero(known):
                text = texts[int(i)].as_py()
                known[i] = not _no_letter(text)
            head = np.where(known, shares.argmax(axis=1), len(model.languages))
            score = np.where(known, shares.max(axis=1), 0.0)
            sets = []
            for i in range(len(texts)):
                some = np.flatnonzero(shares[i] > 0) if known[i] else ()
                some = sorted(some, key=lambda j: (-shares[i, j], j))
                sets.append([{"lang": names[j], "share": float(shares[i, j])} for j in some])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(names[head], pa.string()), pa.array(score), pa.array(sets, kind)],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    narrow = docs.select("doc_id", "text")
    schema = (
        f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string,"
        " score double, languages array<struct<lang:string,share:double>>"
    )
    return narrow.mapInArrow(run, schema)
