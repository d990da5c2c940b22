"""Words and n-grams of Arrow text columns as numpy arrays, a block of rows at a time.

All steps are array operations on the UTF-8 bytes, so a task costs some nanoseconds per
byte and holds a block of a few MB (or one longer text) beside its Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 18

# Odd multipliers of 64 bits; any would do.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def blocks(texts, limit: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(first row, row count, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bytes():
    """For each byte: part of a word (ASCII letters and digits, all beyond ASCII)."""
    import numpy as np

    return np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def letter_bytes():
    """For each byte: part of a run of letters (ASCII letters, all beyond ASCII)."""
    import numpy as np

    return np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def spans(data, offsets, inside) -> tuple:
    """(starts, ends, rows) of the maximal runs of bytes of the table ``inside``.

    Runs end with their row.
    """
    import numpy as np

    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    flag = inside[data]
    before = np.empty_like(flag)
    before[0], before[1:] = False, flag[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(flag)
    after[-1], after[:-1] = False, flag[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h):
    """Spread 64-bit values over all bits."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of byte spans by prefix sums of a polynomial."""

    def __init__(self, piece: int = PIECE_BYTES) -> None:
        self.piece = piece
        self._power, self._inverse = self._tables(piece)

    @staticmethod
    def _tables(n: int) -> tuple:
        import numpy as np

        power = np.full(n, BASE, np.uint64)
        power[0] = 1
        inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        return np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def hashes(self, data, starts, ends):
        """``starts`` and ``ends`` rise and spans do not overlap."""
        import numpy as np

        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + self.piece, "right")))
            part = data[base : ends[j - 1]]
            power, inverse = self._power, self._inverse
            if len(part) > len(power):  # one span longer than a piece
                power, inverse = self._tables(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (total[e] - total[s]) * inverse[s]
            i = j
        return mixed(out)


def gram_hashes(h, size: int):
    """Hashes of ``size`` consecutive words; entry ``i`` begins at word ``i``.

    Grams that reach beyond a row are for the caller to leave out.
    """
    import numpy as np

    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + h[k : k + n]
    return mixed(out)
