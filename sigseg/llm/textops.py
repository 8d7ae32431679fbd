"""Flat numpy views of Arrow string columns, word and n-gram hashes.

A batch of texts is one byte array plus offsets, so that the operators work on
whole batches with vector operations and never on Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Word separators: space and the controls 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: For each of two independent hashes: what blocks are mixed with, the odd step from one place to the next, and the factor of the length.
_SEEDS = [(0x243F6A8885A308D3, 0xD1342543DE82EF95, 0xD6E8FEB86659FD93), (0x13198A2E03707344, 0xAEF17502108EF2D9, 0xA0761D6478BD642F)]
#: The low 0 to 8 bytes of a block.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and n + 1 offsets; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_utf8())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets."""
    n = len(inside)
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[:-1] = inside[1:]
        last = off[1:] - 1
        after[last[last >= 0]] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n + 1 offsets of each text's words."""
    starts, ends = runs(~SPACE[data], off)
    return starts, ends, np.searchsorted(starts, off)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines (one at least in each text), and offsets."""
    cuts = np.flatnonzero(data == 10)
    per = np.searchsorted(cuts, off)
    n_texts = len(off) - 1
    line_off = per - per[0] + np.arange(n_texts + 1)
    starts = np.empty(line_off[-1], np.int64)
    ends = np.empty(line_off[-1], np.int64)
    own = np.arange(len(cuts)) + np.searchsorted(off[1:], cuts, "right")
    ends[own] = cuts
    starts[own + 1] = cuts + 1
    starts[line_off[:-1]] = off[:-1]
    ends[line_off[1:] - 1] = off[1:]
    return starts, ends, line_off


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans' bytes in blocks of 8 (the last filled up with zeros), the place of each block in its span, and each span's first block."""
    n_blocks = np.maximum((ends - starts + 7) >> 3, 1)
    first = np.cumsum(n_blocks) - n_blocks
    place = np.arange(int(n_blocks.sum())) - np.repeat(first, n_blocks)
    at = np.repeat(starts, n_blocks) + 8 * place
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
    return blocks & _MASK[np.clip(np.repeat(ends, n_blocks) - at, 0, 8)], place.astype(np.uint64), first


def _hash(blocks: np.ndarray, place: np.ndarray, first: np.ndarray, length: np.ndarray, lane: int) -> np.ndarray:
    seed, step, factor = map(np.uint64, _SEEDS[lane])
    mixed = mix(mix(blocks ^ seed) + place * step)
    if len(first) != len(mixed):
        mixed = np.add.reduceat(mixed, first) if len(first) else mixed[:0]
    return mix(mixed + length * factor)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: blocks of 8 bytes are scrambled, each with its place, and summed."""
    return _hash(*_blocks(data, starts, ends), (ends - starts).astype(np.uint64), 0)


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span's bytes; the first is that of ``span_hashes``."""
    cut, length = _blocks(data, starts, ends), (ends - starts).astype(np.uint64)
    return _hash(*cut, length, 0), _hash(*cut, length, 1)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rolling hashes of ``width`` successive word hashes; the last width - 1 places are absent."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = _roll(total, hashes[j : j + n])
    return mix(total + np.uint64(width))


def _roll(total: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    total = total * _BASE + hashes
    return total ^ (total >> np.uint64(32))


def gram_places(word_off: np.ndarray, width: int) -> np.ndarray:
    """First words of the windows of ``width`` words that lie in one text."""
    n = int(word_off[-1])
    ok = np.ones(max(0, n - width + 1), bool)
    for j in range(1, width):
        cut = word_off[1:-1] - j
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return np.flatnonzero(ok)


def owner(off: np.ndarray) -> np.ndarray:
    """The text of each item, from offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of each text's values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def is_char_start(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``width`` lower-cased words of each text, sorted within the text, and offsets.

    A text of fewer words has its whole sequence as its only shingle; a text
    without words has none.
    """
    data = LOWER[data]
    starts, ends, word_off = words(data, off)
    hashed = span_hashes(data, starts, ends)
    counts = np.diff(word_off)
    at = gram_places(word_off, width)
    values = grams(hashed, width)[at] if len(at) else np.zeros(0, np.uint64)
    docs = np.searchsorted(word_off, at, "right") - 1
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(few):
                total = _roll(total, hashed[word_off[short] + j])
            values = np.concatenate([values, mix(total + np.uint64(few))])
            docs = np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
        values, docs = values[new], docs[new]
    return values, np.searchsorted(docs, np.arange(len(off)))


def with_fields(docs: DataFrame, ddl: str) -> StructType:
    """The schema of ``docs`` with more fields at its end."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(ddl).fields])
