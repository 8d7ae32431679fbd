"""Passages that repeat across documents, by content-defined chunks.

A gear hash of the last 16 bytes rolls over each text; a word begins a new
chunk where the hash is below a threshold. In a word of more than 24 bytes
(unspaced writing, minified code, base64) a chunk also begins at each code point
whose hash is the least within 18 bytes. Cuts depend on the bytes close to them
only, so an insertion shifts no chunk but its own. Chunks get a
128-bit digest. Digests that two documents or more hold are found by one
aggregation; joined back, they give each document the digests that it shares,
with the smallest document that holds each.

A run of adjacent shared chunks of ``min_words`` words or more is a repeated
passage; 6 bytes of a long word count as a word. Its chunks stay in the
smallest document that holds them and go from all others.

A null or empty text has no chunks. Rows that repeat a doc_id are one
document, and share nothing with each other; rows without a doc_id take no
part. A text longer than a slice (1 MiB) is worked on alone and whole. Empty
tables give empty tables. Extra columns are kept; columns named
like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigseg.llm import textops as T
from sigseg.llm.shared import Scratch, lookup

#: Bytes that decide on a cut, and the share of words that begin a chunk.
WINDOW = 16
CUT_SHARE = 1 / 6
#: A word of more bytes is cut inside, pieces have REACH bytes at least, and UNIT bytes of it count as a word.
LONG_WORD = 24
REACH = 18
UNIT = 6
#: Words of adjacent shared chunks that make a repeated passage.
MIN_WORDS = 12

_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 16, 256, dtype=np.uint16)

ADDED = ["n_chunks", "shared_chunks", "removed_chunks", "removed_chars", "first_docs"]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the table values of the last 16 bytes, each shifted by its age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros(len(h), np.uint16)
        older[step:] = h[:-step] << np.uint16(step) if step < len(h) else 0
        h = h + older
    return h


def inner_cuts(data: np.ndarray, off: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points inside the long words whose hash is the least of those within REACH bytes, the first of equal ones."""
    length = ends - starts
    at = np.cumsum(length + REACH) - length  # words lie apart, so none looks at another
    place = np.arange(length.sum()) + np.repeat(starts - np.cumsum(length) + length, length)
    slot = place + np.repeat(at - starts, length)
    text = off[np.searchsorted(off, starts, "right") - 1]
    fits = (place - np.repeat(starts, length) >= REACH) & (np.repeat(ends, length) - place >= REACH) & (place - np.repeat(text, length) >= WINDOW) & T.is_char_start(data[place])
    value = np.full(int(length.sum()) + REACH * (len(starts) + 1), 1 << 16, np.int32)
    value[slot[fits]] = hashes[place[fits] - 1]
    before, after = np.full_like(value, 1 << 16), np.full_like(value, 1 << 16)
    for step in range(1, REACH):
        np.minimum(before[step:], value[:-step], out=before[step:])
        np.minimum(after[:-step], value[step:], out=after[:-step])
    least = (value < before) & (value <= after)
    return place[fits & least[slot]]


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and offsets of the chunks, both digests, and the running counts of short words and of bytes of long ones."""
    starts, ends, word_off = T.words(data, off)
    first = np.zeros(len(starts), bool)
    first[word_off[:-1][np.diff(word_off) > 0]] = True
    owner = T.owner(word_off)
    room = starts - off[owner] >= WINDOW
    cut = first.copy()
    at = starts[room] - 1
    hashes = gear(data)
    cut[room] |= hashes[at] < int(CUT_SHARE * (1 << 16))
    inner = np.zeros(len(starts), np.int64)
    long = ends - starts > LONG_WORD
    if long.any():
        inside = inner_cuts(data, off, hashes, starts[long], ends[long])
        word = np.searchsorted(starts, inside, "right") - 1
        where = word + 1
        starts, cut = np.insert(starts, where, inside), np.insert(cut, where, True)
        ends, long = np.insert(ends, where, ends[word]), np.insert(long, where, True)
        ends = np.minimum(ends, np.append(starts[1:], len(data)))
        inner = np.where(long, ends - starts, 0)
        word_off = np.searchsorted(starts, off)
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(starts))[: len(begin)]
    a, b = starts[begin], ends[end - 1]
    d1, d2 = T.span_digests(data, a, b)
    bounds = np.append(begin, len(starts))
    counts = [np.append(0, np.cumsum(x))[bounds] for x in (inner == 0, inner)]
    return a, np.searchsorted(begin, word_off), d1, d2, *counts


def chunk_rows(docs: DataFrame) -> DataFrame:
    """d1, d2, doc_id, row, place, words, inner: one row for each chunk, with its place in the text and its short words and bytes of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            _, chunk_off, d1, d2, words, inner = chunks(*T.flat(part.column(2)))
            owner = T.owner(chunk_off)
            ids = [part.column(i).take(pa.array(owner)) for i in (0, 1)]
            counts = [pa.array(x, pa.int32()) for x in (np.arange(len(owner)) - chunk_off[owner], np.diff(words), np.diff(inner))]
            yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *ids, *counts], names=["d1", "d2", "doc_id", "row", "place", "words", "inner"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").filter("doc_id is not null")
    return rows.mapInArrow(run, "d1 bigint, d2 bigint, doc_id bigint, row bigint, place int, words int, inner int")


def _shared(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose digest another document holds, with ``first``, the smallest of its documents."""
    holders = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).filter("first <> last")
    holders = scratch.write(holders.select("d1", "d2", "first", "rows"), name)
    # a chunk that many documents hold is one key on the side of the rows, so such chunks are salted by document
    return lookup(rows, holders, holders.count(), ["d1", "d2"], "doc_id", "inner", "rows").drop("rows")


def _in_passages(shared: DataFrame, min_words: int) -> DataFrame:
    """The rows in runs of adjacent places of ``min_words`` words or more."""
    text = Window.partitionBy("doc_id", "row")
    runs = shared.withColumn("run", F.col("place") - F.row_number().over(text.orderBy("place")))
    run = Window.partitionBy("doc_id", "row", "run")
    total = F.sum("words").over(run) + F.floor(F.sum("inner").over(run) / UNIT)
    return runs.withColumn("total", total).filter(F.col("total") >= min_words).drop("run", "total")


def shared_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, shared: array of (d1, first), the digests that a document holds in repeated passages and the smallest document that does so too."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = scratch.write(_in_passages(_shared(chunk_rows(docs), scratch, "common"), min_words).drop("first"), "rows-0")
    n, k = rows.count(), 0
    while True:
        k += 1
        left = scratch.write(_in_passages(_shared(rows, scratch, f"holders-{k}"), min_words), f"rows-{k}")
        before, n = n, left.count()
        scratch.drop(f"rows-{k - 1}", f"holders-{k}")
        if n == before:
            return left.groupBy("doc_id").agg(F.collect_set(F.struct("d1", "first")).alias("shared"))
        rows = left.drop("first")


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the passages that a smaller document holds, with counts and ``first_docs``, the documents that keep them."""
    rest = docs.select(*[c for c in docs.columns if c not in ADDED])
    names, at = rest.columns, rest.columns.index("text")
    shared = shared_digests(docs, min_words).withColumnsRenamed({"doc_id": "__id", "shared": "__shared"})
    held = rest.withColumn("__id", F.col("doc_id").cast("long")).join(shared, "__id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            yield _clean(part, at, len(names), min_words)

    fields = "n_chunks bigint, shared_chunks bigint, removed_chunks bigint, removed_chars bigint, first_docs array<bigint>"
    return held.select(*names, "__id", "__shared").mapInArrow(run, T.with_fields(rest, fields))


def _clean(part: pa.RecordBatch, at: int, width: int, min_words: int) -> pa.RecordBatch:
    data, off = T.flat(part.column(at))
    lo, chunk_off, d1, _, words, inner = chunks(data, off)
    n, n_chunks = part.num_rows, len(lo)
    first = np.full(n_chunks, -1, np.int64)
    known = np.zeros(n_chunks, bool)
    lists = part.column(width + 1)
    items = lists.flatten()
    if len(items):
        list_off = np.concatenate([[0], np.cumsum(np.where(np.asarray(lists.is_null()), 0, np.asarray(lists.value_lengths().fill_null(0))))])
        keys = T.mix(np.asarray(items.field(0)).view(np.uint64) + T.owner(list_off).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(keys)
        mine = T.mix(d1 + T.owner(chunk_off).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        place = np.searchsorted(keys[order], mine)
        place[place == len(keys)] = 0
        known = keys[order][place] == mine
        first[known] = np.asarray(items.field(1))[order][place[known]]
    run_start, run_end = T.runs(known, chunk_off)
    long = words[run_end] - words[run_start] + (inner[run_end] - inner[run_start]) // UNIT >= min_words
    steps = np.zeros(n_chunks + 1, np.int64)
    steps[run_start[long]] += 1
    np.subtract.at(steps, run_end[long], 1)
    repeated = np.cumsum(steps)[:n_chunks] > 0
    own = np.asarray(part.column(width).fill_null(-1))[T.owner(chunk_off)]
    gone = repeated & (first < own)
    # a chunk goes with the white space after it; the last of a text goes to the text's end
    hi = np.append(lo[1:], len(data))
    last = chunk_off[1:] - 1
    has = np.diff(chunk_off) > 0
    hi[last[has]] = off[1:][has]
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(T.is_char_start(data), out=chars[1:])
    removed = T.sums(np.where(gone, chars[hi] - chars[lo], 0), chunk_off)
    texts, firsts = part.column(at), [[]] * n
    touched = np.flatnonzero(removed)
    if len(touched):
        new = texts.to_pylist()
        for i in touched:
            a, keep = off[i], []
            for j in range(chunk_off[i], chunk_off[i + 1]):
                if gone[j]:
                    keep.append(data[a : lo[j]].tobytes())
                    a = hi[j]
            new[i] = b"".join([*keep, data[a : off[i + 1]].tobytes()]).decode()
            inside = slice(chunk_off[i], chunk_off[i + 1])
            firsts[i] = np.unique(first[inside][gone[inside]]).tolist()
        texts = pa.array(new, texts.type)
    counts = [np.diff(chunk_off), T.sums(repeated, chunk_off), T.sums(gone, chunk_off), removed]
    columns = [*part.columns[:at], texts, *part.columns[at + 1 : width], *(pa.array(c, pa.int64()) for c in counts), pa.array(firsts, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:width], *ADDED])
