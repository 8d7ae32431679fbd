"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizers spell a space and the text, A by byte-level BPE of a tokenizers
file, B by BPE pieces of a sentencepiece model, which adds the space itself.
Special tokens are plain text to both. The ends of all tokens cut the bytes
into elementary intervals: the union of both end arrays, whose owners on either
side are found by binary search. Each interval is one overlap of an A token
with a B token; an end that both have closes a group, and what a group holds on
one side spells the same as on the other. ``links`` says which pairs are
linked: those that end together (``end``, one for each group), those that
overlap (``overlap``, one for each interval), or the product of each group
(``group``: as many as both sides of the group multiplied, so for tokenizers
that often meet).

Links are counted over all documents by their pair of ids, first within batches.
Counts of at most BROADCAST_PAIRS pairs go to every task; beyond, the documents'
distinct pairs are joined with them, the frequent ones salted.

A text that is null or empty, or that one of the tokenizers does not spell byte
for byte (U+2581 is a space to B), has no tokens: zeros and no groups. Rows that
repeat a doc_id are aligned each for itself. Texts are aligned in slices of
SLICE_BYTES, longer ones alone and whole. An empty table gives no rows. Extra
columns are not carried.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.llm import textops as T
from sigseg.llm.pretokenize import BatchEncoder, Vocabulary
from sigseg.llm.shared import Scratch, lookup

#: Distinct pairs whose counts are handed to every task (16 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Links that are looked up at once, pieces that a worker's cache holds, and new pieces that are encoded at once.
LINKS, CACHED_PIECES, PIECES_AT_ONCE = 1 << 19, 200_000, 1 << 12
#: Bytes of text in a slice.
SLICE_BYTES = 1 << 19
KINDS = ("end", "overlap", "group")

ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary"
_ALIGNED = [f.split()[0] for f in ALIGNED.split(", ")]


def _flat_ids(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts


@dataclass(frozen=True)
class _Side:
    """One tokenizer: ids of texts that begin with a space, and the bytes of each id."""

    encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    bytes: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(encode: Callable, label: list[bytes]) -> _Side:
        length = np.fromiter(map(len, label), np.int64, len(label))
        return _Side(encode, np.frombuffer(b"".join(label), np.uint8), np.cumsum(length) - length, length)

    def spells(self, ids: np.ndarray, off: np.ndarray, data: np.ndarray, byte_off: np.ndarray) -> np.ndarray:
        """Which texts are what their ids spell."""
        length = self.length[ids]
        per_text = T.sums(length, off)
        same = per_text == np.diff(byte_off)
        keep = np.repeat(same, np.diff(off))
        ids, length = ids[keep], length[keep]
        total = np.cumsum(length)
        spelled = self.bytes[np.repeat(self.start[ids] - (total - length), length) + np.arange(total[-1] if len(total) else 0)]
        expected = data if same.all() else data[np.repeat(same, np.diff(byte_off))]
        wrong = np.flatnonzero(spelled != expected)
        if len(wrong):
            ends = np.cumsum(np.where(same, per_text, 0))
            same[np.searchsorted(ends, wrong, "right")] = False
        return same


def byte_level(spec: str) -> _Side:
    """A tokenizers file of byte-level BPE."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # an encoding holds far more than its ids, so few are kept at a time
        parts = [pieces[i : i + PIECES_AT_ONCE] for i in range(0, len(pieces), PIECES_AT_ONCE)]
        found = [_flat_ids([x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)]) for part in parts]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])

    vocabulary = Vocabulary(spec)
    label, vocabulary.added = vocabulary.label, {}
    encoder = BatchEncoder(vocabulary, encode)

    def encode_batch(spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(encoder.known) > CACHED_PIECES:  # less than its own limit: the other tokenizer needs memory too
            encoder._forget()
        return encoder(spaced)

    return _Side.of(encode_batch, label)


def sentence_pieces(model: bytes) -> _Side:
    """A sentencepiece model of BPE with byte fallback, which adds the first space of a text."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    label = []
    for i in range(processor.vocab_size()):
        piece = processor.id_to_piece(i)
        label.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = _flat_ids(processor.encode([t[1:] for t in spaced.to_pylist()], num_threads=1))
        return ids, np.append(0, np.cumsum(counts))

    return _Side.of(encode, label)


_loaded: dict[bytes, tuple[_Side, _Side]] = {}


def _sides(spec: str, model: bytes) -> tuple[_Side, _Side]:
    key = hashlib.sha256(spec.encode() + model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = byte_level(spec), sentence_pieces(model)
    return _loaded[key]


def _give_back() -> None:
    """Freed memory goes back to the system: a worker lives on beside what the executor does next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim is not None:
        trim(0)


@dataclass(frozen=True)
class Alignment:
    """Of a batch of texts: ids with each text's offsets, the group of each token, and linked tokens."""

    a: np.ndarray
    a_off: np.ndarray
    b: np.ndarray
    b_off: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_off: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_off: np.ndarray


def _products(a_group: np.ndarray, b_group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens of the same group."""
    a_from, b_from = np.searchsorted(a_group, np.arange(n + 1)), np.searchsorted(b_group, np.arange(n + 1))
    n_b = np.diff(b_from)[a_group]  # partners of each A token
    link_a = np.repeat(np.arange(len(a_group)), n_b)
    total = np.cumsum(n_b)
    return link_a, np.arange(len(link_a)) + np.repeat(b_from[a_group] - (total - n_b), n_b)


def align(a: np.ndarray, a_off: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_off: np.ndarray, b_end: np.ndarray, kind: str) -> Alignment:
    """Groups and links of texts that both sides spell; ends are byte offsets that go on from text to text."""
    cuts, times = np.unique(np.concatenate([a_end, b_end]), return_counts=True)  # union1d, and which ends are shared
    owner_a, owner_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
    both = times == 2
    shared = cuts[both]
    a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
    last = a_end[np.maximum(a_off[1:] - 1, 0)] if len(a_end) else np.zeros(len(a_off) - 1, np.int64)
    last = np.maximum.accumulate(np.where(np.diff(a_off) > 0, last, 0))
    group_off = np.append(0, np.searchsorted(shared, last, "right"))
    if kind == "end":
        link_a, link_b = owner_a[both], owner_b[both]
    elif kind == "overlap":
        link_a, link_b = owner_a, owner_b
    else:
        link_a, link_b = _products(a_group, b_group, len(shared))
    return Alignment(a, a_off, b, b_off, a_group, b_group, group_off, link_a, link_b, np.searchsorted(link_a, a_off))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, with room for a separator, and their number."""
    texts = [str(i) for i in range(n)]
    width = len(texts[-1]) + 1
    return np.frombuffer("".join(t.ljust(width) for t in texts).encode(), np.uint8).reshape(n, width), np.fromiter(map(len, texts), np.int64, n)


_digit_table: list[tuple[np.ndarray, np.ndarray]] = []


def group_texts(x: Alignment) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all texts, one after another, and offsets; one character lies between two texts."""
    top = int(max(x.a.max(initial=0), x.b.max(initial=0))) + 1
    if not _digit_table or len(_digit_table[0][1]) < top:
        _digit_table[:] = [_digits(top)]
    digits, width = _digit_table[0]
    n = len(x.a) + len(x.b)
    ids, end = np.empty(n, np.int64), np.empty(n, np.uint8)
    at_a = np.arange(len(x.a)) + np.searchsorted(x.b_group, x.a_group)  # behind the B tokens of earlier groups
    at_b = np.arange(len(x.b)) + np.searchsorted(x.a_group, x.b_group, "right")
    for at, own, group, closing in ((at_a, x.a, x.a_group, 0x7C), (at_b, x.b, x.b_group, 0x3B)):
        final = np.ones(len(group), bool)
        final[:-1] = group[1:] != group[:-1]
        ids[at], end[at] = own, np.where(final, closing, 0x2C)
    rows, size = digits[ids], width[ids]
    rows[np.arange(n), size] = end
    flat = rows[np.arange(rows.shape[1])[None, :] <= size[:, None]].tobytes()
    total = np.append(0, np.cumsum(size + 1))
    return flat, total[x.a_off + x.b_off]


def _aligned(column: pa.Array, sides: tuple[_Side, _Side], kind: str) -> Alignment:
    column = column.fill_null("").cast(pa.large_utf8())
    spaced = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_utf8()), column, pa.scalar("", pa.large_utf8())))
    data, off = T.flat(spaced)
    coded = [side.encode(spaced) for side in sides]
    good = np.logical_and.reduce([side.spells(*c, data, off) for side, c in zip(sides, coded, strict=True)])
    kept = []
    for side, (ids, ids_off) in zip(sides, coded, strict=True):
        counts = np.diff(ids_off)
        ids = ids if good.all() else ids[np.repeat(good, counts)]
        kept += [ids, np.append(0, np.cumsum(np.where(good, counts, 0))), np.cumsum(side.length[ids])]
    return align(*kept, kind)


def align_documents(docs: DataFrame, spec: str, model: bytes, links: str = "end", digest: bool = False) -> DataFrame:
    """ALIGNED for each row of ``docs`` (doc_id, text).

    ``groups`` lists the ids of each group, or is the SHA-256 of that list with
    ``digest``; ``links`` holds the linked pairs as little-endian unsigned 64-bit
    integers, id of A * 2**32 + id of B.
    """
    if links not in KINDS:
        raise ValueError(f"links is one of {KINDS}")
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*shared.value)
        for part in T.slices(batches, "text", SLICE_BYTES):
            x = _aligned(part.column(2), sides, links)
            flat, off = group_texts(x)
            some, off = np.diff(x.a_off) > 0, off.tolist()
            texts = [flat[s : e - 1] if k else b"" for s, e, k in zip(off[:-1], off[1:], some.tolist(), strict=True)]
            groups = [hashlib.sha256(t).hexdigest() if t else "" for t in texts] if digest else [t.decode() for t in texts]
            key = x.a[x.link_a].astype("<u8") << np.uint64(32) | x.b[x.link_b].astype("<u8")
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(x.link_off.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())
            counts = [pa.array(np.diff(o).astype(np.int64)) for o in (x.a_off, x.b_off, x.group_off, x.link_off)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts, pa.array(groups, pa.string()), packed], names=_ALIGNED)
            x = flat = off = texts = groups = key = packed = counts = None
            _give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED)


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of about LINKS links, one row at least, with the pairs of all their links, and offsets. Links are the last column."""
    for batch in batches:
        column = batch.columns[-1].cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + LINKS, "right")) - 1)
            yield batch.slice(at, to - at), np.frombuffer(data[8 * off[at] : 8 * off[to]].tobytes(), "<i8"), off[at : to + 1] - off[at]
            at = to


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best`` for each linked pair of ids: its links in all documents, and whether no other A id has more with its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs, _ in _link_lists(batches):
            found, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    keyed = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = keyed.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B
    return keyed.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _judged(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum, by counts that every task holds."""
    table = counts.toArrow()
    pair, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    shared = aligned.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch, pairs, off in _link_lists(batches):
            found, which = np.unique(pairs, return_inverse=True)
            at = np.searchsorted(pair, found)
            sums = [pa.array(T.sums(v[at][which].astype(np.int64), off)) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    kept = [f for f in ALIGNED.split(", ") if not f.startswith("links")]
    return aligned.mapInArrow(run, ", ".join([*kept, "n_best bigint", "count_sum bigint"]))


def _joined(aligned: DataFrame, counts: DataFrame, n_pairs: int) -> DataFrame:
    """The same by a join of each document's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pairs, off in _link_lists(batches):
            keys = np.stack([T.owner(off), pairs], 1)
            found, n = np.unique(keys, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(n.astype(np.int64))], names=["row", "pair", "times"])

    own = aligned.select("row", "links").mapInArrow(run, "row bigint, pair bigint, times bigint")
    met = lookup(own, counts, n_pairs, ["pair"], "row", "inner", count="n")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.drop("links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def cross_tokenizer_links(docs: DataFrame, spec: str, model: bytes, links: str = "end", digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` for each row of ``docs`` (doc_id, text).

    ``n_best`` counts the links whose pair is as frequent as any with its B id,
    ``count_sum`` sums up the frequencies of the links' pairs.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = scratch.write(align_documents(docs, spec, model, links, digest), "aligned")
    counts = scratch.write(link_counts(aligned), "counts")
    n_pairs = counts.count()
    return (_judged(aligned, counts) if n_pairs <= BROADCAST_PAIRS else _joined(aligned, counts, n_pairs)).drop("row")
