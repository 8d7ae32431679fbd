"""Token ids in binary files: concatenated ids with Elias-Fano document boundaries.

Documents are dealt out by ranges of doc_id, encoded with the tokenizers
library and written in ascending order. A file is a shard; it consists of
blocks, rows of a Parquet table with

    shard, block         place of the block in ascending order
    base, n_tokens       ids of the shard before the block, ids in it
    width, ids           bytes of an id (2 or 4), concatenated little-endian ids
    n, end_*             Elias-Fano code of the documents' ends
    n_null               documents without a doc_id, the first of the block
    first_id, last_id    the least and largest doc_id
    id_*                 Elias-Fano code of the doc_ids less the least

A block is closed at BLOCK_TOKENS ids; only a longer document makes a larger
one. Reading all documents maps blocks to rows and needs the shards' totals only.
Reading given documents prunes blocks by their doc_ids and goes by ``select``
from a doc_id to its place and from there to its ids, decoding no list whole.

A null text is empty and has the end id only. Null doc_ids come first. Rows
that repeat a doc_id are all written, in an order that their texts fix. A text
longer than a slice (1 MiB) is encoded alone and whole. An
empty table gives no blocks. Extra columns are not written.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigseg.llm import textops as T
from sigseg.llm.elias_fano import EliasFano
from sigseg.llm.pretokenize import BatchEncoder, Vocabulary
from sigseg.llm.shared import small

#: Ids from which a block is closed.
BLOCK_TOKENS = 1 << 18
#: The id after each document.
END_ID = 0

_CODE = ["low_bits int", "lows binary", "highs binary", "samples binary"]
SCHEMA = ", ".join(
    ["shard int", "block int", "base bigint", "n_tokens bigint", "width int", "ids binary", "n int", *(f"end_{x}" for x in _CODE)]
    + ["n_null int", "first_id bigint", "last_id bigint", *(f"id_{x}" for x in _CODE)]
)
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}

_loaded: dict[bytes, BatchEncoder] = {}


def _library(spec: str) -> BatchEncoder:
    """A worker's encoder; the library encodes each distinct piece once."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())), counts

        _loaded.clear()
        _loaded[key] = BatchEncoder(Vocabulary(spec), encode)
    return _loaded[key]


def _code(code: EliasFano) -> list:
    return [code.low_bits, code.lows, code.highs, code.samples]


def _block(shard: int, block: int, base: int, ids: np.ndarray, sizes: np.ndarray, names: pa.Array) -> list:
    ends = np.cumsum(sizes)
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    real = names.drop_null().to_numpy()
    first, last = (int(real[0]), int(real[-1])) if len(real) else (None, None)
    id_code = EliasFano.encode((real - real[:1]).view(np.uint64))
    return [shard, block, base, len(ids), width, ids.astype(f"<u{width}").tobytes(), len(ends), *_code(EliasFano.encode(ends)), names.null_count, first, last, *_code(id_code)]


def _shard(batches: Iterator[pa.RecordBatch], encoder: BatchEncoder, shard: int, end_id: int, block_tokens: int) -> Iterator[list]:
    """The blocks of sorted documents (doc_id, text)."""
    block, base, held = 0, 0, 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    names: list[pa.Array] = []
    for part in T.slices(batches, "text"):
        flat, off = encoder(part.column(1))
        n = part.num_rows
        ends = off[1:] + np.arange(1, n + 1)
        closed = np.full(int(ends[-1]), end_id, np.uint32)
        inner = np.ones(len(closed), bool)
        inner[ends - 1] = False
        closed[inner] = flat
        at = start = 0
        while at < n:
            to = at + int(np.searchsorted(ends[at:] - start, block_tokens - held)) + 1  # the document that reaches the limit is the last
            full, to = to <= n, min(to, n)
            stop = int(ends[to - 1])
            ids.append(closed[start:stop])
            sizes.append(np.diff(ends[at:to], prepend=start))
            names.append(part.column(0).slice(at, to - at))
            held, at, start = held + stop - start, to, stop
            if full:
                yield _block(shard, block, base, np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(names))
                block, base, held, ids, sizes, names = block + 1, base + held, 0, [], [], []
    if sizes:
        yield _block(shard, block, base, np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(names))


def write_token_files(docs: DataFrame, spec: str, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write them to ``path``, a folder that all executors share."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    arrow = pa.schema([pa.field(f.split()[0], _ARROW[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _shard(batches, _library(shared.value), TaskContext.get().partitionId(), end_id, block_tokens):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``first``, the ids of all shards before theirs."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = totals.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("first"))  # a row for each shard
    return blocks.join(small(before, totals.count()), "shard")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, EliasFano, EliasFano, np.ndarray]]:
    """Each block with both codes and its ids."""
    for batch in batches:
        for at in range(batch.num_rows):
            x = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
            code = lambda kind, n: EliasFano(n, *(x[f"{kind}_{f.split()[0]}"] for f in _CODE))  # noqa: B023, E731
            yield x, code("end", x["n"]), code("id", x["n"] - x["n_null"]), np.frombuffer(x["ids"], f"<u{x['width']}").astype("<u4")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
_READ = [f.split()[0] for f in READ.split(", ")]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, end_code, id_code, flat in _rows(batches):
            ends = end_code.all().astype(np.int64)
            starts = np.append(0, ends[:-1])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(starts, ends[-1]) * 4), pa.py_buffer(flat)])
            real = (id_code.all() + np.array(x["first_id"] or 0, np.int64).astype(np.uint64)).view(np.int64)
            names = pa.concat_arrays([pa.nulls(x["n_null"], pa.int64()), pa.array(real)])
            yield pa.RecordBatch.from_arrays([names, pa.array(starts + x["first"] + x["base"]), pa.array(ends - starts), raw.cast(pa.binary())], names=_READ)

    return _placed(spark, path).mapInArrow(run, READ)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_token_files`` for the given documents only, those that repeat a doc_id all."""
    wanted = sorted(set(doc_ids))
    blocks = _placed(spark, path)
    blocks = blocks.filter((F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0])) if wanted else blocks.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, end_code, id_code, flat in _rows(batches):
            out: list[list] = [[], [], [], []]
            for doc_id in wanted:
                if not x["first_id"] <= doc_id <= x["last_id"]:
                    continue
                i = id_code.first_not_below(doc_id - x["first_id"])
                while i < id_code.n and id_code.select(i) == doc_id - x["first_id"]:
                    at = i + x["n_null"]
                    a, b = end_code.select(at - 1) if at else 0, end_code.select(at)
                    for column, value in zip(out, (doc_id, x["first"] + x["base"] + a, b - a, flat[a:b].tobytes()), strict=True):
                        column.append(value)
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_READ)

    return blocks.mapInArrow(run, READ)
