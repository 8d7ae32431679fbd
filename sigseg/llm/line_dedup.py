"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without spaces and controls 0x09-0x0D at its ends, in
lower case for A-Z. Keys of ``min_chars`` code points or more are counted by
the documents that hold them.

State (``LineIndex``): a table of references (key, doc_id), one row for
each document and key, and the exact counts (documents, largest holder) of the
keys that enough documents hold. Inserting documents adds their references,
deleting documents takes theirs away; only the keys that they touch are counted
anew, so deletion undoes insertion exactly. Over the counted keys there is a
cuckoo filter per shard; filters follow insertions and deletions key by key.

Applying the index: the filters screen the references of the documents; only
those that pass are joined with the exact counts, and only their documents are
joined with the lines to drop. Small filters are broadcast. Large ones are sent to
the references of their shard, which are streamed past them in SALTS parts of
each shard, so that a line of all documents burdens no single task.

Null or empty texts are one empty line. Rows that repeat a doc_id are one
holder; each of them is cleaned. A null doc_id holds nothing and loses
nothing. A text longer than a slice (1 MiB) is worked on alone and whole. Empty
tables give empty tables. Extra columns are kept; ``n_lines`` and ``n_dropped``
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigseg.llm import textops as T
from sigseg.llm.shared import SALTS, Scratch, lookup

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of a shard that its filter is built for in one task.
SHARD_KEYS = 200_000
#: Keys up to which filters are broadcast: 2 bytes each at a load of 0.8, so 25 MB. Beyond, they are joined with the references by shard.
FILTER_KEYS = 10_000_000
#: Insertions and deletions after which the references are written as one table again.
COMPACT = 8
SLOTS = 4
SALT = np.uint64(0xA0761D6478BD642F)
MAX_ROUNDS = 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two buckets for each key; inserts and deletes whole arrays."""

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(capacity / 0.8 / SLOTS)) - 1).bit_length()
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table.copy()
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, SLOTS))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = T.mix(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, mixed & self.mask

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (T.mix(prints.astype(np.uint64)) & self.mask)

    def insert(self, keys: np.ndarray) -> bool:
        """Add the keys; False if they do not fit, and then the filter must be rebuilt larger."""
        prints, bucket = self._places(keys)
        rng = np.random.default_rng(1)
        for turn in range(MAX_ROUNDS):
            if not len(prints):
                return True
            _, first = np.unique(bucket, return_index=True)  # one item for a bucket in a round
            row = bucket[first].astype(np.int64)
            free = self.table[row] == 0
            has = free.any(1)
            self.table[row[has], free[has].argmax(1)] = prints[first[has]]
            full = first[~has]
            rest = np.ones(len(prints), bool)
            rest[first] = False
            prints_left, bucket_left = prints[rest], bucket[rest]
            moved, to = prints[full], self._other(bucket[full], prints[full])
            if turn % 2:  # both buckets were full: the item takes the place of another, which moves on
                at, slot = bucket[full].astype(np.int64), rng.integers(0, SLOTS, len(full))
                moved = self.table[at, slot]
                self.table[at, slot] = prints[full]
                to = self._other(bucket[full], moved)
            prints, bucket = np.concatenate([prints_left, moved]), np.concatenate([bucket_left, to])
        return not len(prints)

    def delete(self, keys: np.ndarray) -> None:
        """Remove one fingerprint of each key; the keys must have been inserted."""
        prints, bucket = self._places(keys)
        second = np.zeros(len(prints), bool)
        while len(prints):
            _, first = np.unique(bucket, return_index=True)  # one item for a bucket in a round
            row = bucket[first].astype(np.int64)
            same = self.table[row] == prints[first, None]
            has = same.any(1)
            self.table[row[has], same[has].argmax(1)] = 0
            lost = first[~has & ~second[first]]
            rest = np.ones(len(prints), bool)
            rest[first] = False
            other = self._other(bucket[lost], prints[lost])
            bucket = np.concatenate([bucket[rest], other])
            second = np.concatenate([second[rest], np.ones(len(lost), bool)])
            prints = np.concatenate([prints[rest], prints[lost]])

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in it; those that are in it always are."""
        prints, bucket = self._places(keys)
        hit = (self.table[bucket.astype(np.int64)] == prints[:, None]).any(1)
        return hit | (self.table[self._other(bucket, prints).astype(np.int64)] == prints[:, None]).any(1)


def line_keys(data: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and offsets of all lines; which are long; and both key hashes of the long ones."""
    starts, ends, line_off = T.lines(data, off)
    low = T.LOWER[data]
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~T.SPACE[data], out=solid[1:])
    places = np.flatnonzero(~T.SPACE[data])
    a, b = solid[starts], solid[ends]
    some = b > a
    left, right = starts.copy(), starts.copy()
    left[some] = places[a[some]]
    right[some] = places[b[some] - 1] + 1
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(T.is_char_start(data), out=chars[1:])
    long = chars[right] - chars[left] >= min_chars
    return starts, ends, line_off, long, *T.span_digests(low, left[long], right[long])


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id: one row for each long key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            data, off = T.flat(part.column(1))
            _, _, line_off, long, h1, h2 = line_keys(data, off, min_chars)
            owner = T.owner(line_off)[long]
            _, first = np.unique(T.mix(h1 + owner.astype(np.uint64) * SALT), return_index=True)
            columns = [pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), part.column(0).take(pa.array(owner[first]))]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id"]).filter(columns[2].is_valid())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint").distinct()


class LineIndex:
    """References of the documents inserted so far, exact counts of the keys that enough documents hold, and filters over these."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> None:
        self.spark, self.min_chars, self.min_docs, self.shard_keys = spark, min_chars, min_docs, shard_keys
        self.scratch = Scratch(spark, "lines")
        self.version, self.n_keys, self.shards = 0, 0, 1
        self.refs = spark.createDataFrame([], "h1 bigint, h2 bigint, doc_id bigint")
        self.counts = spark.createDataFrame([], "h1 bigint, h2 bigint, docs bigint, holder bigint")
        self.filters = spark.createDataFrame([], "shard int, filter binary")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; references that are there already are not counted twice."""
        new = references(docs, self.min_chars)
        if self.version:
            new = new.join(self.refs, ["h1", "h2", "doc_id"], "left_anti")
        new = self.scratch.write(new, f"new-{self.version + 1}")
        self.refs = self.refs.unionByName(new) if self.version else new
        return self._become(new)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take the documents with these doc_ids away."""
        ids = self.scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), f"ids-{self.version + 1}")
        gone = self.scratch.write(self.refs.join(ids, "doc_id", "left_semi").select("h1", "h2", "doc_id"), f"gone-{self.version + 1}")
        self.refs = self.refs.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id")
        return self._become(gone)

    def _become(self, changed: DataFrame) -> LineIndex:
        """Count the keys of the changed references anew, and let the filters follow."""
        self.version += 1
        if self.version % COMPACT == 0:
            self.refs = self.scratch.write(self.refs, f"refs-{self.version}")
        first = self.version == 1
        touched = None if first else self.scratch.write(changed.select("h1", "h2").distinct(), f"touched-{self.version}")
        mine = self.refs if first else self.refs.join(touched, ["h1", "h2"], "left_semi")
        now = mine.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("holder")).filter(F.col("docs") >= self.min_docs)
        was = self.counts if first else self.counts.join(touched, ["h1", "h2"], "left_semi")
        rest = self.counts if first else self.counts.join(touched, ["h1", "h2"], "left_anti")
        now = self.scratch.write(now, f"now-{self.version}")
        counts = now if first else self.scratch.write(rest.unionByName(now), f"counts-{self.version}")
        self.n_keys = counts.count()
        if first or self.n_keys > 2 * self.shards * self.shard_keys:
            self.shards = max(1, -(-self.n_keys // self.shard_keys))
            now, was, self.filters = counts, counts.limit(0), self.filters.limit(0)
        self.filters = self.scratch.write(self._updated(now, was), f"filters-{self.version}")
        self.counts = counts
        return self

    def _updated(self, now: DataFrame, was: DataFrame) -> DataFrame:
        """The filters, with the keys that have reached the counts inserted and those that have left them deleted."""
        keys = now.select("h1", "h2", F.lit(True).alias("now")).join(was.select("h1", "h2", F.lit(True).alias("was")), ["h1", "h2"], "full")
        keys = keys.filter("now is null or was is null")
        keys = keys.select(F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard"), "h1", F.col("now").isNotNull().alias("now"))
        given = self.filters.select("shard", F.lit(0).cast("long").alias("h1"), F.lit(False).alias("now"), "filter")
        rows = keys.withColumn("filter", F.lit(None).cast("binary")).unionByName(given)
        # a filter that overflows is built anew from all keys of its shard
        shards = self.shards
        whole = now.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1")
        if self.version > 1:
            whole = self.counts.join(was, ["h1", "h2"], "left_anti").select("h1").unionByName(now.select("h1")).select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            held = [x for x in pdf["filter"] if x is not None]
            keys = pdf[pdf["filter"].isna()]
            hashes, new = keys["h1"].to_numpy(np.int64).view(np.uint64), keys["now"].to_numpy(bool)
            made = CuckooFilter.from_bytes(held[0]) if held else CuckooFilter(int(new.sum()))
            made.delete(hashes[~new])
            fits = made.insert(hashes[new])
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [made.to_bytes() if fits else None]})

        def anew(pdf: pd.DataFrame) -> pd.DataFrame:
            hashes = pdf["h1"].to_numpy(np.int64).view(np.uint64)
            size = len(hashes)
            made = CuckooFilter(size)
            while not made.insert(hashes):
                size = 2 * size + 16
                made = CuckooFilter(size)
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [made.to_bytes()]})

        kind = "shard int, filter binary"
        made = self.scratch.write(rows.groupBy("shard").applyInPandas(build, kind), f"made-{self.version}")
        full = made.filter("filter is null").select("shard")
        if not full.limit(1).count():
            return made
        return made.filter("filter is not null").unionByName(whole.join(full, "shard").groupBy("shard").applyInPandas(anew, kind))

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """``docs`` without the lines that go, and with n_lines and n_dropped. ``refs``: their references, if at hand."""
        drops = self._drops(references(docs, self.min_chars) if refs is None else refs)
        rest = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")])
        held = rest.withColumn("__id", F.col("doc_id").cast("long")).join(drops.withColumnRenamed("doc_id", "__id"), "__id", "left").drop("__id")
        at, names = rest.columns.index("text"), rest.columns
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in T.slices(batches, "text"):
                data, off = T.flat(part.column(at))
                starts, ends, line_off, long, h1, _ = line_keys(data, off, min_chars)
                gone = np.zeros(len(starts), bool)
                drop = part.column(len(names))
                if drop.null_count < len(drop):
                    lengths = np.diff(np.asarray(drop.offsets, np.int64))
                    rows = np.repeat(np.arange(len(drop)), lengths)
                    salt = lambda h, d: T.mix(h + d.astype(np.uint64) * SALT)
                    wanted = salt(np.asarray(drop.flatten()).view(np.uint64), rows)
                    gone[long] = np.isin(salt(h1, T.owner(line_off)[long]), wanted)
                n_dropped = T.sums(gone, line_off)
                texts = part.column(at)
                touched = np.flatnonzero(n_dropped)
                if len(touched):
                    new = texts.to_pylist()
                    for i in touched:
                        keep = [data[starts[j] : ends[j]].tobytes() for j in range(line_off[i], line_off[i + 1]) if not gone[j]]
                        new[i] = b"\n".join(keep).decode()
                    texts = pa.array(new, texts.type)
                columns = [*part.columns[:at], texts, *part.columns[at + 1 : len(names)], pa.array(np.diff(line_off)), pa.array(n_dropped)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped"])

        return held.select(*names, "__drop").mapInArrow(run, T.with_fields(rest, "n_lines bigint, n_dropped bigint"))

    def _drops(self, refs: DataFrame) -> DataFrame:
        """doc_id and the keys (``__drop``) that it loses."""
        use = self._screened(refs) if self.n_keys <= FILTER_KEYS else self._screened_by_shard(refs)
        found = lookup(use, self.counts.select("h1", "h2", "docs", "holder"), self.n_keys, ["h1", "h2"], "doc_id", "inner", "docs").filter("doc_id <> holder")
        return found.groupBy("doc_id").agg(F.collect_set("h1").alias("__drop"))

    def _screened_by_shard(self, refs: DataFrame) -> DataFrame:
        """The same, by a shuffle: each part of a shard begins with its filter, and its references stream past it."""
        dealt = refs.select(F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("part"), "h1", "h2", "doc_id")
        parts = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = dealt.unionByName(parts, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, known = None, None
            for batch in batches:
                place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
                cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                    if tuple(place[a]) != at:
                        at, known = tuple(place[a]), None
                    piece = batch.slice(a, b - a)
                    for blob in piece.column(5).drop_null().to_pylist():
                        known = CuckooFilter.from_bytes(blob)
                    piece = piece.filter(piece.column(5).is_null())
                    if known is not None and piece.num_rows:
                        hit = known.contains(piece.column(2).to_numpy().view(np.uint64))
                        yield pa.RecordBatch.from_arrays(piece.columns[2:5], names=["h1", "h2", "doc_id"]).filter(pa.array(hit))

        return rows.select("shard", "part", "h1", "h2", "doc_id", "filter").mapInArrow(run, refs.schema)

    def _screened(self, refs: DataFrame) -> DataFrame:
        """The references whose keys the filters know, by broadcast."""
        blobs = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}  # at most FILTER_KEYS fingerprints
        shared = self.spark.sparkContext.broadcast(blobs)

        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()}
            for batch in batches:
                signed = batch.column(0).to_numpy()
                shard, h1 = signed % shards, signed.view(np.uint64)
                hit = np.zeros(len(h1), bool)
                for s in np.unique(shard):
                    mine = shard == s
                    if s in filters:
                        hit[mine] = filters[s].contains(h1[mine])
                yield batch.filter(pa.array(hit))

        return refs.mapInArrow(run, refs.schema)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents hold, but in their largest holder; with n_lines and n_dropped."""
    index = LineIndex(docs.sparkSession, min_chars, min_docs).insert(docs)
    return index.apply(docs, index.refs)
