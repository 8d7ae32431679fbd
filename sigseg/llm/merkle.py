"""Merkle manifest of a table: a tree of fanout F over the rows of each source, and one over the sources.

A leaf is the digest of a row's fields, each ``-`` if null, else its length in
bytes, ``:`` and its value. The leaves of a source ascend by ``doc_id`` (nulls
first, equal ones by leaf); while several nodes remain, every F consecutive
ones become the digest of their concatenation, the last run with what is left,
be it one. What remains is the source's subroot, a lone leaf itself. Subroots,
ordered by source (null first, then by bytes), give the root in the same way.
Digests are lower-case hex SHA-256, of hex text where they cover digests.

Superblock reduction: the nodes of a tree are bucketed by index / F**K, and one
group collapses K levels of at most F**K nodes. The roots of the buckets are
the nodes of the next round, so n leaves take log(n) / log(F**K) rounds,
however many of them one source holds. A bucket keeps all its inner nodes: they
are its part of each proof. Going down again, a bucket hands its own upper
proof, with the part that it adds, to the buckets below; a leaf's proof is its
bucket's part and the upper one.

No row is dropped: rows that repeat a doc_id, or repeat wholly, are leaves of
their own. Null and empty values have different leaves. An empty table gives no
rows and no root. Long texts are digested by the JVM and go no further than
their leaf. Extra columns are kept out of the leaves and of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigseg.llm.shared import Scratch, lookup

#: Nodes under one node, and levels that one group collapses.
FANOUT, LEVELS = 3, 4
#: Fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the sources; the trees of sources begin with ``-`` (null) or ``=``.
TOP = "*"

#: A bucket: its digests level by level, and the number of each level. ``payload`` holds what the leaves carry.
_BLOCK = "tree string, block bigint, total bigint, root string, sizes array<int>, nodes array<string>, payload array<struct<doc_id:string,altered:string>>"
#: Siblings on both sides at each level, in hex, from the bottom up.
_PROOF = "array<struct<l:string,r:string>>"


def leaf(fields: tuple[str, ...] = FIELDS, **instead: F.Column) -> F.Column:
    """The digest of a row; ``instead`` gives other values to fields."""
    parts = []
    for name in fields:
        value = instead.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _indexed(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``nodes`` (tree, doc_id, digest, seq, altered) with ``place`` in their tree, and ``total``, the tree's nodes.

    Rows are dealt out in ranges and numbered in each; only the counts of each range's trees are summed up.
    """
    order = ["tree", "doc_id", "digest", "seq"]
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ranged = scratch.write(ranged.withColumn("part", F.shiftright("id", 33)), name)
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    by_tree = Window.partitionBy("tree")
    starts = counts.select("tree", "part", (F.sum("n").over(by_tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(by_tree).alias("total"), "n")
    starts = scratch.write(starts, f"{name}-starts")
    return lookup(ranged, starts, starts.count(), ["tree", "part"], "id", "inner", count="n").select("tree", (F.col("id") + F.col("shift")).alias("place"), "total", "digest", F.col("doc_id").cast("string").alias("doc_id"), "altered")


def _collapse(fanout: int, levels: int):
    """A group's function: K levels of a bucket, or all of them where the tree has no other bucket."""
    width = fanout**levels

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        level, total = rows["digest"].tolist(), int(rows["total"].iloc[0])
        nodes, sizes = list(level), [len(level)]
        while len(level) > 1 if total <= width else len(sizes) <= levels:
            level = [_hex("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
            nodes += level
            sizes.append(len(level))
        payload = [{"doc_id": d, "altered": a} for d, a in zip(rows["doc_id"].tolist(), rows["altered"].tolist(), strict=True)] if "doc_id" in rows else []
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "total": [total], "root": [level[0]], "sizes": [sizes], "nodes": [nodes], "payload": [payload]})

    return run


def _rounds(nodes: DataFrame, scratch: Scratch, name: str, fanout: int, levels: int) -> list[DataFrame]:
    """Tables of buckets, from the leaves (tree, place, total, digest) up to where each tree has but one."""
    width, found = fanout**levels, []
    while True:
        keyed = nodes.withColumn("block", F.expr(f"place div {width}"))
        found.append(scratch.write(keyed.groupBy("tree", "block").applyInPandas(_collapse(fanout, levels), _BLOCK), f"{name}-{len(found)}"))
        several = found[-1].filter(F.col("total") > width)
        if several.limit(1).count() == 0:
            return found
        nodes = several.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / width).alias("total"), F.col("root").alias("digest"))


def _sides(nodes: list[str], sizes: list[int], i: int, fanout: int) -> list[tuple[str, str]]:
    """What lies left and right of node ``i`` of the lowest level, level by level."""
    at, out = 0, []
    for size in sizes[:-1]:
        run = i - i % fanout
        level = nodes[at + run : at + min(run + fanout, size)]
        out.append(("".join(level[: i - run]), "".join(level[i - run + 1 :])))
        at, i = at + size, i // fanout
    return out


def _down(blocks: DataFrame, fanout: int) -> DataFrame:
    """From buckets with ``upper`` proof and ``subroot`` to the same of the nodes that they collapse: tree, place, subroot, upper."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, first, sizes, nodes, subroot, upper in zip(*(batch[c] for c in ("tree", "first", "sizes", "nodes", "subroot", "upper")), strict=True):
                above, sizes, nodes = [(x["l"], x["r"]) for x in upper], list(sizes), list(nodes)
                proofs = [[{"l": a, "r": b} for a, b in _sides(nodes, sizes, i, fanout) + above] for i in range(sizes[0])]
                yield pd.DataFrame({"tree": tree, "place": range(first, first + sizes[0]), "subroot": subroot, "upper": proofs})

    return blocks.select("tree", "first", "sizes", "nodes", "subroot", "upper").mapInPandas(run, f"tree string, place bigint, subroot string, upper {_PROOF}")


def _proved(rounds: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str, fanout: int, levels: int) -> DataFrame:
    """The lowest buckets with ``subroot`` and their upper proofs; ``tops`` (tree, subroot, upper) are those of the trees' last buckets."""
    width, upper = fanout**levels, None
    for k in reversed(range(len(rounds))):
        blocks = rounds[k].withColumn("first", F.col("block") * width)
        known = blocks.filter(F.col("total") <= width).join(tops, "tree")
        if upper is not None:
            known = known.unionByName(blocks.filter(F.col("total") > width).join(upper.withColumnRenamed("place", "block"), ["tree", "block"]))
        if k == 0:
            return known
        upper = scratch.write(_down(known, fanout), f"{name}-{k}")
    raise AssertionError


def _leaves(fanout: int, root: str):
    """Rows of the documents of a bucket: proofs put together, folded from what the document is now."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sizes, nodes, payload, upper, subroot in zip(batch["sizes"], batch["nodes"], batch["payload"], batch["upper"], batch["subroot"], strict=True):
                above, sizes, nodes, out = [(x["l"], x["r"]) for x in upper], list(sizes), list(nodes), []
                for i, row in enumerate(payload):
                    sides = _sides(nodes, sizes, i, fanout) + above
                    folded = row["altered"] or nodes[i]
                    for a, b in sides:
                        folded = _hex(a + folded + b)
                    out.append((row["doc_id"], nodes[i], subroot, root, _hex("".join(a + b for a, b in sides)), folded, folded == root))
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                yield pd.DataFrame(out, columns=names)

    return run


def merkle_manifest(docs: DataFrame, altered: F.Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs`` (FIELDS).

    ``altered`` is the text as it is found now (null: as it was); ``folded_root``
    comes from its leaf and the original siblings, and ``verified`` says whether
    that is the root. ``proof_sha256`` digests the siblings from the bottom up,
    left to right.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree")
    other = F.lit(None).cast("string") if altered is None else F.when(~altered.eqNullSafe(F.col("text")), leaf(text=altered))
    rows = docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), other.alias("altered"), F.monotonically_increasing_id().alias("seq"))
    rounds = _rounds(_indexed(scratch.write(rows, "leaves"), scratch, "placed"), scratch, "tree", fanout, levels)
    width = fanout**levels
    subroots = reduce(DataFrame.unionByName, [r.filter(F.col("total") <= width).select("tree", "root") for r in rounds])

    nodes = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("doc_id"), F.col("root").alias("digest"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("altered"))
    sources = scratch.write(_indexed(nodes, scratch, "sources"), "numbered")
    over = _rounds(sources.select("tree", "place", "total", "digest"), scratch, "top", fanout, levels)
    root = over[-1].select("root").first()  # one row at most: the tree of sources ends in one bucket
    none = docs.sparkSession.createDataFrame([(TOP, None, [])], f"tree string, subroot string, upper {_PROOF}")
    proofs = _down(_proved(over, none, scratch, "top-proofs", fanout, levels), fanout).select("place", "upper")
    tops = scratch.write(sources.select("place", F.col("doc_id").alias("tree"), F.col("digest").alias("subroot")).join(proofs, "place").drop("place"), "tops")

    low = _proved(rounds, tops, scratch, "proofs", fanout, levels).select("sizes", "nodes", "payload", "upper", "subroot")
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return low.mapInPandas(_leaves(fanout, root[0] if root else ""), out).withColumn("doc_id", F.col("doc_id").cast("long"))
