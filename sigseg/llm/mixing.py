"""Mixing sources to target weights by temperature.

The weight of a source is its share of the tokens to the power of an exponent
between 0 (all sources alike) and 1 (as they are), normalised. The exponent is
bisected until the mix meets a target: an entropy (as a share of the largest
possible), or a limit on how often the most repeated source repeats. Every
bisection round probes several exponents in one aggregate over the table of
sources, so sources are never collected.

The budget of tokens, by default just enough that no source loses a document,
is split by weight. A source is passed through whole as often as its budget
holds it, and then once more in part: documents come in the order of a hash,
and those whose running token count stays within the budget are taken. Running
counts go by hash ranges of bounded size, first over the ranges and then within
them, so a hot source is spread over many tasks.

The mix is cut into blocks by each source's progress through its budget: every
block holds the same weights. Within a block, a hash of document and copy
gives the permutation. A position is (block, place).

Tokens are estimated from the bytes of a text (``tokens_of``), which needs no
tokenizer and holds for unspaced writing as well as for prose.

Null sources are a source of their own. Null and empty texts count no tokens
and go with the first document after them. Rows that repeat a doc_id are each
mixed; those without a doc_id are placed by their row number. Texts of any length are
counted whole. A table without tokens is returned once, in one block. Extra columns
are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigseg.llm.shared import Scratch, small

#: Documents of a hash range.
RANGE_DOCS = 1024
#: Exponents that a round probes between the bounds, and rounds: 16 ** 6 steps of the exponent.
PROBES = 15
ROUNDS = 6
#: Bytes of UTF-8 for each token: 2.5 by the 50k vocabulary over prose in four languages, 2.2 to 2.6 by language.
BYTES_PER_TOKEN = 2.5
#: Tokens of a block.
BLOCK_TOKENS = 1 << 22

ADDED = ["copy", "block", "place"]


@dataclass(frozen=True)
class Mix:
    """What the bisection found."""

    exponent: float
    entropy: float
    max_repeats: float
    budget: float


def tokens_of(text: Column) -> Column:
    """Estimated tokens of a text, at least one unless it is null or empty."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(BYTES_PER_TOKEN)), F.lit(0)).cast("long")


def _probe(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """Entropy share, largest repetition when no source loses a document, that budget, and the sum of powers, of each exponent."""
    t = F.col("tokens").cast("double")
    aggs = []
    for i, a in enumerate(exponents):
        power = F.pow(t, F.lit(a))
        aggs += [F.sum(power).alias(f"s{i}"), F.sum(power * F.log(power)).alias(f"l{i}"), F.max(power / t).alias(f"u{i}"), F.min(power / t).alias(f"d{i}")]
    row = sources.agg(F.count("*").alias("n"), *aggs).first()
    out = []
    for i in range(len(exponents)):
        total = row[f"s{i}"]
        entropy = math.log(total) - row[f"l{i}"] / total
        out.append((entropy / math.log(row["n"]) if row["n"] > 1 else 1.0, row[f"u{i}"] / row[f"d{i}"], total / row[f"d{i}"], total))
    return out


def solve(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> Mix:
    """The smallest exponent whose mix repeats no source more than ``max_repeats`` times, or the largest that reaches the entropy.

    ``sources``: a row for each source with its ``tokens``, all positive.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either a target entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        at = [low + (high - low) * i / (PROBES + 1) for i in range(1, PROBES + 1)]
        for a, (entropy, repeats, _, _) in zip(at, _probe(sources, at), strict=True):
            if (entropy >= target_entropy) if target_entropy is not None else (repeats > max_repeats):
                low = a
            else:
                high = a
                break
    exponent = math.floor(low * 1e6) / 1e6 if target_entropy is not None else math.ceil(high * 1e6) / 1e6
    entropy, repeats, budget, _ = _probe(sources, [exponent])[0]
    return Mix(exponent, entropy, repeats, budget)


def mix_sources(
    docs: DataFrame, source: str = "source", target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "1"
) -> DataFrame:
    """The rows of the mix: those of ``docs``, once for each copy, with ``copy``, ``block`` and ``place``."""
    scratch = Scratch(docs.sparkSession, "mix")
    kept = [c for c in docs.columns if c not in ADDED]
    # a written row number tells rows apart that repeat a doc_id
    keyed = scratch.write(docs.select(*kept).withColumn("__row", F.monotonically_increasing_id()), "keyed")
    # rows without a doc_id go by their number, so that they spread over the ranges
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("__row")))))
    counted = keyed.select("__row", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(source).isNull().alias("none"), tokens_of(F.col("text")).alias("tokens"), digest.alias("h"))
    counted = scratch.write(counted, "counted")
    sources = scratch.write(counted.groupBy("s", "none").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    positive = sources.filter("tokens > 0")
    if not positive.limit(1).count():
        return keyed.select(*kept, F.lit(0).cast("long").alias("copy"), F.lit(0).cast("long").alias("block"), F.col("__row").alias("place"))
    found = solve(positive, target_entropy, max_repeats)
    total = float(budget) if budget is not None else found.budget
    power_sum = _probe(positive, [found.exponent])[0][3]
    share = F.pow(F.col("tokens").cast("double"), F.lit(found.exponent)) / F.lit(power_sum)
    # whole tokens; the rounding may not take a source's last document
    grant = F.round(F.when(F.col("tokens") > 0, share * F.lit(total)).otherwise(0.0)).cast("long")
    plan = scratch.write(sources.select("s", "none", F.col("tokens").alias("all"), F.ceil(F.col("docs") / RANGE_DOCS).alias("ranges"), grant.alias("grant")), "plan")
    n_sources = plan.count()
    n_blocks = max(1, math.ceil(total / block_tokens))

    unit = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    ranged = counted.join(small(plan, n_sources), ["s", "none"]).withColumn("range", F.floor(unit * F.col("ranges")))
    ranged = scratch.write(ranged, "ranged")
    sums = ranged.groupBy("s", "none", "range").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("s", "none").orderBy("range")) - F.col("sum")).select("s", "none", "range", "base")
    before = scratch.write(before, "before")
    inner = F.sum("tokens").over(Window.partitionBy("s", "none", "range").orderBy("h", "tokens", "__row").rowsBetween(Window.unboundedPreceding, 0))
    run = ranged.withColumn("inner", inner).join(small(before, before.count()), ["s", "none", "range"]).withColumn("upto", F.col("inner") + F.col("base"))
    # a document's nth copy ends at n * all + upto; it is taken while that is within the grant
    copies = F.when(F.col("all") == 0, 1).otherwise(F.floor((F.col("grant") - F.col("upto")) / F.greatest("all", F.lit(1))) + 1)
    placed = run.withColumn("copies", copies.cast("int")).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    progress = (F.col("copy") * F.col("all") + F.col("upto") - F.col("tokens")) / F.greatest("grant", F.lit(1))
    block = F.least(F.floor(progress * n_blocks), F.lit(n_blocks - 1))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), F.col("h"), F.col("copy"))), 1, 15), 16, 10)
    places = placed.select("__row", F.col("copy").cast("long").alias("copy"), block.cast("long").alias("block"), place.cast("long").alias("place"))
    return places.join(keyed, "__row").select(*kept, *ADDED)
