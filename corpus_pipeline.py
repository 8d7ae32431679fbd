"""From raw documents to token ids: five operators, each on all that the one before it kept.

In every stage rows that repeat a doc_id are rows of their own unless said
otherwise, texts of any length are worked on whole, and an empty table gives an
empty table. Columns other than those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigseg.llm.bpe_automaton import bpe_encode
from sigseg.llm.line_dedup import line_dedup
from sigseg.llm.mixing import mix_sources
from sigseg.llm.near_dup import near_duplicates
from sigseg.llm.quality_rules import quality_filter
from sigseg.llm.queries import tokenizer_spec
from sigseg.llm.shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, the repetition limits and the share of symbols.

    A null or empty text has too few words and goes. Nulls in other columns stay.
    """
    return quality_filter(docs).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in the largest of them; n_chars follows the text.

    No document goes, but a text may end up empty. A null text stays null; lines of rows
    without a doc_id stay.
    """
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies.

    Rows that repeat a doc_id stay or go together. Null and empty texts are like no
    other and stay, as do rows without a doc_id.
    """
    kept = near_duplicates(docs, width=5).filter("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").select(COLUMNS)
    return stay.unionByName(docs.filter("doc_id is null").select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, some sources up to twice as often as others; a null source is a source of its own."""
    return mix_sources(docs, max_repeats=2.0).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and digests of them and of the text that they spell; none for a null or empty text."""
    spec = tokenizer_spec()
    return bpe_encode(docs, spec, packed=True, decoded="decoded").select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode_decode", tokenize),
]

#: Sketches, the bisected mix and the automaton are not SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
