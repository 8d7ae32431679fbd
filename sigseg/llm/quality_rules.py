"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths are taken over whole batches of texts
in numpy. For each length, the characters of the words inside n-grams that
occur twice or more in the text are measured; so are those of repeated lines.
One narrow pass, no shuffle. The share of symbols is a rule of its own, beside
the verdict on repetition.

Nulls and empty texts have no words and fail the base rules. Repeated rows are
judged each for itself, a text longer than a slice (1 MiB) alone and whole. Empty
tables give empty tables. Extra columns are kept; a column named like an added
one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.llm import textops as T

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Lengths of the n-grams, and the share of word characters inside repeated ones above which a text is rejected.
MAX_COVERAGE = {5: 0.30, 8: 0.28, 10: 0.20}
#: The same for the characters of lines that equal an earlier line.
MAX_LINE_COVERAGE = 0.15
#: Share of symbols among the word characters above which a text is rejected.
MAX_SYMBOLS = 0.05
MIN_WORDS = 20
BASE_WIDTH = 8

LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def _covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``width`` words that starts at one of ``at``."""
    steps = np.bincount(at, minlength=n + width + 1)[: n + width + 1]
    steps[width:] -= np.bincount(at, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def measure(column: pa.Array, widths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each text; ``cover_N`` holds the characters in repeated N-grams."""
    data, off = T.flat(column)
    starts, ends, word_off = T.words(data, off)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(T.is_char_start(data), out=chars[1:])
    word_len = chars[ends] - chars[starts]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.diff(word_off), "word_chars": T.sums(word_len, word_off), "n_symbols": T.sums(symbol[data], off)}
    hashed = T.span_hashes(data, starts, ends)
    text_of = T.owner(word_off).astype(np.uint64)
    for width in sorted({*widths, BASE_WIDTH}):
        at = T.gram_places(word_off, width)
        if len(at):
            keys = T.mix(T.grams(hashed, width)[at] + text_of[at] * np.uint64(0xA0761D6478BD642F))
            inside = _covered(at[_repeated(keys)], width, len(starts))
        else:
            inside = np.zeros(len(starts), bool)
        out[f"cover_{width}"] = T.sums(np.where(inside, word_len, 0), word_off)
        if width == BASE_WIDTH:
            out["n_repeat_words"] = T.sums(inside, word_off)
    line_starts, line_ends, line_off = T.lines(data, off)
    has_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    keys = T.mix(T.span_hashes(data, line_starts, line_ends) + T.owner(line_off).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    again &= has_word
    out["n_dup_lines"] = T.sums(again, line_off)
    out["dup_line_chars"] = T.sums(np.where(again, chars[line_ends] - chars[line_starts], 0), line_off)
    out["line_chars"] = T.sums(np.where(has_word, chars[line_ends] - chars[line_starts], 0), line_off)
    return out


def repetition_coverage(
    docs: DataFrame,
    text: str = "text",
    max_coverage: dict[int, float] | None = None,
    max_line_coverage: float = MAX_LINE_COVERAGE,
    max_symbols: float = MAX_SYMBOLS,
) -> DataFrame:
    """``docs`` with the counts, the coverages, ``base_failed``, ``too_many_symbols`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 in 100 words lie in
    repeated 8-word windows. ``kept``: not base_failed and no coverage, of n-grams
    or of lines, above its limit. ``coverage`` maps each n-gram length to the
    share of word characters inside repeated n-grams of that length.
    """
    limits = dict(MAX_COVERAGE if max_coverage is None else max_coverage)
    widths = tuple(sorted(limits))
    added = [*LONGS, "coverage", "line_coverage", "base_failed", "too_many_symbols", "kept"]
    rest = docs.select(*[c for c in docs.columns if c not in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, text):
            got = measure(part.column(part.schema.get_field_index(text)), widths)
            share = {w: got[f"cover_{w}"] / np.maximum(got["word_chars"], 1) for w in widths}
            line_share = got["dup_line_chars"] / np.maximum(got["line_chars"], 1)
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
            symbols = got["n_symbols"] > max_symbols * got["word_chars"]
            kept = ~failed & (line_share <= max_line_coverage)
            for w in widths:
                kept &= share[w] <= limits[w]
            n = part.num_rows
            coverage = pa.MapArray.from_arrays(
                pa.array(np.arange(n + 1) * len(widths), pa.int32()),
                pa.array(np.tile(np.array(widths, np.int32), n)),
                pa.array(np.stack([share[w] for w in widths], 1).ravel() if widths else np.zeros(0)),
            )
            columns = [*part.columns, *(pa.array(got[c], pa.int64()) for c in LONGS), coverage, pa.array(line_share), pa.array(failed), pa.array(symbols), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    types = ", ".join([f"{c} bigint" for c in LONGS] + ["coverage map<int,double>", "line_coverage double", "base_failed boolean", "too_many_symbols boolean", "kept boolean"])
    return rest.mapInArrow(run, T.with_fields(rest, types))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that both the repetition and the symbol rules keep, with their own columns only."""
    judged = repetition_coverage(docs, text).filter(F.col("kept") & ~F.col("too_many_symbols"))
    return judged.select(*docs.columns)
