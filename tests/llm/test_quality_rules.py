import random
import re
from collections import Counter

import pytest

from sigseg.llm.quality_rules import MAX_COVERAGE, MAX_LINE_COVERAGE, MAX_SYMBOLS, quality_filter, repetition_coverage


def brute(text):
    """Counts, coverages and verdicts of one text, from the definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    inside = {}
    for width in (5, 8, 10):
        seen = Counter(tuple(words[i : i + width]) for i in range(n - width + 1))
        inside[width] = {i + j for i in range(n - width + 1) if seen[tuple(words[i : i + width])] > 1 for j in range(width)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    symbols = sum(c in "#*$%&|<>" for c in text)
    coverage = {w: sum(len(words[i]) for i in inside[w]) / max(chars, 1) for w in inside}
    share = sum(map(len, again)) / max(sum(map(len, lines)), 1)
    failed = n < 20 or 100 * len(inside[8]) > 30 * n
    kept = not failed and all(coverage[w] <= x for w, x in MAX_COVERAGE.items()) and share <= MAX_LINE_COVERAGE
    junk = symbols > MAX_SYMBOLS * chars
    return n, chars, symbols, len(again), len(inside[8]), coverage, share, failed, junk, kept, kept and not junk


def texts():
    rng = random.Random(1)
    out = ["", None, " \n\t", "one", "a b " * 40, "# * | " * 20, "same line here\n" * 30, "é漢 " * 25, "w " * 2000]
    for _ in range(200):
        words = [rng.choice(["a", "bb", "é", "#x"]) + str(rng.randrange(rng.choice([5, 50, 5000]))) for _ in range(rng.randrange(0, 200))]
        text = "".join(w + rng.choice([" ", " ", "\n", "  ", "\r\n"]) for w in words)
        out.append(text * rng.choice([1, 1, 1, 2]))
    return out


def test_equals_brute_force(spark):
    docs = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: r for r in repetition_coverage(df).collect()}
    for i, text, _ in docs:
        n, chars, symbols, again, repeat, coverage, share, failed, junk, kept, _ = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.too_many_symbols, r.kept) == (n, chars, symbols, again, repeat, failed, junk, kept), text
        assert r.coverage == pytest.approx(coverage)
        assert r.line_coverage == pytest.approx(share)


def test_filter_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    assert {r.doc_id for r in quality_filter(df).collect()} == {i for i, t in enumerate(texts()) if brute(t)[-1]}
    assert repetition_coverage(df.limit(0)).count() == 0
