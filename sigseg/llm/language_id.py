"""Language of texts and of the spans in them.

Learning counts, for each language, hashed letter pairs and triples of the
words of labelled texts, and the letters of each script. The model has a fixed
number of buckets for each language, so it is small whatever the corpus.

A word is a run of letters of one script; its script narrows the languages to
those that are known to use it. A word's score in a language is the sum of the
log probabilities of its pairs and triples, halved because they overlap.
Viterbi over the words, with a penalty for each switch of language, labels
spans of mixed text. Texts of one language are found without the walk: if no
run of words favours another language by more than half the penalty, the path
that never switches is the best one.

A text's language is the one with the most letters in its spans, the first in
alphabetical order of equal ones; its score is the share of these letters. It
is ``und`` with score 0 for null, empty and letterless texts, and for all
texts if nothing was learned, as from an empty table; an empty table of documents gives no rows. Repeated rows are judged each for itself; a text
longer than a slice (1 MiB) is judged alone and whole; rows without text or language teach nothing. Extra columns are kept; columns named
like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.llm import textops as T
from sigseg.llm.pretokenize import _LETTER, _classes
from sigseg.llm.shared import Scratch

#: Buckets for pairs and as many for triples, of each language.
BUCKETS = 1 << 15
#: Languages that a task counts before it hands its counts on, and that the driver takes over at once.
HELD_LANGUAGES = 64
#: Languages of a model (a quarter of a MB each); of more, those with the fewest letters are not learned.
MAX_LANGUAGES = 400
#: Scores of letters by languages that are looked up at once.
CELLS = 1 << 22
#: Natural logarithm of the odds against a switch of language between two words.
SWITCH_PENALTY = 12.0
#: Share of a language's letters from which it uses a script.
SCRIPT_SHARE = 0.001
#: Count added to each bucket.
SMOOTHING = 0.05

#: First and last code points of scripts; all other letters are of script 0 (Latin).
SCRIPTS = [
    ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF),
    ("Malayalam", 0xD00, 0xD7F), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Greek", 0x1F00, 0x1FFF),
    ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FFFF),
]
_NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS))
N_SCRIPTS = len(_NAMES) + 1


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script and lower case of each code point."""
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = _NAMES.index(name) + 1
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        if not 0xD800 <= i < 0xE000 and len(x := chr(i).lower()) == 1:
            low[i] = ord(x)
    return script, low


@dataclass(frozen=True)
class Words:
    """Words of a batch of texts: where they are, their script and the buckets of their letters."""

    off: np.ndarray  # of the words of each text
    start: np.ndarray  # in code points of the batch
    end: np.ndarray
    text_start: np.ndarray
    script: np.ndarray
    letter_off: np.ndarray  # of the letters of each word
    pairs: np.ndarray
    triples: np.ndarray


def split_words(column: pa.Array) -> Words:
    data, byte_off = T.flat(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero(T.is_char_start(data))
    off = np.searchsorted(at_byte, byte_off)
    script_of, low_of = _tables()
    letter = _classes()[points] == _LETTER
    script = script_of[points]
    bounds = np.unique(np.concatenate([off, np.flatnonzero(script[1:] != script[:-1]) + 1]))
    start, end = T.runs(letter, bounds)
    at = np.flatnonzero(letter)
    letter_off = np.searchsorted(at, np.append(start, len(points)))
    low = low_of[points[at]].astype(np.uint64)
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[letter_off[:-1]] = 0
    after[letter_off[1:] - 1] = 0
    pair = T.mix(before << np.uint64(21) | low)
    triple = T.mix(pair ^ (after + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(BUCKETS - 1)
    return Words(np.searchsorted(start, off), start, end, off[:-1], script[start], letter_off, (pair & mask).astype(np.int32), (triple & mask).astype(np.int32) + BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # [2 * BUCKETS, languages]
    uses: np.ndarray  # [scripts, languages]


def learn(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows (``text``, ``lang``) that have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in T.slices(batches, "text"):
            words = split_words(part.column(0))
            names = part.column(1).dictionary_encode()
            lang = np.asarray(names.indices)[T.owner(words.off)]
            of_letter = np.repeat(lang, np.diff(words.letter_off))
            for i, name in enumerate(names.dictionary.to_pylist()):
                mine = of_letter == i
                got = np.bincount(words.pairs[mine], minlength=2 * BUCKETS + N_SCRIPTS) + np.bincount(words.triples[mine], minlength=2 * BUCKETS + N_SCRIPTS)
                chosen = lang == i
                got[2 * BUCKETS :] += np.bincount(words.script[chosen], np.diff(words.letter_off)[chosen], N_SCRIPTS).astype(np.int64)
                total[name] = total.get(name, 0) + got
                if len(total) >= HELD_LANGUAGES:
                    yield from counted(total)
                    total = {}
        yield from counted(total)

    def counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, got in total.items():
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(got[some], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    found = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = Scratch(labelled.sparkSession, "languages").write(found, "counts")
    letters = F.sum(F.when(F.col("bucket") >= 2 * BUCKETS, F.col("n")).otherwise(0))
    most = found.groupBy("lang").agg(letters.alias("letters")).orderBy(F.desc("letters"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in most)
    log_probability = np.zeros((2 * BUCKETS, len(languages)), np.float32)
    uses = np.zeros((N_SCRIPTS, len(languages)), bool)
    for at in range(0, len(languages), HELD_LANGUAGES):
        some = languages[at : at + HELD_LANGUAGES]
        table = found.filter(F.col("lang").isin(some)).toArrow()  # at most 2 * BUCKETS + N_SCRIPTS rows for a language
        counts = np.zeros((2 * BUCKETS + N_SCRIPTS, len(some)))
        counts[table.column("bucket").to_numpy(), np.searchsorted(np.array(some, object), np.array(table.column("lang").to_pylist(), object))] = table.column("n").to_numpy()
        parts = [counts[:BUCKETS] + SMOOTHING, counts[BUCKETS : 2 * BUCKETS] + SMOOTHING]
        log_probability[:, at : at + len(some)] = np.concatenate([np.log(p / p.sum(0)) / 2 for p in parts])
        scripts = counts[2 * BUCKETS :]
        uses[:, at : at + len(some)] = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    return LanguageModel(languages, log_probability, uses)


@dataclass(frozen=True)
class Scores:
    """Log scores of words by languages: those of each distinct word once, and what a script adds to languages that do not use it."""

    total: np.ndarray  # [distinct words, languages]
    script: np.ndarray  # of each distinct word
    out: np.ndarray  # [scripts, languages]
    which: np.ndarray  # the distinct word of each word

    @staticmethod
    def of(matrix: np.ndarray) -> Scores:
        return Scores(matrix, np.zeros(len(matrix), np.int64), np.zeros((1, matrix.shape[1])), np.arange(len(matrix)))

    def column(self, language: int) -> np.ndarray:
        """Of each word in one language."""
        return (self.total[:, language].astype(np.float64) + self.out[self.script, language])[self.which]

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Of some words in all languages."""
        at = self.which[words]
        return self.total[at].astype(np.float64) + self.out[self.script[at]]


def word_scores(words: Words, model: LanguageModel) -> Scores:
    """Languages that do not use a word's script are out, unless none does."""
    off, k = words.letter_off, len(model.languages)
    size = np.diff(off)
    place = (np.arange(off[-1]) - np.repeat(off[:-1], size)).astype(np.uint64)
    letters = T.mix(words.pairs.astype(np.uint64) << np.uint64(32) | words.triples.astype(np.uint64)) + place * np.uint64(0xD1342543DE82EF95)
    names = T.mix(np.add.reduceat(T.mix(letters), off[:-1]) + words.script.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    total = np.zeros((len(first), k), np.float32)
    ends = np.cumsum(size[first])
    at = 0
    while at < len(first):  # distinct words whose letters fit the bound, one at least
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + CELLS // max(k, 1), "right")))
        some = first[at:to]
        inner = np.append(0, np.cumsum(size[some]))
        flat = np.repeat(off[some] - inner[:-1], size[some]) + np.arange(inner[-1])
        total[at:to] = np.add.reduceat(model.log_probability[words.pairs[flat]] + model.log_probability[words.triples[flat]], inner[:-1], axis=0)
        at = to
    out = np.where(model.uses | ~model.uses.any(1, keepdims=True), 0, -1e4)
    return Scores(total, words.script[first], out, which)


def viterbi(scores: Scores, off: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of each text."""
    n, k = len(scores.which), scores.total.shape[1]
    label = np.zeros(n, np.int64)
    counts = np.diff(off)
    some = np.flatnonzero(counts)
    if not n:
        return label
    main, best, own = np.zeros(len(some), np.int64), np.full(len(some), -np.inf), np.zeros(n)
    owner = np.repeat(np.arange(len(some)), counts[some])
    for j in range(k):
        value = scores.column(j)
        total = np.add.reduceat(value, off[some])
        better = total > best
        main[better], best[better] = j, total[better]
        own = np.where(better[owner], value, own)
    label[:] = main[owner]
    walk = np.zeros(len(some), bool)
    for j in range(k):
        gain = scores.column(j) - own
        far = 2 * np.abs(gain).sum() + 1  # running minima start afresh in each text
        total = np.cumsum(gain)
        before = np.minimum.accumulate(total - gain - owner * far)
        walk |= np.maximum.reduceat(total - owner * far - before, off[some]) > penalty / 2
    hard = some[walk]
    hard = hard[np.argsort(-counts[hard], kind="stable")]
    if not len(hard):
        return label
    size, first = counts[hard], off[hard]
    longest = int(size[0])
    value = scores.rows(first)
    back: list[np.ndarray] = []
    for t in range(1, longest):
        m = int(np.searchsorted(-size, -t))  # texts longer than t words
        best = value[:m].argmax(1)
        stay = value[:m] >= value[np.arange(m), best][:, None] - penalty
        back.append(np.where(stay, np.arange(k)[None, :], best[:, None]).astype(np.int16))
        value[:m] = np.where(stay, value[:m], value[np.arange(m), best][:, None] - penalty) + scores.rows(first[:m] + t)
    state = value.argmax(1)
    for t in range(longest - 1, 0, -1):
        m = int(np.searchsorted(-size, -t))
        label[first[:m] + t] = state[:m]
        state[:m] = back[t - 1][np.arange(m), state[:m]]
    label[first] = state
    return label


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (start and end in code points of the text, and language)."""
    added = ["lang_pred", "score", "spans"]
    rest = docs.select(*[c for c in docs.columns if c not in added])
    at = rest.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in T.slices(batches, "text"):
            found = _judge(part.column(at), known, penalty)
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *added])

    return rest.mapInArrow(run, T.with_fields(rest, "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"))


def _judge(column: pa.Array, model: LanguageModel, penalty: float) -> list[pa.Array]:
    n, k = len(column), len(model.languages)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    if not k:
        return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array([[]] * n, kind)]
    words = split_words(column)
    label = viterbi(word_scores(words, model), words.off, penalty)
    owner = T.owner(words.off)
    letters = np.bincount(owner * k + label, np.diff(words.letter_off), n * k).reshape(n, k)
    total = letters.sum(1)
    best = letters.argmax(1)
    names = pa.array(model.languages, pa.string())
    predicted = pa.DictionaryArray.from_arrays(pa.array(np.where(total > 0, best, k), pa.int32()), pa.array([*model.languages, "und"], pa.string())).cast(pa.string())
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(label))[1:] - 1
    base = words.text_start[owner[first]]
    spans = pa.StructArray.from_arrays(
        [pa.array(words.start[first] - base, pa.int32()), pa.array(words.end[last] - base, pa.int32()), pa.DictionaryArray.from_arrays(pa.array(label[first], pa.int32()), names).cast(pa.string())], names=["start", "end", "lang"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, words.off), pa.int32()), spans)
    return [predicted, pa.array(letters[np.arange(n), best] / np.maximum(total, 1)), lists]
