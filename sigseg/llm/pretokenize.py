"""Splitting of texts before byte-level BPE, on whole batches, and a cache of encoded pieces."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from sigseg.llm import textops as T

_OTHER, _LETTER, _NUMBER, _WHITE = range(4)
#: Pieces in a worker's cache, and their bytes; beyond, those that have not been met for the longest go, half of all.
CACHE_PIECES = 700_000
CACHE_BYTES = 1 << 26
#: The endings that byte-level BPE splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[[ord(x) for x in m[0]]] = kind
    return table


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pieces start and end; ``off`` bounds texts that are split each for itself."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at_byte = np.flatnonzero(T.is_char_start(data))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at_byte, off)] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of a run of white space that is followed by something is a piece, or part of the next if it is a space
    last = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~edge[1:n])
    start[last] = True
    joined = last[points[last] == 0x20] + 1
    start[joined] = False
    for p in np.flatnonzero((points == 0x27) & start):
        for ending in ENDINGS:
            to = p + 1 + len(ending)
            if to <= n and not edge[p + 1 : to].any() and all(points[p + 1 + j] == ord(x) for j, x in enumerate(ending)):
                start[p + 1] = False
                if to < n:
                    start[to] = True
                break
    begin = at_byte[start]
    return begin, np.append(begin[1:], len(data))


class Vocabulary:
    """What a tokenizers file says of a byte-level BPE: merges, ids and added tokens."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if not plain or spec["normalizer"] or model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-level BPE files are supported")
        # the byte of each character that stands for one: printable ones for themselves, the others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.label = [b""] * size
        for text_, i in [*self.ids.items(), *self.added.items()]:
            self.label[i] = text_


Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class BatchEncoder:
    """Encodes batches of texts; each distinct piece is encoded once while the cache holds it."""

    def __init__(self, vocabulary: Vocabulary, encode: Encode) -> None:
        self.encode = encode
        self.added = vocabulary.added
        self.pattern = regex.compile(b"|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.met = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used, self.bytes, self.turn = np.zeros(4096, np.uint32), 0, 0, 0

    def _learn(self, pieces: list[bytes]) -> None:
        ids, lengths = self.encode(pieces)
        first, n = len(self.known), len(pieces)
        while first + n > len(self.start):
            self.start, self.length, self.met = (np.resize(x, 2 * len(x)) for x in (self.start, self.length, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[first : first + n] = lengths
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.bytes += sum(map(len, pieces))
        self.known.update(zip(pieces, range(first, first + n), strict=True))

    def _forget(self) -> None:
        """Keep the half of the pieces that was met last, or none if one turn met them all."""
        n = len(self.known)
        stay = self.met[:n] > np.median(self.met[:n])
        place = np.cumsum(stay) - 1
        self.known = {x: int(place[i]) for x, i in self.known.items() if stay[i]}
        start, length = self.start[:n][stay], self.length[:n][stay]
        new = np.cumsum(length) - length
        self.flat = np.append(self.flat[np.repeat(start - new, length) + np.arange(int(length.sum()))], np.zeros(4096, np.uint32))
        self.used, self.bytes = int(length.sum()), sum(map(len, self.known))
        self.start, self.length, self.met = (np.append(x, np.zeros(1024, np.int64)) for x in (new, length, self.met[:n][stay]))

    def _places(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each piece in the cache; pieces are told apart by 128 bits within a batch, and by their bytes in the cache."""
        one, two = T.span_digests(data, begin, end)
        _, first, which = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][which] != two).any():
            _, first, which = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        if len(self.known) + len(first) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self._forget()
        raw, a, b = data.tobytes(), begin[first].tolist(), end[first].tolist()
        pieces = [raw[x:y] for x, y in zip(a, b, strict=True)]
        get = self.known.get
        places = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            self._learn([pieces[i] for i in new])
            places[new] = np.arange(len(self.known) - len(new), len(self.known))
        self.turn += 1
        self.met[places] = self.turn
        return places[which]

    def _added(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Starts and ends of the added tokens in the texts."""
        whole = data.tobytes() if self.pattern is not None else b""
        if not any(x in whole for x in self.added):
            return []
        bounds = zip(off[:-1].tolist(), off[1:].tolist(), strict=True)
        return [(a + m.start(), a + m.end()) for a, b in bounds for m in self.pattern.finditer(whole[a:b])]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n + 1 offsets."""
        data, off = T.flat(column)
        special = self._added(data, off)
        bounds = np.unique(np.concatenate([off, np.array(special, np.int64).ravel()]))
        begin, end = split(data, bounds)
        if special:
            lo = np.array([a for a, _ in special])
            hi = np.array([b for _, b in special])
            at = np.searchsorted(lo, begin, "right") - 1
            inside = (at >= 0) & (begin > lo[at]) & (begin < hi[at])
            begin = begin[~inside]
            end = np.append(begin[1:], len(data))
        place = self._places(data, begin, end)
        lengths, starts = self.length[place], self.start[place]
        if special:
            ids_of = {}
            for x, y in special:
                ids_of[x] = self.added[bytes(data[x:y])]
            at = np.searchsorted(begin, lo)
            lengths = lengths.copy()
            lengths[at] = 1
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        if special:
            ids[total[at]] = [ids_of[int(x)] for x in lo]
        return ids, total[np.searchsorted(begin, off)]
