"""Byte-level BPE by a deterministic automaton that accepts correct tokenizations only.

States are what may follow a token. At first one state follows every byte and
allows every byte. Each merge (u, v) -> w, in order, is one gadget: the state
after u is replaced by a copy that no longer allows v, w becomes allowed
wherever u is, and w leads where v led. Every token so leads to one state, and
a string has exactly one accepted path, its BPE tokenization.

A state is stored as the list of what it has removed: (v, time). w is absent
from a state if u is, so a token is looked up along its left components: the
transition is barred if one of them was removed no later than the token above it was
made. Words are encoded in lockstep: a suffix automaton over the tokens gives
the tokens that end at each byte, and the transition tables tell which of them
continues the path of the prefix before it.

Decoding emits the labels (bytes) of the arcs.

A null or empty text has no ids, null or empty ids spell an empty text. Repeated
rows are encoded each for itself. A text longer than a slice (1 MiB) is worked on alone
and whole, as is a list of more than DECODE_IDS ids. Empty tables give empty tables.
Extra columns are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigseg.llm import textops as T
from sigseg.llm.pretokenize import BatchEncoder, Vocabulary


class HashTable:
    """Integer keys to integer values, looked up by whole arrays; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        at = (T.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & int(self.mask)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        at = (T.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class MergeAutomaton:
    """Tables of the automaton of a vocabulary; tokens are numbered bytes first, then merges in order."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        label = [bytes([b]) for b in range(256)]
        number = {x: i for i, x in enumerate(label)}
        left, right, made = [-1] * 256, [-1] * 256, [-1] * 256
        times: dict[tuple[int, int], int] = {}
        target = [0] * 256
        parent, removed, since = [-1], [-1], [-1]
        for time, (a, b) in enumerate(vocabulary.merges):
            u, v = number[a], number[b]
            if self._barred(u, v, time, left, right, made, times) or a + b in number:
                continue
            times[u, v] = time
            w = number[a + b] = len(label)
            label.append(a + b)
            left.append(u)
            right.append(v)
            made.append(time)
            target.append(target[v])
            parent.append(target[u])
            removed.append(v)
            since.append(time)
            target[u] = len(parent) - 1
            assert w == len(target) - 1
        self.label = label
        self.length = np.array([len(x) for x in label], np.int32)
        self.ids = np.array([vocabulary.ids[x] for x in label], np.uint32)
        self.left = np.array(left, np.int32)
        self.made = np.array(made, np.int32)
        states, self.target = np.unique(np.array(target), return_inverse=True)
        keys, values = [], []
        for i, state in enumerate(states.tolist()):
            seen: set[int] = set()
            while parent[state] >= 0:
                v = removed[state]
                if v not in seen:  # a later copy cannot remove it again
                    seen.add(v)
                    keys.append(i << 20 | v)
                    values.append(since[state])
                state = parent[state]
        self.bars = HashTable(np.array(keys, np.int64), np.array(values, np.int32))
        self._suffixes()

    @staticmethod
    def _barred(u: int, v: int, time: int, left: list[int], right: list[int], made: list[int], times: dict[tuple[int, int], int]) -> bool:
        """Whether earlier merges have removed v from the state after u."""
        x, before_x = u, time
        while x >= 0:
            y, before_y = v, time
            while y >= 0:
                k = times.get((x, y))
                if k is not None and k < before_x and k <= before_y:
                    return True
                y, before_y = left[y], made[y]
            x, before_x = right[x], made[x]
        return False

    def _suffixes(self) -> None:
        """Trie of the tokens with suffix links; each node knows the longest token that ends there."""
        arcs: list[dict[int, int]] = [{}]
        token = [-1]
        for t, text in enumerate(self.label):
            node = 0
            for byte in text:
                if byte not in arcs[node]:
                    arcs[node][byte] = len(arcs)
                    arcs.append({})
                    token.append(-1)
                node = arcs[node][byte]
            token[node] = t
        link, ending = [0] * len(arcs), list(token)
        shorter = [-1] * len(self.label)
        queue = list(arcs[0].values())
        for node in queue:
            for byte, child in arcs[node].items():
                queue.append(child)
                at = link[node]
                while at and byte not in arcs[at]:
                    at = link[at]
                link[child] = arcs[at].get(byte, 0)
            below = ending[link[node]]
            if token[node] >= 0:
                shorter[token[node]] = below
            else:
                ending[node] = below
        pairs = [(node << 8 | byte, child) for node, out in enumerate(arcs) for byte, child in out.items()]
        self.goto = HashTable(np.array([k for k, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int32))
        self.link, self.ending, self.shorter = np.array(link, np.int32), np.array(ending, np.int32), np.array(shorter, np.int32)
        self.first = np.zeros(256, np.int32)
        for byte, child in arcs[0].items():
            self.first[byte] = child

    def allowed(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it."""
        state = self.target[before].astype(np.int64) << 20
        out = np.ones(len(token), bool)
        todo, at, above = np.arange(len(token)), token.astype(np.int64), np.full(len(token), np.iinfo(np.int32).max, np.int32)
        while len(todo):
            time = self.bars(state[todo] | at)
            barred = (time >= 0) & (time <= above)
            out[todo[barred]] = False
            above, at = self.made[at], self.left[at].astype(np.int64)
            go = ~barred & (at >= 0)
            todo, at, above = todo[go], at[go], above[go]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of ids of each."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        chain: list[list[int]] = [[]] * len(words)
        at = 0
        while at < len(order):  # a group's table has about 2 million cells, or one word
            to = at + max(1, int(2_000_000 // (size[order[at]] + 1)))
            group = order[at:to]
            for i, x in zip(group, self._lockstep([words[i] for i in group], size[group]), strict=True):
                chain[i] = x
            at = to
        counts = np.array([len(x) for x in chain], np.int64)
        flat = np.concatenate(chain) if len(chain) else np.zeros(0, np.int64)
        return self.ids[flat.astype(np.int64)], counts

    def _lockstep(self, words: list[bytes], size: np.ndarray) -> Iterator[np.ndarray]:
        """Paths of words that are sorted from long to short."""
        longest = int(size[0])
        text = np.zeros((longest, len(words)), np.uint8)
        raw = np.frombuffer(b"".join(words), np.uint8)
        row = np.concatenate([np.arange(n) for n in size]) if len(size) else np.zeros(0, np.int64)
        text[row, np.repeat(np.arange(len(words)), size)] = raw
        last = np.full((longest + 1, len(words)), -1, np.int32)
        node = np.zeros(len(words), np.int32)
        for i in range(longest):
            n = int(np.searchsorted(-size, -i))  # words longer than i
            byte = text[i, :n].astype(np.int64)
            at = node[:n].astype(np.int64)
            new = self.goto(at << 8 | byte)
            stuck = np.flatnonzero((new < 0) & (at > 0))
            while len(stuck):
                at[stuck] = self.link[at[stuck]]
                new[stuck] = self.goto(at[stuck] << 8 | byte[stuck])
                stuck = stuck[(new[stuck] < 0) & (at[stuck] > 0)]
            new = np.where(new < 0, self.first[byte], new)
            node[:n] = new
            token = self.ending[new].astype(np.int64)
            todo = np.arange(n)
            while len(todo):
                begin = i + 1 - self.length[token]
                ok = begin == 0
                inner = np.flatnonzero(~ok)
                if len(inner):
                    ok[inner] = self.allowed(last[begin[inner], todo[inner]], token[inner])
                last[i + 1, todo[ok]] = token[ok]
                todo, token = todo[~ok], self.shorter[token[~ok]].astype(np.int64)
        # all words walk back from their ends together; rounds of tokens are then put in order
        at, places = size.copy(), np.arange(len(words))
        rounds, owners = [], []
        while len(places):
            places = places[at[places] > 0]
            token = last[at[places], places]
            rounds.append(token)
            owners.append(places)
            at[places] -= self.length[token]
        who, what = np.concatenate(owners), np.concatenate(rounds)
        turn = np.repeat(np.arange(len(rounds)), [len(x) for x in rounds])
        by = np.lexsort((-turn, who))
        return np.split(what[by], np.cumsum(np.bincount(who, minlength=len(words)))[:-1])


#: Ids that are decoded at once; a longer list is decoded alone.
DECODE_IDS = 1 << 18

_built: dict[bytes, tuple[BatchEncoder, np.ndarray, np.ndarray]] = {}


def _tables(spec: str) -> tuple[BatchEncoder, np.ndarray, np.ndarray]:
    """A worker's encoder and arc labels, built once."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _built:
        vocabulary = Vocabulary(spec)
        off = np.concatenate([[0], np.cumsum([len(x) for x in vocabulary.label])])
        _built.clear()
        _built[key] = BatchEncoder(vocabulary, MergeAutomaton(vocabulary).encode), np.frombuffer(b"".join(vocabulary.label), np.uint8), off
    return _built[key]


def decode_ids(ids: np.ndarray, labels: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all arcs, one after another, and the number of bytes of each."""
    length = (off[1:] - off[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    return labels[np.repeat(off[:-1][ids] - total[:-1], length) + np.arange(total[-1])], length


def bpe_encode(docs: DataFrame, spec: str, text: str = "text", output: str = "ids", packed: bool = False, decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text; a null text has none.

    ``spec`` is the content of a tokenizers file; it is broadcast. The ids are
    an ``array<int>`` or, if packed, little-endian unsigned 32-bit integers in
    a ``binary``. ``decoded`` names a column for the text that the ids spell,
    decoded in the same pass. Columns that have these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    added = [output, decoded] if decoded else [output]
    rest = docs.select(*[c for c in docs.columns if c not in added])
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, labels, label_off = _tables(shared.value)
        for part in T.slices(batches, text):
            ids, off = encoder(part.column(at))
            if packed:
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            else:
                rows = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.view(np.int32)))
            columns = [*part.columns, rows]
            if decoded:
                columns.append(_spelled(ids.astype(np.int64), off, labels, label_off))
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    kind = f"{output} {'binary' if packed else 'array<int>'}"
    return rest.mapInArrow(run, T.with_fields(rest, f"{kind}, {decoded} string" if decoded else kind))


def _spelled(ids: np.ndarray, off: np.ndarray, labels: np.ndarray, label_off: np.ndarray) -> pa.Array:
    """The texts of lists of ids."""
    raw, length = decode_ids(ids, labels, label_off)
    place = np.concatenate([[0], np.cumsum(length)])[off]
    return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(place[:-1], place[1:], strict=True)], pa.string())


def bpe_decode(tokens: DataFrame, spec: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the ids (either form) spell; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(spec)
    rest = tokens.select(*[c for c in tokens.columns if c != output])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, label_off = _tables(shared.value)
        for batch in batches:
            _, rows = _id_lists(batch.column(batch.schema.get_field_index(ids)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(rows, rows[at] + DECODE_IDS, "right")) - 1)
                part, at = batch.slice(at, to - at), to
                flat, off = _id_lists(part.column(part.schema.get_field_index(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, _spelled(flat, off, labels, label_off)], names=[*part.schema.names, output])

    return rest.mapInArrow(run, T.with_fields(rest, f"{output} string"))


def _id_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and n + 1 offsets; null lists count as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.fill_null(b"").cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        return raw.view("<u4").astype(np.int64), (off - off[0]) // 4
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
    off = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[off[0] : off[-1]].astype(np.int64), off - off[0]
