import numpy as np
import pyarrow as pa

from sigseg.llm import textops as T


def thue_morse(n, one="a", other="b"):
    """A word and its complement: any polynomial hash modulo a power of two gives both the same value."""
    word = "".join(other if bin(i).count("1") % 2 else one for i in range(n))
    return word, word.translate(str.maketrans(one + other, other + one))


def test_hashes_tell_thue_morse_words_apart():
    for n in (64, 1024, 4096):
        data, off = T.flat(pa.array(thue_morse(n)))
        one, two = T.span_digests(data, off[:-1], off[1:])
        assert one[0] != one[1] and two[0] != two[1]
        assert (T.span_hashes(data, off[:-1], off[1:]) == one).all()


def test_hashes_depend_on_the_bytes_of_the_span_only():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 2, rng.integers(0, 30))) for _ in range(3000)]
    texts += [t[8:16] + t[:8] + t[16:] for t in texts if len(t) > 16] + ["\0", "\0\0", "", "a\0"]
    data, off = T.flat(pa.array(texts))
    one, two = T.span_digests(data, off[:-1], off[1:])
    by_text = {}
    for t, a, b in zip(texts, one.tolist(), two.tolist(), strict=True):
        assert by_text.setdefault(t, (a, b)) == (a, b)
    assert len({a for a, _ in by_text.values()}) == len({b for _, b in by_text.values()}) == len(by_text)


def test_grams_tell_swapped_halves_apart():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 2, dtype=np.uint64)
    seen = {int(T.grams(np.array([b if bin(i).count("1") % 2 else a for i in order], np.uint64), 8)[0]) for order in ([*range(8)], [*range(7, -1, -1)], [4, 5, 6, 7, 0, 1, 2, 3], [0, 3, 1, 2, 5, 6, 4, 7])}
    assert len(seen) >= 2
