"""How candidate phrases are dealt to tries, and that tries step once a word."""

import numpy as np

from turnledger.llm import collocations
from turnledger.llm.double_array import build

PHRASES = "w1 long, w2 long, w3 long"


def test_phrases_of_a_first_word_lie_together(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PHRASES_PER_TRIE", 500)
    rows = [(w * 7919, k, None if k % 2 else k + 1) for w in range(300) for k in range(10)]
    # One first word with more phrases than a trie takes.
    rows += [(-1, k, None) for k in range(2000)]
    dealt, n_tries = collocations.dealt_to_tries(spark.createDataFrame(rows, PHRASES))
    found = dealt.collect()
    assert n_tries == 10 and sorted((r["w1"], r["w2"]) for r in found) == sorted((w, k) for w, k, _ in rows)
    sizes = np.bincount([r["trie"] for r in found], minlength=n_tries)
    assert len(sizes) == n_tries and sizes.min() > 250 and sizes.max() < 750
    tries = {}
    for r in found:
        tries.setdefault(r["w1"], set()).add(r["trie"])
    assert max(len(t) for w, t in tries.items() if w != -1) <= 2
    # Those that a border of two tries cuts, and no others, lie in two.
    assert sum(len(t) == 2 for w, t in tries.items() if w != -1) < n_tries + 20
    assert len(tries[-1]) >= 4


def test_no_phrases(spark):
    dealt, n_tries = collocations.dealt_to_tries(spark.createDataFrame([], PHRASES))
    assert n_tries == 0 and dealt.count() == 0


def test_counting_by_distinct_words():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 40, 5000)
    joined = rng.random(5000) < 0.8
    joined[-1] = False
    phrases = [(a, b) for a in range(0, 30, 3) for b in range(30)] + [(a, a + 1, a + 2) for a in range(25)]
    keys = np.array([(*p, 0) if len(p) == 2 else p for p in phrases], dtype=np.uint64)
    trie = build(keys, np.array([len(p) for p in phrases]))
    distinct, which = np.unique(words, return_inverse=True)
    codes = trie.codes(distinct.astype(np.uint64))
    got = trie.count(codes, joined, 3, which)
    assert got.tolist() == trie.count(codes[which], joined).tolist()
    at = [
        i
        for i in range(5000 - 1)
        if joined[i] and (words[i], words[i + 1]) == phrases[31]
    ]
    assert got[31] == len(at) > 0


def test_windows_stand_for_their_positions():
    """A trie counts phrases at the start of a window, as often as the window occurs."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 12, (400, 3))
    long, times = rng.random(400) < 0.5, rng.integers(1, 1000, 400)
    phrases = [(a, b) for a in range(12) for b in range(0, 12, 2)] + [(a, b, 3) for a in range(12) for b in range(12)]
    keys = np.array([(*p, 0) if len(p) == 2 else p for p in phrases], dtype=np.uint64)
    trie = build(keys, np.array([len(p) for p in phrases]))
    distinct, which = np.unique(rows.ravel(), return_inverse=True)
    joined = np.stack([np.ones(400, dtype=bool), long, np.zeros(400, dtype=bool)], axis=1).ravel()
    got = trie.count(trie.codes(distinct.astype(np.uint64)), joined, 3, which, np.arange(400) * 3, times)
    want = [
        sum(int(n) for row, w, n in zip(rows.tolist(), long, times, strict=True) if (len(p) == 2 or w) and tuple(row[: len(p)]) == p)
        for p in phrases
    ]
    assert got.tolist() == want and sum(want[:72]) > 0 and sum(want[72:]) > 0


def test_texts_are_gone_through_as_often_whatever_the_tries(spark, monkeypatch):
    """More candidates make more tries, but no more passes over the texts."""
    data = [("en", "a b c d e f g h. " * 3), ("de", "x y z x y z")]
    docs = spark.createDataFrame(data, "lang string, text string").coalesce(1)
    mapped, found = [], []
    real = type(docs).mapInArrow

    def traced(self, *args, **kwargs):
        mapped.append("body" in self.columns)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", traced)
    monkeypatch.setattr(collocations, "TRIES_PER_PASS", 1)
    for size in (1 << 18, 4):
        monkeypatch.setattr(collocations, "PHRASES_PER_TRIE", size)
        mapped.clear()
        rows = sorted(map(tuple, collocations.mine(docs, 2).collect()))
        found.append((mapped.count(True), rows))
    assert mapped.count(False) > 1
    assert found[0] == found[1] and found[0][0] == 4
