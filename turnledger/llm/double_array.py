"""Double-array tries over runs of word keys, built and walked with numpy.

A state is a slot: from state ``s`` the symbol ``x`` leads to slot ``base[s] + x`` if
``check`` of that slot is ``s``. A word is a number among the trie's words, written as two
symbols, so that no state has more than 2,048 children and the arrays stay dense.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOL_BITS = 11
SYMBOLS = 1 << SYMBOL_BITS
#: Distinct words a trie can tell apart.
MAX_WORDS = 1 << (2 * SYMBOL_BITS)
ROUNDS = 24


@dataclass
class Trie:
    """``vocabulary`` holds the sorted word keys, ``accept`` the phrase a slot ends, or -1."""

    vocabulary: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    n_phrases: int

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for words that no phrase has."""
        if not len(self.vocabulary):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == keys, at, -1)

    def advance(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """States after one more word; -1 where the trie has no such run."""
        out = np.full(len(state), -1, dtype=np.int64)
        live = np.flatnonzero(code >= 0)
        at, words = state[live], code[live]
        for shift in (SYMBOL_BITS, 0):
            slot = self.base[at] + ((words >> shift) & (SYMBOLS - 1))
            good = self.check[slot] == at
            live, at, words = live[good], slot[good], words[good]
        out[live] = at
        return out

    def count(
        self,
        code: np.ndarray,
        joined: np.ndarray,
        longest: int = 3,
        which: np.ndarray | None = None,
        starts: np.ndarray | None = None,
        times: np.ndarray | None = None,
    ) -> np.ndarray:
        """Occurrences of each phrase; ``joined[i]`` tells whether word i + 1 continues word i.

        ``code`` has the words at all text positions or, with ``which``, distinct words, of which
        ``which`` tells the one at each position: the first step is then taken once a word. The
        states of all text positions advance together, one word a level. With ``starts`` phrases
        begin at these positions only, each of which counts ``times`` as often.
        """
        counts = np.zeros(self.n_phrases, dtype=np.int64)
        state = self.advance(np.zeros(len(code), dtype=np.int64), code)
        if which is not None:
            state = state[which]
        at = np.arange(len(state))
        if starts is not None:
            at, state = starts, state[starts]
        for level in range(1, longest + 1):
            good = np.flatnonzero(state >= 0)
            at, state, times = at[good], state[good], None if times is None else times[good]
            ended = self.accept[state]
            done = ended >= 0
            if done.any():
                # Sums of whole numbers, exact up to 2^53.
                own = np.bincount(ended[done], None if times is None else times[done], self.n_phrases)
                counts += own.astype(np.int64, copy=False)
            if level == longest:
                break
            last = at + level - 1
            good = joined[last]
            at, state, times = at[good], state[good], None if times is None else times[good]
            state = self.advance(state, code[at + level] if which is None else code[which[at + level]])
        return counts


class _Slots:
    """Growing arrays of slots; parents are placed at random bases, larger ones first."""

    def __init__(self, expected: int):
        self.taken = np.zeros(max(2 * expected, 4 * SYMBOLS), dtype=bool)
        self.taken[0] = True
        self.random = np.random.default_rng(1)

    def place(self, parent: np.ndarray, symbol: np.ndarray, n_parents: int) -> np.ndarray:
        """A base for each parent, so that no two children share a slot.

        ``parent`` is sorted. Larger parents win a slot over smaller ones; after a number of
        rounds the arrays grow, so every parent is placed.
        """
        base = np.full(n_parents, -1, dtype=np.int64)
        size = np.bincount(parent, minlength=n_parents)
        order = np.lexsort((parent, -size[parent]))
        parent, symbol = parent[order], symbol[order]
        rounds = 0
        while len(parent):
            if rounds and rounds % ROUNDS == 0:
                self.taken = np.append(self.taken, np.zeros(max(len(self.taken) // 2, 2 * len(parent)), dtype=bool))
            rounds += 1
            proposal = self.random.integers(0, len(self.taken) - SYMBOLS, n_parents)
            slot = proposal[parent] + symbol
            _, first = np.unique(slot, return_index=True)
            bad = np.ones(len(slot), dtype=bool)
            bad[first] = False
            bad |= self.taken[slot]
            refused = np.zeros(n_parents, dtype=bool)
            refused[parent[bad]] = True
            good = ~refused[parent]
            base[parent[good]] = proposal[parent[good]]
            self.taken[slot[good]] = True
            parent, symbol = parent[~good], symbol[~good]
        return base


def build(phrases: np.ndarray, lengths: np.ndarray) -> Trie:
    """A trie of distinct phrases: a row of word keys each, of which the first ``lengths`` count."""
    width = phrases.shape[1] if len(phrases) else 0
    used = np.arange(width)[None, :] < lengths[:, None]
    vocabulary = np.unique(phrases[used]) if len(phrases) else np.zeros(0, dtype=np.uint64)
    if len(vocabulary) > MAX_WORDS:
        raise ValueError("too many distinct words for one trie")
    n = len(phrases)
    node = np.zeros(n, dtype=np.int64)  # the slot each phrase has reached
    slots = _Slots(2 * n)
    edges = []
    ended = np.zeros(n, dtype=np.int64)
    for level in range(width):
        inside = np.flatnonzero(lengths > level)
        code = np.searchsorted(vocabulary, phrases[inside, level])
        for shift in (SYMBOL_BITS, 0):
            symbol = (code >> shift) & (SYMBOLS - 1)
            edge, which = np.unique(node[inside] * SYMBOLS + symbol, return_inverse=True)
            parents, number = np.unique(edge // SYMBOLS, return_inverse=True)
            base = slots.place(number, edge % SYMBOLS, len(parents))
            child = base[number] + edge % SYMBOLS
            edges.append((parents, base, child, parents[number]))
            node[inside] = child[which]
        done = inside[lengths[inside] == level + 1]
        ended[done] = node[done]
    size = len(slots.taken) + SYMBOLS
    base, check, accept = (np.full(size, fill, dtype=np.int32) for fill in (0, -1, -1))
    for parents, own, child, parent in edges:
        base[parents] = own
        check[child] = parent
    accept[ended] = np.arange(n)
    return Trie(vocabulary, base, check, accept, n)
