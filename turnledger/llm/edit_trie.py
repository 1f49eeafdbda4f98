"""Levenshtein automata of many words intersected with a lexicon's trie, with numpy.

The automaton of a word has a state for each position and number of edits. All pairs of an
automaton state and a trie node that some word reaches are moved down the trie together, one
letter a level; pairs that no term below the node can still complete are dropped.
"""

from __future__ import annotations

import numpy as np

#: Words taken through the trie at once.
WORDS_AT_ONCE = 1 << 13
_FAR = 1 << 20


def edits_allowed(length: int) -> int:
    """Short terms must be spelled exactly, middling ones allow one edit, long ones two."""
    return 0 if length <= 3 else 1 if length <= 7 else 2


class EditTrie:
    """A trie of the terms; each allows as many edits as its length does."""

    def __init__(self, terms: list[str]):
        self.terms = list(terms)
        children: list[dict[str, int]] = [{}]
        end = [-1]
        for number, term in enumerate(self.terms):
            node = 0
            for letter in term:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    end.append(-1)
                node = children[node][letter]
            if end[node] < 0:
                end[node] = number
        n = len(children)
        self.end = np.array(end)
        self.allowed = np.array([edits_allowed(len(t)) for t in self.terms], dtype=np.int64)
        self.shortest, self.longest, self.budget = np.full(n, _FAR), np.full(n, -1), np.full(n, -1)
        for node in range(n - 1, -1, -1):  # children have larger numbers than their parent
            if end[node] >= 0:
                self.shortest[node], self.longest[node] = 0, 0
                self.budget[node] = self.allowed[end[node]]
            for child in children[node].values():
                self.shortest[node] = min(self.shortest[node], self.shortest[child] + 1)
                self.longest[node] = max(self.longest[node], self.longest[child] + 1)
                self.budget[node] = max(self.budget[node], self.budget[child])
        self.first = np.cumsum([0] + [len(c) for c in children])
        self.letter = np.array([ord(x) for c in children for x in c], dtype=np.int64)
        self.child = np.array([k for c in children for k in c.values()], dtype=np.int64)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest term of each word, -1 if none is near enough, and its distance.

        Of equally near terms the first of the lexicon is taken.
        """
        term, distance = np.full(len(words), -1), np.zeros(len(words), dtype=np.int64)
        if not self.terms:
            return term, distance
        for first in range(0, len(words), WORDS_AT_ONCE):
            part = slice(first, first + WORDS_AT_ONCE)
            term[part], distance[part] = self._match(words[part])
        return term, distance

    def _match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        able = np.flatnonzero((length >= 1) & (length <= self.longest[0] + 2))
        width = int(length[able].max(initial=0)) + 1
        text = np.zeros((len(words), width), dtype=np.int64)
        flat = np.frombuffer("".join([words[i] for i in able]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text[np.repeat(able, length[able]), np.arange(len(flat)) - np.repeat(
            np.cumsum(length[able]) - length[able], length[able])] = flat
        n_terms = len(self.terms)
        best = np.full(len(words), 3 * n_terms)
        word, node, at, edits = able, np.zeros_like(able), np.zeros_like(able), np.zeros_like(able)
        while len(word):
            word, node, at, edits = self._skipped(word, node, at, edits, length)
            ended = self.end[node]
            done = np.flatnonzero(ended >= 0)
            total = edits[done] + length[word[done]] - at[done]
            near = total <= self.allowed[ended[done]]
            done, total = done[near], total[near]
            np.minimum.at(best, word[done], total * n_terms + ended[done])
            count = self.first[node + 1] - self.first[node]
            again = np.repeat(np.arange(len(word)), count)
            edge = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[node[again]]
            word, at, edits = word[again], at[again], edits[again]
            node, letter = self.child[edge], self.letter[edge]
            same = (at < length[word]) & (text[word, np.minimum(at, width - 1)] == letter)
            other = ~same
            instead = other & (at < length[word])
            word = np.concatenate([word[same], word[instead], word[other]])
            node = np.concatenate([node[same], node[instead], node[other]])
            edits = np.concatenate([edits[same], edits[instead] + 1, edits[other] + 1])
            at = np.concatenate([at[same] + 1, at[instead] + 1, at[other]])
            keep = self._possible(word, node, at, edits, length)
            word, node, at, edits = word[keep], node[keep], at[keep], edits[keep]
        found = best < 3 * n_terms
        return np.where(found, best % n_terms, -1), np.where(found, best // n_terms, 0)

    def _possible(self, word, node, at, edits, length) -> np.ndarray:
        """Pairs that some term below the node can complete within its edits."""
        left = length[word] - at
        lack = np.maximum(np.maximum(left - self.longest[node], self.shortest[node] - left), 0)
        return edits + lack <= self.budget[node]

    def _skipped(self, word, node, at, edits, length):
        """Add the pairs reached by leaving out letters of the word; keep the least edits of each."""
        parts = [(word, node, at, edits)]
        for _ in range(2):
            w, n, a, e = parts[-1]
            more = (a < length[w]) & (e < 2)
            w, n, a, e = w[more], n[more], a[more] + 1, e[more] + 1
            keep = self._possible(w, n, a, e, length)
            parts.append((w[keep], n[keep], a[keep], e[keep]))
        word, node, at, edits = (np.concatenate(c) for c in zip(*parts, strict=True))
        # The nodes of a level are known by number, positions differ from the depth by two at most.
        key = ((word * len(self.end) + node) * (int(length.max(initial=0)) + 2) + at) * 4 + edits
        key = np.sort(key)
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] // 4 != key[:-1] // 4
        key = key[fresh]
        edits, key = key % 4, key // 4
        wide = int(length.max(initial=0)) + 2
        at, key = key % wide, key // wide
        return key // len(self.end), key % len(self.end), at, edits
