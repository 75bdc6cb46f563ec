"""Tries walked with a Levenshtein automaton."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class Trie:
    """A trie of words with payloads, whose search returns every word within a bounded edit distance."""

    __slots__ = ("root", "longest")

    def __init__(self, entries: Iterable[tuple[str, Hashable]] = ()) -> None:
        self.root: dict = {}
        self.longest = 0
        for word, payload in entries:
            self.add(word, payload)

    def add(self, word: str, payload: Hashable) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", set()).add(payload)
        self.longest = max(self.longest, len(word))

    def exact(self, word: str) -> set:
        node = self.root
        for ch in word:
            node = node.get(ch)
            if node is None:
                return set()
        return node.get("", set())

    def within(self, word: str, bound: int) -> Iterator[tuple[Hashable, int]]:
        """(payload, distance) of every entry within `bound` edits of `word`.

        An edit is a letter put in, left out or changed, or two neighbours swapped. The automaton's state is the band
        of the edit matrix's row for the letters read; a branch ends when no state of its row is within the bound.
        """
        if bound <= 0:
            for payload in self.exact(word):
                yield payload, 0
            return
        n = len(word)
        stack = [(self.root, list(range(n + 1)), None, "", 0)]
        while stack:
            node, row, above, last, depth = stack.pop()
            if row[n] <= bound:
                for payload in node.get("", ()):
                    yield payload, row[n]
            for ch, child in node.items():
                if not ch:
                    continue
                lo, hi = max(1, depth + 1 - bound), min(n, depth + 1 + bound)
                new = [bound + 1] * (n + 1)
                new[0] = depth + 1
                least = new[0]
                for j in range(lo, hi + 1):
                    cost = row[j - 1] + (word[j - 1] != ch)
                    if row[j] + 1 < cost:
                        cost = row[j] + 1
                    if new[j - 1] + 1 < cost:
                        cost = new[j - 1] + 1
                    if above is not None and j > 1 and word[j - 1] == last and word[j - 2] == ch and above[j - 2] + 1 < cost:
                        cost = above[j - 2] + 1
                    new[j] = cost
                    if cost < least:
                        least = cost
                if least <= bound:
                    stack.append((child, new, row, ch, depth + 1))


def damerau(a: str, b: str, bound: int) -> int:
    """The edit distance as in Trie.within, or bound + 1 if it is larger."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    for _, d in Trie([(b, 0)]).within(a, bound):
        return d
    return bound + 1
