"""A suffix automaton over several weighted word sequences, and sliding matches in it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Recognises every run of words that occurs in the added sequences, and knows how
    often it does: a state stands for runs that end at the same places.

    Nothing runs across the end of a sequence. A sequence added with a weight counts as
    that many equal ones.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self._counted = True

    def _copy(self, state: int, before: int, word: Hashable) -> int:
        """Split off the shorter runs of ``state``, those that ``before`` reaches by ``word``."""
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[state].copy())
        self.length.append(self.length[before] + 1)
        link.append(link[state])
        self.count.append(0)
        link[state] = new
        while before != -1 and nxt[before].get(word) == state:
            nxt[before][word] = new
            before = link[before]
        return new

    def add(self, words: Sequence[Hashable], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        self._counted = False
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._copy(known, last, w)
            else:
                new, p = len(nxt), last
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(0)
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self._copy(q, p, w)
                last = new
            count[last] += weight

    def finish(self) -> "SuffixAutomaton":
        """Pass the counts on from longer to shorter runs; to be called before matching."""
        if not self._counted:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
                self.count[self.link[s]] += self.count[s]
            self._counted = True
        return self

    def matches(self, words: Iterable[Hashable], longest: int) -> Iterator[tuple[int, int]]:
        """Per word the length of the longest run that ends there and occurs in the added
        sequences, ``longest`` at most, and how often that run occurs."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        s = n = 0
        for w in words:
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(w)
            if t is None:
                n = 0
                yield 0, 0
                continue
            s, n = t, n + 1
            if n >= longest:
                n = longest
                while length[link[s]] >= n:
                    s = link[s]
            yield n, count[s]
