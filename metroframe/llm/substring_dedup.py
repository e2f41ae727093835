"""Substring deduplication with suffix automata of reference shards.

The reference is cut into shards by anchor, and each shard's texts, in the order of their first occurrence, stream through
the suffix automaton of those before them: matching statistics give, for each word, the longest match that ends there, and
every span that matches over the length threshold is removed, but for its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Kind, clean, report, spans_of_windows


class SuffixAutomaton:
    """Of several word sequences; states are places in parallel lists, 0 is the start."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        next_, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in next_[state]:
                state = link[state]
                size = length[state]
            to = next_[state].get(w)
            if to is not None:
                state, size = to, size + 1
            else:
                size = 0
            out.append(size)
        return out

    def _state(self, length: int, next_: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.next.append(next_)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes]) -> None:
        next_, length = self.next, self.length
        last = 0
        for w in words:
            q = next_[last].get(w)
            if q is not None:  # the sequence so far is known
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(length[last] + 1, {}, 0), last
            while p >= 0 and w not in next_[p]:
                next_[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = next_[p][w]
                self.link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new


def _index(rows, kind: Kind) -> list[list[int]]:
    automaton, out = SuffixAutomaton(), []
    for _, passage, _, _ in rows:
        words = passage.split()
        found = [end - kind.window + 1 for end, size in enumerate(automaton.matches(words)) if size >= kind.window]
        if len(found) < len(words) - kind.window + 1:
            automaton.add(words)
        out.append(spans_of_windows(found, kind.window, len(words)))
    return out


def kind(window: int = 20) -> Kind:
    return Kind(words=True, window=window, k=max(1, 3 * window // 10), first=True, index=_index)


def deduplicate(docs: DataFrame, window: int = 20) -> DataFrame:
    """A row per document of docs (doc_id, text): n_units (words), n_removed, n_spans, kept_sha256 (of the words that stay, joined by one space).

    A word goes if it lies in a window of so many words that also starts earlier, in a document of smaller id or earlier in
    its own. Null texts have no words; empty ones neither. Rows that repeat an id with the same text are one place. A row
    without id has no place in the order: it is left as it is. An empty table gives no rows.
    """
    return report(docs, kind(window))


def cleaned(docs: DataFrame, window: int = 20) -> DataFrame:
    return clean(docs, kind(window))
