"""Suffix-array deduplication: maximal repeat groups from the common-prefix intervals of an enhanced suffix array.

In each shard the suffixes from the anchors are sorted, with the lengths of the common prefixes of neighbours. A stack scan
gives the tree of common-prefix intervals. In each interval the members' left contexts are compared: a member's longest left
extension that another member shares, with the interval's prefix, is a maximal repeat, and it is reported for all its
occurrences, not for neighbours alone.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Kind, clean, report, runs
from .winnow import covered


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # they agree up to low and differ before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]):
    """The common-prefix intervals (begin, end, length) of suffixes whose neighbours have these common prefixes; lcp[i]: of i and i + 1."""
    stack: list[tuple[int, int]] = []  # begin, length
    for i, size in enumerate([*lcp, -1]):
        begin = i
        while stack and stack[-1][1] > size:
            begin, length = stack.pop()
            if length:
                yield begin, i + 1, length
        if size >= 0 and (not stack or stack[-1][1] < size):
            stack.append((begin, size))


def repeat_groups(suffixes: list[bytes], lefts: list[bytes], least: int):
    """Of texts given from a place on and, reversed, before it: (length after, [(text, length before)]) of each group of maximal
    repeats of at least that length through the place. lefts, suffixes: in parallel."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    rank = {t: r for r, t in enumerate(by_left)}
    shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
    lcp = [common_prefix(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]
    for begin, end, length in intervals(lcp):
        ranks = sorted(rank[t] for t in order[begin:end])
        between = [min(shared[a:b]) if b - a < 64 else int(np.min(shared[a:b])) for a, b in zip(ranks, ranks[1:])]
        extension = [max(a, b) for a, b in zip([0, *between], [*between, 0])]
        group = [(by_left[r], e) for r, e in zip(ranks, extension) if e + length >= least]
        if group:
            yield length, group


def _index(rows, kind: Kind) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in rows]
    by_anchor = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for _, group in groupby(by_anchor, key=lambda i: rows[i][0]):
        ids = list(group)
        if len(ids) == 1:
            continue
        found: dict[int, list[tuple[int, int]]] = {}
        for length, members in repeat_groups([rows[i][1][rows[i][2] :] for i in ids], [rows[i][1][: rows[i][2]][::-1] for i in ids], kind.window):
            for t, before in members:
                found.setdefault(ids[t], []).append((rows[ids[t]][2] - before, rows[ids[t]][2] + length))
        for i, spans in found.items():
            begin, end = runs(covered(len(rows[i][1]), *np.array(spans).T))
            out[i] = np.stack([begin, end], axis=1).reshape(-1).tolist()
    return out


def kind(window: int = 200) -> Kind:
    return Kind(words=False, window=window, k=max(1, window // 6), first=False, index=_index)


def deduplicate(docs: DataFrame, window: int = 200) -> DataFrame:
    """A row per document of docs (doc_id, text): n_units (bytes), n_removed, n_spans, kept_sha256 (of the bytes that stay).

    A byte goes if it lies in a string of window bytes that also starts anywhere else, in the same document too. Null texts
    are empty. Repeated rows are other places, so they lose what they share. A row without id is left as it is, but what it
    shares counts as repeated only between others. An empty table gives no rows.
    """
    return report(docs, kind(window))


def cleaned(docs: DataFrame, window: int = 200) -> DataFrame:
    """docs with all columns, without the repeated passages."""
    return clean(docs, kind(window))
