"""Removal of word passages that a document with a smaller id has too, by suffix automata of reference shards.

The reference is the corpus itself, which has no size bound, so its automata aren't broadcast whole: `shared_windows`
brings the passages that can share a window into shards by content, and each shard's automaton is built in the task that
owns it. Its states carry the smallest document that has their strings. The shard's passages are then streamed through
the automaton: the state after each word gives the longest match that ends there, capped at a window, and with it the
smallest document; maximal runs of such windows are the spans to remove.

Defined cases: a null text has no words; fewer words than a window lose nothing; of equal ids none is smaller; null ids
count as smallest; repeated rows are judged each for itself; an empty table gives an empty result; all columns of the
input are kept, but for one with the name of a result, which gives way; ids that aren't whole numbers are refused. Very long
texts are one batch. Hashes only route; passages and words are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .shared_windows import Shape, beside, shared_windows

#: Words in the grams that anchors are chosen from.
ANCHOR = 5


class Automaton:
    """A suffix automaton of several sequences, with the smallest id for the strings of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def add(self, sequence: list[int], id_: int) -> None:
        last, least = 0, self.least
        for c in sequence:
            last = self.extended(last, c)
            if id_ < least[last]:
                least[last] = id_

    def extended(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self.cloned(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.least.append(1 << 63)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self.cloned(p, c, q)
        return cur

    def cloned(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.least.append(1 << 63)
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def close(self) -> None:
        """Each state's strings also end where those of the states that link to it do."""
        least, link = self.least, self.link
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            p = link[s]
            if p >= 0 and least[s] < least[p]:
                least[p] = least[s]

    def matched(self, sequence: list[int], window: int) -> list[int]:
        """The smallest id for each window of a sequence; 2**63 where no sequence of the automaton has it."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state, n, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            if n >= window:
                while length[link[state]] >= window:
                    state = link[state]
                n = window
            if i >= window - 1:
                out.append(least[state] if n >= window else 1 << 63)
        return out


def smallest_ids(symbols: np.ndarray, bounds: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For each window of each record, the smallest id of a record that has it."""
    _, dense = np.unique(symbols, return_inverse=True)
    words, at, owner = dense.tolist(), bounds.tolist(), ids.tolist()
    automaton = Automaton()
    for i, id_ in enumerate(owner):
        automaton.add(words[at[i] : at[i + 1]], id_)
    automaton.close()
    out: list[int] = []
    for i in range(len(owner)):
        out += automaton.matched(words[at[i] : at[i + 1]], window)
    return np.array(out, np.int64)


def remove_passages(docs: DataFrame, min_words: int = 13, key: str = "doc_id") -> DataFrame:
    """The input's columns with n_words, n_removed, n_spans, kept (binary, words joined by one space) and removed ranges."""
    shape = Shape(min_words, min(ANCHOR, max(1, min_words // 2)), words=True)
    names = {"symbols": "n_words", "removed": "n_removed", "spans": "n_spans", "kept": "kept", "ranges": "ranges"}
    return beside(shared_windows(docs, shape, smallest_ids, key), docs.columns, names)
