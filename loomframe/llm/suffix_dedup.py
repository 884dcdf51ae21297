"""Removal of byte strings that a document with a smaller id has too, by interval expansion on a Burrows-Wheeler transform.

`shared_windows` brings all texts that can share a window of `min_bytes` bytes into one bucket. There the matcher sorts
the suffixes to the depth of a window, takes the Burrows-Wheeler transform, and begins with the interval of the empty
string. In each round every interval is extended backwards by each byte in front of its suffixes, breadth first; the ends
of a new interval are places where the common prefix of neighbouring suffixes is one shorter than the round, so common
prefixes come out by increasing value. Intervals whose two ends are known already lead to nothing new and are dropped,
and expansion stops at `min_bytes`: suffixes not yet parted share at least that much.

Defined cases: a null text is empty and stays null; a text shorter than a window loses nothing; of equal ids none is
smaller; ids that are null count as smallest; repeated rows and ties are judged each for itself; an empty table gives an
empty result; all columns of the input are kept, but for one with the name of a result, which gives way; ids that aren't
whole numbers are refused. Texts are UTF-8, in which the byte 0xFF, used here inside, doesn't occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .shared_windows import Shape, beside, shared_windows

#: Grams that anchors are chosen from, in bytes, by window length.
ANCHOR = 20


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | wide[j : j + n]
    reach = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if reach >= depth or new.all():
            return order
        key = rank * (n + 1)
        key[: max(n - reach, 0)] += rank[reach:]
        key = key.view(np.uint64)
        reach *= 2


def parted(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the suffix order, whether a string of `depth` bytes without separator (0) begins anew there."""
    n = len(text)
    before = text[order - 1]  # the transform; suffix 0 begins with a separator, and what is in front of it isn't used
    before[order == 0] = 0
    back = np.empty(n, np.int32)  # where a suffix goes when it is extended backwards
    back[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    byte_begins = np.zeros(n + 1, bool)
    byte_begins[np.cumsum(np.bincount(text, minlength=256))] = True
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    left, right = np.array([0], np.int32), np.array([n], np.int32)
    tag = np.zeros(n + 1, np.int32)
    for _ in range(depth):
        single = right - left == 1
        alone = left[single]
        alone = back[alone[before[alone] != 0]]
        l, r = left[~single], right[~single]
        size = (r - l).astype(np.int64)
        total = int(size.sum())
        if total:
            place = np.arange(total) + np.repeat(l - (np.cumsum(size) - size), size)
            which = np.repeat(np.arange(1, len(l) + 1, dtype=np.int32), size)
            use = before[place] != 0
            goal, which = back[place[use]], which[use]
            if total > n >> 3:
                tag[:] = 0
                tag[goal] = which
                head = np.flatnonzero((tag[:n] != 0) & ((tag[:n] != np.concatenate([[0], tag[: n - 1]])) | byte_begins[:n]))
                tail = np.flatnonzero((tag[:n] != 0) & ((tag[:n] != tag[1:]) | byte_begins[1:])) + 1
                nl, nr = head.astype(np.int32), tail.astype(np.int32)
            else:
                o = np.argsort(goal)
                goal, which = goal[o], which[o]
                new = np.concatenate([[True], (goal[1:] != goal[:-1] + 1) | (which[1:] != which[:-1]) | byte_begins[goal[1:]]]) if len(goal) else np.zeros(0, bool)
                head = np.flatnonzero(new)
                nl = goal[head]
                nr = goal[np.append(head[1:], len(goal)) - 1] + 1 if len(head) else goal
            left, right = np.concatenate([alone, nl]), np.concatenate([alone + 1, nr])
        else:
            left, right = alone, alone + 1
        fresh = ~(known[left] & known[right])
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        known[left] = True
        known[right] = True
    return known[:n]


def smallest_ids(symbols: np.ndarray, bounds: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For each window of each record, the smallest id of a record that has it."""
    length = np.diff(bounds)
    records = len(length)
    text = np.zeros(len(symbols) + records + 1, np.uint8)
    shift = np.repeat(np.arange(1, records + 1), length)
    text[np.arange(len(symbols)) + shift] = symbols + np.uint8(1)
    order = sorted_suffixes(text, window)
    many = length - window + 1
    total = int(many.sum())
    row = np.repeat(np.arange(records), many)
    start = np.arange(total) + np.repeat(bounds[:-1] + np.arange(1, records + 1) - (np.cumsum(many) - many), many)
    value = np.full(len(text), np.iinfo(np.int64).max)
    value[start] = ids[row]
    new = parted(text, order, window)
    least = np.minimum.reduceat(value[order], np.flatnonzero(new))
    value[order] = least[np.cumsum(new) - 1]
    return value[start]


def repeats(docs: DataFrame, min_bytes: int = 50, key: str = "doc_id", whole_characters: bool = False) -> DataFrame:
    """`row`, a struct of the input's columns, with symbols (bytes), removed, spans, kept (binary) and ranges of removed bytes.

    With `whole_characters` a character goes only if all of its bytes do, so that what is kept is text again.
    """
    return shared_windows(docs, Shape(min_bytes, min(ANCHOR, max(1, min_bytes // 2)), words=False), smallest_ids, key, whole_characters)


def remove_repeats(docs: DataFrame, min_bytes: int = 50, key: str = "doc_id", whole_characters: bool = False) -> DataFrame:
    """The input's columns with n_bytes, n_removed, n_spans, kept and ranges; see `repeats`."""
    names = {"symbols": "n_bytes", "removed": "n_removed", "spans": "n_spans", "kept": "kept", "ranges": "ranges"}
    return beside(repeats(docs, min_bytes, key, whole_characters), docs.columns, names)
