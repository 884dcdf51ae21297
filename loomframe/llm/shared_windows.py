"""Windows of symbols that several documents share: the frame of suffix-array and substring de-duplication.

A window is `window` consecutive symbols (bytes or words) of one document. Its anchor is the smallest hash among the
`anchor`-symbol grams inside it, which depends on the window alone, so equal windows have equal anchors wherever they
stand. Neighbouring windows mostly share an anchor and form a run. The plan is one lazy DataFrame of four passes over
batches of documents, which all read one exchange of the texts:

1. census: each batch sends its anchors, packed and pre-aggregated (one entry an anchor), to buckets by anchor;
2. a bucket finds the anchors that two or more documents have, their owner (smallest id) and how many different contexts
   they stand in, and answers the batches that asked;
3. a batch cuts the windows of those anchors out as records and sends each, once for each different content, to the
   bucket where all its equals meet: runs of one owner together; for an anchor in many contexts its runs alone; for one
   in very many its single windows, so that no group of copies and no common passage makes a hot bucket;
4. a bucket drops repeated contents, hands the rest to a matcher, which gives for every window the smallest id among the
   documents that have it, and answers each batch with the ranges that a smaller document has too.

Hashes only route: records travel with their bytes, contents count as equal after a comparison of these, and words become
symbols in the bucket, after the same comparison. No document's links, anchors or ranges reach the driver; work and traffic are linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, Rolling, byte_view, mixed, parallelism, whole_number_key, within, word_bounds, word_hashes

_U = np.uint64
#: Bytes of text in a batch, and symbols in one vectorised step.
BATCH_BYTES, STEP = 4 << 20, 1 << 19
#: Different contexts (counted by batch) from which an anchor's runs go alone, and its windows go alone.
ALONE, SINGLE = 48, 1024
#: Symbols in one call of a matcher, unless one key has more.
MATCHED = 1 << 18
#: Ids of documents without one: the smallest.
NO_ID = -(1 << 63)
FINGERPRINT = _U((1 << 48) - 1)

#: What shared_windows tells of each document.
RESULTS = ("symbols", "removed", "spans", "kept", "ranges")
#: symbols, offsets of records, smallest id of each record, window -> smallest id for each window of each record
Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Shape:
    window: int
    anchor: int
    words: bool


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, each by byte planes, which compress well."""
    head = np.array([len(columns[0]), len(columns), *(c.dtype.num for c in columns)], "<i4").tobytes()
    return head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i8", "i4")}


def unpacked(blob: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(blob, "<i4", 2)
    kinds = [_KINDS[int(x)] for x in np.frombuffer(blob, "<i4", k, 8)]
    out, at = [], 8 + 4 * int(k)
    for t in kinds:
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, int(n) * t.itemsize, at).reshape(t.itemsize, int(n)).T).view(t).reshape(int(n)))
        at += int(n) * t.itemsize
    return out


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(unpacked(b) for b in blobs))]


def steps(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with at most STEP symbols (or one row)."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, "right")) - 1))
        out.append((a, b))
        a = b
    return out


@dataclass
class Batch:
    """The documents of a batch in the order of their ids, as symbols; of words, codes hold hashes, and text the words with
    one blank between them."""

    table: pa.Table
    data: np.ndarray
    byte_offsets: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    text: np.ndarray | None = None
    text_starts: np.ndarray | None = None

    def spans(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in which ranges of symbols stand, and where they begin and how long they are there."""
        if self.starts is None:
            return self.data, start, length
        if self.text is None:
            size = self.ends - self.starts + 1
            self.text_starts = np.cumsum(size) - size
            self.text = gathered(np.append(self.data, np.uint8(0x20)), self.starts, size)
            self.text[self.text_starts + size - 1] = 0x20
        first, last = self.text_starts[start], start + length - 1
        return self.text, first, self.text_starts[last] + (self.ends - self.starts)[last] - first

    @classmethod
    def of(cls, table: pa.Table, shape: Shape) -> Batch:
        table = table.sort_by([("_id", "ascending"), ("_row", "ascending")]).combine_chunks()
        data, offsets = byte_view(table.column("_text").chunk(0)) if table.num_rows else byte_view(pa.array([], pa.binary()))
        ids = table.column("_id").to_numpy()
        if not shape.words:
            return cls(table, data, offsets, ids, data, offsets)
        starts, ends, own = word_bounds(data, offsets)
        codes = np.empty(len(starts), _U)
        for a, b in steps(offsets):
            x, y = own[a], own[b]
            codes[x:y] = word_hashes(data[offsets[a] : offsets[b]], starts[x:y] - offsets[a], ends[x:y] - offsets[a])
        return cls(table, data, offsets, ids, codes, own, starts, ends)

    def rolled(self, a: int, b: int) -> Rolling:
        own = self.codes[self.offsets[a] : self.offsets[b]]
        return Rolling(own if own.dtype == _U else BYTE_CODES[own])


def runs(roll: Rolling, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows and row of each run."""
    width = shape.window - shape.anchor + 1
    many = np.maximum(np.diff(offsets) - shape.window + 1, 0)
    total = int(many.sum())
    if not total:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, reach = roll.every(shape.anchor), 1
    least &= FINGERPRINT
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(many) - many), many)
    least = least[at]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    return least[first], at[first], np.diff(np.append(first, total)), row[first]


def census(batch: Batch, shape: Shape) -> tuple[np.ndarray, ...]:
    """Sorted anchors, smallest id, block in that document, contexts, and whether several ids have it."""
    parts = []
    for a, b in steps(batch.offsets):
        roll = batch.rolled(a, b)
        anchor, start, many, row = runs(roll, batch.offsets[a : b + 1] - batch.offsets[a], shape)
        context = roll.of(start, start + many + (shape.window - 1)) & _U(0xFFFF)
        place = start - (batch.offsets[a : b + 1] - batch.offsets[a])[row]
        parts.append((anchor, context, row + a, place))
    if not parts:
        parts = [(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    anchor, context, row, place = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(anchor, kind="stable")
    key = anchor[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(key))[: len(head)]
    own = batch.ids[row[order]]
    pairs = np.unique(key << _U(16) | context[order]) >> _U(16)
    contexts = np.diff(np.searchsorted(pairs, np.append(key[head], FINGERPRINT + _U(1))))
    block = np.minimum(place[order][head] // (64 if shape.words else 512), 65535).astype("u2")
    return key[head], own[head], block, np.minimum(contexts, 255).astype("u1"), (own[tail - 1] != own[head]).astype("u1")


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return []
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cut)]


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=_U(0)).astype(_U)


def settle(batches: np.ndarray, blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """One census bucket: the answers to its batches, with the anchors that several documents have."""
    parts = [unpacked(b) for b in blobs]
    anchor = np.concatenate([np.cumsum(p[0]) for p in parts])
    asker = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    ids, block, contexts, several = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
    order = np.lexsort((ids, anchor))
    key, own = anchor[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tail = np.append(head[1:], len(key))
    group = np.repeat(np.arange(len(head)), tail - head)
    wanted = (own[tail - 1] != own[head]) | (np.maximum.reduceat(several[order], head) > 0)
    n = np.add.reduceat(contexts[order].astype(np.int64), head)
    tier = np.where(n <= ALONE, 0, np.where(n <= SINGLE, 1, 2)).astype("u1")
    keep = wanted[group]
    source, g = order[keep], group[keep]
    out = []
    for k, x in by_bucket(asker[source]):
        h = g[x]
        out.append((int(batches[k]), packed(deltas(key[head[h]]), own[head[h]], block[order[head[h]]], tier[h])))
    return out


def records(batch: Batch, shape: Shape, answers: list[bytes]) -> tuple[np.ndarray, ...]:
    """Key, content hash, first symbol, length and row of each record."""
    parts = [unpacked(b) for b in answers]
    anchors = np.concatenate([np.cumsum(p[0]) for p in parts])
    order = np.argsort(anchors)
    anchors = anchors[order]
    owner, block, tier = (np.concatenate([p[i] for p in parts])[order] for i in (1, 2, 3))
    found = []
    for a, b in steps(batch.offsets):
        roll = batch.rolled(a, b)
        anchor, start, many, row = runs(roll, batch.offsets[a : b + 1] - batch.offsets[a], shape)
        at = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
        hit = anchors[at] == anchor
        anchor, start, many, row, at = anchor[hit], start[hit], many[hit], row[hit], at[hit]
        if not len(anchor):
            continue
        kind = tier[at]
        key = np.where(kind == 0, mixed(owner[at].view(_U) * _U(Rolling.BASE) + block[at]), mixed(anchor + _U(0)))
        same = (kind[1:] == 0) & (kind[:-1] == 0) & (key[1:] == key[:-1]) & (start[1:] == start[:-1] + many[:-1]) & (row[1:] == row[:-1]) & (anchor[1:] & _U(7) != 0)
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        n = np.add.reduceat(many, head)
        key, start, row, kind = key[head], start[head], row[head], kind[head]
        lone = np.flatnonzero(kind == 2)
        if len(lone):
            count = n[lone]
            begin = np.repeat(start[lone] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            hashes = roll.of(begin, begin + shape.window)
            rest = kind != 2
            key = np.concatenate([key[rest], hashes])
            row = np.concatenate([row[rest], np.repeat(row[lone], count)])
            start = np.concatenate([start[rest], begin])
            n = np.concatenate([n[rest], np.ones(len(begin), n.dtype)])
        length = n + shape.window - 1
        found.append((key, roll.of(start, start + length), start + batch.offsets[a], length, row + a))
    if not found:
        return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def gathered(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return symbols[np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)]


def equal_ranges(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether symbols[a : a + length] and symbols[b : b + length] are the same, range by range."""
    out = np.ones(len(a), bool)
    offsets = np.concatenate([[0], np.cumsum(length)])
    for i, j in steps(offsets):
        differ = gathered(symbols, a[i:j], length[i:j]) != gathered(symbols, b[i:j], length[i:j])
        out[within(offsets[i : j + 1])[differ] + i] = False
    return out


def content_classes(hashes: np.ndarray, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First range of each class of equal ranges, and each range's class. Hashes propose the classes, symbols decide."""
    _, first, which = np.unique(hashes + _U(31) * length.astype(_U), return_index=True, return_inverse=True)
    head = first[which]
    later = np.flatnonzero(head != np.arange(len(head)))
    if (length[later] == length[head[later]]).all() and equal_ranges(symbols, start[later], start[head[later]], length[later]).all():
        return first, which
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(symbols[s : s + n].tobytes(), len(known)) for s, n in zip(start.tolist(), length.tolist())])
    return np.unique(which, return_index=True)[1], which


def parcels(batch: Batch, shape: Shape, answers: list[bytes], buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """For each bucket: contents, their hash and length, and the places where they stand."""
    key, content, start, length, row = records(batch, shape, answers)
    text, begin, size = batch.spans(start, length)
    out = []
    for bucket, x in by_bucket((key % _U(buckets)).astype(np.int64)):
        first, which = content_classes(content[x], text, begin[x], size[x])
        f = x[first]
        places = packed(which.astype("u4"), row[x].astype("u4"), (start[x] - batch.offsets[row[x]]).astype("u4"), batch.ids[row[x]])
        out.append((bucket, gathered(text, begin[f], size[f]).tobytes(), packed(content[f], length[f].astype("u4"), key[f], size[f].astype("u4")), places))
    return out


def settle_records(shape: Shape, matcher: Matcher, batches: np.ndarray, contents: list[bytes], heads: list[bytes], places: list[bytes]) -> list[tuple[int, bytes]]:
    """One bucket of records: for each batch the ranges (row, start, end) of windows that a smaller document has."""
    text = np.concatenate([np.frombuffer(c, np.uint8) for c in contents])
    parts, where = [unpacked(h) for h in heads], [unpacked(p) for p in places]
    content, length, key, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
    length, size = length.astype(np.int64), size.astype(np.int64)
    offsets = np.cumsum(size) - size
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    record = np.concatenate([w[0] + b for w, b in zip(where, base)]).astype(np.int64)
    row, start, ids = (np.concatenate([w[i] for w in where]) for i in (1, 2, 3))
    asker = np.repeat(np.arange(len(where)), [len(w[0]) for w in where])
    first, which = content_classes(content, text, offsets, size)
    by_key = np.argsort(key[first], kind="stable")
    place = np.empty(len(first), np.int64)
    place[by_key] = np.arange(len(first))
    first, one = first[by_key], place[which[record]]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, one, ids)
    # Equal windows have one key, so keys can be matched one after another, a bounded number of symbols at a time.
    ends = np.append(np.flatnonzero(np.diff(key[first])) + 1, len(first))
    reach = np.cumsum(length[first])[ends - 1]
    smallest, a = [], 0
    while a < len(first):
        done = int(reach[np.searchsorted(ends, a, "right") - 1]) if a else 0
        b = int(ends[max(np.searchsorted(reach, done + MATCHED, "right") - 1, np.searchsorted(ends, a, "right"))])
        f = first[a:b]
        own = gathered(text, offsets[f], size[f])
        if shape.words:
            starts, stops, _ = word_bounds(own, np.concatenate([[0], np.cumsum(size[f])]))
            own = content_classes(word_hashes(own, starts, stops), own, starts, stops - starts)[1]
        smallest.append(matcher(own, np.concatenate([[0], np.cumsum(length[f])]), least[a:b], shape.window))
        a = b
    smallest = np.concatenate(smallest)
    windows = length[first] - shape.window + 1
    begin = np.cumsum(windows) - windows
    later = ids > least[one]  # the whole content stands in a smaller document
    rows = [(asker[later], row[later], start[later].astype(np.int64), start[later] + length[first][one[later]])]
    rest = np.flatnonzero(~later)
    if len(rest):
        n = windows[one[rest]]
        at = np.arange(n.sum()) + np.repeat(begin[one[rest]] - (np.cumsum(n) - n), n)
        lower = smallest[at] < np.repeat(ids[rest], n)
        owner = np.repeat(np.arange(len(rest)), n)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = np.concatenate([[False], (owner[1:] == owner[:-1]) & lower[:-1]])
        head = np.flatnonzero(lower & ~same)
        tail = np.flatnonzero(lower & ~np.append(same[1:] & lower[1:], False))
        r = rest[owner[head]]
        rows.append((asker[r], row[r], start[r] + spot[head], start[r] + spot[tail] + shape.window))
    asker, row, start, end = (np.concatenate(x) for x in zip(*rows))
    return [(int(batches[k]), packed(row[x].astype("u4"), start[x].astype("u4"), end[x].astype("u4"))) for k, x in by_bucket(asker)]


def removed(batch: Batch, answers: list[bytes], whole_characters: bool) -> np.ndarray:
    """A flag for each symbol."""
    n = len(batch.codes)
    if not answers:
        return np.zeros(n, bool)
    row, start, end = joined(answers)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, batch.offsets[row] + start, 1)
    np.subtract.at(change, batch.offsets[row] + end, 1)
    gone = np.cumsum(change[:-1]) > 0
    if whole_characters and n:
        head = np.flatnonzero((batch.codes & 0xC0) != 0x80)
        gone = np.repeat(np.minimum.reduceat(gone.astype("u1"), head), np.diff(np.append(head, n))) > 0
    return gone


def shared_windows(docs: DataFrame, shape: Shape, matcher: Matcher, key: str, whole_characters: bool = False) -> DataFrame:
    """`row`, a struct of all columns of `docs`, with `symbols`, `removed`, `spans` (longs), `kept` (binary) and `ranges`, which
    has the removed ranges in symbols."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = 2 * parallelism(spark)
    batches = max(least, -(-size // BATCH_BYTES))
    ids = F.coalesce(whole_number_key(docs, key), F.lit(NO_ID))
    carried = [c for c in docs.columns]
    row = F.xxhash64(*carried)
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    body = docs.select(
        F.pmod(F.xxhash64(ids, F.lit(7)), F.lit(batches)).cast("int").alias("_batch"), ids.alias("_id"), row.alias("_row"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"), *(F.col(c).alias(names[c]) for c in carried if c != "text"),
        F.col("text").isNull().alias("_null"),
    )

    def count(table: pa.Table) -> pa.Table:
        batch = Batch.of(table, shape)
        anchor, own, block, contexts, several = census(batch, shape)
        out = [(b, packed(deltas(anchor[x]), own[x], block[x], contexts[x], several[x])) for b, x in by_bucket((anchor % _U(batches)).astype(np.int64))]
        n = table.column("_batch")[0].as_py()
        return pa.table({"_bucket": pa.array([b for b, _ in out], pa.int32()), "_batch": pa.array([n] * len(out), pa.int32()), "_blob": pa.array([x for _, x in out], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        out = settle(table.column("_batch").to_numpy(), table.column("_blob").to_pylist())
        return pa.table({"_batch": pa.array([b for b, _ in out], pa.int32()), "_blob": pa.array([x for _, x in out], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            n = left.column("_batch")[0].as_py()
            out = [(b, n, *x) for b, *x in parcels(Batch.of(left, shape), shape, right.column("_blob").to_pylist(), batches)]
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("_bucket", pa.int32()), ("_batch", pa.int32()), ("_contents", pa.binary()), ("_heads", pa.binary()), ("_places", pa.binary())))})

    def match(table: pa.Table) -> pa.Table:
        out = settle_records(shape, matcher, table.column("_batch").to_numpy(), *(table.column(c).to_pylist() for c in ("_contents", "_heads", "_places")))
        return pa.table({"_batch": pa.array([b for b, _ in out], pa.int32()), "_blob": pa.array([x for _, x in out], pa.binary())})

    kinds = {c: docs.schema[c].dataType for c in carried}
    fields = [*(T.StructField(names[c], kinds[c]) for c in carried if c != "text"), T.StructField("_null", T.BooleanType()), T.StructField("_text", T.BinaryType())]
    fields += [T.StructField(c, T.LongType()) for c in ("_symbols", "_removed", "_spans")] + [T.StructField("_kept", T.BinaryType()), T.StructField("_ranges", T.ArrayType(T.LongType()))]
    target = T.StructType(fields)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], pa.null()) for f in fields})
        batch = Batch.of(left, shape)
        gone = removed(batch, right.column("_blob").to_pylist() if right.num_rows else [], whole_characters)
        at = batch.offsets
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = total[at[1:]] - total[at[:-1]]
        kept, ranges = [], []
        data = batch.data.tobytes()
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            x, y = int(batch.byte_offsets[i]), int(batch.byte_offsets[i + 1])
            if not lost[i]:
                kept.append(b" ".join(data[x:y].split()) if shape.words else data[x:y])
                ranges.append([])
                continue
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            ranges.append(edge.tolist())
            if shape.words:
                stay = np.flatnonzero(~own) + a
                kept.append(b" ".join([data[s:e] for s, e in zip(batch.starts[stay].tolist(), batch.ends[stay].tolist())]))
            else:
                kept.append(batch.codes[a:b][~own].tobytes())
        out = {f.name: batch.table.column(f.name) for f in fields if f.name in batch.table.column_names}
        out |= {"_symbols": pa.array(np.diff(at)), "_removed": pa.array(lost.astype(np.int64)), "_spans": pa.array([len(r) // 2 for r in ranges], pa.int64())}
        out |= {"_kept": pa.array(kept, pa.binary()), "_ranges": pa.array(ranges, pa.list_(pa.int64()))}
        return pa.table({f.name: out[f.name] for f in fields})

    asked = body.groupBy("_batch").applyInArrow(count, "_bucket int, _batch int, _blob binary")
    answers = asked.groupBy("_bucket").applyInArrow(answer, "_batch int, _blob binary")
    sent = body.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(cut, "_bucket int, _batch int, _contents binary, _heads binary, _places binary")
    ranges = sent.groupBy("_bucket").applyInArrow(match, "_batch int, _blob binary")
    done = body.groupBy("_batch").cogroup(ranges.groupBy("_batch")).applyInArrow(finish, target)
    text = F.when(~F.col("_null"), F.col("_text").cast("string")).alias("text")
    row = F.struct(*(text if c == "text" else F.col(names[c]).alias(c) for c in carried)).alias("row")
    return done.select(row, *(F.col(f"_{c}").alias(c) for c in RESULTS))


def beside(done: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    """The input's columns with the results under the given names; a column of the input with one of these names gives way."""
    taken = {n.lower() for n in names.values()}
    return done.select(*(F.col("row")[c].alias(c) for c in columns if c.lower() not in taken), *(F.col(a).alias(b) for a, b in names.items()))
