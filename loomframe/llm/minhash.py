"""Near-duplicates by min-max hashing.

A document is the set of its distinct shingles, each a hash modulo 2**61 - 1. Under each of `PERMUTATIONS` random linear
permutations both the smallest and the largest value are kept, so that 80 evaluations yield 160 comparable values, each
equal for two sets with probability their similarity. A band joins both values of two permutations; two sets of similarity
0.8 share none of the 40 bands with probability 7e-10.

Rows of one set (128 bits and its size stand for it) form a class, and everything up to the last join works on classes, so
ids may be null or repeat. A band's bucket first yields the pairs with its smallest member, which are confirmed on full sets
and link groups of copies in time linear in their size. Buckets whose members still lie in several components are then
searched, each for itself: the members outside the bucket's largest component are the queries, and in blocks of bounded
size they are compared with all members of other components. A first pass over sketches of one byte a value (two sets of
similarity 0.8 agree in fewer than `SKETCH` of 160 with probability below 1e-8) tells the members that may have a partner,
where a pair is looked at in the first bucket that it shares and in no other; only their full sets go to the second pass, from which one link for each query and component comes out. So every bucket
pair is linked already, or compared; none is dropped or capped, and pairs are never written out.

Defined cases: a null or empty text has no shingles and is linked with nothing; with fewer words than a shingle the whole
sequence is one shingle; null ids count as smallest; repeated rows, and different texts of one id, are judged each for
itself (an id's texts aren't linked by it); ids that aren't whole numbers are refused; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrimeRolling, Rolling, drop_stored, fresh, lowered, mixed, stored, text_batches, whole_number_key, word_bounds, word_hashes
from .components import components

_U = np.uint64
PERMUTATIONS, BANDS = 80, 40
SKETCH = 98
#: Classes, and shingles, in one block of comparisons inside a bucket.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Shingles in one vectorised step.
STEP = 1 << 17
_RANDOM = np.random.default_rng(6)
_FACTOR = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)
_TERM = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = lowered(data)
    starts, ends, own = word_bounds(data, offsets)
    roll = PrimeRolling(word_hashes(data, starts, ends)) if len(starts) else None
    every = roll.every(size) if roll is not None else np.zeros(0, _U)
    out = []
    for a, b in zip(own[:-1].tolist(), own[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(roll.of(np.array([a]), np.array([b])) ^ _U(b - a))
        else:
            out.append(np.zeros(0, _U))
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS) and one-byte sketches (rows x 2 PERMUTATIONS) of sets that aren't empty."""
    rows = len(sets)
    low, high = np.empty((rows, PERMUTATIONS), _U), np.empty((rows, PERMUTATIONS), _U)
    sizes = np.array([len(s) for s in sets], np.int64)
    a = 0
    while a < rows:
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), STEP, "right")))
        values = np.concatenate(sets[a:b])
        at = np.cumsum(sizes[a:b]) - sizes[a:b]
        for j in range(PERMUTATIONS):
            h = values * _FACTOR[j]
            h += _TERM[j]
            low[a:b, j] = np.minimum.reduceat(h, at)
            high[a:b, j] = np.maximum.reduceat(h, at)
        a = b
    low, high = mixed(low), mixed(high)
    k = PERMUTATIONS // BANDS
    keys = np.zeros((rows, BANDS), _U) + np.arange(BANDS, dtype=_U)
    for i in range(k):
        keys = mixed(keys * _U(Rolling.BASE) + low[:, i::k])
        keys = mixed(keys * _U(Rolling.BASE) + high[:, i::k])
    return keys, np.concatenate([low, high], axis=1).astype(np.uint8)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """(id, digest, n, k1, k2, bands, sketch): the set's size, 128 bits that stand for it, its bands and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            sets = shingles(data, offsets, size)
            n, k1, k2 = marks(sets)
            full = np.flatnonzero(n)
            bands: list[list[int] | None] = [None] * len(sets)
            sketch: list[bytes | None] = [None] * len(sets)
            if len(full):
                keys, bytes_ = sketches([sets[i] for i in full.tolist()])
                for i, k, s in zip(full.tolist(), keys.view(np.int64).tolist(), bytes_):
                    bands[i], sketch[i] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("digest"), pa.array(n), pa.array(k1), pa.array(k2), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["id", "digest", "n", "k1", "k2", "bands", "sketch"],
            )

    return rows.mapInArrow(run, "id long, digest long, n long, k1 long, k2 long, bands array<long>, sketch binary")


def marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size of each set and 128 bits that depend on its members alone."""
    n = np.array([len(s) for s in sets], np.int64)
    return n, np.array([int(s.sum()) for s in sets], _U).view(np.int64), np.array([int(mixed(s + _U(1)).sum()) for s in sets], _U).view(np.int64)


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(class, shingles): the sorted hashes as bytes; rows are (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("class"), pa.array([s.tobytes() for s in shingles(data, offsets, size)], pa.binary())], names=["class", "shingles"])

    return rows.mapInArrow(run, "class long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


TASK = ["bucket", "data_block", "query_block"]


def block_tasks(placed: DataFrame) -> DataFrame:
    """Blocks of data and queries of each bucket; placed is (bucket, class, n, label)."""
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("n").alias("all_n"), F.max(F.struct("rows", "label", "n")).alias("home"))
    count = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    home = F.col("home")
    sizes = sizes.filter(F.col("rows") > home["rows"]).select(
        "bucket", home["label"].alias("home"), count(F.col("rows"), F.col("all_n")).alias("data_blocks"),
        count(F.col("rows") - home["rows"], F.col("all_n") - home["n"]).alias("query_blocks"),
    )
    dealt = lambda seed, blocks: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(blocks)).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    one = lambda x: F.array(x)
    # A member is data in its data block for all query blocks, and, outside of the home component, a query the other way round.
    as_data = F.struct(F.lit(False).alias("query"), one(dealt(1, "data_blocks")).alias("data"), every("query_blocks").alias("queries"))
    as_query = F.struct(F.lit(True).alias("query"), every("data_blocks").alias("data"), one(dealt(2, "query_blocks")).alias("queries"))
    roles = F.when(F.col("label") == F.col("home"), F.array(as_data)).otherwise(F.array(as_data, as_query))
    rows = placed.join(sizes, "bucket").select("bucket", "class", "n", "label", F.explode(roles).alias("role"))
    rows = rows.select("bucket", "class", "n", "label", "role.query", F.explode("role.data").alias("data_block"), "role.queries")
    return rows.select("bucket", "class", "n", "label", "query", "data_block", F.explode("queries").alias("query_block"))


class Block:
    """The rows of one task: members of a bucket, some of them queries."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        self.bucket = self.table.column("bucket")[0].as_py()
        query = self.table.column("query").to_numpy(zero_copy_only=False)
        self.data, self.queries = np.flatnonzero(~query), np.flatnonzero(query)
        self.marks = np.frombuffer(b"".join(self.table.column("sketch").to_pylist()), np.uint8).reshape(len(query), -1)
        self.bands = self.table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(query), -1)
        self.label, self.n = self.table.column("label").to_numpy(), self.table.column("n").to_numpy()

    def near(self, q: int, percent: int) -> np.ndarray:
        """The data of other components that may be similar to q, by size and sketch, and share no earlier bucket with it."""
        label, n, data = self.label, self.n, self.data
        found = data[(label[data] != label[q]) & (100 * np.minimum(n[data], n[q]) >= percent * np.maximum(n[data], n[q]))]
        found = found[(self.marks[found] == self.marks[q]).sum(axis=1) >= SKETCH]
        first = (self.bands[found] == self.bands[q]).argmax(axis=1)
        return found[self.bands[q][first] == self.bucket]


def hopeful(tasks: DataFrame, percent: int) -> DataFrame:
    """The rows of tasks (with sketch and bands) that may have a partner in their block."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        use = np.zeros(table.num_rows, bool)
        for q in block.queries.tolist():
            found = block.near(q, percent)
            use[found] = True
            use[q] = len(found) > 0
        return block.table.filter(pa.array(use))

    return tasks.groupBy(*TASK).applyInArrow(run, tasks.schema)


def block_links(tasks: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (label, label) between components; tasks have sketch, bands and shingles."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        label, n = block.label, block.n
        every, dense = np.unique(np.frombuffer(b"".join(block.table.column("shingles").to_pylist()), _U), return_inverse=True)
        at = np.cumsum(n) - n
        held = np.zeros(len(every), bool)
        found: set[tuple[int, int]] = set()
        for q in block.queries.tolist():
            close = block.near(q, percent)
            if not len(close):
                continue
            own = dense[at[q] : at[q] + n[q]]
            held[own] = True
            size = n[close]
            first = np.cumsum(size) - size
            both = np.add.reduceat(held[dense[np.arange(size.sum()) + np.repeat(at[close] - first, size)]].astype(np.int64), first)
            held[own] = False
            good = close[100 * both >= percent * (size + n[q] - both)]
            found.update((min(int(label[q]), x), max(int(label[q]), x)) for x in np.unique(label[good]).tolist())
        pairs = sorted(found)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return tasks.groupBy(*TASK).applyInArrow(run, "a long, b long")


def grouped(docs: DataFrame, size: int, percent: int, key: str) -> DataFrame:
    """(id, digest, n, least, whole) of every row: digest of the text, and the component's smallest row as (id, digest),
    null for rows without shingles."""
    if percent < 80:
        raise ValueError("bands and sketches are laid out for percent >= 80")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(whole_number_key(docs, key).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    signed = stored(signatures(rows, size), "signatures")
    same = ["k1", "k2", "n"]
    # The smallest row stands for a class; a struct with a null id is smaller than any other.
    classes = signed.filter("n > 0").groupBy(*same).agg(F.min(F.struct("id", "digest")).alias("head"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    banded = classes.select("class", "n", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min(F.struct("class", "n")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    members = stored(banded.join(buckets.select("bucket", F.col("first.class").alias("first"), F.col("first.n").alias("first_n")), "bucket"), "members")
    fit = 100 * F.least("n", "first_n") >= percent * F.greatest("n", "first_n")
    pairs = members.filter((F.col("class") != F.col("first")) & fit).select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    wanted = members.select("class").distinct().join(classes.select("class", F.col("head.id").alias("w_id"), F.col("head.digest").alias("w_digest")), "class")
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))).select("class", "text")
    sets = stored(full_sets(texts, size).groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    links = stored(confirmed(pairs, sets, percent), "links")
    labels = components(links).withColumnRenamed("id", "class")
    placed = members.select("bucket", "class", "n").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    placed = stored(placed, "placed")
    able = hopeful(block_tasks(placed).join(classes.select("class", "sketch", "bands"), "class"), percent)
    further = stored(block_links(able.join(sets, "class"), percent).distinct(), "links")
    joined = components(further).select(F.col("id").alias("label"), F.col("label").alias("whole"))
    label = F.coalesce("label", "class")
    named = classes.select("class", *same, "head").join(labels, "class", "left").select(*same, "head", label.alias("label"))
    named = named.join(joined, "label", "left").select(*same, "head", F.coalesce("whole", "label").alias("whole"))
    named = stored(named, "named")
    drop_stored(classes, members, sets, links, labels, placed, further, joined)
    # Stored, so that the join may split a large group: it can't behind an aggregate by the same key.
    least = stored(named.groupBy("whole").agg(F.min("head").alias("least")), "least")
    owner = named.select(*same, "whole").join(least, "whole").select(*same, "least")
    return signed.select("id", "digest", *same).join(owner, same, "left").select("id", "digest", "n", "least")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest id reachable by links) and kept.

    Bands are laid out for a similarity of 0.8; for a `percent` below 80 they would miss links, so that is refused.
    """
    component = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    out = grouped(docs, size, percent, key).withColumn("component", component)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, without all but the smallest of each group: of rows with the smallest id, the
    one whose text has the smallest digest, and of equal rows one. Documents without words all stay."""
    head = F.struct("id", "digest")
    kept = grouped(docs, size, percent, key).filter(F.col("least").isNull() | head.eqNullSafe(F.col("least")))
    rows = kept.groupBy("id", "digest").agg(F.count("*").alias("rows"), F.max(F.col("n") > 0).alias("some"))
    own, digest, again = (fresh(docs.columns, c) for c in ("id", "digest", "again"))
    rows = stored(rows.select(F.col("id").alias(own), F.col("digest").alias(digest), ((F.col("rows") > 1) & F.col("some")).alias(again)), "kept")
    met = F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(digest))
    if not rows.filter(again).limit(1).count():
        return docs.join(rows, met, "left_semi")
    once = docs.join(rows.filter(again), met).dropDuplicates([own, digest]).select(*docs.columns)
    return docs.join(rows.filter(~F.col(again)), met, "left_semi").unionAll(once)
