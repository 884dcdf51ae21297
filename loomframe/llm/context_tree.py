"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions; each decision has a tree of contexts, the 0 to `DEPTH` bytes before it. Every
node holds a Krichevsky-Trofimov estimate, whose probability for a block depends on counts alone, and mixes it half and
half with the product of its children, so that all depths contribute by how well they coded the training text. A text's
probability is the product over its bytes, and an end sign, of the mixed predictions of the trained tree.

The tree of a corpus is far too large for one machine, so it is never in one place. Counts of (context, byte) grams are
pre-aggregated, packed and merged in buckets by the two latest context bytes, at most `MERGED` parcels at a time in as many
rounds as that takes, so that no task holds more than `MERGED` times what is distinct in a bucket; the nodes of depths 0 and 1, at most
256 * 255 + 255, are summed up and given to every task. Blocks of documents ask the buckets for the predictions of the
distinct grams that they contain and get one number back for each. The questions to one bucket are dealt out to as many
copies of it as keep both sides alike in size, so that a frequent context is no hot task either. Word counts of the unigram base are kept and asked for
in the same manner, by hash. What is gathered grows with the corpus; what is broadcast does not.

Defined cases: a null text is empty and scores its end sign; training rows are given by a column; with no training rows
every bit has probability one half; repeated rows count and are scored each for itself; words are told apart by 64-bit
hashes; very long texts lie in one block; ties don't arise; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, lowered, mixed, parallelism, pieces_of, stored, within, word_bounds, word_hashes
from .shared_windows import by_bucket, deltas, packed, steps, unpacked

_U = np.uint64
DEPTH = 6
#: Bytes of text in a block and in a counting step.
BLOCK_BYTES = 8 << 20
#: Bytes in one vectorised step.
STEP = 1 << 20
#: Grams of whole contexts that are worked on at once.
GRAMS = 1 << 17
#: Parcels that one task merges.
MERGED = 32
#: Predictions travel as whole units of 1e-10 of a decimal digit, so that a text of 100,000 bytes errs by 5e-6 at most.
UNIT = 1e-10
#: Stands before and after each text; UTF-8 has no such byte.
EDGE = 0xFF
END_WORD = mixed(np.array([0x656E64], _U))[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams, latest context byte first and the coded byte last, and offsets by text."""
    n = len(offsets) - 1
    wide = np.full(len(data) + (DEPTH + 1) * n + DEPTH, EDGE, np.uint8)
    size = np.diff(offsets) + 1
    coded = np.ones(len(wide), bool)  # all but the places that only stand before a text
    head = offsets[:-1] + np.arange(n) * (DEPTH + 1)
    coded[(head[:, None] + np.arange(DEPTH)).ravel()] = False
    coded[len(data) + (DEPTH + 1) * n :] = False
    inside = coded.copy()
    inside[head + DEPTH + size - 1] = False
    wide[inside] = data
    out, at = np.empty(int(size.sum()), _U), 0
    for a in range(DEPTH, len(wide), STEP):
        b = min(a + STEP, len(wide))
        code = wide[a:b].astype(_U)
        for d in range(1, DEPTH + 1):
            code |= wide[a - d : b - d].astype(_U) << _U(8 * (DEPTH + 1 - d))
        code = code[coded[a:b]]
        out[at : at + len(code)] = code
        at += len(code)
    return out, np.concatenate([[0], np.cumsum(size)])


def heads(s: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; sorts its argument."""
    keys.sort()
    head = heads(keys)
    return keys[head], np.diff(np.append(head, len(keys)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the end of each text, and offsets by text."""
    low = lowered(data)
    starts, ends, own = word_bounds(low, offsets)
    hashes = word_hashes(low, starts, ends) >> _U(1)
    return np.insert(hashes, own[1:], END_WORD >> _U(1)), own + np.arange(len(own))


def gram_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed((code >> _U(8 * (DEPTH - 1))) + _U(0)) % _U(buckets)).astype(np.int64)


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % _U(buckets)).astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(count[order], head) if len(head) else count


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up, for x >= 0.5."""
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(x + i)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimate gives a block with these counts."""
    return looked_up(_HALF, zeros, 0.5) + looked_up(_HALF, ones, 0.5) - 1.1447298858494002 - looked_up(_WHOLE, zeros + ones, 1.0)


_HALF, _WHOLE = (log_gamma(np.arange(1 << 14) + x) for x in (0.5, 1.0))


def looked_up(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    """log gamma of n + shift for whole n, from a table of the small ones."""
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(table))
    out[large] = log_gamma(n[large] + shift)
    return out


class Level:
    """The nodes of one depth for one bit: counts, evidence, and how to reach them from grams."""

    def __init__(self, order: np.ndarray, grams: np.ndarray, count: np.ndarray, bit: int):
        # In the order of (context, byte) the nodes of every bit stand in order.
        sym = grams & _U(255)
        node = (grams >> _U(8)) << _U(bit) | sym >> _U(8 - bit)
        head = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        self.node = node[first]
        self.of = np.empty(len(node), np.int32)
        self.of[order] = np.cumsum(head, dtype=np.int32) - 1
        total = np.add.reduceat(count, first) if len(first) else count
        self.ones = np.add.reduceat(count * ((sym >> _U(7 - bit)) & _U(1)), first) if len(first) else count
        self.zeros = total - self.ones
        self.estimate = log_kt(self.zeros, self.ones)
        self.weighted = self.estimate
        self.share = np.ones(len(self.node))

    def mix(self, below: Level) -> None:
        """Weighs the estimate against the product of the nodes one byte deeper."""
        up = np.zeros(len(below.node), np.int64)
        up[below.of] = self.of
        self.settle(np.bincount(up, below.weighted, len(self.node)))

    def settle(self, children: np.ndarray) -> None:
        self.weighted = np.logaddexp(self.estimate, children) - np.log(2)
        self.share = 1 / (1 + np.exp(np.clip(children - self.estimate, -700, 700)))

    def one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def shortened(key: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For depths 2 to DEPTH an order of the grams by that much context and the byte; the grams so cut and their counts, in
    that order."""
    out = []
    for depth in range(2, DEPTH + 1):
        cut = (key >> _U(8 * (DEPTH - depth + 1))) << _U(8) | key & _U(255)
        order = np.argsort(cut)
        out.append((order, cut[order], count[order]))
    return out


def levels(cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bit: int) -> list[Level]:
    """Depths 2 to DEPTH, mixed from below."""
    own = [Level(*cut, bit) for cut in cuts]
    for i in range(len(own) - 2, -1, -1):
        own[i].mix(own[i + 1])
    return own


def by_context(key: np.ndarray) -> list[slice]:
    """Ranges of sorted grams that hold whole contexts of two bytes, at most GRAMS of them unless one context has more."""
    edges = np.append(heads(key >> _U(8 * (DEPTH - 1))), len(key))
    out, a = [], 0
    while a < len(key):
        b = int(edges[max(np.searchsorted(edges, a + GRAMS, "right") - 1, np.searchsorted(edges, a, "right"))])
        out.append(np.s_[a:b])
        a = b
    return out


def top_parts(key: np.ndarray, count: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """What a bucket adds to the nodes of depth 1: (byte, node, evidence of children, zeros, ones)."""
    return [row for x in by_context(key) for row in top_parts_of(key[x], count[x])]


def top_parts_of(key: np.ndarray, count: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    out, cuts = [], shortened(key, count)
    for bit in range(8):
        two = levels(cuts, bit)[0]
        up = two.node >> _U(8 + bit) << _U(bit) | two.node & _U((1 << bit) - 1)
        node, of = np.unique(up, return_inverse=True)
        sums = [np.bincount(of, x, len(node)).tolist() for x in (two.weighted, two.zeros, two.ones)]
        out += [(int(v) >> bit, (1 << bit) + (int(v) & ((1 << bit) - 1)), *x) for v, *x in zip(node.tolist(), *sums)]
    return out


def top_tables(parts: list[tuple[int, int, float, float, float]]) -> np.ndarray:
    """(2, 2, 256, 256): for depths 1 and 0 the estimate's share and its chance of a one, by byte and node."""
    table = np.full((2, 2, 256, 256), 0.5)
    if not parts:
        return table
    byte, node = (np.array([p[i] for p in parts]) for i in (0, 1))
    evidence, zeros, ones = (np.array([p[i] for p in parts], np.float64) for i in (2, 3, 4))

    def fill(depth: int, byte: np.ndarray | int, node: np.ndarray, evidence: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        estimate = log_kt(zeros, ones)
        table[depth, 0, byte, node] = 1 / (1 + np.exp(np.clip(evidence - estimate, -700, 700)))
        table[depth, 1, byte, node] = (ones + 0.5) / (zeros + ones + 1)
        return np.logaddexp(estimate, evidence) - np.log(2)

    weighted = fill(1, byte, node, evidence, zeros, ones)
    every = np.unique(node)
    at = np.searchsorted(every, node)
    fill(0, 0, every, *(np.bincount(at, x, len(every)) for x in (weighted, zeros, ones)))
    return table


def predictions(key: np.ndarray, count: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte after its context; grams are sorted."""
    return np.concatenate([np.zeros(0), *(predictions_of(key[x], count[x], top) for x in by_context(key))])


def predictions_of(key: np.ndarray, count: np.ndarray, top: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key))
    latest = (key >> _U(8 * DEPTH)).astype(np.int64)
    sym = (key & _U(255)).astype(np.int64)
    cuts = shortened(key, count)
    for bit in range(8):
        p = np.full(len(key), 0.5)
        for level in reversed(levels(cuts, bit)):
            one, share = level.one()[level.of], level.share[level.of]
            p = share * one + (1 - share) * p
        node = (1 << bit) + (sym >> (8 - bit))
        p = top[1, 0, latest, node] * top[1, 1, latest, node] + (1 - top[1, 0, latest, node]) * p
        p = top[0, 0, 0, node] * top[0, 1, 0, node] + (1 - top[0, 0, 0, node]) * p
        out += np.log10(np.where((sym >> (7 - bit)) & 1, p, 1 - p))
    return out


MODEL = "bucket int, blob binary, tokens long, kinds long"


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score, n_coded (bytes and end) and bits_per_byte of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(2 * parallelism(spark), -(-size // BLOCK_BYTES))
    buckets = max(64, parallelism(spark), blocks // 4)
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", BLOCK_BYTES):
                out = []
                for source, make, deal in ((0, grams, gram_bucket), (1, words, word_bucket)):
                    keys, n = tallied(make(*byte_view(part.column("text")))[0])
                    out += [(b if source == 0 else buckets + b, packed(deltas(keys[x]), n[x].astype("u4"))) for b, x in by_bucket(deal(keys, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpacked(b) for b in table.column("blob").to_pylist()]
        keys, n = merged([np.cumsum(p[0]) for p in parts], [p[1].astype(np.int64) for p in parts])
        return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "blob": pa.array([packed(deltas(keys), n)], pa.binary()), "tokens": [int(n.sum())], "kinds": [len(n)]})

    trained = docs.filter(train).select(text.alias("text")).mapInArrow(count, "bucket int, blob binary")
    parcels = max(blocks, 0)
    while parcels > MERGED:
        parcels = -(-parcels // MERGED)
        share = F.pmod(F.xxhash64("blob"), F.lit(parcels))
        trained = trained.groupBy("bucket", share).applyInArrow(merge, MODEL).select("bucket", "blob")
    model = stored(trained.groupBy("bucket").applyInArrow(merge, MODEL), "context-tree")
    sums = model.filter(F.col("bucket") >= buckets).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_train, v_train = int(sums["n"]), int(sums["v"])
    # A question takes a block's distinct grams, fewer than its bytes; copies of the tree together take no more than all questions.
    known = model.filter(F.col("bucket") < buckets).agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("n")).first()["n"]
    copies = max(1, min(blocks // MERGED, size // (4 * known + 1)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                d, n = unpacked(blob)
                rows = top_parts(np.cumsum(d), n.astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=["byte", "node", "evidence", "zeros", "ones"])

    parts = model.filter(F.col("bucket") < buckets).select("blob").repartition(parallelism(spark)).mapInArrow(tops, "byte int, node int, evidence double, zeros double, ones double")
    summed = parts.groupBy("byte", "node").agg(*(F.sum(c).alias(c) for c in ("evidence", "zeros", "ones")))
    top = top_tables([tuple(r) for r in summed.orderBy("byte", "node").collect()])  # at most 256 * 255 rows

    body = docs.select(F.pmod(F.xxhash64(F.col(key), F.xxhash64("text")), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), text.alias("text"))

    def block_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        data = table.column("text").combine_chunks()
        return byte_view(data.chunk(0) if isinstance(data, pa.ChunkedArray) else data)

    def ask(table: pa.Table) -> pa.Table:
        seen = block_keys(table)
        out = []
        for source, make, deal in ((0, grams, gram_bucket), (1, words, word_bucket)):
            keys = tallied(make(*seen)[0])[0]
            out += [(buckets * source + b, packed(deltas(keys[x]))) for b, x in by_bucket(deal(keys, buckets))]
        n = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "block": pa.array([n] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        bucket = left.column("bucket")[0].as_py()
        asked = [np.cumsum(unpacked(b)[0]) for b in left.column("blob").to_pylist()]
        known = [unpacked(b) for b in right.column("blob").to_pylist()]
        known = [(np.cumsum(k), n.astype(np.int64)) for k, n in known]
        keys = tallied(np.concatenate([k for k, _ in known] + asked))[0]
        n = np.zeros(len(keys), np.int64)
        for k, own in known:
            n[np.searchsorted(keys, k)] += own
        told = predictions(keys, n.astype(np.float64), top).astype(np.float64) if bucket < buckets else n
        told = np.rint(-told / UNIT).astype("u8") if bucket < buckets else told.astype("u4" if n_train < 1 << 32 else "u8")
        return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "blob": pa.array([packed(told[np.searchsorted(keys, a)]) for a in asked], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["key", "n_tokens", "n_known", "base_score", "score", "n_coded"]
        if not left.num_rows:
            return pa.table({n: pa.array([], pa.null()) for n in names})
        told = {b: unpacked(x)[0] for b, x in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist())}
        data, offsets = block_keys(left)
        parts: dict[str, list[np.ndarray]] = {n: [] for n in names[1:]}
        for source, make, deal in ((0, grams, gram_bucket), (1, words, word_bucket)):
            keys = tallied(make(data, offsets)[0])[0]
            value = np.zeros(len(keys))
            for b, x in by_bucket(deal(keys, buckets)):
                value[x] = told[buckets * source + b]
            # Texts are looked up a few at a time, so that a block's grams are in memory once.
            for a, b in steps(offsets):
                codes, at = make(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.argsort(codes)
                own = codes[order]
                head = heads(own)
                every = np.empty(len(codes))
                every[order] = np.repeat(value[np.searchsorted(keys, own[head])], np.diff(np.append(head, len(own))))
                row = at[:-1]
                if source:
                    base = np.log10((every + 0.5) / (n_train + 0.5 * (v_train + 1)))
                    got = {"n_tokens": np.diff(at), "n_known": np.add.reduceat((every > 0).astype(np.int64), row), "base_score": np.add.reduceat(base, row)}
                else:
                    got = {"score": np.add.reduceat(every, row) * -UNIT, "n_coded": np.diff(at)}
                for n, x in got.items():
                    parts[n].append(x)
        out = {n: np.concatenate(x) for n, x in parts.items()}
        return pa.table({"key": left.column("key"), **{n: pa.array(out[n]) for n in names[1:]}})

    asked = body.groupBy("block").applyInArrow(ask, "bucket int, block int, blob binary")
    asked = asked.withColumn("copy", F.pmod(F.col("block"), F.lit(copies)))
    copied = model.select("bucket", "blob", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    replies = asked.groupBy("bucket", "copy").cogroup(copied.groupBy("bucket", "copy")).applyInArrow(answer, "block int, bucket int, blob binary")
    out = body.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, f"key {kind}, n_tokens long, n_known long, base_score double, score double, n_coded long")
    bits = -F.col("score") / F.lit(np.log10(2)) / F.col("n_coded")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_coded", bits.alias("bits_per_byte"))
