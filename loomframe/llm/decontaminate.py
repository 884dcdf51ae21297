"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: words of lower-cased letters, with runs of numbers, of names (a capital inside a sentence)
and units of measure after a number replaced by one typed placeholder each. Capitals don't mark names where a sentence is
written in them (upper case, title case), nor does their lack prove a word no name, so windows with names also exist in a
literal form, all words folded; two literal forms meet only if one of them stands in such a sentence. Windows of `WINDOW` template tokens of the
benchmark and of the documents are joined by hash. Matches of one document and item on one diagonal form an
alignment, and its slots are checked, so that a question whose numbers or names were exchanged is caught, and a chance
template is not. A name of the item must stand for one name all along the alignment, or else its windows with names don't
count. Numbers and units may fill two roles, so they must be consistent within a window only, or else that window doesn't
count. A window without a slot always counts. A document is contaminated if the windows that count are at least `COVERAGE`
of an item's, or `RUN` on one alignment, however long the item.

A document's windows first pass a bitmap of the benchmark's hashes, whose size is fixed (`BITS`) whatever the benchmark's;
only windows that pass are joined. A window needs `LITERALS` literal tokens. An item that has no such window goes by exact
windows of its typed form, whatever their tokens, whose slots have the same values.

Defined cases: null and empty texts, and items of under `LEAST` words without a usable window, match nothing; items with fewer tokens than a
window are one window; items of one id and different texts count each for itself; repeated documents each yield a row; an
empty benchmark marks nothing; null ids of documents and items are allowed (a null item is listed as "null"); very long
texts are read whole; columns other than the keys and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrimeRolling, byte_view, fresh, mixed, pieces_of, stored, text_batches, within, word_hashes

_U = np.uint64
WINDOW, LITERALS, COVERAGE = 8, 4, 0.3
#: Windows on one alignment that mark a document whatever their share of the item: a quote of 50 tokens.
RUN = 43
#: Words, a run of numbers as one, that an item without a usable window must have.
LEAST = 3
#: Bits of the fixed-size bitmap of benchmark hashes (512 KB).
BITS = 1 << 22
NUMBER, NAME, UNIT = (_U(x) for x in (1, 2, 3))
#: Units of measure, singular and plural, as they stand after a number.
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg ton tons lb lbs pound pounds oz ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh hz khz mhz ghz kb mb gb tb w kw v a j cal kcal".split()

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in UTF-8 (0xC3 0x80-0x9E) to small letters, and sharp s to ss, as upper case has it."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 32
    if len(data) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
        sharp = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] == 0x9F))
        out[sharp] = out[sharp + 1] = 0x73
    return out


def _unit_hashes() -> np.ndarray:
    texts = [u.encode() for u in UNITS]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return np.sort(word_hashes(data, ends - [len(t) for t in texts], ends))


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The typed and the literal form of the texts, each as codes, slot values (hashes of what a placeholder replaced, 0 for
    literals), number of words before each token, offsets by text, and marks: 1 for a name, 2 for one in a sentence that
    has at least as many of them as words in small letters."""
    n = len(data)
    low = _folded(data)
    inside = _WORD[data]
    row = within(offsets)
    edge = np.concatenate([[True], row[1:] != row[:-1]]) if n else np.zeros(0, bool)
    before = np.concatenate([[False], inside[:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.concatenate([~inside[1:] | edge[1:], [True]]) if n else np.zeros(0, bool)
    ends = np.flatnonzero(inside & after) + 1
    if not len(starts):
        nothing = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        return nothing, nothing
    words = word_hashes(low, starts, ends)
    owner = row[starts]
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    number = digits[ends] - digits[starts] == ends - starts
    first = data[starts]
    second = data[np.minimum(starts + 1, n - 1)]
    capital = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    previous = np.concatenate([[0], ends[:-1]])
    opening = np.concatenate([[True], owner[1:] != owner[:-1]]) | (stops[starts] > stops[previous])
    name = capital & ~opening
    small = ~opening & (((first >= 0x61) & (first <= 0x7A)) | ((first == 0xC3) & (second >= 0x9F)))
    sentence = np.cumsum(opening) - 1
    loud = np.bincount(sentence, name) >= np.bincount(sentence, small)
    mark = np.where(name, 1 + loud[sentence], 0)
    units = _unit_hashes()
    is_unit = units[np.minimum(np.searchsorted(units, words), len(units) - 1)] == words
    is_unit &= np.concatenate([[False], number[:-1] & (owner[1:] == owner[:-1])])
    plain = np.where(number, NUMBER, np.where(is_unit, UNIT, words | _U(8)))
    return tuple(_tokens(code, words, owner, mark, len(offsets)) for code in (np.where(name & (plain >= _U(8)), NAME, plain), plain))


def _tokens(code: np.ndarray, words: np.ndarray, owner: np.ndarray, mark: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """Runs of one placeholder joined."""
    slot = code < _U(8)
    joined = np.concatenate([[False], slot[1:] & (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])])
    head = np.flatnonzero(~joined)
    group = np.cumsum(~joined) - 1
    value = np.zeros(len(head), _U)
    np.add.at(value, group, words * (_U(2) * (np.arange(len(words)) - head[group]).astype(_U) + _U(1)))
    value = np.where(slot[head], value & ~_U(3) | code[head], _U(0))  # the lowest bits tell the kind
    return code[head], value, head, np.searchsorted(owner[head], np.arange(rows)), np.where(code[head] >= _U(8), mark[head], 0)


def windows(code: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of `size` tokens with enough literals."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = PrimeRolling(mixed(code + _U(0))).every(size) ^ _U(size)
    literals = np.concatenate([[0], np.cumsum(code >= _U(8))])
    row = within(own)
    good = (row[:n] == row[size - 1 :]) & (literals[size:] - literals[:n] >= min(LITERALS, size))
    at = np.flatnonzero(good)
    return at, h[at]


def exact_windows(form: tuple[np.ndarray, ...], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of `size` tokens, slots by value."""
    code, value, _, own, _ = form
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = PrimeRolling(mixed(np.where(value > 0, value, code))).every(size) ^ _U(size | 16)
    row = within(own)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, h[at]


def marked(mark: np.ndarray, at: np.ndarray, size: np.ndarray | int, least: int) -> np.ndarray:
    """Whether windows hold a token with at least that mark."""
    sums = np.concatenate([[0], np.cumsum(mark >= least)])
    return sums[at + size] > sums[at]


def window_rows(keys: pa.Array, form: tuple[np.ndarray, ...], literal: bool, at: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    _, value, head, own, mark = form
    row = np.searchsorted(own, at, "right") - 1
    ends = np.cumsum(size)
    slots = value[np.arange(int(size.sum())) + np.repeat(at - (ends - size), size)].view(np.int64)
    slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(slots))
    quiet = ~marked(mark, at, size, 2) & literal
    place = head[at] - head[own[row]] if len(at) else at
    cols = [keys.take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(at - own[row]), slots, pa.array(np.full(len(at), literal)), pa.array(quiet), pa.array(place)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "h", "at", "slots", "literal", "quiet", "place"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per contaminated document (key, xxhash64 of its text as row): coverage of the best item, and the items.

    Items are told apart by id and text together, documents by a number that the scan gives them.
    """
    spark = docs.sparkSession
    key_kind = docs.schema[key].dataType.simpleString()

    def item_rows(part: pa.RecordBatch, form: tuple[np.ndarray, ...], literal: bool, at: np.ndarray, h: np.ndarray, size: np.ndarray, exact: bool) -> pa.RecordBatch:
        rows = window_rows(part.column("key"), form, literal, at, h, size)
        return rows.append_column("size", pa.array(size)).append_column("exact", pa.array(np.full(len(at), exact)))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            forms = template(data, offsets)
            usable = np.zeros(part.num_rows, bool)
            for literal, form in enumerate(forms):
                code, _, _, own, mark = form
                sizes = np.diff(own)
                at, h = windows(code, own, WINDOW)
                size = np.full(len(at), WINDOW)
                short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
                for n in np.unique(sizes[short]).tolist():
                    a, g = windows(code, own, n)
                    use = np.isin(a, own[short])
                    at, h, size = np.concatenate([at, a[use]]), np.concatenate([h, g[use]]), np.concatenate([size, np.full(int(use.sum()), n)])
                if literal:
                    use = marked(mark, at, size, 1)
                    at, h, size = at[use], h[use], size[use]
                if not literal:
                    usable[np.searchsorted(own, at, "right") - 1] = True
                yield item_rows(part, form, bool(literal), at, h, size, False)
            own = forms[0][3]
            left = ~usable & (np.diff(forms[1][3]) >= LEAST)
            sizes = np.minimum(np.diff(own), WINDOW)
            for n in np.unique(sizes[left]).tolist():
                at, h = exact_windows(forms[0], n)
                row = np.searchsorted(own, at, "right") - 1
                use = left[row] & (sizes[row] == n)
                size = np.full(int(use.sum()), n)
                yield item_rows(part, forms[0], False, at[use], h[use], size, True)

    text = F.coalesce("text", F.lit(""))
    items = benchmark.select(F.struct(F.xxhash64(F.col(item), text).alias("row"), F.col(item).cast("string").alias("id")).alias("key"), text.alias("text"))
    wanted = items.mapInArrow(of_items, "key struct<row:long,id:string>, h long, at long, slots array<long>, literal boolean, quiet boolean, place long, size long, exact boolean")
    wanted = wanted.withColumnsRenamed({"at": "q", "slots": "item_slots", "literal": "item_literal", "quiet": "item_quiet"})
    wanted = stored(wanted.withColumn("item", F.col("key.row")).withColumn("item_id", F.col("key.id")).drop("key"), "benchmark-windows")
    word = F.shiftright(F.col("h").bitwiseAND(F.lit(BITS - 1)), 6)
    bits = wanted.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).collect()  # at most BITS / 64 rows
    kinds = sorted({(r["exact"], r["size"]) for r in wanted.select("exact", "size").distinct().collect()})  # at most 2 * WINDOW rows
    bitmap = np.zeros(BITS // 64, np.int64)
    for r in bits:
        bitmap[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bitmap)  # a fixed BITS / 8 bytes

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                for literal, form in enumerate(template(*byte_view(part.column("text")))):
                    code, _, _, own, mark = form
                    for whole, n in kinds:
                        if whole and literal:
                            continue
                        at, h = exact_windows(form, n) if whole else windows(code, own, n)
                        low = (h & _U(BITS - 1)).astype(np.int64)
                        hit = (marks[low >> 6] >> (low & 63)) & 1 > 0
                        if literal:
                            hit &= marked(mark, at, n, 1)
                        if hit.any():
                            yield window_rows(part.column("key"), form, bool(literal), at[hit], h[hit], np.full(int(hit.sum()), n)).drop_columns(["place"])

    doc = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("row"), F.monotonically_increasing_id().alias("number"))
    seen = docs.select(doc.alias("key"), text.alias("text")).mapInArrow(of_docs, f"key struct<id:{key_kind},row:long,number:long>, h long, at long, slots array<long>, literal boolean, quiet boolean")
    # A document's windows with one hash, and an item's, meet on one diagonal each; alignments are bounded by items.
    slots = F.transform(F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y")), lambda p, i: F.struct((F.col("q") + i).alias("at"), p["x"].alias("x"), p["y"].alias("y")))
    met = seen.join(wanted.drop("item_id", "exact"), "h").filter(~(F.col("quiet") & F.col("item_quiet"))).withColumn("pairs", F.filter(slots, lambda p: p["x"] != 0))
    diagonal = met.groupBy("key", "item", "literal", "item_literal", (F.col("at") - F.col("q")).alias("diagonal")).agg(
        F.collect_set(F.struct("place", "pairs")).alias("own"), F.min("q").alias("low"), F.max(F.col("q") + F.col("size") - 1).alias("high")
    )

    def is_name(pair: Column) -> Column:
        return pair["x"].bitwiseAND(F.lit(3)) == int(NAME)

    # A slot at an end of the alignment may have run together with a word outside of it, so it proves nothing.
    # An item's name must stand for one name, and a document's too; two numbers may well become equal.
    def agree(pairs: Column, names: bool) -> Column:
        inner = F.filter(pairs, lambda p: (p["at"] > F.col("low")) & (p["at"] < F.col("high")) & (is_name(p) == names))
        pairs = F.array_distinct(F.transform(inner, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
        one = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))) == F.size(pairs)
        return one("x") & one("y") if names else one("x")

    counts = F.filter("own", lambda w: agree(w["pairs"], False) & (F.col("named") | ~F.exists(w["pairs"], is_name)))
    held = diagonal.withColumn("named", agree(F.flatten("own.pairs"), True)).withColumn("places", F.array_distinct(F.transform(counts, lambda w: w["place"])))
    held = held.withColumn("run", F.size("places")).withColumn("place", F.explode("places"))
    # Coverage of the typed form's windows, or of all places at which a window of any form starts.
    typed = F.when(~F.col("item_literal"), F.col("place"))
    whole = wanted.groupBy("item").agg(F.first("item_id").alias("item_id"), F.countDistinct(typed).alias("typed"), F.countDistinct("place").alias("places"))
    found = held.groupBy("key", "item").agg(F.countDistinct(F.when(~F.col("literal"), typed)).alias("held_typed"), F.countDistinct("place").alias("held"), F.max("run").alias("run"))
    share = F.greatest(F.try_divide("held_typed", "typed"), F.col("held") / F.col("places"))
    cover = found.join(whole, "item").withColumn("coverage", share).filter((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN))
    out = cover.groupBy("key").agg(F.max("coverage").alias("coverage"), F.concat_ws(",", F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("null"))))).alias("items"))
    return out.select(F.col("key.id").alias(key), F.col("key.row").alias("row"), F.lit(True).alias("contaminated"), "coverage", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    own, digest = (fresh(docs.columns, c) for c in ("id", "row"))
    found = decontaminate(docs, benchmark, key).select(F.col(key).alias(own), F.col("row").alias(digest))
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(found, F.col(key).eqNullSafe(F.col(own)) & (row == F.col(digest)), "left_anti")
