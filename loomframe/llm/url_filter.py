"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by vectorised binary search.

A rule is a host and a path prefix with a verdict. Rules are stored in three flat files: the sorted xxhash64 digests of
`host` + `path prefix`, the offsets of the full strings, and the strings with their verdicts. A worker maps the files,
looks up every (host suffix, stored prefix length) of a block of urls with one `searchsorted`, and confirms each digest
found against the stored string, so that a collision never decides. Beyond `MAX_RULES` rules, or with rules in a DataFrame
of more, the array is cut into ranges of digests; the distinct probes of all urls are dealt out by range, each range is
searched by the task that holds its part of the array, and the hits go back to their urls. Nothing is refused.

Defined cases: a null url or one without `://` has an empty host and path and fits no rule; equal rules keep the first
verdict given (the smallest, where rules come as a DataFrame); the longest fitting rule (host and prefix together) wins; other columns of the input, whatever their names,
are neither read nor returned; repeated rows are judged each for itself; long urls are read whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of one digest array, whose files are sent to every executor (about 100 MB); more are cut into ranges.
MAX_RULES = 1_000_000

#: The rules of the query (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def build(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
    """Writes the digest array of (host, path prefix, verdict) rules into `folder` and returns its file."""
    kept: dict[str, str] = {}
    for host, prefix, verdict in rules:
        if not prefix.startswith("/"):
            raise ValueError(f"a path prefix begins with '/': {prefix!r}")
        kept.setdefault(host.lower() + prefix, verdict)
    return write_array(kept, folder)


def write_array(kept: dict[str, str], folder: str) -> str:
    rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in kept.items())
    texts = [f"{k}\t{v}".encode() for _, k, v in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    lengths = np.array(sorted({len(k.partition("/")[2]) + 1 for _, k, _ in rows}), np.int64)
    depth = max((k.partition("/")[0].count(".") + 1 for _, k, _ in rows), default=0)
    file = os.path.join(folder, "rules.digests")
    with open(file, "wb") as out:
        for part in (np.array([len(rows), len(lengths), depth], np.int64), lengths, np.array([d for d, _, _ in rows], np.uint64), offsets):
            out.write(part.tobytes())
        out.write(b"".join(texts))
    return file


class DigestArray:
    """The memory-mapped file of `build`."""

    def __init__(self, file: str):
        self.map = np.memmap(file, np.uint8, "r")
        n, m, self.depth = (int(x) for x in self.map[:24].view(np.int64))
        self.lengths = self.map[24 : 24 + 8 * m].view(np.int64)
        at = 24 + 8 * m
        self.digests = self.map[at : at + 8 * n].view(np.uint64)
        self.offsets = self.map[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.texts = at + 16 * n + 8

    def find(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key, None where it isn't stored."""
        out: list[str | None] = [None] * len(keys)
        if not len(self.digests) or not keys:
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)
        for i in hit:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # equal digests stand together
                key, _, verdict = bytes(self.map[self.texts + self.offsets[j] : self.texts + self.offsets[j + 1]]).decode().rpartition("\t")
                if key == keys[i]:
                    out[i] = verdict
                    break
                j += 1
        return out


def probe_keys(host: str, path: str, lengths: list[int], depth: int) -> list[str]:
    """The rules that could fit a url: each suffix of its host with each prefix of its path that has a stored length."""
    labels = host.split(".") if host else []
    return [".".join(labels[-d:]) + path[:n] for d in range(min(len(labels), depth), 0, -1) for n in lengths if n <= len(path)]


def judge(array: DigestArray, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
    """The longest fitting rule of each url and its verdict."""
    lengths = [int(x) for x in array.lengths]
    probes = [probe_keys(host, path, lengths, array.depth) for host, path in zip(hosts, paths)]
    texts = list(dict.fromkeys(k for own in probes for k in own))
    known = {k: v for k, v in zip(texts, array.find(texts)) if v is not None}
    out: list[tuple[str | None, str | None]] = []
    for own in probes:
        best = max((k for k in own if k in known), key=len, default=None)
        out.append((best, None if best is None else known[best]))
    return out


def split_urls(pages: DataFrame, key: str) -> DataFrame:
    """key, host and path of every row."""
    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    slash = F.instr(F.col("rest"), "/")
    host = F.when(slash > 0, F.expr("substring(rest, 1, instr(rest, '/') - 1)")).otherwise(F.col("rest"))
    path = F.when(slash > 0, F.expr("substring(rest, instr(rest, '/'))")).otherwise(F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(rest, F.lit("")).alias("rest"))
    return rows.select("key", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def judged_by_range(split: DataFrame, rules: DataFrame, parts: int, default: str) -> DataFrame:
    """The verdicts where the digest array is cut into ranges; rules are (rule, verdict), each rule once."""
    prefix = F.length(F.substring_index("rule", "/", 1))
    shape = rules.agg(F.collect_set(F.length("rule") - prefix).alias("lengths"), F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("depth")).first()
    lengths, depth = sorted(shape["lengths"]), shape["depth"] or 0
    width = -(-(1 << 64) // parts)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(dict.fromkeys(probe_keys(h, p, lengths, depth))) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.string()))], names=["host", "path", "own"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [xxhash.xxh64_intdigest(k) // width for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), b.column(1)], names=["part", "rule", "verdict"])

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        keys = asked.column("rule").to_pylist()
        found: list[str | None] = [None] * len(keys)
        if keys and stored.num_rows:
            with tempfile.TemporaryDirectory() as folder:  # the task's own scratch space
                found = DigestArray(write_array(dict(zip(stored.column("rule").to_pylist(), stored.column("verdict").to_pylist())), folder)).find(keys)
        hit = [(k, v) for k, v in zip(keys, found) if v is not None]
        return pa.table({"rule": pa.array([k for k, _ in hit], pa.string()), "verdict": pa.array([v for _, v in hit], pa.string())})

    own = split.select("host", "path").distinct().mapInArrow(probes, "host string, path string, own array<string>").select("host", "path", F.explode("own").alias("rule"))
    ranges = "part int, rule string, verdict string"
    asked = own.select("rule", F.lit(None).cast("string").alias("verdict")).distinct().mapInArrow(ranged, ranges)
    hits = asked.groupBy("part").cogroup(rules.mapInArrow(ranged, ranges).groupBy("part")).applyInArrow(search, "rule string, verdict string")
    best = own.join(hits, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("best"))
    out = split.join(best, ["host", "path"], "left")
    return out.select("key", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, key: str = "page_id", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """key, host, path, rule (host + path prefix, null if none fits) and verdict of every row.

    Up to `max_rules` rules it is one pass without a shuffle. Rules are tuples, or a DataFrame (host, prefix, verdict).
    """
    split = split_urls(pages, key)
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) > max_rules:
            rules = pages.sparkSession.createDataFrame(rules, "host string, prefix string, verdict string")
    if isinstance(rules, DataFrame):
        whole = rules.select(F.concat(F.lower("host"), "prefix").alias("rule"), "verdict").groupBy("rule").agg(F.min("verdict").alias("verdict"))
        n = whole.count()
        if n > max_rules:
            return judged_by_range(split, whole, -(-n // max_rules), default).withColumnRenamed("key", key)
        rules = [(r["rule"].partition("/")[0], "/" + r["rule"].partition("/")[2], r["verdict"]) for r in whole.collect()]  # at most max_rules
    spark: SparkSession = pages.sparkSession
    folder = tempfile.mkdtemp(prefix="loomframe-url-")
    name = f"{os.path.basename(folder)}.digests"
    os.rename(build(rules, folder), os.path.join(folder, name))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addFile(os.path.join(folder, name))  # bounded by MAX_RULES; served again to executors that come later

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            found = judge(array, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())],
                names=["key", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    return split.mapInArrow(probe, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
