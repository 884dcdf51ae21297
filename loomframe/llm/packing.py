"""Best-fit packing by the sum-of-squares rule.

Documents become token ids with an end id, longer ones are cut into pieces of one sequence's length, and each piece goes
to the open sequence (or a new one) for which the sum over residual gaps g of N(g)**2 becomes smallest, where N(g) counts
open sequences with g tokens left. The rule needs lengths alone, so texts and ids never move: a tokenising pass yields one
small row per piece, the rows are dealt out in even groups whose number follows the input, and each group is packed for
itself with vectorised costs. Full pieces are sequences of their own.

Tokenising uses a memory of white-space separated chunks, whose ids depend on nothing around them; it is emptied when it
holds `MEMORY` chunks, so a worker's memory is bounded.

Defined cases: a null text is an empty one and becomes the end id alone; ties between gaps go to the smallest gap; an
empty table gives an empty result; repeated rows are packed each for itself; only the key and the text are read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

SEQUENCE = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker remembers during a task.
MEMORY = 400_000
#: Documents in a packing group, on average: a 24th of all, within these bounds. A group's last open sequences are the only
#: waste that grouping adds (measured: 0.3 % at 3,000).
GROUP = (3_000, 50_000)

#: The vocabulary's own splitting of a lower-cased chunk, for chunks of visible Latin-1 characters.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+").findall
#: Byte-level vocabularies write a byte that isn't a visible Latin-1 character as one from 256 on, in the order of bytes.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTES = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_PLAIN = re.compile("[\x21-\x7e\u00a1-\u00ff]+").fullmatch


class Chunks(dict):
    """Ids of chunks, learnt when first asked for."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN(chunk) and "<|" not in chunk:
            ids, parts = b"", self.parts
            for p in _PARTS(chunk.lower()):
                if (known := parts.get(p)) is None:
                    byte_wise = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
                    known = parts[p] = array("I", [t.id for t in self.merge(byte_wise)]).tobytes()
                ids += known
        else:
            ids = array("I", self.model.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids


@functools.cache
def chunk_memory(path: str | None) -> Chunks:
    """One for each worker process, as the vocabulary takes time to load."""
    return Chunks(path)


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    White space never lies inside a token, so the ids of a text are those of its chunks. A chunk of plain characters is
    split further, as the vocabulary does, so that "The", "the," and "the" share one entry; any other chunk, and one
    with `<|`, which may begin a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str | None = None):
        self.chunks = chunk_memory(path)

    def forget(self) -> None:
        self.chunks.clear()
        self.chunks.parts.clear()

    def of(self, texts: list[str]) -> list[bytes]:
        known = self.chunks
        if len(known) > MEMORY:
            known.clear()
        if len(known.parts) > MEMORY:
            known.parts.clear()
        get = known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


PIECES = "key {kind}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, key: str = "doc_id", sequence: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length and the crc32 of its ids; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(vocabulary), np.array([END_ID], "<u4").tobytes()
        try:
            for batch in batches:
                for part in pieces_of(batch, "text", 2 << 20):
                    row, piece, start, length, crc = [], [], [], [], []
                    for i, ids in enumerate(tokens.of(part.column("text").to_pylist())):
                        ids += end
                        for p, at in enumerate(range(0, len(ids), 4 * sequence)):
                            own = ids[at : at + 4 * sequence]
                            row.append(i)
                            piece.append(p)
                            start.append(at // 4)
                            length.append(len(own) // 4)
                            crc.append(zlib.crc32(own))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                        names=["key", "piece", "start", "length", "ids_crc32"],
                    )
        finally:  # the worker may go on to other work
            tokens.forget()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES.format(kind=kind)).withColumnRenamed("key", key)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item in the given order, and the number of bins."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; count[0] stays 0, a full bin costs nothing
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    cost = np.empty(capacity + 1, np.int64)
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - s changes the sum by 2 * (count[g - s] - count[g] + 1), with no new gap if g = s.
        there = count[s:]
        c = cost[: capacity + 1 - s]
        np.subtract(count[: capacity + 1 - s], there, out=c)
        c += 1
        c *= 2
        c[0] -= 1
        c[there == 0] = 1 << 60
        g = int(c.argmin())
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if fresh < c[g]:
            b, gap = n, capacity
            n += 1
        else:
            gap = g + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, n


def group_count(documents: int) -> int:
    return max(1, round(documents / min(max(documents / 24, GROUP[0]), GROUP[1])))


def pack(pieces: DataFrame, groups: int, key: str = "doc_id", sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset. Longer pieces are placed first, equal lengths in the order of a hash."""
    kind = pieces.schema[key].dataType.simpleString()

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "h", "key", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, _ = sum_of_squares(rows["length"].to_numpy(), sequence)
        out = rows[["key", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = bins * groups + rows["g"].to_numpy()
        out["offset"] = offsets
        return out

    # The content's crc deals out rows of one id, or of none.
    h = F.xxhash64(F.col(key), F.col("piece"), F.col("ids_crc32"))
    dealt = pieces.select(F.col(key).alias("key"), "piece", "start", "length", "ids_crc32", h.alias("h"), F.pmod(h, F.lit(groups)).alias("g"))
    out = dealt.groupBy("g").applyInPandas(place, PIECES.format(kind=kind) + ", sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, key: str = "doc_id", sequence: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """All of it: tokens, pieces, sequences."""
    return pack(token_pieces(docs, key, sequence, vocabulary), group_count(docs.count()), key, sequence)
