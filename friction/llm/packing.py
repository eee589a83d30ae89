"""Variable-capacity best-fit packing: several sequence lengths are permitted, and each bin ends as the shortest that holds
its contents.

Lengths are tokens: whole documents are encoded once, and those beyond the longest capacity are cut into pieces, none is
dropped. A hash deals the pieces out to cells of bounded size that are packed independently; pieces of bins that stay too
empty meet others in the cells of the next round, until one cell is left or a round closes too few: then every bin closes.
A cell holds about CELL pieces in any round. Only numbers are packed; the tokens, as bytes, wait in the table of pieces and
join their places at the end.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from friction.llm.common import written
from friction.llm.token_counts import VOCABULARY, encoded, vocabulary

CAPACITIES = (256, 512, 1024, 2048)
#: Cost of a bin besides its capacity; pieces in a cell; the part of a bin that must be used for it to close early; the
#: part of the open pieces that a round must close for another to follow.
OVERHEAD, CELL, FULL, CLOSES = 16, 8192, 0.97, 0.1
#: Tokens that a task hands over together, about.
HANDED = 2_000_000


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each length, and capacity and contents of each bin. lengths: descending, none above the largest capacity.

    A length goes where it leaves the least room. If it fits nowhere, the bin that opens is the one of the least cost for
    each token it can expect to hold: this length and what is still to come of lengths that fit beside it."""
    bins, caps, used = np.zeros(len(lengths), np.int64), [], []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    mass = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0])).tolist()  # from each place on
    smaller = (-lengths).tolist()

    def cost(c: int, n: int, i: int) -> tuple[float, int]:
        beside = mass[max(i + 1, bisect_left(smaller, n - c))]
        return (c + overhead) / max(1, min(c, n + beside)), -c

    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: cost(c, n, i))
            b = len(caps)
            caps.append(free)
            used.append(0)
        bins[i] = b
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    small = sorted(capacities)
    caps = [small[bisect_left(small, u)] for u in used]
    return bins, np.array(caps, np.int64), np.array(used, np.int64)


def packer(capacities: tuple[int, ...], overhead: int, last: bool, level: int):
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "pid"], ascending=[False, True], ignore_index=True)
        bins, caps, used = best_fit(pdf["length"].to_numpy(), capacities, overhead)
        pdf["bin_id"] = [f"{level}-{key[0]}-{b}" for b in bins]
        pdf["capacity"], pdf["bin_used"] = caps[bins], used[bins]
        pdf["bin_offset"] = pdf.groupby("bin_id", sort=False)["length"].cumsum() - pdf["length"]
        pdf["closed"] = True if last else (used >= FULL * caps)[bins]
        return pdf[["pid", "length", "bin_id", "capacity", "bin_used", "bin_offset", "closed"]]

    return pack


def id_type(path: str) -> np.dtype:
    """Little-endian integers that hold every id of the vocabulary: two bytes, or four."""
    return np.dtype("<u2" if max(vocabulary(path).values()) < 1 << 16 else "<u4")


def pieces(docs: DataFrame, top: int, path: str, with_tokens: bool) -> DataFrame:
    """pid, doc_id, piece, start, length: the tokens of each row of docs, cut after every `top` of them; with_tokens: and
    token_ids, as bytes of id_type(). pid is unique and stays what it is in the table that is written."""

    def handed(doc_ids, took, piece, length, ids, wide):
        columns = [doc_ids.take(pa.array(took, pa.int64())), pa.array(piece, pa.int64()), pa.array(np.array(piece, np.int64) * top), pa.array(length, pa.int64())]
        names = ["doc_id", "piece", "start", "length"]
        if with_tokens:
            ends = np.concatenate(([0], np.cumsum(length, dtype=np.int64) * wide.itemsize)).astype(np.int32)
            data = np.concatenate(ids).astype(wide)
            columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches):
        wide = id_type(path)
        for batch in batches:
            doc_ids, took, piece, length, ids = batch.column(0), [], [], [], []
            held = 0
            for row, text in enumerate(batch.column(1)):
                got = encoded(text.as_py(), path)
                for at in range(0, max(1, len(got)), top):
                    took.append(row)
                    piece.append(at // top)
                    length.append(min(top, len(got) - at))
                if with_tokens:
                    ids.append(got)
                    held += len(got)
                    if held > HANDED:
                        yield handed(doc_ids, took, piece, length, ids, wide)
                        took, piece, length, ids, held = [], [], [], [], 0
            if took:
                yield handed(doc_ids, took, piece, length, ids, wide)

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece long, start long, length long" + ", token_ids binary" * with_tokens)
    return written(rows.select(F.monotonically_increasing_id().alias("pid"), "*"), "pieces")


def placed(rows: DataFrame, capacities: tuple[int, ...], overhead: int) -> DataFrame:
    """pid, bin_id, capacity, bin_used, bin_offset of each row (pid, length)."""
    kind = "pid long, length long, bin_id string, capacity long, bin_used long, bin_offset long, closed boolean"
    left, level, done, last = rows.count(), 0, [], False
    while True:
        cells = max(1, -(-left // CELL))
        last = last or cells == 1
        dealt = rows.withColumn("cell", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(cells)).cast("long"))
        packed = written(dealt.groupBy("cell").applyInPandas(packer(tuple(capacities), overhead, last, level), kind), "packed")
        done.append(packed.where("closed"))
        if last:
            break
        rows = packed.where("not closed").select("pid", "length")
        before, left, level = left, rows.count(), level + 1
        last = left > (1 - CLOSES) * before
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("pid", "bin_id", "capacity", "bin_used", "bin_offset")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, path: str = VOCABULARY, with_tokens: bool = True) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, bin_used, bin_offset: one row for each piece of each row of docs
    (doc_id, text; others ignored). Lengths and places are in tokens of the vocabulary at `path`. with_tokens: and token_ids,
    the piece itself as bytes, each id an integer of id_type().

    A document is one piece unless it is longer than the largest capacity, of which all its pieces but the last then are;
    the token_ids of its pieces in order decode to its text. Null and empty texts are a piece of length 0. Repeated rows and
    rows without an id are packed each. An empty table gives an empty result."""
    table = pieces(docs, max(capacities), path, with_tokens)
    places = placed(table.select("pid", "length"), capacities, overhead).withColumnRenamed("pid", "of")
    out = table.join(places, F.col("pid") == F.col("of"))
    return out.select("doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_used", "bin_offset", *["token_ids"] * with_tokens)


def sequences(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, path: str = VOCABULARY) -> DataFrame:
    """pack() with the tokens of each piece: what a trainer reads."""
    return pack(docs, capacities, overhead, path, with_tokens=True)
