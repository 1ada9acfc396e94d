"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Pieces are dealt at random to groups of about ``GROUP``; a task packs a group best-fit decreasing and then improves it: from
the emptiest sequence on, a document moves to another underfull sequence, or is exchanged for one or for two smaller
documents of it, whenever that makes the sum of squared fills larger, until no further sequence can be emptied. The
sequences that stay underfull are dealt anew, across groups, and improved once more.

Defined cases: null and empty texts are the end token alone; a longer document is cut into full pieces behind a first,
shorter one; repeated rows and ids are packed as often as they stand; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwise.llm.common import stored, trimmed
from panelwise.llm.subwords import default_path, encoder

CAPACITY, END_ID = 2048, 0
GROUP = 8192
# Sequences with more free tokens than this share of the capacity are improved across groups.
LOOSE = 0.01


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what full pieces leave over."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    kind, path = docs.schema["doc_id"].dataType.simpleString(), path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for doc, raw in enumerate(code.ids(part.column("text").to_pylist())):
                    ids = memoryview(raw + end)
                    rows += [(doc, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                             for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()),
                     *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        trimmed(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: in falling size, to the fullest bin that takes it."""
    out = np.zeros(len(size), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0  # bit r of some: a bin has r free
    for i in np.argsort(-size, kind="stable").tolist():
        n = int(size[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            b, r = bins, capacity
            bins += 1
        out[i] = b
        free[r - n].append(b)
        some |= 1 << (r - n)
    return out


def improve(size: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from a packing: moves and exchanges that raise the sum of squared fills, until no bin empties."""
    where = np.unique(where, return_inverse=True)[1].astype(np.int64)
    while True:
        fill = np.bincount(where, size).astype(np.int64)
        items = np.flatnonzero(fill[where] < capacity)
        if not len(items):
            return where
        s, b = size[items], where[items]
        order = np.lexsort((s, b))
        left, right = order[:-1], order[1:]
        pair = b[left] == b[right]
        left, right, every = left[pair], right[pair], np.arange(len(s))
        emptied = False
        for a in np.unique(b)[np.argsort(fill[np.unique(b)], kind="stable")].tolist():
            moved = True
            while moved and fill[a]:
                moved = False
                for i in np.flatnonzero(b == a)[np.argsort(-s[b == a], kind="stable")].tolist():
                    for taken in ((), (every,), (left, right)):
                        spot = b[taken[0]] if taken else b
                        net = s[i] - sum(s[t] for t in taken)
                        room = capacity - fill[spot]
                        ok = (net > 0) & (net <= room) & (spot != a) & (fill[spot] + net > fill[a])
                        if len(taken) == 2:
                            ok &= b[left] == b[right]
                        if np.any(ok):
                            j = int(np.argmin(np.where(ok, room - net, capacity + 1)))
                            to, gain = int(spot[j]), int(np.broadcast_to(net, room.shape)[j])
                            for t in taken:
                                b[t[j]] = a
                            b[i] = to
                            fill[to] += gain
                            fill[a] -= gain
                            moved = True
                            break
                    if moved:
                        break
            emptied |= not fill[a]
        where[items] = b
        if not emptied:
            return np.unique(where, return_inverse=True)[1]


def placed(rows: pd.DataFrame, where: np.ndarray, group: int) -> pd.DataFrame:
    """Sequence ids that no other group uses, and gapless offsets."""
    out = rows.assign(sequence_id=(np.int64(group) << 32) + where)
    order = out.sort_values(["sequence_id", "length", "row"], ascending=[True, False, True])
    return order.assign(offset=order.groupby("sequence_id")["length"].cumsum() - order["length"])


def pack(cuts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to stored pieces (length at most capacity)."""
    kinds = {f.name: f.dataType.simpleString() for f in cuts.schema}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", row long, `group` long, sequence_id long, offset long"
    rows = cuts.withColumn("row", F.monotonically_increasing_id())
    full = rows.where(F.col("length") >= capacity)
    loose = rows.where(F.col("length") < capacity)

    def dealt(df: DataFrame, by: str, generation: int) -> DataFrame:
        n = max(1, -(-df.count() // group))
        return df.withColumn("group", F.pmod(F.xxhash64(by, F.lit(generation)), F.lit(n)) * 2 + generation)

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["length"].to_numpy(np.int64)
        return placed(rows, improve(size, best_fit(size, capacity), capacity), int(rows["group"].iloc[0]))

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["length"].to_numpy(np.int64)
        return placed(rows.drop(columns=["sequence_id", "offset"]), improve(size, rows["sequence_id"].to_numpy(), capacity),
                      int(rows["group"].iloc[0]))

    packed = stored(dealt(loose, "row", 0).groupBy("group").applyInPandas(first, schema))
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    open_ids = fills.where(F.col("fill") < capacity * (1 - LOOSE)).select("sequence_id")
    shut = packed.join(open_ids, "sequence_id", "left_anti")
    rest = stored(packed.join(open_ids, "sequence_id", "left_semi"))
    merged = dealt(rest, "sequence_id", 1).select(*packed.columns).groupBy("group").applyInPandas(again, schema)
    whole = full.withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    names = [*kinds, "sequence_id", "offset"]
    return shut.select(*names).union(merged.select(*names)).union(whole.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(stored(pieces(docs)))
