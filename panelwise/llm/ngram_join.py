"""Similarity join on word shingles: rare-first prefix filtering with length, positional and suffix filters.

Sets J(x, y) >= num/den. Shingles are ordered by rarity, taken from a count sketch of all documents of a fixed size, ties
by hash; any two sets that are similar enough share a shingle among the rarest n - ceil(n num/den) + 1 of each. Texts with
equal sets are one class, and only classes are joined. Classes that share a prefix shingle are candidates if their sizes
fit, if enough shingles are left behind the shared place, and if the counts of their shingles by hash range allow the
overlap; each candidate pair is verified once on the texts themselves.

Components need not see every pair: short lists give their pairs, and long ones, as many near copies make, are groups in
which ``copies`` finds links from the members' differences against what most of the group holds, so that work grows with the
members and not with their pairs, and leaves no link between components unseen.

Defined cases: null, empty and wordless texts have no shingles and no links and are their own component; rows with one id
and one text are one row, with one id and several texts one row each; rows without doc_id are left out; ties go to the
smallest id; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.llm import copies
from panelwise.llm.common import broadcast_checked, condensed, stored, text_key, trimmed
from panelwise.llm.components import components
from panelwise.llm.shingles import shingle_sets

WORDS, NUM, DEN = 4, 85, 100
# The sketch has 2 ** 22 counters, in chunks that are added up apart.
SKETCH_BITS, CHUNKS, SALTS = 22, 64, 16
# Hash ranges by which shingles are counted for the suffix filter.
RANGES = 64
# Sets that a task keeps while it verifies pairs.
KEPT_SETS = 512
# Texts that a task holds as Python objects at a time.
SLICE = 500


def _sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    texts = pc.cast(batch.column(column), pa.binary())
    for at in range(0, len(texts), SLICE):
        yield from shingle_sets(texts.slice(at, SLICE).to_pylist(), k)


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, text_key, n, cls (hash of its set), ranges (counts by hash range); per task: chunks of a sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        ids = None
        for batch in batches:
            ids = batch.column("doc_id")
            n, cls, ranges = [], [], []
            for s in _sets(batch, "text", k):
                n.append(len(s))
                cls.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                ranges.append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES).astype("<u4").tobytes())
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("text_key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(ranges, pa.binary()),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if ids is not None:
            parts = np.split(sketch, CHUNKS)
            task = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(CHUNKS, ids.type), *[pa.nulls(CHUNKS, pa.int64())] * 3,
                 pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()),
                 pa.array([task] * CHUNKS, pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names)

    names = ["doc_id", "text_key", "n", "cls", "ranges", "chunk", "salt", "counts"]
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(
        trimmed(run), f"doc_id {kind}, text_key bigint, n bigint, cls bigint, ranges binary, chunk int, salt int, counts binary")


def rarity(profiles: DataFrame) -> np.ndarray:
    """The added-up sketch: as many counters as SKETCH_BITS says, whatever the number of documents."""
    def add(table: pa.Table) -> pa.Table:
        out = sum(map(unpacked, table.column("counts").to_pylist()))
        return table.slice(0, 1).set_column(table.schema.get_field_index("counts"), "counts", pa.array([packed(out)], pa.binary()))

    rows = profiles.where("chunk IS NOT NULL").select("chunk", "salt", "counts")
    schema = "chunk int, salt int, counts binary"
    parts = rows.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(sketch) // CHUNKS
    for r in parts.collect():
        sketch[r["chunk"] * width:(r["chunk"] + 1) * width] = unpacked(r["counts"])
    return sketch


def prefixes(docs: DataFrame, sketch: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(shingle, cls, n, pos): the rarest shingles of each class. A task emits a class once."""
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, (1 << 32) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out = []
            for s in _sets(batch, "text", k):
                n = len(s)
                cls = int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                if n and cls not in seen:
                    seen.add(cls)
                    length = n - -(-num * n // den) + 1
                    order = np.lexsort((s, counts.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:length]
                    out.append((s[order].view(np.int64), np.full(length, cls), np.full(length, n), np.arange(length)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                for a in range(0, len(cols[0]), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[a:a + 100_000], t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                        ["shingle", "cls", "n", "pos"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(trimmed(run), "shingle bigint, cls bigint, n int, pos int")


def lists(prefix: DataFrame) -> DataFrame:
    """Postings of the prefix shingles that two classes at least share, each class once, with the list's members."""
    once = prefix.groupBy("shingle", "cls").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    members = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    return once.withColumn("members", members).where("members > 1")


def may_reach(num: int, den: int) -> Callable[[Column, Column], Column]:
    """Length and positional filter on two postings x and y of one shingle, with fields n and pos."""
    def fits(x: Column, y: Column) -> Column:
        sizes = den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"])
        return sizes & (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) * (num + den) >= num * (x["n"] + y["n"]))

    return fits


def candidates(postings: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of short lists, groups (g, cls) of long ones)."""
    short = postings.where(F.col("members") <= copies.FEW).groupBy("shingle").agg(F.collect_list(F.struct("cls", "n", "pos")).alias("m"))
    long = postings.where(F.col("members") > copies.FEW)
    return copies.few_pairs(short, may_reach(num, den)), copies.merged(stored(long.select(F.col("shingle").alias("l"), "cls")))


def overlap_possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Suffix filter: shingles are counted by hash range, and two sets share at most the smaller count of each range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, RANGES).astype(np.int64)
                    for c in ("ra", "rb"))
            most = np.minimum(x, y).sum(axis=1)
            keep = most * (num + den) >= num * (x.sum(axis=1) + y.sum(axis=1))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    one = classes.select(F.col("cls").alias("a"), F.col("ranges").alias("ra"))
    two = classes.select(F.col("cls").alias("b"), F.col("ranges").alias("rb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb").mapInArrow(trimmed(run), "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(batch: pa.RecordBatch, key: str, text: str) -> list[np.ndarray]:
            keys = batch.column(key).to_pylist()
            new = {c: i for i, c in enumerate(keys) if c not in kept}
            found = dict(zip(new, _sets(batch.take(pa.array(list(new.values()), pa.int64())), text, k)))
            out = [kept[c] if c in kept else found[c] for c in keys]
            kept.update(found)
            while len(kept) > KEPT_SETS:
                kept.popitem(last=False)
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                link = []
                for x, y in zip(sets(batch, "a", "ta"), sets(batch, "b", "tb")):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    link.append(both * (num + den) >= num * (len(x) + len(y)))
                yield batch.filter(pa.array(link, pa.bool_())).select(["a", "b"])

    one, two = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a bigint, b bigint")


def class_texts(docs: DataFrame, classes: DataFrame, postings: DataFrame) -> DataFrame:
    """(cls, text): one text of each class that shares a prefix shingle with another."""
    wanted = stored(postings.select("cls").distinct().join(classes, "cls").select("cls", "rep.doc_id", "rep.text_key"))
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return stored(keyed.join(broadcast_checked(wanted), ["doc_id", "text_key"]).select("cls", "text").dropDuplicates(["cls"]))


def join(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id (smallest doc_id that links of J >= num/den reach)."""
    profiles = stored(profile(docs, k))
    sketch = rarity(profiles)
    rows = stored(profiles.where("chunk IS NULL").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "cls", "ranges").dropDuplicates(["doc_id", "text_key"]))
    classes = stored(rows.where("n_shingles > 0").groupBy("cls").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("ranges").alias("ranges")))
    postings = stored(lists(prefixes(docs, sketch, k, num, den)))
    texts = class_texts(docs, classes, postings)

    pairs, groups = candidates(postings, num, den)
    groups = stored(groups)
    sets = stored(copies.hashed_sets(texts.join(groups.select("cls").distinct(), "cls"), k))
    sure, asked = copies.links(groups, sets, num, den)
    proven = stored(verified(overlap_possible(pairs.union(asked).distinct(), classes, num, den), texts, k, num, den))
    labels = stored(components(proven.union(sure)))
    named = classes.select("cls", "rep.doc_id").join(labels, F.col("cls") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "cls"))
    # The smallest id of each component of classes.
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("cls", "component_id")
    return rows.join(ids, "cls", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(
            F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return condensed(lambda: join(docs).select("doc_id", "n_shingles", "component_id"))
