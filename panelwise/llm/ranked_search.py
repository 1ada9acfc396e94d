"""Ranked search by MaxScore with bounds of term pairs.

The index is a table of blocks of documents. A block row holds its documents' ids and, for each term, its places in the
block and how often it stands there, so a block is inverted in one task of bounded size and a lost task is redone from files.
Its long columns are packed: Spark carries each as one value, where arrays would take it several times their size.

From the index comes a table of bounds: for each block the greatest impact of every term, and for each pair of terms that a
query pairs up the greatest joint impact over the intersection of the two lists. The lists of the terms that queries ask for
stand beside them, so that queries read this table only and no block is joined or shuffled. A document that holds both terms scores at
most the joint maximum, one that holds a single term at most that term's, so a pair is worth max(joint, one, other), never
more than the two maxima together. The best ``k`` joint impacts of a pair, and impacts of a term, are real scores that
documents reach, so the k-th of them is a threshold that any query holding the pair starts from.

A query meets a block only if the sum of its pair bounds there reaches the threshold. In the block, terms whose joint bound
stays below the threshold are left out of the search for candidates (they are non-essential) and looked up only in
documents that can still reach it. Results are those of scoring every document.

Defined cases: null, empty and wordless texts hold no term and are found by no query, documents without doc_id are left out;
rows that share a doc_id are documents of their own; items without item_id or terms have no result, items that share an id are
one query with the terms of all; equal scores rank by ascending doc_id; empty tables give an empty result. Only doc_id, text
and item_id are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from panelwise.llm.common import stored

TOP = 20
# Documents of a block.
BLOCK_DOCS = 8192
# Queries that one pass over the index answers; more are answered in further passes.
QUERIES = 2000
# Scores that are kept of a list while thresholds are added up are dealt over so many groups first.
SALTS = 32
# Fixed values of the scoring rule.
LENGTH_SHARE, SCALE, SPREAD = 25, 1_000_000_000, 12
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, lower-cased in A-Z, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as many bytes as the greatest takes; a last byte tells how many."""
    size = np.min_scalar_type(int(x.max(initial=0))).itemsize
    return x.astype(f"<u{size}").tobytes() + bytes([size])


def _numbers(batch: pa.RecordBatch, row: int, column: str, kind: type = np.int64) -> np.ndarray:
    raw = memoryview(batch.column(column)[row].as_buffer())
    return np.frombuffer(raw[:-1], f"<u{raw[-1]}").astype(kind)


def _block(number: int, ids: list, lengths: list[int], parts: list[np.ndarray], local: dict[bytes, int], kind: pa.DataType) -> pa.RecordBatch:
    """The inverted block: its terms in byte order, and for each the documents (places in ids) and their counts."""
    terms = np.array(sorted(local), object)
    rank = np.empty(len(local), np.int64)
    rank[[local[t] for t in terms]] = np.arange(len(terms))
    term = rank[np.concatenate(parts)] if local else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ids)), lengths)
    keys, tf = np.unique(term * len(ids) + doc, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(terms) + 1) * len(ids))
    column = lambda x, t: pa.array([x], pa.list_(t))
    packed = (np.cumsum([len(t) for t in terms], dtype=np.int64), starts, keys % max(len(ids), 1), tf)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), column(ids, kind), column(lengths, pa.int32()), pa.array([b"".join(terms)], pa.binary()),
         *(pa.array([_packed(x)], pa.binary()) for x in packed)], ["block", "ids", "lengths", "terms", "ends", "starts", "places", "tf"])


def _places_of(batch: pa.RecordBatch, row: int, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms given a block holds, and the places of those among its own."""
    ends = _numbers(batch, row, "ends", np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(np.int32(0), ends)), batch.column("terms")[row].as_buffer()])
    at = pc.index_in(pa.array(terms, pa.binary()), value_set=own)
    return np.flatnonzero(np.asarray(at.is_valid())), at.drop_null().to_numpy()


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_chars: int = 8 << 20) -> DataFrame:
    """Inverted blocks of all terms of all documents, stored in the shared folder. A block ends at either bound."""
    spark_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        local: dict[bytes, int] = {}
        ids, lengths, parts, size, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = terms_of(text.as_py())
                for t in set(found).difference(local):
                    local[t] = len(local)
                ids.append(doc_id)
                lengths.append(len(found))
                parts.append(np.fromiter(map(local.__getitem__, found), np.int64, len(found)))
                size += len(found) * 8
                if len(ids) >= block_docs or size >= block_chars:
                    yield _block(number, ids, lengths, parts, local, kind)
                    number, local = number + 1, {}
                    ids, lengths, parts, size = [], [], [], 0
        if ids:
            yield _block(number, ids, lengths, parts, local, kind)

    schema = (f"block bigint, ids array<{spark_kind}>, lengths array<int>, terms binary, ends binary, starts binary, "
              "places binary, tf binary")
    return stored(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, schema))


@dataclass
class Plan:
    """Queries against an index: terms with weights, the pairs that queries bind, and per query its terms and pairs."""

    items: list
    terms: list[bytes]
    weight: np.ndarray
    # Per query: places of its terms, and how often each stands in it, rarest first.
    uses: list[np.ndarray]
    times: list[np.ndarray]
    pairs: np.ndarray
    # Per query: places of its pairs; the i-th binds its terms 2 i and 2 i + 1. An odd last term stands alone.
    bound: list[np.ndarray]
    docs: int
    total: int
    floor: np.ndarray | None = None


def _asked(batch: pa.RecordBatch, row: int, plan: Plan) -> pa.RecordBatch:
    """A block with no terms but those of the plan, which stand as their numbers."""
    has, at = _places_of(batch, row, plan.terms)
    starts, places, tf = (_numbers(batch, row, c, np.int32) for c in ("starts", "places", "tf"))
    size = starts[at + 1] - starts[at]
    first = np.append(0, np.cumsum(size))
    to = np.repeat(starts[at] - first[:-1], size) + np.arange(first[-1])
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).slice(row, 1) for c in ("block", "ids", "lengths")),
         *(pa.array([_packed(x)], pa.binary()) for x in (has, first, places[to], tf[to]))], ["block", "ids", "lengths", "has", "starts", "places", "tf"])


def _postings(batch: pa.RecordBatch, row: int, plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(places, weighted impacts) of each term of the plan that a block of ``_asked`` holds."""
    starts, tf = _numbers(batch, row, "starts"), _numbers(batch, row, "tf")
    places = _numbers(batch, row, "places", np.int32)
    lengths = batch.column("lengths")[row].values.to_numpy().astype(np.int64)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * plan.docs) // max(plan.total, 1)
    out = {}
    for i, a, b in zip(_numbers(batch, row, "has").tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        here, n = places[a:b], tf[a:b]
        out[i] = here, plan.weight[i] * ((SCALE * n) // (1000 * n + SPREAD * m[here]))
    return out


def _best(values: np.ndarray, k: int) -> np.ndarray:
    return np.sort(values)[::-1][:k]


def statistics(index: DataFrame, terms: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, all their terms, and for each of the terms given the documents that hold it."""
    n, total = index.agg(F.sum(F.size(F.filter("lengths", lambda x: x > 0))).cast("long"), F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                starts = _numbers(batch, row, "starts")
                has, k = _places_of(batch, row, terms)
                df[has] += starts[k + 1] - starts[k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(df)], ["term", "df"])

    rows = index.select("terms", "ends", "starts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect()
    return n or 0, total or 0, {terms[i]: df for i, df in rows}


def plan_queries(index: DataFrame, queries: list[tuple[object, list[bytes]]]) -> Plan:
    """Weights, and pairs of terms that follow each other by rarity in a query."""
    counts = [Counter(t) for _, t in queries]
    terms = sorted(set().union(*counts))
    docs, total, df = statistics(index, terms)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1))) for t in terms], np.int64)
    place = {t: i for i, t in enumerate(terms)}
    uses, times, bound, pairs = [], [], [], {}
    for c in counts:
        order = sorted(c, key=lambda t: (-weight[place[t]], t))
        uses.append(np.array([place[t] for t in order], np.int64))
        times.append(np.array([c[t] for t in order], np.int64))
        both = [tuple(sorted(x)) for x in zip(uses[-1][0::2].tolist(), uses[-1][1::2].tolist())]
        bound.append(np.array([pairs.setdefault(p, len(pairs)) for p in both], np.int64))
    return Plan([q for q, _ in queries], terms, weight, uses, times, np.array(list(pairs), np.int64).reshape(-1, 2), bound, docs, total)


def bounds(index: DataFrame, plan: Plan, k: int = TOP) -> DataFrame:
    """Rows of blocks, with the lists of the plan's terms and maxima: greatest impacts of terms, then of pairs, 0 where a list is
    empty, else more by 1; and rows (list, best), the k best values of each term and pair in a task."""
    n, m = len(plan.terms), len(plan.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = _asked(batch, row, plan)
                lists, most = _postings(block, 0, plan), np.zeros(n + m, np.int64)
                found = {i: v for i, (_, v) in lists.items()}
                for j, (a, b) in enumerate(plan.pairs.tolist()):
                    if a in lists and b in lists:
                        _, x, y = np.intersect1d(lists[a][0], lists[b][0], assume_unique=True, return_indices=True)
                        if len(x):
                            found[n + j] = lists[a][1][x] + lists[b][1][y]
                for i, v in found.items():
                    most[i] = v.max() + 1
                    best[i] = _best(np.concatenate((best[i], v)) if i in best else v, k)
                kinds = block.schema.types
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, pa.array([_packed(most)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64()))], names)
        if best:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(best), t) for t in kinds), pa.nulls(len(best), pa.binary()), pa.array(list(best), pa.int32()),
                 pa.array(list(best.values()), pa.list_(pa.int64()))], names)

    names = ["block", "ids", "lengths", "has", "starts", "places", "tf", "maxima", "list", "best"]
    id_kind = index.schema["ids"].dataType.simpleString()
    return stored(index.mapInArrow(run, f"block bigint, ids {id_kind}, lengths array<int>, has binary, starts binary, places binary, "
                                        "tf binary, maxima binary, list int, best array<bigint>"))


def thresholds(bound: DataFrame, plan: Plan, k: int = TOP) -> np.ndarray:
    """For each query a score that k documents reach, 0 if none is known: the k-th best of its terms and pairs."""
    def merged(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))

    # Each row holds k values at most; those of many tasks meet in two steps.
    rows = bound.where("list IS NOT NULL").select("list", "best", F.pmod(F.xxhash64("best"), F.lit(SALTS)).alias("salt"))
    last = merged(merged(rows, "list", "salt"), "list").where(F.size("best") >= k).select("list", F.element_at("best", k)).collect()
    kth, n = dict(map(tuple, last)), len(plan.terms)
    out = np.zeros(len(plan.items), np.int64)
    for q, (uses, times, pairs) in enumerate(zip(plan.uses, plan.times, plan.bound)):
        least = np.minimum(times[0:2 * len(pairs):2], times[1:2 * len(pairs):2])
        out[q] = max([0, *(kth.get(t, 0) * c for t, c in zip(uses.tolist(), times.tolist())),
                      *(kth.get(n + p, 0) * c for p, c in zip(pairs.tolist(), least.tolist()))])
    return out


def _unit_bounds(most: np.ndarray, plan: Plan, q: int) -> np.ndarray:
    """What each pair of a query, and its odd last term, can add to a score where ``most`` holds."""
    single, pairs = np.maximum(most[plan.uses[q]], 0) * plan.times[q], len(plan.bound[q])
    a, b = single[0:2 * pairs:2], single[1:2 * pairs:2]
    ta, tb = plan.times[q][0:2 * pairs:2], plan.times[q][1:2 * pairs:2]
    both, c = most[len(plan.terms) + plan.bound[q]], np.minimum(ta, tb)
    joint = np.where(both >= 0, np.minimum(c * both + (ta - c) * (a // ta) + (tb - c) * (b // tb), a + b), 0)
    return np.concatenate((np.maximum(joint, np.maximum(a, b)), single[2 * pairs:]))


def _search_block(lists: dict, size: int, most: np.ndarray, plan: Plan, q: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the block's documents whose score for query q is at least floor and above 0."""
    unit = _unit_bounds(most, plan, q)
    order = np.argsort(unit, kind="stable")
    below = np.cumsum(unit[order])
    if not len(below) or below[-1] < max(floor, 1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    split = int(np.searchsorted(below, max(floor, 1), side="left"))  # units before it can't reach the floor together
    members = lambda u: [i for i in (2 * u, 2 * u + 1) if i < len(plan.uses[q]) and int(plan.uses[q][i]) in lists]
    score = np.zeros(size, np.int64)
    for u in order[split:].tolist():
        for i in members(u):
            here, value = lists[int(plan.uses[q][i])]
            score[here] += value * plan.times[q][i]
    rest = int(below[split - 1]) if split else 0
    places = np.flatnonzero((score > 0) & (score + rest >= floor))
    for step in range(split - 1, -1, -1):
        if not len(places):
            break
        for i in members(int(order[step])):
            here, value = lists[int(plan.uses[q][i])]
            at = np.minimum(np.searchsorted(here, places), len(here) - 1)
            score[places] += np.where(here[at] == places, value[at], 0) * plan.times[q][i]
        rest = int(below[step - 1]) if step else 0
        places = places[score[places] + rest >= floor]
    return places, score[places]


def answer(bound: DataFrame, plan: Plan, k: int = TOP) -> DataFrame:
    """(query, doc_id, score): the k best documents of each query in each task."""
    id_kind = bound.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = plan.floor.copy()
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                most = _numbers(batch, row, "maxima") - 1
                able = [q for q in range(len(plan.items)) if _unit_bounds(most, plan, q).sum() >= max(floor[q], 1)]
                if not able:
                    continue
                ids, lists = batch.column("ids")[row].as_py(), _postings(batch, row, plan)
                names = np.array(ids)
                for q in able:
                    places, score = _search_block(lists, len(ids), most, plan, q, int(floor[q]))
                    if len(places):
                        old = top.get(q)
                        name = names[places] if old is None else np.concatenate((old[0], names[places]))
                        score = score if old is None else np.concatenate((old[1], score))
                        first = np.lexsort((name, -score))[:k]
                        top[q] = name[first], score[first]
                        if len(first) == k:
                            floor[q] = max(floor[q], score[first[-1]])
        for q, (name, score) in top.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(name), q, np.int32)), pa.array(name.tolist(), kind), pa.array(score)], ["query", "doc_id", "score"])

    blocks = bound.where("block IS NOT NULL").drop("block", "list", "best")
    return blocks.mapInArrow(run, f"query int, doc_id {id_kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, queries: int = QUERIES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    return search_index(build_index(docs, block_docs), items, k, queries)


def search_index(index: DataFrame, items: DataFrame, k: int = TOP, queries: int = QUERIES) -> DataFrame:
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    texts = stored(items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text")))
    passes = max(1, -(-texts.count() // queries))
    out = None
    for p in range(passes):
        rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        asked = [(r["item_id"], t) for r in sorted(rows, key=lambda r: r["item_id"]) if (t := terms_of(r["text"]))]
        if not asked:
            continue
        plan = plan_queries(index, asked)
        bound = bounds(index, plan, k)
        plan.floor = thresholds(bound, plan, k)
        names = spark.createDataFrame([(i, q) for i, q in enumerate(plan.items)], f"query int, item_id {kind}")
        found = answer(bound, plan, k).join(F.broadcast(names), "query").select("item_id", "doc_id", "score")
        out = found if out is None else out.union(found)
    if out is None:
        id_kind = index.schema["ids"].dataType.elementType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_kind}, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(docs, items)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
p AS (SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM p JOIN q USING (term) JOIN w USING (term), s GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {TOP}
"""
