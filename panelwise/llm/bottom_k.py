"""Near-duplicate groups by bottom-k sketches of one hash function.

The sketch of a set is its k smallest shingle hashes, all of them if it has fewer. Inverted lists of the retained values
bring sets together: two sets with J >= num/den share at least r values with a chance of all but 1e-9 a pair (for sets of
less than k shingles r is exact), so only the rarest k - r + 1 values of each sketch are listed. The union sketch, the k
smallest values of two sketches, estimates J as the share of its values that both hold and filters the pairs; what is left
is verified on the full sets.

Lists of a few sets give their pairs. Longer lists, as many copies make, are groups in which ``copies`` finds sure links and
few candidates without listing pairs. Texts with equal sets are one class, so exact copies cost one row each.

Defined cases: null, empty and wordless texts have no shingles and no links and are their own component; rows with one id
and one text are one row, with one id and several texts one row each; rows without doc_id are left out; ties go to the
smallest id; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.llm import copies
from panelwise.llm.common import condensed, stored, text_key, trimmed
from panelwise.llm.components import components
from panelwise.llm.ngram_join import class_texts, verified
from panelwise.llm.shingles import shingle_sets

WORDS, NUM, DEN = 4, 80, 100
KEEP = 64
# Chance that a pair of exactly num/den falls below the number of common values asked for.
MISS = 1e-9


def least_common(keep: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest r that fewer than r of ``keep`` draws, each common with chance num/den, stay below with chance <= miss."""
    p, below, r = num / den, 0.0, 0
    while r < keep and below + (chance := comb(keep, r) * p ** r * (1 - p) ** (keep - r)) <= miss:
        below, r = below + chance, r + 1
    return r


def sketches(docs: DataFrame, k: int, keep: int) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, cls (hash of its set), kept (its smallest hashes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, kept = [], [], []
            for s in shingle_sets(pc.cast(batch.column("text"), pa.binary()).to_pylist(), k):
                n.append(len(s))
                cls.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                kept.append(s[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                 pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "cls", "kept"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(
        trimmed(run), f"doc_id {kind}, text_key bigint, n_shingles bigint, cls bigint, kept array<bigint>")


def inverted(classes: DataFrame, keep: int, num: int, den: int) -> DataFrame:
    """(value, cls, n, df): the rarest retained values of each class that another class retains as well."""
    values = classes.select("cls", "n", F.size("kept").alias("size"), F.explode("kept").alias("value"))
    df = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    r = F.least(F.lit(least_common(keep, num, den)), F.ceil(F.col("size") * num / F.lit(den))).cast("int")
    shared = values.join(df, "value").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    # Values of no other class come first in the order of rarity and take their places.
    listed = F.greatest(F.size("v") - r + 1, F.lit(0))
    return shared.select("cls", "n", F.explode(F.slice("v", F.lit(1), listed)).alias("v")).select("v.value", "cls", "n", "v.df")


def candidates(postings: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of short lists, groups (g, cls) of long ones)."""
    def sizes(x: Column, y: Column) -> Column:
        return den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"])

    short = postings.where(F.col("df") <= copies.FEW)
    long = postings.where(F.col("df") > copies.FEW)
    # Lists of common values may be short where most classes have rarer ones.
    heads = long.groupBy("value").agg(F.count(F.lit(1)).alias("m"))
    headed = stored(long.join(heads.where("m > 1"), "value"))
    few = short.select("value", "cls", "n").union(headed.where(F.col("m") <= copies.FEW).select("value", "cls", "n"))
    lists = few.groupBy("value").agg(F.collect_list(F.struct("cls", "n")).alias("m")).where(F.size("m") > 1)
    groups = copies.merged(headed.where(F.col("m") > copies.FEW).select(F.col("value").alias("l"), "cls"))
    return copies.few_pairs(lists, sizes), groups


def estimated(pairs: DataFrame, classes: DataFrame, keep: int, num: int, den: int) -> DataFrame:
    """The pairs whose union sketch allows J >= num/den."""
    one = classes.select(F.col("cls").alias("a"), F.col("kept").alias("ka"))
    two = classes.select(F.col("cls").alias("b"), F.col("kept").alias("kb"))
    met = pairs.join(one, "a").join(two, "b")
    # Kept values are the smallest as unsigned numbers; turning the top bit orders them so.
    turned = [F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63)))) for c in ("ka", "kb")]
    met = met.select("a", "b", turned[0].alias("ka"), turned[1].alias("kb"))
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, keep)
    met = met.withColumn("u", union).withColumn("both", F.size(F.array_intersect(F.array_intersect("u", "ka"), F.col("kb"))))
    enough = F.when(F.size("u") < keep, F.col("both") * den >= F.size("u") * num).otherwise(
        F.col("both") >= least_common(keep, num, den))
    return met.where(enough).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, keep: int = KEEP) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id (smallest doc_id that links of J >= num/den reach)."""
    rows = stored(sketches(docs, k, keep).dropDuplicates(["doc_id", "text_key"]))
    classes = stored(rows.where("n_shingles > 0").groupBy("cls").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("kept").alias("kept")))
    postings = stored(inverted(classes, keep, num, den))
    pairs, groups = candidates(postings, num, den)
    texts = class_texts(docs, classes, postings)
    groups = stored(groups)
    sets = stored(copies.hashed_sets(texts.join(groups.select("cls").distinct(), "cls"), k))
    sure, asked = copies.links(groups, sets, num, den)
    proven = verified(estimated(pairs.union(asked).distinct(), classes, keep, num, den), texts, k, num, den)
    return grouped(rows, classes, stored(proven).union(sure))


def grouped(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Documents with the smallest doc_id of the classes that links connect with theirs."""
    named = classes.select("cls", "rep.doc_id").join(stored(components(links)), F.col("cls") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("cls", "component_id")
    return rows.join(ids, "cls", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return condensed(lambda: near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


def linked_sql(k: int, num: int, den: int, columns: str) -> str:
    """Check SQL of the components of documents that share enough k-word shingles, by all pairs with one in common."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(0, greatest(len(w) - {k - 1}, least(len(w), 1))),
        lambda i: array_to_string(list_slice(w, i + 1, i + {k}), ' '))) AS s FROM w),
cls AS MATERIALIZED (SELECT s, md5(array_to_string(list_sort(s), '|')) AS c, len(s) AS n, min(doc_id) AS doc_id FROM s WHERE len(s) > 0 GROUP BY ALL),
e AS MATERIALIZED (SELECT doc_id, n, hash(unnest(s)) AS x FROM (SELECT min(doc_id) AS doc_id, any_value(n) AS n, any_value(s) AS s FROM cls GROUP BY c)),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS b FROM r GROUP BY a),
heads AS (SELECT c, min(doc_id) AS doc_id FROM cls GROUP BY c)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.b, h.doc_id, s.doc_id) AS component_id{columns}
FROM s LEFT JOIN heads h ON len(s.s) > 0 AND h.c = md5(array_to_string(list_sort(s.s), '|')) LEFT JOIN m ON m.a = h.doc_id
"""


SQL = linked_sql(WORDS, NUM, DEN, ", s.doc_id = coalesce(m.b, h.doc_id, s.doc_id) AS kept")
