"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half their greatest depth: the upper trie holds what lies above the cut, each distinct cut prefix gets
a name, and what lies below it is a forest of its own, which hangs on that name. Both are cut at half depth again, and so
on. All pieces of one recursion level are handled at once, as rows keyed by (conversation, block), so the number of rounds
is the logarithm of the depth whatever the number of pieces, and no conversation is gathered in one row.

* Down: prefixes of length d are named from the name of the last cut above d and the digest of the turns between, digests
  of aligned blocks being put together from those of their halves.
* Up: when two pieces meet again, the totals of each tree of the lower forest are grafted on the nodes of the upper trie
  that lie above it. A node is known by its depth and its smallest member, so its ancestors are those of that member.

Names are 128-bit digests of the turns. Only SHA-256 over the members that end at a node is sequential by its definition;
their ids are sorted by Spark and run through it as a stream.

Defined cases: null role or text is empty; rows without conv_id are left out; turns with equal numbers are ordered by role,
then text, repeated rows included; a conversation may have any number of turns and is rebuilt to none if nothing is left; an
empty table has no nodes. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.llm.common import stored

# Blocks of conversations that share a system prompt, and the number of turns taken over from the first of a block.
BLOCK, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): places of turns from 0.

    Rows are dealt out by range, so a conversation with very many turns lies in several tasks, whose counts are added up.
    """
    empty = F.lit("")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = stored(rows.repartitionByRange(F.col("conv_id"), *order, F.rand(7)).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = dealt.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return local.join(offset, ["conv_id", "part"]).select(
        "conv_id", (F.col("k") - 1 + F.col("offset")).cast("long").alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """(conv_id, pos, digest, words): conversations with their first turns taken from the first one of their block.

    A row with pos -1 stands for each conversation, turnless ones included.
    """
    size = F.concat(F.char_length("role").cast("string"), F.lit(":"))
    t = stored(ranked(turns).select(
        "conv_id", "pos", F.md5(F.concat(size, "role", "text")).alias("digest"),
        F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words")))
    convs = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % block,
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared})
    first = t.where(F.col("pos") < shared - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    plan = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0))))
    plan = plan.select("conv_id", "base", "h", "taken")
    taken = plan.where("taken > 0").join(first, "base").where("pos < taken").select("conv_id", "pos", "digest", "words")
    own = t.join(plan, "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    none = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"),
                        F.lit(0).cast("long").alias("words"))
    return stored(taken.union(own).union(none))


def _rounds(seqs: DataFrame) -> int:
    """Halvings down to single depths: the logarithm of the number of depths, the root's included."""
    deepest = seqs.agg(F.max("pos")).first()[0]
    return 0 if deepest is None else int(deepest + 1).bit_length()


def named(seqs: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, depth, name): the name of each prefix, from the cuts down."""
    digests = [stored(seqs.where("pos >= 0").select("conv_id", F.col("pos").alias("block"), "digest"))]
    for _ in range(rounds - 1):
        # Blocks of which only the first half is there are never asked for.
        pairs = digests[-1].groupBy("conv_id", F.shiftright("block", 1).alias("half")).agg(
            F.max(F.when(F.col("block") % 2 == 0, F.col("digest"))).alias("a"),
            F.max(F.when(F.col("block") % 2 == 1, F.col("digest"))).alias("b"))
        digests.append(stored(pairs.where("b IS NOT NULL").select(
            "conv_id", F.col("half").alias("block"), F.md5(F.concat("a", "b")).alias("digest"))))
    names = seqs.where("pos < 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.md5(F.lit("")).alias("name"))
    for j in reversed(range(len(digests))):
        # Prefixes whose last cut lies 2 ** j turns above: those that end with an aligned block of that size.
        width = 1 << j
        below = digests[j].where("block % 2 = 0").select("conv_id", (F.col("block") * width).alias("depth"), "digest")
        more = below.join(names, ["conv_id", "depth"]).select(
            "conv_id", (F.col("depth") + width).alias("depth"), F.md5(F.concat("name", "digest")).alias("name"))
        names = stored(names.union(more))
    return names


def _sha_of_sorted(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): one pass over sorted ids, of which none are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for n, c in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if n != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    return ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(run, "name string, ends_sha256 string")


def trie(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return of_sequences(rebuilt(turns, block, shared))


def of_sequences(seqs: DataFrame) -> DataFrame:
    """The trie of (conv_id, pos, digest, words), with one row of pos -1 for each conversation."""
    rounds = _rounds(seqs)
    names = named(seqs, rounds)
    words = seqs.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    at = names.join(words, ["conv_id", "depth"])
    nodes = stored(at.groupBy("depth", "name").agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")))
    # Each conversation's way through the nodes. All begin at the root, whose member is a single number.
    root = nodes.where("depth = 0").agg(F.min("node")).first()[0]
    inner = names.where("depth > 0").join(nodes.select("depth", "name", "node"), ["depth", "name"])
    way = stored(inner.select("conv_id", "depth", "node").union(
        names.where("depth = 0").select("conv_id", "depth", F.lit(root).cast(names.schema["conv_id"].dataType))))
    above = way.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    linked = stored(nodes.join(above, (nodes.node == above.conv_id) & (nodes.depth == above.depth), "left").select(
        "node", nodes.depth, "name", "parent", "n_convs", "words"))
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    own = stored(linked.join(children, ["node", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    totals = own.select("node", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    for j in range(rounds):
        totals = stored(grafted(totals, way, 1 << j))
    last = names.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"))
    out = own.join(totals, ["node", "depth"]).join(_sha_of_sorted(last.select("name", "conv_id")), "name", "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def grafted(totals: DataFrame, way: DataFrame, half: int) -> DataFrame:
    """Put pieces of ``half`` depths together two by two: trees of a lower forest add their totals to all nodes above them."""
    piece: Column = F.floor(F.col("depth") / half)
    roots = totals.where((F.col("depth") % half == 0) & (piece % 2 == 1)).select(
        F.col("node").alias("conv_id"), (piece - 1).alias("piece"), "n_leaves", "saved_tokens")
    upper = way.where(piece % 2 == 0).select("conv_id", piece.alias("piece"), "node", "depth")
    more = roots.join(upper, ["conv_id", "piece"]).select("node", "depth", "n_leaves", "saved_tokens")
    return totals.union(more).groupBy("node", "depth").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS base, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
        string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))) % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
whole AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY k) AS s FROM t GROUP BY 1),
seq AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.s, 1, h), []), coalesce(list_slice(w.s, h + 1, len(w.s)), [])) AS s
        FROM c JOIN whole w USING (conv_id) LEFT JOIN whole b ON b.conv_id = c.base),
pre AS (SELECT conv_id, len(s) AS n, d, list_slice(s, 1, d) AS p, list_slice(s, 1, d - 1) AS up,
               CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].x, '{WORD}')) ELSE 0 END AS words
        FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
under AS (SELECT d, list_slice(p, 1, d) AS p, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
          FROM (SELECT p, saved, n_children, unnest(range(0, len(p) + 1)) AS d FROM full_node) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(under.leaves AS BIGINT) AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN under USING (d, p) LEFT JOIN node u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.up
"""
