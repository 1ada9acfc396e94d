"""Document fingerprints by consistent weighted sampling.

A document is its weighted terms: pairs of neighbouring words (a single word where there is only one), weighted by their
count. Sample d draws for each term r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of (term, d); with weight S,
t = floor(ln S / r + b), y = exp(r (t - b)), a = c / (y exp r); the term with the smallest a wins, and (term, t) is the
d-th part of the signature. Two signatures agree in a part with probability sum(min S) / sum(max S), the generalised
Jaccard similarity, so the share of equal parts estimates it.

Defined cases: null text is empty; an empty text has the empty fingerprint, which equals only itself; rows that share a
doc_id are one document with the shortest text (ties: the smallest); rows without doc_id are no documents; a single
document is its own next one; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.llm.common import SEPARATOR, stored, words

SAMPLES = 16
_BITS24 = float(1 << 24)


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 24) - 1)) + F.lit(0.5)) / F.lit(_BITS24)


def sample(term: Column, log_weight: Column, d: int) -> Column:
    """A long that orders terms by a and carries the identity (term, t) in its low 31 bits; null for a null weight."""
    h = F.xxhash64(term, F.lit(d))
    g = F.xxhash64(h, F.lit(-1 - d))
    r = -F.log(_uniform(h, 40) * _uniform(h, 16))
    log_c = F.log(-F.log(_uniform(g, 40) * _uniform(g, 16)))
    b = (h.bitwiseXOR(F.shiftright(g, 48)).bitwiseAND(F.lit(0xFFFF)) + F.lit(0.5)) / F.lit(65536.0)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    order = ((log_a + F.lit(128.0)) * F.lit(_BITS24)).cast("long")
    return F.shiftleft(order, 31).bitwiseOR(F.xxhash64(h, t).bitwiseAND(F.lit(0x7FFFFFFF)))


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id): the next document by ascending doc_id, the first one after the last.

    Ids are dealt out by range; only the first id of each range crosses the ranges.
    """
    n = F.char_length(F.coalesce("text", F.lit("")))
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(n).cast("long").alias("n_chars"))
    dealt = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    # One row for each range, so as many as there are shuffle partitions.
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    parts = Window.orderBy("part")
    heads = firsts.select("part", F.coalesce(
        F.lead("first").over(parts),
        F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    return stored(dealt.withColumn("inner", F.lead("doc_id").over(inside)).join(F.broadcast(heads), "part").select(
        "doc_id", "n_chars", F.coalesce("inner", "after").alias("next_id")))


def edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id, head, tail, patch): text is head + tail, the edited text head + patch."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    texts = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.struct(n.alias("n"), F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select(
        "doc_id", F.col("m.text").alias("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("owner"), quarter.alias("q"))
    patches = texts.join(wanted, "doc_id").select(F.col("owner").alias("doc_id"), F.left("text", F.col("q")).alias("patch"))
    cut = (F.col("n_chars") - quarter).cast("int")
    return texts.join(order, "doc_id").join(patches, "doc_id").select(
        "doc_id", "n_chars", "next_id", F.left("text", cut).alias("head"),
        F.substring("text", cut + 1, quarter).alias("tail"), "patch")


def weights(parts: DataFrame) -> DataFrame:
    """(doc_id, term, own, other): the weight of each term in head + tail and in head + patch, 0 if absent.

    Head words are counted once for both texts. Its last two words go with either end, as the last may go on there.
    """
    head = words(F.col("head"))
    cut = parts.select("doc_id", head.alias("w"), "tail", "patch", F.when(
        F.right("head", F.lit(1)).rlike(SEPARATOR), F.lit(" ")).otherwise(F.lit("")).alias("glue"))
    k = F.size("w")
    last, before = F.coalesce(F.get("w", k - 1), F.lit("")), F.get("w", k - 2)

    def end(text: str) -> Column:
        return words(F.concat_ws(" ", before, F.concat(last, F.col("glue"), F.col(text))))

    lists = cut.select("doc_id", F.when(k > 1, F.slice("w", F.lit(1), k - 1)).otherwise(F.array().cast("array<string>")).alias("a"),
                       end("tail").alias("b"), end("patch").alias("c"))
    sized = lists.select("doc_id", F.concat("a", "b", "c").alias("w"), F.size("a").alias("na"), F.size("b").alias("nb"),
                         F.size("c").alias("nc"))
    at = sized.select("doc_id", "w", "na", "nb", "nc", F.posexplode_outer("w").alias("p", "word"))
    p, na, nb, nc = (F.col(c) for c in ("p", "na", "nb", "nc"))
    in_a, in_b, in_c = p < na - 1, (p >= na) & (p < na + nb - 1), (p >= na + nb) & (p < na + nb + nc - 1)
    lone_b, lone_c = (na == 0) & (nb == 1) & (p == 0), (na == 0) & (nc == 1) & (p == nb)
    term = F.when(lone_b | lone_c, F.xxhash64("word")).otherwise(F.xxhash64("word", F.get("w", p + 1)))
    own, other = (in_a | in_b | lone_b).cast("int"), (in_a | in_c | lone_c).cast("int")
    kept = at.select("doc_id", term.alias("term"), own.alias("own"), other.alias("other")).where("own + other > 0")
    return kept.groupBy("doc_id", "term").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))


def signatures(weighted: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, own, other): arrays of signature parts of both texts; null where a text has no terms."""
    logs = weighted.select("doc_id", "term", F.when(F.col("own") > 0, F.log("own")).alias("own"),
                           F.when(F.col("other") > 0, F.log("other")).alias("other"))
    least = [F.min(sample(F.col("term"), F.col(side), d)).alias(f"{side}{d}") for d in range(samples)
             for side in ("own", "other")]
    sig = logs.groupBy("doc_id").agg(*least)

    def parts(side: str) -> Column:
        low = [F.col(f"{side}{d}").bitwiseAND(F.lit(0x7FFFFFFF)) for d in range(samples)]
        return F.when(F.col(f"{side}0").isNotNull(), F.array(*low))

    return sig.select("doc_id", parts("own").alias("own"), parts("other").alias("other"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts: an estimate of the generalised Jaccard similarity."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal)


def as_text(sig: Column) -> Column:
    return F.coalesce(F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0"))), F.lit(""))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, next_id, n_chars, edited_sha256, own, other, next: signatures of the text, its edit and the next text."""
    parts = edited(docs, ordered(docs))
    # Both branches read the same exchange of texts, and meet again without another one.
    meta = parts.select("doc_id", "next_id", "n_chars", F.sha2(F.concat("head", "patch"), 256).alias("edited_sha256"))
    out = stored(meta.join(signatures(weights(parts), samples), "doc_id", "left"))
    after = out.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next"))
    return out.join(after, "next_id", "left")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint(docs).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))
