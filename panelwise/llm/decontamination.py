"""Benchmark decontamination with a distributed positional inverted index.

The index stores one posting (term, doc_id, text_key, pos) for every corpus token that belongs to the vocabulary asked
for, and an end posting behind each document's last word, so it also knows how long documents are. A phrase is found from
its rarest terms: their posting lists are shifted by the term's offset in the phrase and intersected on (document, start);
what is left is checked against the document's words. Proximity search asks for the rarest terms within a number of words.

Defined cases: null text and text without words have no words and no matches; rows that share doc_id are told apart by
their text, exact repeats get equal results; a null doc_id is an id like any other; an item with a null id or without words
is ignored; empty tables give empty results or documents without matches. Only doc_id, text, item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.llm.common import broadcast_checked, same, stored, text_key, words

WINDOW = 13
# Contaminated from this share of hit words: one in SHARE.
SHARE = 20
# Posting lists that are intersected before a candidate is compared with the document.
RAREST = 2
END = ""
KEY = ("doc_id", "text_key")


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def vocabulary(items: DataFrame) -> DataFrame:
    """Distinct term hashes of the items' texts, and the end marker."""
    end = items.sparkSession.range(1).select(F.lit(END).alias("term"))
    return items.select(F.explode(words(F.col("text"))).alias("term")).union(end).select(
        term_hash(F.col("term")).alias("term")).distinct()


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Positional postings of all tokens, or of those in ``terms`` (column term), stored in the shared folder."""
    tokens = docs.select("doc_id", text_key(F.col("text")).alias("text_key"),
                         F.array_append(words(F.col("text")), F.lit(END)).alias("w"))
    postings = tokens.select("doc_id", "text_key", F.posexplode_outer("w").alias("pos", "word")).select(
        "doc_id", "text_key", "pos", term_hash(F.col("word")).alias("term"))
    if terms is not None:
        postings = postings.join(broadcast_checked(terms), "term")
    return stored(postings.select("term", "doc_id", "text_key", "pos"))


def lengths(index: DataFrame) -> DataFrame:
    """One row per document: its number of words, from the end postings."""
    return index.where(F.col("term") == term_hash(F.lit(END))).select(
        *KEY, F.col("pos").cast("long").alias("n_words"))


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def phrase_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, phrase, len, terms): each n consecutive words of an item; a shorter item is one window."""
    w = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = w.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return at.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("terms")).select(
        "item_id", "len", F.xxhash64("terms").alias("phrase"), "terms").distinct()


def rarest_terms(phrases: DataFrame, df: DataFrame, r: int = RAREST) -> DataFrame:
    """(phrase, len, term, offset, lists): the r rarest places of each phrase; none if a term never occurs."""
    one = phrases.select("phrase", "len", "terms").dropDuplicates(["phrase"])
    places = one.select("phrase", "len", F.posexplode("terms").alias("offset", "word")).select(
        "phrase", "len", "offset", term_hash(F.col("word")).alias("term"))
    ranked = places.join(df, "term", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("phrase").orderBy("df", "offset"))).withColumn(
        "absent", F.max(F.col("df").isNull()).over(Window.partitionBy("phrase")))
    return ranked.where((F.col("rank") <= r) & ~F.col("absent")).select(
        "phrase", "len", "term", "offset", F.least(F.col("len"), F.lit(r)).alias("lists"))


def exact_matches(index: DataFrame, docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, text_key, found array<struct<start, len, phrase>>): every place where a phrase stands in a document."""
    rare = rarest_terms(phrases, frequencies(index))
    shifted = index.join(broadcast_checked(stored(rare)), "term").select(
        *KEY, "phrase", "len", "lists", "offset", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    both = shifted.groupBy(*KEY, "phrase", "len", "lists", "start").agg(F.countDistinct("offset").alias("met"))
    places = both.where("met = lists").groupBy(*KEY).agg(
        F.collect_list(F.struct("start", "len", "phrase")).alias("places"))
    text = docs.select(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("t"), F.col("text"))
    # The text is turned into words only for documents that have candidates.
    met = places.join(text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).dropDuplicates(
        list(KEY)).select(*KEY, "places", words(F.col("text")).alias("w"))
    found = F.filter("places", lambda p: F.xxhash64(F.slice("w", p["start"] + 1, p["len"])) == p["phrase"])
    return met.select(*KEY, found.alias("found")).where(F.size("found") > 0)


def covered(found: Column) -> Column:
    """Words inside at least one of the places."""
    spans = F.array_sort(F.array_distinct(F.transform(found, lambda p: F.struct(
        p["start"].cast("long").alias("a"), (p["start"] + p["len"]).cast("long").alias("b")))))
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(s["b"] - F.greatest(acc["end"], s["a"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted ids as strings), n_items, contaminated.

    ``n_hit`` counts words inside an occurrence of any window of n item words; contaminated from one hit word in ``share``.
    """
    index = build_index(docs, vocabulary(items))
    phrases = stored(phrase_windows(items, n))
    found = exact_matches(index, docs, phrases).select(
        *KEY, covered(F.col("found")).alias("n_hit"), F.array_distinct(F.col("found.phrase")).alias("phrases"))
    names = phrases.select("phrase", F.col("item_id").cast("string").alias("item"))
    hits = found.select(*KEY, "n_hit", F.explode("phrases").alias("phrase")).join(names, "phrase").groupBy(*KEY).agg(
        F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    rows, hits = lengths(index).alias("l"), hits.alias("h")
    out = rows.join(hits, same(rows, hits, *KEY), "left").select(
        "l.doc_id", "l.text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def proximity_matches(index: DataFrame, items: DataFrame, r: int = 3, slop: int = 20) -> DataFrame:
    """(doc_id, text_key, item_id, pos): the item's r rarest terms (all, if fewer) stand within ``slop`` words up to pos."""
    w = items.where(F.col("item_id").isNotNull()).select("item_id", F.array_distinct(words(F.col("text"))).alias("w"))
    terms = w.select("item_id", F.explode("w").alias("word")).select("item_id", term_hash(F.col("word")).alias("term"))
    ranked = terms.join(frequencies(index), "term", "left")
    by_item = Window.partitionBy("item_id")
    picked = ranked.withColumn("rank", F.row_number().over(by_item.orderBy(F.coalesce("df", F.lit(0)), "term"))).withColumn(
        "wanted", F.least(F.count(F.lit(1)).over(by_item), F.lit(r))).where(F.col("rank") <= r)
    near = Window.partitionBy(*KEY, "item_id").orderBy("pos").rangeBetween(-slop, 0)
    seen = index.join(broadcast_checked(stored(picked.select("item_id", "term", "wanted"))), "term").distinct()
    return seen.withColumn("met", F.size(F.collect_set("term").over(near))).where("met = wanted").select(
        *KEY, "item_id", "pos")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, s + 1, s + n) AS p
        FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM il)),
starts AS (SELECT doc_id, n, s, list_slice(w, s + 1, s + n) AS p
           FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s
                 FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM starts JOIN win USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
