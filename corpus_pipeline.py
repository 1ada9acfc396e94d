"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it wrote. All but the last keep the
columns of documents. Rows that a stage has no reason to reject stay, also with nulls in any column. Empty tables pass through,
further columns of documents are not read, and tables that a stage stores on its way go when its result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.llm import decontamination, language_id, ngram_join, packing, pseudonyms
from panelwise.llm.common import condensed, same, stored, text_key
from panelwise.sources.storage import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A text whose best language has less than this is no text in one of the learned languages.
LEAST_LANGUAGE = 0.3
# Near duplicates: shingles of five words, similarity of 80 hundredths.
SHINGLE_WORDS, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, null texts and texts unlike every learned language go."""
    model = language_id.train(language_id.sample(docs))
    kept = language_id.predict(docs.select(*COLUMNS), model, "language")
    return kept.where((F.col("language.lang_pred") != language_id.UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without an id stay."""
    def find() -> DataFrame:
        found = ngram_join.join(docs.select("doc_id", "text"), SHINGLE_WORDS, NUM, DEN)
        return found.where("doc_id = component_id").select("doc_id", "text_key")

    heads = condensed(find)
    keyed = docs.where("doc_id IS NOT NULL").select(*COLUMNS).withColumn("text_key", text_key(F.col("text")))
    one = keyed.join(heads, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)
    return one.union(docs.where("doc_id IS NULL").select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty stands inside a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    bad = condensed(lambda: decontamination.decontaminate(docs.select("doc_id", "text"), items).where("contaminated").select(
        "doc_id", "text_key").distinct())
    keyed = docs.select(*COLUMNS).withColumn("text_key", text_key(F.col("text")))
    return keyed.join(bad, same(keyed, bad, "doc_id", "text_key"), "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars follows the text."""
    return pseudonyms.pseudonymize(docs.select(*COLUMNS), pseudonyms.key_of(spark)).withColumn(
        "n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(stored(packing.pieces(docs.select("doc_id", "text"))))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("personal_data", personal_data), ("packing", pack)]
# Trained models, Feistel rounds and local search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
