"""The pipeline's stages on planted rows."""

import corpus_pipeline as cp
from conftest import SF
from test_joins import brute


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()
    items = [(1, " ".join(f"benchmark{i}" for i in range(20)))]
    long = docs[3].text if len(docs[3].text.split()) > 60 else docs[4].text
    extra = [(90001, long, "en", "s", 1), (90002, long + " tail", "en", "s", 1), (90003, "the " + items[0][1], "en", "s", 1),
             (90004, None, None, None, None), (90005, "123 456 !!", None, None, 1), (None, "the and of with that " * 5, "en", None, 5),
             (90006, "write to the bob.smith@mail1.example.com and of the house with her", "en", "s", 1)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([tuple(r) for r in docs] + extra + [tuple(docs[0])], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == list(cp.COLUMNS)
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert not ids["language"] & {90004, 90005} and {90001, 90006, None} <= ids["language"]
    kept = brute([(r.doc_id, r.text) for r in seen["language"]], 5, 80, 100)
    assert ids["near_duplicates"] - {None} == {i for i, _, c in kept if i == c} and not ids["near_duplicates"] & {90001, 90002}
    assert len(seen["near_duplicates"]) == len(ids["near_duplicates"])
    assert ids["near_duplicates"] - ids["benchmark"] == {90003}
    text = {r.doc_id: r for r in seen["personal_data"]}
    assert "bob.smith" not in text[90006].text and "@mail1.example.com" in text[90006].text
    assert ids["packing"] == ids["personal_data"] == ids["benchmark"]
    assert cp.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_pipeline_of_empty_tables_and_other_columns(spark, tmp_path):
    """Empty tables give no rows; columns of any name beside those of documents are not read; stages leave no tables behind."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, language string, text_key int, m int"
    for name, rows in (("none", []), ("few", [(i, f"the house of number {i} and the garden with it", "en", "s", 1, 2, "x", 3, 4) for i in range(6)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/few").collect()} <= set(range(6))
