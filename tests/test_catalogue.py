"""Registered queries over whole tables, where the driver's tables can't show a cut."""

from lattica.plans.catalogue import QUERIES


def test_removeaccents_takes_whole_texts(spark, tmp_path):
    texts = {1: "a" * 300 + "é ñ ß", 2: "é" * 5000, 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["v"] for r in QUERIES["removeaccents"](spark, f"file://{tmp_path}").collect()}
    assert got == {1: "a" * 300 + "e n ss", 2: "e" * 5000, 3: "", 4: None}
