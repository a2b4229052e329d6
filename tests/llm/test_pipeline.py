"""The stages one by one on a small corpus: each works on what the one before kept."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from lattica.llm import linededup, media, mixing, secrets, simhash, toxicity
from lattica.llm.common import documents


def test_mix_keeps_rows_without_ids_and_tells_repeated_ones_apart(spark):
    rng = random.Random(4)
    docs = [(None if i % 3 == 0 else i % 20, "w" * (i + 1) + " x" * rng.randint(0, 40), f"s{i % 4}" if i % 7 else None) for i in range(120)] + [(None, None, "s1"), (5, "", "s1")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    count = lambda rows: sorted(((r[0] or -1, r[1] or "", r[2], n) for r, n in rows.items()))
    want, got = Counter(), Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += round(r["copies"])
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r["doc_id"], r["source"], len((r["text"] or "").split())] += 1
    assert count(got) == count(+want) and any(i is None for i, *_ in got)


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(n))
    docs = [(i, make(60) + "\n" + make(40), "en", f"s{i % 3}", 0) for i in range(120)]
    toxic = {i for i in range(120) if i % 4 == 0}
    docs = [(i, t + " idiot scum moron idiot" if i in toxic else t, a, s, n) for i, t, a, s, n in docs]
    docs += [(200, docs[1][1], "en", "s1", 0), (201, docs[2][1].replace("\n", " x\n", 1), "en", "s2", 0), (202, None, "en", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf_dir, ids = f"file://{tmp_path}", lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    first = documents(spark, sf_dir)
    clean = corpus_pipeline.drop_toxic(spark, first, sf_dir)
    assert ids(clean) == ids(first) - toxic and clean.columns == first.columns
    lines = corpus_pipeline.drop_lines(spark, clean, sf_dir)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert texts[200] == ("", 0) and texts[1][0] == docs[1][1] and lines.columns == first.columns
    assert texts[201][0] == ""  # both lines match those of 2
    alone = corpus_pipeline.drop_near_copies(spark, lines, sf_dir)
    assert ids(alone) == ids(clean) - {201, 202}  # the three empty texts are one group
    mixed = corpus_pipeline.mix_sources(spark, alone, sf_dir)
    assert ids(mixed) <= ids(alone) and mixed.columns == first.columns
    packed = corpus_pipeline.run(spark, sf_dir)
    assert ids(packed) == ids(mixed) and packed.filter("offset + length > 1024").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]


NAMES = ["toxicity", "n_lines", "n_removed", "_doc_id", "_doc", "_copy", "_copies", "_gone", "_row", "row", "copies", "owner", "segment", "sequence_id", "_hash", "_id", "fp", "node", "h1", "token"]


def odd_table(spark):
    """Documents with null and repeated ids, repeated rows, null, empty and very long texts, and columns of any name."""
    rng = random.Random(12)
    make = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(n))
    shared = make(30)
    rows = [(i if i % 5 else None, make(50) + "\n" + shared, f"s{i % 3}" if i % 4 else None) for i in range(40)]
    rows += [(1, make(40), "s1"), (1, make(40), "s2"), rows[3], rows[3], (None, None, None), (None, None, None), (2, "", "s0"), (None, " \n\n ", "s1"), (3, None, "s2")]
    rows += [(900, "x" * 1_000_000, "s0"), (901, "Ab1-" * 250_000, "s1"), (902, make(60_000), "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *(F.lit(f"<{n}>").alias(n) for n in NAMES))


def test_every_stage_takes_odd_tables(spark, tmp_path):
    docs = odd_table(spark)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(1, 40)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf_dir = f"file://{tmp_path}"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"<{n}>" for r in rows for n in NAMES), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert any(r["doc_id"] is None and r["text"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert corpus_pipeline.pack(spark, docs, sf_dir).filter("offset + length > 1024").count() == 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(packed.columns)


def test_operators_take_odd_tables(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    number = docs.count()
    for df in (docs, docs.limit(0)):
        want = number if df is docs else 0
        assert secrets.scan_secrets(df).count() == want
        assert toxicity.toxicity_of_documents(df, labels).count() == want
        assert media.media_of_documents(df).count() == want
        assert simhash.near_duplicates(df).count() == want
        assert mixing.mix_documents(df).count() == want
        assert linededup.dedup_lines(df).count() == want
    got = mixing.mix_documents(docs).collect()
    assert len({(r["doc_id"], r["source"], r["size"], r["row"]) for r in got}) == number
