"""The registered queries on a folder: the columns of their contracts, and a row for whatever they owe one."""

import random
import zlib

import pytest

from lattica.llm.queries import QUERIES

CONTRACT = {
    "op1_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_token_orc": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text string",
    "op3_perspective_rotation": "conv_id bigint, perspective string, text string, mask_spans string",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(21), f"file://{tmp_path_factory.mktemp('tables')}"
    make = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 7))) for _ in range(n))
    docs = [(i, "\n".join(make(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))), "en", f"s{i % 4}", 0) for i in range(300)]
    docs += [(300 + i, docs[i][1] if i % 2 else docs[i][1] + " tail", "en", "s1", 0) for i in range(40)] + [(400, None, "en", None, None), (401, "", "en", "s2", 0), (402, make(5000), "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(350)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i // 4, i % 4, ["user", "assistant"][i % 2], make(8)) for i in range(80)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, docs


@pytest.mark.parametrize("name", CONTRACT)
def test_query_keeps_its_contract(spark, folder, name):
    path, docs = folder
    got = QUERIES[name](spark, path)
    kinds = dict(got.dtypes)
    for column in CONTRACT[name].split(", "):
        assert kinds[column.split()[0]] == column.split()[1], column
    rows, ids = got.collect(), sorted(d[0] for d in docs)
    if name == "op6_top_k":
        assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, k) for q in (0, 100, 200, 300) for k in range(1, 11)]
    elif name == "op3_perspective_rotation":
        assert len(rows) == 40
    elif name == "op2_best_fit_packing":
        assert sorted({r["doc_id"] for r in rows}) == ids
        lengths = {i: [r["length"] for r in rows if r["doc_id"] == i] for i in (400, 401)}
        assert lengths == {400: [1], 401: [1]} and max(r["length"] for r in rows) == 1024
    else:
        assert sorted(r["doc_id"] for r in rows) == ids
    if name == "op4_toxicity":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    if name == "op8_mixing":
        size = {d[3]: sum(len((e[1] or "").split()) for e in docs if e[3] == d[3]) for d in docs}
        by_id = {d[0]: d for d in docs}
        assert all(r["source_size"] == size[by_id[r["doc_id"]][3]] for r in rows)
    if name == "op7_simhash":
        assert all(r["component_id"] <= r["doc_id"] - 300 for r in rows if 300 <= r["doc_id"] < 340 and r["doc_id"] % 2)
    if name == "op10_line_dedup":
        assert all(r["text"] == "" and r["n_removed"] == r["n_lines"] for r in rows if 300 <= r["doc_id"] < 340 and r["doc_id"] % 2)
