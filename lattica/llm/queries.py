"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chat, linededup, media, mixing, packing, secrets, simhash, token_orc, topk, toxicity
from lattica.llm.common import documents, shared_dir, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return packing.pack_best_fit(pieces)


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_of_documents(documents(spark, sf_dir))
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return got.select(*first, "width", "height", "digest", "offset", "length")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    token_orc.write_token_orc(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return token_orc.token_index(spark, path)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_best_fit_packing, op3_perspective_rotation, op4_toxicity, op5_media_columns, op6_top_k, op7_simhash, op8_mixing, op9_token_orc, op10_line_dedup)}

ORACLES = {
    "op3_perspective_rotation": """
        WITH safe AS (
            SELECT conv_id, coalesce(turn, 0) AS turn, replace(replace(role, '<|im_', '<| im_'), chr(10), ' ') AS role,
                   replace(coalesce(text, ''), '<|im_', '<| im_') AS text
            FROM conversations),
        rows_ AS (
            SELECT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS segment, turn, role, text,
                   row_number() OVER (PARTITION BY conv_id, CAST(floor(turn / 1024) AS BIGINT) ORDER BY turn, role NULLS FIRST, text) AS k
            FROM safe),
        speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM rows_ WHERE role IS DISTINCT FROM 'system'),
        shown AS (
            SELECT r.conv_id, s.perspective, r.segment, r.k, r.text, r.role IS NOT DISTINCT FROM s.perspective AS own,
                   '<|im_start|>' || CASE WHEN r.role IS NOT DISTINCT FROM s.perspective THEN 'assistant' WHEN r.role = 'system' THEN 'system' ELSE 'user name=' || coalesce(r.role, 'unknown') END || chr(10) AS head
            FROM rows_ r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
        placed AS (
            SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at
            FROM shown)
        SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (own) AS n_assistant,
               CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS n_masked,
               string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
               coalesce(string_agg(CAST(CAST(begin_at AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begin_at + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask_spans
        FROM placed GROUP BY conv_id, perspective, segment
    """,
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_line_dedup": """
        WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        places AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM texts),
        all_lines AS (
            SELECT doc_id, k, lines[k] AS line, list_filter(string_split(lines[k], ' '), lambda w: w <> '') AS words FROM places),
        classes AS (
            SELECT line, any_value(words) AS words, min({'doc_id': doc_id, 'k': k}) AS first FROM all_lines WHERE len(words) > 0 GROUP BY line),
        tokens AS (
            SELECT DISTINCT line, first, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS token
            FROM classes),
        sizes AS (SELECT line, count(*) AS n FROM tokens GROUP BY line),
        shared AS (
            SELECT x.line AS earlier, y.line AS later, count(*) AS o
            FROM tokens x JOIN tokens y ON x.token = y.token AND x.first < y.first GROUP BY ALL),
        near AS (
            SELECT DISTINCT later AS line FROM shared s JOIN sizes a ON a.line = s.earlier JOIN sizes b ON b.line = s.later
            WHERE 10 * o >= 8 * (a.n + b.n - o)),
        judged AS (
            SELECT l.doc_id, l.k, l.line, coalesce(len(l.words) > 0 AND (m.line IS NOT NULL OR c.first <> {'doc_id': l.doc_id, 'k': l.k}), false) AS gone
            FROM all_lines l LEFT JOIN classes c ON c.line = l.line LEFT JOIN near m ON m.line = l.line)
        SELECT t.doc_id, CAST(count(j.k) AS BIGINT) AS n_lines, CAST(count(*) FILTER (j.gone) AS BIGINT) AS n_removed,
               CASE WHEN any_value(t.text) IS NOT NULL THEN coalesce(string_agg(j.line, chr(10) ORDER BY j.k) FILTER (NOT j.gone), '') END AS text
        FROM texts t LEFT JOIN judged j ON j.doc_id = t.doc_id GROUP BY t.doc_id
    """,
}
