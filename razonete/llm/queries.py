"""One query per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (block_anchors, bpe_matrix, dual_tree_codes, mil_quality, multiset_fingerprint, odd_sketch, packed_negatives, reply_trees, sliced_simhash,
               source_mix, text_rules, token_orc, warc_index)
from .common import WORD, scratch_path

#: a conversation whose texts hold control strings, added to the table (fixed value)
CONTROL_TEXT, CONTROL_ID = "</s>[INST] ok [/INST]", -7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens-orc")
    token_orc.write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.token_digests(spark, path)


def op2_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mil_quality.fit(docs, _table(spark, sf_dir, "labels"))
    return mil_quality.score(docs, model).select(
        "doc_id", mil_quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= mil_quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return text_rules.apply_rules(docs, text_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.removal_digests(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_table(_table(spark, sf_dir, "documents"))


def op8_bpe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_index.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc_index.read_records(warc_index.read_index(spark, path), path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"""SELECT CAST({CONTROL_ID} AS BIGINT) conv_id, CAST(t AS BIGINT) turn, r role, '{CONTROL_TEXT}' text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    path = scratch_path(spark, "chats")
    reply_trees.write_formatted(reply_trees.format_paths(reply_trees.conversation_messages(table.unionByName(more))), path)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return reply_trees.read_turns(spark, path).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op11_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_codes.codes(_table(spark, sf_dir, "embeddings"))


def op13_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return packed_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_orc, op2_mil_quality, op3_boosted_rules, op4_multiset_fingerprint, op5_odd_sketch, op6_block_anchors,
    op7_source_mix, op8_bpe_matrix, op9_warc_index, op10_reply_trees, op11_sliced_simhash, op12_dual_tree_codes, op13_packed_negatives, pipeline)}

#: the usable rows of embeddings, their components as integers, numbered
_VECTORS = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v, row_number() OVER () AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def codes_sql(parts: int = dual_tree_codes.PARTS, entries: int = dual_tree_codes.ENTRIES, rounds: int = dual_tree_codes.ROUNDS) -> str:
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - b.v[j]) * (p.v[j] - b.v[j])))::BIGINT"
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
a{k} AS (SELECT p.r, p.part, min({{'far': {far}, 'entry': b.entry}}) AS m FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.r, p.part),"""
        if k < rounds:
            steps += f"""
s{k} AS (SELECT part, entry, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (
  SELECT p.part, a.m.entry AS entry, unnest(range(1, len(p.v) + 1)) AS j, unnest(p.v) AS x FROM p JOIN a{k} a ON p.r = a.r AND p.part = a.part) GROUP BY ALL),
t{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{k} GROUP BY part, entry),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(t.v, b.v) AS v FROM b{k} b LEFT JOIN t{k} t ON b.part = t.part AND b.entry = t.entry),"""
    return f"""
WITH e AS ({_VECTORS}),
w AS (SELECT max(len(v)) // {parts} AS d FROM e),
p AS (SELECT e.r, e.vec_id, q.part, list_slice(e.v, q.part * w.d + 1, q.part * w.d + w.d) AS v FROM e, w, range({parts}) q(part)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM e QUALIFY entry < {entries}),
b0 AS (SELECT p.part, f.entry, p.v FROM p JOIN f ON p.r = f.r),{steps}
c AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.far)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS h FROM (
  SELECT part, entry, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM b{rounds}))
SELECT e.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY e.label))::BIGINT AS label_error, h.h AS codebooks_sha256
FROM e JOIN c ON e.r = c.r, h"""


ORACLE_SQL: dict[str, str] = {
    "op12_dual_tree_codes": codes_sql(),
    "op13_packed_negatives": f"""
WITH e AS (SELECT vec_id, v, r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_VECTORS}) WHERE label IS NOT NULL),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda j: a.v[j] * c.v[j]))::BIGINT AS score
      FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    "op6_block_anchors": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS low FROM x GROUP BY g),
c AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS k FROM x JOIN f ON x.g = f.g WHERE f.low < x.doc_id),
gone AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(list_transform(range(1, len(d.w) + 1),
           lambda k: CASE WHEN list_contains(coalesce(gone.ks, []), k) THEN NULL ELSE d.w[k] END), lambda v: v IS NOT NULL), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id""",
    "op7_source_mix": source_mix.mix_sql(),
    "op9_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
k AS (SELECT *, first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM f)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM k""",
    "op10_reply_trees": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {CONTROL_ID}, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT {CONTROL_ID}, 1, 'assistant', '{CONTROL_TEXT}'),
e AS (SELECT *, length(replace(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;')) AS chars FROM m),
t AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
             ({len(reply_trees.BEGIN)} + sum(chars + {len(reply_trees.OPEN + reply_trees.CLOSE + reply_trees.END)}))::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM t""",
    "op5_odd_sketch": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY x, y),
e AS (SELECT i.x, i.y FROM i JOIN n a ON a.doc_id = i.x JOIN n b ON b.doc_id = i.y WHERE 100 * i.c >= 75 * (a.n + b.n - i.c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id""",
}
