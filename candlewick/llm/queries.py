"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, caps, langid, lm, media, minhash, mixing, quality, quotes, tokenshards
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenshards.op1(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op2(table(spark, sf_dir, "documents"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op4(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.op7(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_media": op2_media,
    "op3_quotes": op3_quotes,
    "op4_language_model": op4_language_model,
    "op5_mix_sources": op5_mix_sources,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_cap_filters": op7_cap_filters,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
}

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))

#: The two whose rows SQL can state in full; both compare all pairs that can link, so they suit small tables.
ORACLES: dict[str, str] = {
    "op6_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_cap_filters": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT t.vec_id, coalesce(k.n, 0) AS n_links, c.c AS component_id, t.vec_id = c.c AS kept
FROM embeddings t JOIN c ON c.a = t.vec_id LEFT JOIN k ON k.x = t.vec_id""",
}
