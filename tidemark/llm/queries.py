"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    cotraining, decontamination, exact_dedup, hard_negatives, importance, jaccard_join, language_id, mixing, pieces, sharding, suffix_tree, topk_search, url_filter,
)
from tidemark.llm.common import LOWER, UPPER, table


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode(docs, pieces.PieceModel.load(), verify=True)
    return done.select("row.doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"), "round_trip")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"), keep="largest")


OP5 = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm)"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions that follow from the text, so that copies share all coordinates."""
    dims = {"bytes": F.octet_length("text"), "n_chars": F.col("n_chars"), "lang": F.crc32("lang")}
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 16, dims=dims)


# The rules of the contract as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


OP10 = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
r AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) r(verdict, rule_host, rule_path)),
m AS (SELECT page_id, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
  arg_max(verdict, (length(rule_host || rule_path), length(rule_host))) AS verdict
  FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Words of lower-case ASCII letters, digits and whatever is not ASCII.
WORDS_OF = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11 = f"""WITH w AS (SELECT doc_id, {WORDS_OF} AS ws FROM documents), b AS (SELECT {WORDS_OF} AS ws FROM benchmark),
crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
f AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT unnest(ws) AS word FROM (SELECT ws FROM w UNION ALL SELECT ws FROM b))),
k AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM f, crc),
s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) JOIN k USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) JOIN k USING (word) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
  / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM (SELECT doc_id, unnest(ws) AS word FROM w) JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
d AS (SELECT w.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN m USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20
  QUALIFY rank <= (SELECT count(*) FILTER (n_features >= 20) * 10 // 100 FROM e))
SELECT e.*, rank FROM e LEFT JOIN r USING (doc_id)"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontamination.digest(found, "doc_id")


OP13 = f"""WITH d AS (SELECT doc_id, {WORDS_OF} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, {WORDS_OF} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
x AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS run FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM b) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, x.n FROM x JOIN win USING (n, run)),
cover AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""


QUERIES = {
    "op1_quality_cotraining": (op1_quality_cotraining, None),
    "op2_jaccard_join": (op2_jaccard_join, None),
    "op3_language_id": (op3_language_id, None),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_exact_dedup": (op5_exact_dedup, OP5),
    "op6_source_mixing": (op6_source_mixing, None),
    "op7_lm_scoring": (op7_lm_scoring, None),
    "op8_topk_search": (op8_topk_search, OP8),
    "op9_kd_sharding": (op9_kd_sharding, None),
    "op10_url_filter": (op10_url_filter, OP10),
    "op11_importance_resampling": (op11_importance_resampling, OP11),
    "op12_hard_negatives": (op12_hard_negatives, OP12),
    "op13_decontamination": (op13_decontamination, OP13),
}
