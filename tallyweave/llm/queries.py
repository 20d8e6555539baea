"""The thin queries of this package, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, licences, mixing, pii, quality, repeats, secrets, sharding, tokencounts


TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard_join, op2_mixing, op3_decontamination, op4_licences, op5_secrets, op6_quality, op7_sharding, op8_repeats, op9_token_counts, op10_pii)
}
LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
SPACED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NIBBLES = [f"{i:04b}" for i in range(16)]

#: For DuckDB. The others' methods have no SQL form for their whole result and are tested against plain Python.
ORACLES: dict[str, str] = {
    "op1_jaccard_join": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {SPACED} AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT any_value(d.doc_id) AS doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.a JOIN d o ON o.rid = reach.b LEFT JOIN n ON n.rid = d.rid GROUP BY reach.a""",
    "op3_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM} AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 13) AS s FROM (SELECT item_id, {ALNUM} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, s, array_to_string(ws[p:p + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - s + 2)) AS p FROM i)),
dw AS (SELECT rid, p, s, array_to_string(ws[p:p + s - 1], ' ') AS g FROM (SELECT rid, ws, s, unnest(range(1, len(ws) - s + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT s FROM iw) WHERE len(ws) >= s)),
h AS (SELECT rid, p, s, item_id FROM dw JOIN iw USING (s, g)),
cov AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + s)) AS x FROM h) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT rid, item_id::VARCHAR AS t FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN ids USING (rid)""",
    "op7_sharding": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS m FROM documents),
b AS (SELECT rid, doc_id, n, array_to_string(list_transform(range(1, 17), lambda i: {NIBBLES}[instr('0123456789abcdef', m[i])]), '') AS b FROM d),
e AS (SELECT rid, n, b[1:k] AS p, k FROM b, range(65) AS t(k)),
s AS (SELECT k, p, sum(n) AS size, count(*) AS c FROM e GROUP BY ALL),
f AS (SELECT rid, min(k) AS k FROM e JOIN s USING (k, p) WHERE size <= {sharding.LIMIT} OR c = 1 GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, p AS shard, f.k::INTEGER AS shard_depth, size::BIGINT AS shard_bytes FROM f JOIN b USING (rid) JOIN s ON s.k = f.k AND s.p = b.b[1:f.k]""",
}
