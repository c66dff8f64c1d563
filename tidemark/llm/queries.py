"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import mark_matches
from tidemark.llm.embdedup import embedding_dedup
from tidemark.llm.langid import identify_language
from tidemark.llm.linededup import line_dedup
from tidemark.llm.lmscore import score_documents
from tidemark.llm.mixing import mix
from tidemark.llm.ngramjoin import ngram_join
from tidemark.llm.pii import find_pii
from tidemark.llm.toxicity import score_toxicity
from tidemark.llm.urlfilter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _remainder(divisor: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    training = docs.where(_remainder(3) != 1)
    found = identify_language(docs.select("doc_id", "text"), training)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return score_toxicity(docs, labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark_matches(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", F.col("m.item").alias("item_id"), "m.score", "m.first_word", "m.end_word")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_lm_score": op10_lm_score,
}

def _mix_sql(seed: int = 17, blocks: int = 1024, entropy_share: float = 0.95, repeats: float = 4.0, steps: int = 60) -> str:
    """Exponent by bisection in recursive CTEs, then the same keyed permutations."""
    key = lambda *what: f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(what)})), 1, 8))::BIGINT"
    words = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
    entropy = lambda a: f"(SELECT ln(sum(exp({a} * ls))) - sum(exp({a} * ls) * {a} * ls) / sum(exp({a} * ls)) FROM t)"
    most = lambda a: f"(SELECT max(exp({a} * ls) / tokens) / sum(exp({a} * ls)) * any_value(total) FROM t)"
    mid = "(lo + hi) / 2"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, {words}::BIGINT AS n_tokens,
  {key("'block'", "coalesce(doc_id::VARCHAR, '')")} % {blocks} AS block FROM documents),
b AS MATERIALIZED (SELECT source, block, sum(n_tokens)::BIGINT AS size FROM d GROUP BY source, block),
s AS (SELECT source, sum(size)::BIGINT AS tokens FROM b GROUP BY source HAVING sum(size) > 0),
t AS MATERIALIZED (SELECT *, sum(tokens) OVER ()::BIGINT AS total, ln(tokens / (sum(tokens) OVER ())::DOUBLE) AS ls, count(*) OVER () AS n FROM s),
goal AS (SELECT CASE WHEN max(n) > 1 THEN {entropy_share} * ln(max(n)) ELSE 0 END AS target FROM t),
e(k, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, {mid} AS mid, {entropy(mid)} >= (SELECT target FROM goal) AS good FROM e WHERE k < {steps})),
a1 AS (SELECT CASE WHEN {entropy('1.0')} >= (SELECT target FROM goal) THEN 1.0::DOUBLE ELSE (SELECT lo FROM e WHERE k = {steps}) END AS a),
r(k, lo, hi) AS (SELECT 0, 1::DOUBLE, a FROM a1 UNION ALL
  SELECT k + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, {mid} AS mid, {most(mid)} <= {repeats} AS good FROM r WHERE k < {steps})),
a2 AS MATERIALIZED (SELECT CASE WHEN {most('a')} <= {repeats} THEN a WHEN {most('1.0')} <= {repeats} THEN (SELECT lo FROM r WHERE k = {steps}) ELSE 1.0 END AS a FROM a1),
w AS (SELECT source, tokens, floor(exp(a * ls) / sum(exp(a * ls)) OVER () * total + 0.5)::BIGINT AS budget FROM t, a2),
p AS (SELECT source, budget // tokens AS whole, budget % tokens AS part FROM w),
o AS (SELECT b.*, row_number() OVER q AS block_rank, coalesce(sum(size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b WINDOW q AS (PARTITION BY source ORDER BY {key("'order'", "coalesce(source, '')", "block::VARCHAR")}, block)),
x AS (SELECT d.*, block_rank, whole, part - before AS left_, size,
    sum(n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY {key("'row'", "coalesce(d.doc_id::VARCHAR, '')")}, d.doc_id, n_tokens RANGE UNBOUNDED PRECEDING) AS spent
  FROM d JOIN o ON d.block = o.block AND d.source IS NOT DISTINCT FROM o.source JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, whole + CASE WHEN left_ <= 0 THEN 0 WHEN left_ >= size THEN 1 WHEN spent <= left_ THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, source, n_tokens, unnest(range(copies::BIGINT)) AS epoch, block_rank::INTEGER AS block_rank FROM c"""


ORACLE: dict[str, str] = {
    "op1_mix": _mix_sql(),
    "op5_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS d, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.d = l.a),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, m.c AS component_id, m.c = v.vec_id AS kept
FROM v JOIN m ON m.d = v.vec_id""",
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.d = e.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, x.c AS component_id
FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) x ON x.d = s.doc_id""",
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.i, r.key IS NOT NULL AND r.keeper <> k.doc_id AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
