"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, html_extract, language_id, line_dedup, lm_scoring, ngram_join, source_mixing, topk_search, toxicity

Query = Callable[[SparkSession, str], DataFrame]
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents).select("doc_id", "n_lines", "n_removed", "text")


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return source_mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.against_next(_table(spark, folder, "documents").select("doc_id", "text"))


def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    words = lm_scoring.vocabulary(documents)
    net, table = lm_scoring.train(documents, words), lm_scoring.spelling(documents, words)
    return lm_scoring.score(documents, words, net, table=table).select("doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood")


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(_table(spark, folder, "documents").select("doc_id", "text"), 3, Fraction(9, 10)).select("doc_id", "n_shingles", "component_id", "class_id")


def op7_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_table(spark, folder, "pages"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    fold = language_id.fold(F.col("doc_id"))
    model = language_id.learn(documents.filter(fold != 1).select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    out = language_id.identify(documents.select("doc_id", "text", held_out), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    out = byte_bpe.digests(documents, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.sample(documents, _table(spark, folder, "labels")))
    return toxicity.score(documents, model).select("doc_id", "severity", "grade", "toxic_pred")


_ORACLES: dict[str, str] = {}

#: A run deleted is a longest run of equal lines, blank ones passed over, at an earlier and a later place, with 50 words.
_ORACLES["op1_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), full_lines AS (
  SELECT doc_id, line, trim(value, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         len(regexp_extract_all(value, '[^\x20\x09-\x0D]+')) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place
  FROM split WHERE regexp_matches(value, '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT b.doc_id, b.line, b.place, b.n, a.doc_id AS other, b.place - a.place AS apart
  FROM full_lines a JOIN full_lines b ON a.body = b.body AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.place < b.place)
), islands AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, other, apart ORDER BY place) AS island FROM pairs
), runs AS (
  SELECT doc_id, min(line) AS start, max(line) AS stop FROM islands GROUP BY doc_id, other, apart, island HAVING sum(n) >= 50
), kept AS (
  SELECT s.doc_id, string_agg(s.value, chr(10) ORDER BY s.line) AS text
  FROM split s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = s.doc_id AND s.line BETWEEN r.start AND r.stop) GROUP BY s.doc_id
), counted AS (
  SELECT f.doc_id, count(*) AS n_lines,
         count(*) FILTER (WHERE EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = f.doc_id AND f.line BETWEEN r.start AND r.stop)) AS n_removed
  FROM full_lines f GROUP BY f.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

_ORACLES["op2_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('mix-1|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
            / (1.0::DOUBLE + log10(1.0::DOUBLE + size) / 3.0::DOUBLE) AS key
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level,
         cap / weight AS ratio
  FROM weighted WINDOW below AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final_level AS (
  SELECT level FROM leveled WHERE cap > level * weight ORDER BY ratio, place LIMIT 1
), targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM final_level) * weight), cap) AS target FROM leveled
), spread AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id) AS through
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, target - epochs * source_size AS rest, through - (target - epochs * source_size) AS over FROM spread
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN over <= 0 OR (over - size < 0 AND over <= size - over) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn"""


_ORACLES["op4_topk_search"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

_ORACLES["op6_ngram_join"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded
), sized AS (
  SELECT doc_id, len(s) AS n, s FROM shingled
), each AS (
  SELECT doc_id, n, unnest(s) AS s FROM sized
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, c.component_id,
       coalesce(k.class_id, z.doc_id) AS class_id
FROM sized z JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = z.doc_id
LEFT JOIN (SELECT list_sort(s) AS s, min(doc_id) AS class_id FROM sized WHERE n > 0 GROUP BY list_sort(s)) k ON k.s = list_sort(z.s)"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
