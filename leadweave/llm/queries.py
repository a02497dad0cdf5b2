"""The registered queries of this package and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.exact_dedup import exact_dedup

    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_mixing", r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
closing AS (
  SELECT *, (1.5 * sum(source_size) OVER () - sum(2 * source_size) OVER upto) / nullif(sum(weight) OVER () - sum(weight) OVER upto, 0) AS level,
    lead(2 * source_size / weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS next_limit, count(*) OVER upto AS closed
  FROM sources WINDOW upto AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT 1.5 * sum(source_size) / sum(weight) AS level, min(2 * source_size / weight) AS next_limit, 0 AS closed FROM sources
  UNION ALL SELECT level, next_limit, closed FROM closing),
goals AS (
  SELECT source, source_size, least(2 * source_size, (SELECT arg_min(level, closed) FROM levels WHERE level < next_limit) * weight) AS target, 1.5 * sum(source_size) OVER () AS budget
  FROM sources),
queued AS (
  SELECT sized.*, source_size, target, budget, sum(size) OVER (PARTITION BY sized.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS done
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source),
entries AS (
  SELECT doc_id, source, key, size, pass, budget, (pass * source_size + done) / target AS finish
  FROM queued, (VALUES (0), (1)) AS passes(pass) WHERE size > 0 AND target > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, pass, size ROWS UNBOUNDED PRECEDING) AS total FROM entries)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM served WHERE total <= budget GROUP BY doc_id) t ON q.doc_id = t.doc_id""")
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.mixing import mix

    docs = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.secret_scan import scan_secrets

    return scan_secrets(read_table(spark, folder, "documents"))


@query("op6_bpe")
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from leadweave.llm.bpe import encoding_digests

    return encoding_digests(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, folder, "documents"), percent=85)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.toxicity import fit_toxicity, score_toxicity

    docs = read_table(spark, folder, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, folder, "labels")))


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from leadweave.llm.lm import score_held_out

    return score_held_out(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_top_k", """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a * c.vec[i] FOR a, i IN q.vec]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20""")
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.topk import top_k

    return top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.license_scan import scan_licenses

    return scan_licenses(read_table(spark, folder, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.quality import score_quality

    return score_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op11_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
uses AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT u.lang, u.source, u.term, count(*) AS c FROM uses u JOIN kept k ON u.lang = k.lang AND u.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
g AS (
  SELECT p.lang, p.source, CAST(coalesce(n, 0) AS HUGEINT) AS n, CAST(coalesce(v, 0) AS HUGEINT) AS v
  FROM (SELECT DISTINCT lang, source FROM d) p LEFT JOIN sizes s ON p.lang = s.lang AND p.source = s.source LEFT JOIN v ON p.lang = v.lang),
rates AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * CAST(coalesce(c, 0) + 2 AS HUGEINT)) // (n + 2 * v) AS p
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
langs AS (
  SELECT t.lang, t.term, 1 + (1000000000 * (t.c + 2)) // (z.n + 2 * z.v) AS q
  FROM (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM rates GROUP BY ALL) t JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY lang) z ON t.lang = z.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT r.lang, r.source, r.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM rates r JOIN langs l ON r.lang = l.lang AND r.term = l.term WHERE r.c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""")
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.divergence import source_divergence

    return source_divergence(read_table(spark, folder, "documents"))


@query("op12_lexical_search", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
size AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, r, len(terms) AS n, unnest(terms) AS term FROM d),
uses AS (SELECT doc_id, r, n, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * size.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM uses GROUP BY term), size),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * u.n * size.n) // size.l)))) AS BIGINT) AS score
  FROM q JOIN uses u ON q.term = u.term JOIN weights ON weights.term = q.term, size GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""")
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.lexical_search import ranked_search

    return ranked_search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op13_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13),
k AS (SELECT r, doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS window_key FROM w),
hit AS (SELECT k.r, k.i FROM k JOIN (SELECT window_key, min(doc_id) AS lo FROM k GROUP BY window_key) m ON k.window_key = m.window_key AND k.doc_id > m.lo),
cut AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM hit),
lost AS (SELECT r, list(p) AS gone FROM cut GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([words[p] FOR p IN range(1, len(words) + 1) IF gone IS NULL OR NOT list_contains(gone, p)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost ON d.r = lost.r""")
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from leadweave.llm.repeats import substring_dedup

    return substring_dedup(read_table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
