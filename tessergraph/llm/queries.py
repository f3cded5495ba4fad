"""One query an operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_forest, jaccard_join, language_id, lm_scoring, mixing, pii, secret_scan, sentencepiece_codec, token_counts, topk_search

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": lambda spark, d: sentencepiece_codec.piece_digests(_documents(spark, d)),
        "op2_language_id": lambda spark, d: language_id.identify(_documents(spark, d)),
        "op3_secret_scan": lambda spark, d: secret_scan.scan(_documents(spark, d)),
        "op4_source_mixing": lambda spark, d: mixing.mix(_documents(spark, d)),
        "op5_lm_scoring": lambda spark, d: lm_scoring.score(_documents(spark, d)),
        "op6_token_counts": lambda spark, d: token_counts.document_token_counts(_documents(spark, d)),
        "op7_nearest_neighbours": lambda spark, d: ann_forest.nearest(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op8_topk_search": lambda spark, d: topk_search.similar_documents(_documents(spark, d)),
        "op9_jaccard_join": lambda spark, d: jaccard_join.jaccard_join(_documents(spark, d)),
        "op10_personal_data": lambda spark, d: pii.scan(_documents(spark, d)),
    }


_MIXING = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
                      md5(concat_ws(':', '{mixing.SEED}', CAST(doc_id AS VARCHAR))) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM sized GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS words FROM sources),
ordered AS (SELECT *, coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS filled, sum(weight) OVER onward AS open
            FROM sources WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                onward AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
marked AS (SELECT *, weight * ((words - filled) / open) > 3.0::DOUBLE * source_size OR source_size = 0 AS is_full FROM ordered, total),
level AS (SELECT (max(words) - coalesce(sum(3.0::DOUBLE * source_size) FILTER (WHERE is_full), 0)) / sum(weight) FILTER (WHERE NOT is_full) AS level FROM marked),
targets AS (SELECT source, source_size, least(weight * coalesce(level, 0), 3.0::DOUBLE * source_size) AS target FROM sources, level),
placed AS (SELECT s.*, t.source_size, t.target, CAST(coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS BIGINT) AS epochs,
                  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM placed
"""

_LM = rf"""
WITH listed AS (SELECT row_number() OVER (ORDER BY doc_id) AS doc, doc_id, {_WORDS} AS words FROM documents),
placed AS (SELECT doc, unnest(words) AS w, unnest(list_prepend(NULL, words[:-2])) AS v FROM listed WHERE len(words) > 0),
total AS (SELECT count(*) AS words FROM placed),
one AS (SELECT w, count(*) AS n FROM placed GROUP BY w),
two AS (SELECT v, w, count(*) AS n FROM placed WHERE v IS NOT NULL GROUP BY v, w),
scored AS (SELECT p.doc, CAST(round({lm_scoring._UNIT:.0f} * CASE WHEN b.n IS NOT NULL THEN ln(CAST(b.n AS DOUBLE) / c.n)
                                                ELSE CASE WHEN p.v IS NULL THEN 0 ELSE ln({lm_scoring.BACKOFF}::DOUBLE) END + ln(CAST(o.n AS DOUBLE) / t.words) END) AS BIGINT) AS units
           FROM placed p CROSS JOIN total t JOIN one o ON o.w = p.w LEFT JOIN two b ON b.v = p.v AND b.w = p.w LEFT JOIN one c ON c.w = p.v)
SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, s.units / {lm_scoring._UNIT:.1f}::DOUBLE / len(l.words) AS score
FROM listed l LEFT JOIN (SELECT doc, CAST(sum(units) AS DOUBLE) AS units FROM scored GROUP BY doc) s USING (doc)
"""

_BM25 = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
stats AS (SELECT count(*) AS docs, avg(len(words)) AS average FROM listed WHERE len(words) > 0),
term AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM listed) GROUP BY doc_id, word),
df AS (SELECT word, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM term, stats GROUP BY word),
scored AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(df.idf * q.tf * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(l.words) / s.average))), 6) AS score
           FROM term q JOIN term d ON d.word = q.word AND d.doc_id <> q.doc_id JOIN df ON df.word = q.word JOIN listed l ON l.doc_id = d.doc_id CROSS JOIN stats s
           WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_JACCARD = rf"""
WITH RECURSIVE listed AS (SELECT doc_id, {_WORDS} AS words FROM documents),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < {jaccard_join.SHINGLE} THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + {jaccard_join.SHINGLE - 1}], ' ') END AS s
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {jaccard_join.SHINGLE - 2}, 2))) AS i FROM listed WHERE len(words) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE k >= {jaccard_join.THRESHOLD} * (p.n + q.n - k) - 1e-9),
reach AS (SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y)
SELECT d.doc_id, coalesce((SELECT least(d.doc_id, min(y)) FROM reach r WHERE r.x = d.doc_id), d.doc_id) AS class_id,
       (SELECT count(*) FROM linked l WHERE l.x = d.doc_id) AS n_links
FROM documents d
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": _MIXING, "op5_lm_scoring": _LM, "op8_topk_search": _BM25, "op9_jaccard_join": _JACCARD}
