"""The registered queries of the ten operators and of the pipeline, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, jaccard_join, lang_id, license_scan, line_dedup, mixing, mtree, pii, secret_scan, url_filter
from chronoweave.llm.common import table

#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, d, "documents"))


def op3_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, d, "documents"))


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, d, "pages"), URL_RULES)


def op5_lang_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = lang_id.train(docs, ~F.expr(HELD_OUT))
    found = lang_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_kept").cast("bigint").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@lru_cache(maxsize=1)
def _tagger() -> pii.Tagger:
    return pii.train_tagger(pii.labelled_examples())


def _count(kind: str) -> Column:
    """How many of the joined spans in `base` are of this kind."""
    return F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("bigint").alias(f"n_{kind}")


def _counts(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select("doc_id", *map(_count, kinds), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    return _counts(pii.find_pii(table(spark, d, "documents"), _tagger()), pii.KINDS)


def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return _counts(secret_scan.scan_secrets(table(spark, d, "documents")), secret_scan.KINDS[:3])


def op9_mtree_topk(spark: SparkSession, d: str) -> DataFrame:
    return mtree.top_inner_products(table(spark, d, "embeddings"), "vec_id % 20 = 0", 20)


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents").select("doc_id", "source"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_license_scan, op3_jaccard_join, op4_url_filter, op5_lang_id, op6_line_dedup, op7_pii, op8_secret_scan, op9_mtree_topk, op10_mixing, pipeline)
}

# ---------------------------------------------------------------- SQL


def _license_sql(templates: dict[str, str] = license_scan.TEMPLATES, threshold: float = license_scan.THRESHOLD) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in templates.items())
    return rf"""
WITH templates AS (
  SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM (SELECT license, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM (VALUES {values}) v(license, t))
), plain AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, -1 AS unit, regexp_replace(t, '\s+', ' ', 'g') AS u FROM plain
  UNION ALL
  SELECT doc_id, i - 1 AS unit, lines[i] AS u FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS lines FROM plain))
), grams AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT doc_id, unit, string_split(trim(u), ' ') AS w FROM units)
), scored AS (
  SELECT doc_id, unit, license, len(g) AS n, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams, templates WHERE len(g) > 0
)
SELECT doc_id, unit::INT AS unit, license, dice, n::INT AS n
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS place FROM scored WHERE dice >= {threshold} - 1e-9)
WHERE place = 1
"""


URL_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), hits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS place
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.place = 1
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 20
"""


def _dedup_sql(min_words: int = line_dedup.MIN_WORDS) -> str:
    """Later copies by windows from each line to the first, and to each line from the last, that makes `min_words` words."""
    return f"""
WITH lines AS (
  SELECT doc_id, i AS raw, trim(l[i], ' ' || chr(9) || chr(13)) AS line, l[i] AS whole FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), full_ AS (
  SELECT doc_id, raw, line, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS pos, len(string_split_regex(line, '\\s+')) AS words FROM lines WHERE line <> ''
), cum AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM full_
), windows AS (
  SELECT a.doc_id, a.pos, min(b.pos) AS last FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + {min_words} AND b.total - a.total + a.words >= {min_words} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos) AS pos, b.pos AS last FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + {min_words} AND b.total - a.total + a.words >= {min_words} GROUP BY b.doc_id, b.pos
), keyed AS (
  SELECT w.doc_id, w.pos, w.last, sha256(string_agg(c.line, chr(10) ORDER BY c.pos)) AS k FROM windows w JOIN cum c ON c.doc_id = w.doc_id AND c.pos BETWEEN w.pos AND w.last GROUP BY ALL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS place FROM keyed) WHERE place > 1
), gone AS (
  SELECT DISTINCT c.doc_id, c.raw FROM cum c JOIN later x ON c.doc_id = x.doc_id AND c.pos BETWEEN x.pos AND x.last
), kept AS (
  SELECT l.doc_id, string_agg(l.whole, chr(10) ORDER BY l.raw) AS text FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.raw = g.raw WHERE g.raw IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(n.n, 0) - coalesce(g.n, 0) AS n_kept, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM full_ GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def _mix_sql(block: int = mixing.BLOCK_ROWS, period: int = mixing.PERIOD) -> str:
    return f"""
WITH RECURSIVE src AS (
  SELECT CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s, source, doc_id, sha256(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), w AS (
  SELECT s, count(*) AS nrows, floor(sqrt(count(*)) * 1000)::BIGINT AS w FROM src GROUP BY s
), share AS (
  SELECT s, nrows, greatest(1, ({period} * w * 2 + sum(w) OVER ()) // (2 * sum(w) OVER ()))::BIGINT AS a, row_number() OVER (ORDER BY s) AS i FROM w
), one AS (
  SELECT list(a ORDER BY i) AS a, count(*) AS n, sum(a)::BIGINT AS p FROM share
), edf AS (
  SELECT -1::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS nxt, 0::BIGINT AS pick, 0::BIGINT AS j, a, n, p FROM one
  UNION ALL
  SELECT t, list_transform(range(1, n + 1), lambda i: nxt[i] + (i = pick)::BIGINT) AS nxt, pick, nxt[pick] AS j, a, n, p FROM (
    SELECT t + 1 AS t, nxt, a, n, p,
      list_sort(list_filter(list_transform(range(1, n + 1), lambda i: struct_pack(due := ((nxt[i] + 1) * p + a[i] - 1) // a[i], i := i, release := nxt[i] * p // a[i])), lambda c: c.release <= edf.t + 1))[1].i AS pick
    FROM edf WHERE t < p - 1)
), slots AS (
  SELECT share.s, share.a, edf.j, edf.t AS slot FROM edf JOIN share ON share.i = edf.pick WHERE edf.t >= 0
), fin AS (
  SELECT min((f.nrows // {block}) // f.a * one.p + slots.slot) AS fin FROM one, share f JOIN slots ON slots.s = f.s AND slots.j = (f.nrows // {block}) % f.a
), numbered AS (
  SELECT s, source, doc_id, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS n FROM src
)
SELECT doc_id, source, n // {block} AS mix_block, (n // {block}) // slots.a * one.p + slots.slot AS mix_slot, (n % {block})::INT AS mix_index,
       (n // {block}) // slots.a * one.p + slots.slot < fin.fin AS mix_exact
FROM (SELECT p FROM one) one, fin, numbered JOIN slots ON slots.s = numbered.s AND slots.j = (n // {block}) % slots.a
"""


ORACLE: dict[str, str] = {"op2_license_scan": _license_sql(), "op4_url_filter": URL_SQL, "op6_line_dedup": _dedup_sql(), "op9_mtree_topk": TOPK_SQL, "op10_mixing": _mix_sql()}
