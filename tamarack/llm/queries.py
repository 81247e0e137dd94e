"""The queries of the corpus operators and the SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import centroids, decontamination, filter_audit, fingerprints, fixity, langid, licenses, mixing, pii, secrets, simhash, substrings, suffixes
from tamarack.llm._shared import WORD, documents


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "weight")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contained(documents(spark, sf_dir), items)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")]
    base, every = secrets.joined_spans(secrets.KINDS[:3]), secrets.joined_spans(secrets.KINDS)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with damage: some records are lost, some begin otherwise and are longer, so that later offsets move."""
    place = F.pmod(F.col("page_id") * 7919, F.lit(9797))
    hit = (place % 97 == 5) & F.col("html").startswith("<")
    html = F.when(hit, F.concat(F.lit("???"), F.col("html").substr(F.lit(2), F.length("html")))).otherwise(F.col("html"))
    return pages.where(~F.coalesce(place % 101 == 7, F.lit(False))).select("page_id", "url", html.alias("html"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return fixity.audit(fixity.manifest(pages), fixity.manifest(_damaged(pages)))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(documents(spark, sf_dir)))


QUERIES = {"op6_fixity": op6_fixity, "op8_licenses": op8_licenses, "op4_fingerprints": op4_fingerprints, "op7_langid": op7_langid, "op2_substrings": op2_substrings, "op9_suffixes": op9_suffixes, "op3_simhash": op3_simhash, "op10_secrets": op10_secrets, "op1_decontamination": op1_decontamination, "op5_mixing": op5_mixing, "op11_centroids": op11_centroids, "op12_pii": op12_pii, "op13_filter_audit": op13_filter_audit}

_REPEATS_SQL = """
flagged AS (
  SELECT s.doc_id, s.i, s.x, s.n, coalesce(max(h.hit) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS 49 PRECEDING), 0) AS gone
  FROM symbols s LEFT JOIN (
    SELECT w.doc_id, w.i, 1 AS hit FROM win w JOIN (SELECT key, min(doc_id) AS least FROM win GROUP BY key) f USING (key) WHERE w.doc_id > f.least) h
  ON s.doc_id = h.doc_id AND s.i = h.i),
edged AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM flagged),
told AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept
  FROM edged GROUP BY doc_id)
SELECT d.doc_id, coalesce(d.n, 0)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN told t USING (doc_id)
"""

_ASSIGN_SQL = """
near{r} AS (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.rid, c.cluster, list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM kept k, cent{r} c) GROUP BY rid)"""
_MOVE_SQL = """
cent{s} AS (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM cent{r} c LEFT JOIN (
    SELECT cluster, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM (SELECT n.cluster, i, sum(k.v[i]) AS t, count(*) AS n FROM near{r} n JOIN kept k USING (rid), range(1, 65) j(i) GROUP BY n.cluster, i) GROUP BY cluster) m
  USING (cluster))"""
_ROUNDS_SQL = ",".join(_ASSIGN_SQL.format(r=r) + "," + _MOVE_SQL.format(r=r, s=r + 1) for r in range(centroids.ROUNDS)) + "," + _ASSIGN_SQL.format(r=centroids.ROUNDS)

ORACLE_SQL = {
    "op13_filter_audit": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {{A: len(w) < 200, B: 100 * len(list_distinct(w)) < 50 * len(w), C: 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
           D: regexp_matches(t, '[#$%&*|]'), E: coalesce(d.doc_id > least, false)}} AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN told ON d.doc_id = told.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
sets AS (
  SELECT part, [l FOR l IN ['A', 'B', 'C', 'D', 'E'] IF CASE l WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END] AS failing,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL),
seen AS (
  SELECT part, o AS filter_order, step, failing, n, good, toxic, o[step] AS l, len([x FOR x IN failing IF instr(o, x) < step]) > 0 AS gone
  FROM sets, orders, range(1, 6) s(step)),
counts AS (
  SELECT part, filter_order, step, l,
         coalesce(sum(n) FILTER (NOT gone AND NOT list_contains(failing, l)), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND list_contains(failing, l)), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND list_contains(failing, l)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failing = [l]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND list_contains(failing, l)), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND list_contains(failing, l)), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley
FROM counts
""",
    "op11_centroids": rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])),
cent0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {centroids.CENTROIDS})),
{_ROUNDS_SQL}
SELECT k.vec_id, n.cluster::INT AS cluster, n.distance, sum(n.distance) OVER (PARTITION BY n.cluster)::BIGINT AS cluster_inertia, sum(n.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{centroids.ROUNDS} n JOIN kept k USING (rid) JOIN cent{centroids.ROUNDS} c USING (cluster)
""",
    "op2_substrings": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
symbols AS (SELECT doc_id, n, unnest(ws) AS x, unnest(range(1, n + 1)) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, greatest(n - 48, 1))) AS i FROM d)),
"""
    + _REPEATS_SQL,
    "op6_fixity": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS u, (page_id * 7919) % 9797 AS place, floor(page_id / 1000)::BIGINT + 1 AS file FROM pages),
s AS (
  SELECT *, (strlen('WARC/1.1..WARC-Type: resource..WARC-Record-ID: <urn:page:') + strlen(page_id::VARCHAR) + strlen('>..WARC-Target-URI: ') + strlen(u)
    + strlen('..Content-Type: text/html..Content-Length: ') + strlen(strlen(body)::VARCHAR) + 4 + strlen(body) + 4)::BIGINT AS length FROM p),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s)
SELECT file, "offset", length, page_id, 1::BIGINT AS copies, CASE WHEN place % 101 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE place % 101 = 7 OR (place % 97 = 5 AND starts_with(body, '<'))
""",
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS g FROM n),
t AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
g AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, greatest(len(w) - k + 2, 1))]) AS g
      FROM d, (SELECT DISTINCT k FROM n))
SELECT doc_id, item_id, n_item::INT AS n_item, count(*)::INT AS n_shared, count(*) / n_item AS containment
FROM g JOIN s USING (k, g) JOIN t USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)
""",
    "op5_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
tot AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t, sum(weight) AS w FROM src),
filled AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING), 0) AS held,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING), 0) AS gone,
         lead(cap / weight) OVER (ORDER BY cap / weight, source NULLS LAST) AS next_ratio
  FROM src),
levels AS (
  SELECT 0 AS k, t / w AS level, (SELECT min(ratio) FROM filled) AS upto FROM tot
  UNION ALL
  SELECT row_number() OVER (ORDER BY ratio, source NULLS LAST), (t - held) / (w - gone), next_ratio
  FROM filled, tot WHERE w > gone),
chosen AS (SELECT level FROM levels WHERE upto > level ORDER BY k LIMIT 1),
planned AS (
  SELECT source, source_size, weight, least(cap, coalesce((SELECT level FROM chosen) * weight, cap)) AS target FROM src),
split AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM planned),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.weight, s.whole,
         round(s.target - s.whole * s.source_size)::BIGINT AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 15), d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, weight::INT AS weight
FROM placed
""",
}
