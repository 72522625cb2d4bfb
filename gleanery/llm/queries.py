"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import codebooks_digest, labelled_errors, vector_codes
from .collocations import collocations
from .decontaminate import contained
from .jaccard import jaccard_components
from .licenses import license_scan
from .lines import line_dedup
from .quality import quality_scores
from .rules import quality_rules
from .suffixes import suffix_dedup
from .toxicity import toxicity_scores
from .unigram import round_trip, token_counts
from .urls import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded_digest(df: DataFrame, *more: str) -> DataFrame:
    """Of (doc_id, text, ids, decoded): doc_id, n_pieces, a hash of the ids, whether the text came back, and columns of `more`."""
    return df.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), *more)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes its ids; `ids_sha256` is of the ids as decimal text joined by blanks."""
    return encoded_digest(round_trip(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of each text, and a hash of what stays."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("node")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


#: The rules that pages are judged by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None if books is None else codebooks_digest(books)).cast("string")
    return labelled_errors(found).select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_classifier, op3_sentencepiece, op4_line_dedup, op5_quality_rules, op6_token_counts, op7_jaccard_join, op8_url_filter, op9_license_scan, op10_suffix_dedup, op11_vector_codes, op12_collocations, op13_toxicity)}

ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT *, row_number() OVER d AS n, sum(w) OVER d AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT a.doc_id, a.n, min(b.n) AS e, min(b.n) FILTER (b.upto >= a.upto + 50) AS next_e
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + 50 AND b.upto >= a.upto - a.w + 50 GROUP BY ALL),
t AS (SELECT doc_id, list(line ORDER BY n) AS lines FROM f GROUP BY doc_id),
m AS (SELECT doc_id, n, unnest(range(e, CASE WHEN next_e IS NULL THEN len(lines) + 1 ELSE greatest(next_e, e + 1) END)) AS b, lines FROM w JOIN t USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(lines[n:b], chr(10)) ORDER BY doc_id, n) AS nth FROM m),
r AS (SELECT doc_id, n AS a, b FROM o WHERE nth > 1),
s AS (SELECT f.doc_id, f.pos, x.n IS NOT NULL AS gone FROM f LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS n FROM r) x ON f.doc_id = x.doc_id AND f.n = x.n),
v AS (SELECT l.doc_id, l.pos, coalesce(s.gone, last_value(s.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AND first_value(s.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS gone FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.pos = s.pos),
g AS (SELECT doc_id, pos FROM v WHERE gone),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
""",
    "op8_url_filter": r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m LEFT JOIN r ON rule = rh || rp
""",
    "op11_vector_codes": r"""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (
  SELECT row, p, list_transform(embedding[p * len(embedding) // 16 + 1 : (p + 1) * len(embedding) // 16], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM kept, range(16) r(p)),
books0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM parts WHERE row <= 64),
near0 AS MATERIALIZED (
  SELECT q.row, q.p, arg_min(b.e, (list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e)) AS e,
    min(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d
  FROM parts q JOIN books0 b USING (p) GROUP BY q.row, q.p),
books1 AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v
  FROM books0 b LEFT JOIN (
    SELECT p, e, list(floor_mean ORDER BY j) AS v FROM (
      SELECT n.p, n.e, j, ((sum(q.v[j]) - ((sum(q.v[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM near0 n JOIN parts q USING (row, p), (SELECT unnest(range(1, max(len(v)) + 1)) AS j FROM parts) i GROUP BY n.p, n.e, j)
    GROUP BY p, e) m USING (p, e)),
near1 AS MATERIALIZED (
  SELECT q.row, q.p, arg_min(b.e, (list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e)) AS e,
    min(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d
  FROM parts q JOIN books1 b USING (p) GROUP BY q.row, q.p),
books2 AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v
  FROM books1 b LEFT JOIN (
    SELECT p, e, list(floor_mean ORDER BY j) AS v FROM (
      SELECT n.p, n.e, j, ((sum(q.v[j]) - ((sum(q.v[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM near1 n JOIN parts q USING (row, p), (SELECT unnest(range(1, max(len(v)) + 1)) AS j FROM parts) i GROUP BY n.p, n.e, j)
    GROUP BY p, e) m USING (p, e)),
near2 AS MATERIALIZED (
  SELECT q.row, q.p, arg_min(b.e, (list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e)) AS e,
    min(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d
  FROM parts q JOIN books2 b USING (p) GROUP BY q.row, q.p),
codes AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM books2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM kept JOIN codes USING (row), digest
""",
    "op12_collocations": r"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM t),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 4) r(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, cut, array_to_string(ws[1:cut], ' ') AS one, array_to_string(ws[cut + 1:], ' ') AS two FROM c, range(1, 3) x(cut) WHERE cut < c.k),
s AS (
  SELECT x.*, l.a AS l, r.a AS r, (1000000::HUGEINT * x.a * x.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = one JOIN f r ON r.lang = x.lang AND r.phrase = two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT b.lang, b.phrase FROM b JOIN c ON b.lang = c.lang AND b.k = 2 AND c.k = 3 AND b.phrase IN (array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')) AND 100 * c.a >= 50 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE (lang, phrase) NOT IN (SELECT lang, phrase FROM d))
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
""",
}
