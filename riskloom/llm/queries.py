"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import spans as S
from .bpe import bpe
from .decontaminate import decontaminate
from .jaccard_join import jaccard_join
from .langid import language_id
from .pii import pii_scan
from .quality import quality
from .secrets import secret_scan
from .substring_dedup import substring_dedup
from .token_count import token_count
from .urlfilter import url_filter
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, digest, vector_codes
from .warc import read_bundles, write_bundles

#: The contract's url rules (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(_table(spark, sf_dir, "documents"))
    counts = [S.count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(S.text_of("base"), 256).alias("base_sha256"), S.text_of("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(_table(spark, sf_dir, "pages")))


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_scan(_table(spark, sf_dir, "documents"))
    counts = [S.count_of("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(S.text_of("base"), 256).alias("base_sha256"), S.text_of("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_pii_scan": op8_pii_scan,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_count": op12_token_count,
    "pipeline": corpus_pipeline.run,
}


def _lloyd() -> str:
    """Rounds of plain assignment to the nearest entry and floored means, one pair of tables a round (DuckDB)."""
    books = []
    for r in range(ROUNDS + 1):
        books.append(
            f"""a{r} AS MATERIALIZED (SELECT x.r, x.part, arg_min(b.entry, (list_inner_product(b.c, b.c) - 2 * list_inner_product(x.c, b.c), b.entry)) AS entry,
         min(list_inner_product(b.c, b.c) - 2 * list_inner_product(x.c, b.c)) + any_value(list_inner_product(x.c, x.c)) AS d FROM x JOIN b{r} b ON b.part = x.part GROUP BY x.r, x.part)"""
        )
        if r < ROUNDS:
            books.append(
                f"""m{r} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM (SELECT a.part, a.entry, unnest(x.c) AS v, generate_subscripts(x.c, 1) AS i FROM a{r} a JOIN x ON x.r = a.r AND x.part = a.part) GROUP BY part, entry, i) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
            )
    return ",\n".join(books)


#: A word list of a text, as the contract has it (DuckDB); null has none.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, list_aggregate(list_slice(w, s, s + 19), 'string_agg', ' ') AS k FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE n > 1),
x AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n_kept
      FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + 3), 'string_agg', ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id
      JOIN n u ON u.doc_id = x.doc_id JOIN n v ON v.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, u.n, v.n HAVING 100 * count(*) >= 85 * (u.n + v.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k FROM s),
l AS (SELECT DISTINCT n FROM k),
p AS (SELECT d.doc_id, l.n, d.w, unnest(range(1, CAST(len(d.w) - l.n + 2 AS BIGINT))) AS i FROM d, l WHERE len(d.w) >= l.n),
x AS (SELECT doc_id, n, i, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k FROM p),
m AS (SELECT x.doc_id, x.i, x.n, k.item_id FROM x JOIN k ON x.n = k.n AND x.k = k.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op6_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM r WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS x FROM d),
t AS (SELECT doc_id, max(n) AS n_top, sum(n * CAST(regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]') AS INT)) AS n_lettered
      FROM (SELECT doc_id, x, count(*) AS n FROM x GROUP BY doc_id, x) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(d.text, '[^!]', '', 'g')) AS n_bangs,
             coalesce(u.n_lines, 0) AS n_lines, coalesce(u.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, t.n_top, t.n_lettered
      FROM d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > 3 * n_words OR n_bangs > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 5 * n_lettered < n_words OR 10 * n_top > 6 * n_words) AS kept FROM f""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS s FROM p),
m AS (SELECT s, max(page_id) AS top FROM q WHERE n >= 1000 GROUP BY s)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.s AS payload_digest,
       CASE WHEN m.top > q.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m.top > q.page_id THEN m.top END AS refers_to
FROM q LEFT JOIN m ON m.s = q.s AND q.n >= 1000""",
    "op11_vector_codes": f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id) AS r
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p AS part, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS c FROM (SELECT r, v, unnest(range({PARTS})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, c FROM x WHERE r <= {ENTRIES}),
{_lloyd()},
e AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', CAST(a.entry AS INT)), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM k JOIN a{ROUNDS} a ON a.r = k.r GROUP BY k.r, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{ROUNDS})) AS codebooks_sha256
FROM e""",
    "op9_url_filter": r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
b AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT c.page_id, c.host, c.path, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS n
      FROM c LEFT JOIN r ON (c.host = r.h OR c.host LIKE '%.' || r.h) AND starts_with(c.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1""",
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
