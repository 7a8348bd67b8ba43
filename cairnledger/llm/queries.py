"""The registered queries of the corpus operators, over whole tables and whole texts, and their SQL where SQL can state them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, backoff, bpe, chunks, html, merkle, minhash, mixing, outliers, secrets, token_cache, warc, whitening
from .common import own_folder

PIECES, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"
#: Tokens beyond which a text does not fit a context window.
TOKEN_LIMIT = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken_words(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(documents(spark, sf_dir))


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir)).drop("lang", "source")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so each run counts every distinct text once."""
    cache = f"{own_folder(spark)}/token_counts-{uuid.uuid4().hex}"
    counted = token_cache.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECES), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded to four decimals, so that the order of additions doesn't show."""
    return backoff.score(documents(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.span_names(F.col("base")), 256).alias("base_sha256"),
        secrets.span_names(F.col("spans")).alias("spans"),
        "n_live", "n_example",
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), keep=["doc_id"], decoded_col="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay in the application's folder until clean() is called."""
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_substrings, op3_outliers, op4_token_counts, op5_near_duplicates,
        op6_merkle, op7_backoff, op8_secrets, op9_bpe, op10_html, op11_warc, op12_alignment, op13_whitening,
    )
}

#: Words of a text as a list, A-Z lowered.
WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '')"""

#: Mixing by running sums over the hashes in order; links by counting common shingles of all pairs that have one, and components by recursion.
#: The other operators' results hold hashes, positions, encodings or iterated estimates, which SQL does not state; their tests are by brute force. Scores by counts of words
#: and of pairs, each less the document's own.
ORACLE: dict[str, str] = {
    "op1_mixing": r"""WITH
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws(chr(31), coalesce('=' || CAST(doc_id AS VARCHAR), '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS nth FROM s),
v AS (SELECT nth, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap / w AS full_at FROM o),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, nth) FROM v WHERE level <= full_at)) AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM d GROUP BY source, h),
k AS (SELECT g.source, h, CASE WHEN before + words <= target - whole * source_size OR (before <= target - whole * source_size AND 2 * (target - whole * source_size - before) >= words) THEN 1 ELSE 0 END AS once
    FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + once) AS BIGINT) AS taken FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h""",
    "op6_merkle": r"""WITH
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS at_row FROM documents),
e AS (SELECT at_row, doc_id, text, coalesce(lead(text) OVER (ORDER BY at_row), first_value(text) OVER (ORDER BY at_row)) AS following FROM d),
x AS (SELECT *, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited FROM e),
t AS (SELECT at_row, 'own' AS kind, text FROM x UNION ALL SELECT at_row, 'edited', edited FROM x UNION ALL SELECT at_row, 'next', following FROM x),
leaves AS (SELECT at_row, kind, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, ' *(?:[^ ]+ *){1,8}| +'), lambda w: md5(w)))) AS ss FROM t),
inner_ AS (SELECT at_row, kind, list_transform(ss, lambda s: list_transform(s, lambda p: struct_pack(d := md5(coalesce(array_to_string(p, ''), '')), o := p))) AS ss FROM leaves),
tops AS (SELECT at_row, kind, list_transform(ss, lambda s: struct_pack(d := md5(array_to_string(list_transform(s, lambda p: p.d), '')), o := s)) AS ss FROM inner_),
f AS (SELECT at_row, kind, left(sha256(array_to_string(list_transform(ss, lambda s: s.d), '')), 32) || '/' || array_to_string(list_transform(ss, lambda s: left(s.d, 8) || '(' ||
    array_to_string(list_transform(s.o, lambda p: left(p.d, 8) || coalesce(array_to_string(list_transform(p.o, lambda l: '.' || left(l, 6)), ''), '')), ',') || ')'), ';') AS f FROM tops),
w AS (SELECT at_row, max(f) FILTER (kind = 'own') AS a, max(f) FILTER (kind = 'edited') AS b, max(f) FILTER (kind = 'next') AS c FROM f GROUP BY at_row),
l AS (SELECT *, list_distinct(regexp_extract_all(a, '\.([0-9a-f]{6})', 1)) AS la, list_distinct(regexp_extract_all(b, '\.([0-9a-f]{6})', 1)) AS lb, list_distinct(regexp_extract_all(c, '\.([0-9a-f]{6})', 1)) AS lc FROM w)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
    CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_intersect(la, lb)) / CAST(greatest(len(la), len(lb), 1) AS DOUBLE) END AS near_edited,
    CASE WHEN a = c THEN 1.0::DOUBLE ELSE len(list_intersect(la, lc)) / CAST(greatest(len(la), len(lc), 1) AS DOUBLE) END AS near_next FROM x JOIN l USING (at_row)""",
    "op11_warc": r"""WITH
p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NULL OR page_id <> first THEN first END AS refers_to, url, CAST(NULL AS VARCHAR) AS problem FROM p JOIN f USING (html)""",
    "op7_backoff": f"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
n AS (SELECT CAST(coalesce(sum(len(ws)), 0) AS DOUBLE) AS n FROM d),
e AS (SELECT r, len(ws) AS l, i, ws[i] AS b, CASE WHEN i > 1 THEN ws[i - 1] END AS a FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
w AS (SELECT b AS word, count(*) AS c FROM e GROUP BY 1), p AS (SELECT a, b, count(*) AS c FROM e WHERE i > 1 GROUP BY 1, 2),
ow AS (SELECT r, b AS word, count(*) AS c FROM e GROUP BY 1, 2), op AS (SELECT r, a, b, count(*) AS c FROM e WHERE i > 1 GROUP BY 1, 2, 3),
ww AS (SELECT r, word, w.c - ow.c AS c FROM ow JOIN w USING (word)), pp AS (SELECT r, a, b, p.c - op.c AS c FROM op JOIN p USING (a, b)),
t AS (SELECT e.r, CASE WHEN pp.c > 0 THEN log10(pp.c / CAST(greatest(1, f.c) AS DOUBLE))
    ELSE log10(CASE WHEN e.i > 1 THEN 0.4 ELSE 1.0 END * CASE WHEN s.c > 0 THEN s.c ELSE 0.4 END / greatest(1, n.n - e.l)) END AS score
    FROM e CROSS JOIN n JOIN ww s ON s.r = e.r AND s.word = e.b LEFT JOIN ww f ON f.r = e.r AND f.word = e.a LEFT JOIN pp ON pp.r = e.r AND pp.a = e.a AND pp.b = e.b)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(s, 4) AS log_score, round(s / len(ws), 4) AS mean_log_score FROM d LEFT JOIN (SELECT r, sum(score) AS s FROM t GROUP BY 1) USING (r)""",
    "op5_near_duplicates": r"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS shingle
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT doc_id, shingle, n FROM s JOIN n USING (doc_id)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 80 * (an + bn - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
}
