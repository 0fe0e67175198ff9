"""The registered queries of this subpackage: each applies one operator, with production parameters,
to its whole table and derives the columns that are asked for from the operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


OP1_SQL = """
WITH lower AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM lower
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, win, len(win) AS n FROM (
    SELECT item, ws[i : i + least(10, len(ws)) - 1] AS win
    FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)
  )
), doc_windows AS (
  SELECT r, n, i, ws[i : i + n - 1] AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows))
), hits AS (
  SELECT r, i, d.n, item FROM doc_windows d JOIN item_windows w ON d.win = w.win
), hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.toxicity import toxicity

    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.simhash import hex_of, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.substring import repeats

    return repeats(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT r, doc_id, i, ws[i : i + 12] AS win FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs)
), least AS (
  SELECT win, min(doc_id) AS first FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows w JOIN least l ON w.win = l.win WHERE first < doc_id
), counts AS (
  SELECT r, count(*) AS n, list(p) AS ps FROM gone GROUP BY r
), words AS (
  SELECT r, ws[p] AS w, p FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM docs)
), kept AS (
  SELECT w.r, string_agg(w, ' ' ORDER BY w.p) AS t FROM words w ANTI JOIN gone g ON w.r = g.r AND w.p = g.p GROUP BY w.r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages, written and read, against a copy of its files in which records were
    changed: of every 50 one has a wrong byte, of every 5,000 one is lost and one has a byte more."""
    from quadrille.llm.common import scratch_path
    from quadrille.llm.warc import audit, copy, write

    def change(rows: DataFrame) -> DataFrame:
        number = F.coalesce(F.regexp_extract("id", "(-?[0-9]+)>", 1).cast("long"), F.lit(0))
        end = "\r\n\r\n"
        head = F.substring_index("value", end, 1)
        body = F.expr("substring(value, length(substring_index(value, '\r\n\r\n', 1)) + 5)")
        more = F.concat(F.regexp_replace(head, "[0-9]+$", ""), (F.regexp_extract(head, "([0-9]+)$", 1).cast("long") + 1).cast("string"), F.lit(end), body, F.lit("x"))
        wrong = F.concat(head, F.lit(end), F.regexp_replace(body, "(?s)^([^<]*)<", "$1>"))
        value = F.when(number % 50 == 7, wrong).when(number % 5000 == 23, more).otherwise(F.col("value"))
        return rows.where(number % 5000 != 11).withColumn("value", value)

    path, replica = scratch_path(spark, "archive"), scratch_path(spark, "replica")
    write(table(spark, sf_dir, "pages"), path)
    copy(spark, path, replica, change)
    return audit(spark, path, replica)


OP6_SQL = """
WITH bodies AS (
  SELECT page_id, url, chr(13) || chr(10) AS e, coalesce(html, '') AS html,
    CASE WHEN page_id % 50 = 7 THEN regexp_replace(coalesce(html, ''), '<', '>') WHEN page_id % 5000 = 23 THEN coalesce(html, '') || 'x' ELSE coalesce(html, '') END AS other
  FROM pages
), heads AS (
  SELECT *, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none')
    || '>' || e || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || translate(coalesce(url, ''), e, '  ')
    || e || 'Content-Type: text/html' || e || 'Content-Length: ' AS head
  FROM bodies
), records AS (
  SELECT page_id, url, '<urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' AS id, trim(translate(coalesce(url, ''), e, '  ')) AS uri,
    head || strlen(html) || e || e || html || e || e AS record, head || strlen(other) || e || e || other || e || e AS changed, coalesce(page_id % 5000 = 11, false) AS lost
  FROM heads
), hashed AS (
  SELECT *, sha256(record) AS sha256, CAST(strlen(record) AS BIGINT) AS length, CASE WHEN lost THEN 0 ELSE strlen(changed) END AS left_length FROM records
), files AS (
  SELECT *, CAST(coalesce(floor(page_id / 65536), -1) * 64 + CAST('0x' || substr(sha256, 1, 4) AS BIGINT) % 64 AS BIGINT) AS file FROM hashed
), parts AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256) - 1 AS BIGINT) // 4096 AS part FROM files
), placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER w, 0) AS BIGINT) AS "offset", CAST(coalesce(sum(left_length) OVER w, 0) AS BIGINT) AS there
  FROM parts WINDOW w AS (PARTITION BY file, part ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), told AS (
  SELECT *, CASE WHEN lost THEN 'lost' WHEN record <> changed THEN 'damaged' WHEN "offset" <> there THEN 'moved' ELSE 'intact' END AS verdict FROM placed
)
SELECT file, part, "offset", length, id, uri, sha256, verdict, verdict IN ('intact', 'moved') AS intact FROM told
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    from quadrille.llm.secrets import BASE, RULES

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"""
  SELECT r, {k} AS k, '{r.kind}' AS kind, start, start + len(ms[i]) AS stop
  FROM (
    SELECT r, ms, gs, i, CAST(list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start
    FROM (SELECT r, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT r, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {r.group}) AS gs, regexp_split_to_array(text, {p}) AS ps FROM docs WHERE regexp_matches(text, {p})))
    WHERE len(gs[i]) >= {r.least}
  )""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({"  UNION ALL".join(parts)}),
rows AS (SELECT r, {counts}, {listed} FILTER (WHERE k < {len(BASE)}) AS base, {listed} AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN rows USING (r)
"""


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.fingerprints import edit_test, grouped

    docs = table(spark, sf_dir, "documents")
    return grouped(edit_test(docs), docs)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quadrille.llm.bpe import tokenize

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_html_text, op4_simhash, op5_substring, op6_warc_fixity, op7_secret_scan, op8_fingerprint, op9_quality, op10_byte_bpe)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op5_substring": OP5_SQL, "op6_warc_fixity": OP6_SQL, "op7_secret_scan": op7_sql()}
