"""Not-modified captures resolved to the response they repeat, by an as-of join in DataFrame operations.

The latest earlier full response of the same canonical URL is taken over from row to row in time order. Time is cut into blocks, so that one
URL with a third of all captures is many window partitions; the last response of each block is carried to the later blocks by a second window
over one row for each block. Bodies never take part: the result refers to the response by its record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_SECONDS = 1 << 16
#: Fields that a not-modified response must not change, as the HTTP caching standard lists them (RFC 9111, 3.2).
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: str) -> str:
    """SQL: without scheme, leading www., fragment, tracking parameters and closing slash; host in lower case, parameters sorted."""
    bare = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^[A-Za-z]+://', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^www[.]', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    query = f"array_join(array_sort(filter(split(regexp_extract({bare}, '[?](.*)$', 1), '&'), p -> p <> '' AND NOT p RLIKE '{_TRACKING}')), '&')"
    return f"concat({host}, {path}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END)"


def resolve_revisits(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """``record_id``, ``url``, ``time``, ``refers_to``, ``verdict`` and ``headers`` for each revisit.

    Both inputs have ``record_id`` (long), ``url``, ``time`` (seconds), ``etag``, ``last_modified`` and ``headers`` (map, names in lower case).
    The verdict is ``resolved``, ``mismatch`` (a validator differs; an entity tag is decisive where both have one), ``unvalidated`` (no validator
    in common) or ``missing`` (no earlier response, or no URL or time). Only resolved and unvalidated revisits get headers: the response's, replaced
    or joined by those of the revisit that may change. Of responses at one time the largest record counts; one at the time of the revisit is not
    earlier. Repeated revisits stay; other columns are ignored.
    """
    names = ["record_id", "url", "time", "etag", "last_modified", "headers"]
    full, again = (df.selectExpr(*names, f"{canonical_url('url')} AS page", f"floor(time / {BLOCK_SECONDS}) AS block") for df in (responses, revisits))
    body = "struct(time, record_id, etag, last_modified, headers)"
    given = full.where("page IS NOT NULL AND time IS NOT NULL").selectExpr("page", "block", "time", "1 AS full", "record_id", f"{body} AS response", "cast(NULL AS struct<url: string, etag: string, last_modified: string, headers: map<string, string>>) AS own")
    asked = again.where("page IS NOT NULL AND time IS NOT NULL").selectExpr("page", "block", "time", "0 AS full", "record_id", "NULL AS response", "struct(url, etag, last_modified, headers) AS own")
    rows = given.unionByName(asked.withColumn("response", F.lit(None).cast(given.schema["response"].dataType)))
    # at one time revisits come first, so that a response of that time is not earlier
    near = rows.withColumn("near", F.expr("last(response, true) OVER (PARTITION BY page, block ORDER BY time, full, record_id ROWS UNBOUNDED PRECEDING)")).where("full = 0")
    lasts = given.groupBy("page", "block").agg(F.expr("max_by(response, struct(time, record_id))").alias("carried"))
    blocks = lasts.unionByName(asked.select("page", "block").distinct().withColumn("carried", F.lit(None).cast(given.schema["response"].dataType)))
    blocks = blocks.groupBy("page", "block").agg(F.first("carried", True).alias("carried"))
    blocks = blocks.withColumn("earlier", F.expr("last(carried, true) OVER (PARTITION BY page ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).where("earlier IS NOT NULL")
    found = near.join(blocks.select("page", "block", "earlier"), ["page", "block"], "left").withColumn("r", F.coalesce("near", "earlier"))
    out = found.selectExpr("record_id", "own.url AS url", "time", "r", "own.etag AS etag", "own.last_modified AS last_modified", "own.headers AS headers")
    lost = again.where("page IS NULL OR time IS NULL").selectExpr("record_id", "url", "time", "etag", "last_modified", "headers").withColumn("r", F.lit(None).cast(given.schema["response"].dataType))
    out = out.unionByName(lost)
    tag = "regexp_replace({}, '^W/', '')"
    verdict = f"""CASE WHEN r IS NULL THEN 'missing' WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN {tag.format('etag')} = {tag.format('r.etag')} THEN 'resolved' ELSE 'mismatch' END
    WHEN last_modified IS NOT NULL AND r.last_modified IS NOT NULL THEN CASE WHEN last_modified = r.last_modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END"""
    kept = ", ".join(f"'{h}'" for h in KEPT_HEADERS)
    changed = f"map_filter(coalesce(headers, map()), (k, v) -> NOT k IN ({kept}))"
    merged = f"map_concat(map_filter(coalesce(r.headers, map()), (k, v) -> NOT map_contains_key({changed}, k)), {changed})"
    out = out.withColumn("verdict", F.expr(verdict))
    return out.selectExpr("record_id", "url", "time", "r.record_id AS refers_to", "verdict", f"CASE WHEN verdict IN ('resolved', 'unvalidated') THEN {merged} END AS headers")


_TIME = "1600000000 + page_id * 977"


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full responses and revisits in the shape of an archive, derived from every page: each is captured whole once and asked for again twice."""
    tag = "concat('\"', md5(html), '\"')"
    known = pages.where("page_id IS NOT NULL").selectExpr("page_id", "url", f"{_TIME} AS time", f"{tag} AS etag", "length(html) AS size")
    full = known.selectExpr("page_id * 4 AS record_id", "url", "time", "CASE WHEN page_id % 3 <> 0 THEN etag END AS etag", "concat('day ', floor(time / 86400)) AS last_modified", "size").selectExpr(
        "record_id", "url", "time", "etag", "last_modified",
        "map_filter(map('content-type', 'text/html', 'content-length', cast(size AS string), 'etag', etag, 'date', cast(time AS string), 'server', 'a'), (k, v) -> v IS NOT NULL) AS headers")
    again = known.selectExpr("*", "explode(array(1, 2)) AS nth").selectExpr(
        "page_id * 4 + nth AS record_id", "url", "time + nth * 40000 - page_id % 7 * 9000 AS time", "CASE WHEN page_id % 5 = 0 THEN concat('W/', etag) WHEN page_id % 11 = 0 THEN '\"old\"' WHEN page_id % 4 <> 0 THEN etag END AS etag",
        "CASE WHEN page_id % 2 = 0 THEN concat('day ', floor(time / 86400)) END AS last_modified")
    again = again.withColumn("headers", F.expr("map_filter(map('date', cast(time AS string), 'etag', etag, 'cache-control', 'max-age=60', 'content-length', '0'), (k, v) -> v IS NOT NULL)"))
    return full, again


def resolved_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    del spark
    out = resolve_revisits(*captures(pages))
    return out.withColumn("headers", F.expr("array_join(array_sort(transform(map_entries(headers), e -> concat(e.key, ': ', e.value))), '; ')"))


def resolved_pages_sql() -> str:
    """DuckDB SQL for the query's rows."""
    bare = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '')"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{_TRACKING}'))), '&')"
    page = f"concat(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^www[.]', ''), regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', ''), CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END)"
    return f"""
WITH known AS (SELECT page_id, url, CASE WHEN url IS NOT NULL THEN {page} END AS page, {_TIME} AS time, concat('"', md5(html), '"') AS tag, length(html) AS size FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT page_id * 4 AS id, page, time, CASE WHEN page_id % 3 <> 0 THEN tag END AS etag, concat('day ', time // 86400) AS lm, size FROM known),
v AS (SELECT page_id * 4 + nth AS id, url, page, time + nth * 40000 - page_id % 7 * 9000 AS time,
CASE WHEN page_id % 5 = 0 THEN concat('W/', tag) WHEN page_id % 11 = 0 THEN '"old"' WHEN page_id % 4 <> 0 THEN tag END AS etag, CASE WHEN page_id % 2 = 0 THEN concat('day ', time // 86400) END AS lm FROM known, (VALUES (1), (2)) n(nth)),
latest AS (SELECT v.id AS vid, max(struct_pack(t := f.time, id := f.id)) AS m FROM v JOIN f ON v.page = f.page AND f.time < v.time GROUP BY v.id),
j AS (SELECT v.*, f.id AS fid, f.time AS ft, f.etag AS fe, f.lm AS fl, f.size FROM v LEFT JOIN latest ON vid = v.id LEFT JOIN f ON f.id = m.id),
k AS (SELECT *, CASE WHEN fid IS NULL THEN 'missing' WHEN etag IS NOT NULL AND fe IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = fe THEN 'resolved' ELSE 'mismatch' END
WHEN lm IS NOT NULL AND fl IS NOT NULL THEN CASE WHEN lm = fl THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS verdict FROM j)
SELECT CAST(id AS BIGINT) AS record_id, url, CAST(time AS BIGINT) AS time, CAST(fid AS BIGINT) AS refers_to, verdict,
CASE WHEN verdict IN ('resolved', 'unvalidated') THEN concat('cache-control: max-age=60; content-length: ', size, '; content-type: text/html; date: ', time, CASE WHEN coalesce(etag, fe) IS NULL THEN '' ELSE concat('; etag: ', coalesce(etag, fe)) END, '; server: a') END AS headers FROM k"""
