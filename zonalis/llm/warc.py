"""Not-modified revisits of web archives, resolved against the latest earlier full response.

An as-of join by canonical URL in two levels. Records are cut into time spans; each span's last
response is found by aggregation, a window over these few rows carries it into later spans, and a
window within a span finds what is nearer. A URL that holds a third of all records is so spread
over its spans; no task orders all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

#: Headers that a 304 answer may update in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or final slash, query parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    base, query = F.regexp_extract(u, r"^([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    head, path = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1), F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    head = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(head, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(records: DataFrame, span_seconds: int = 86_400, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row for each revisit in records: record_id, url, response_id, status and the merged headers.

    records: record_id string, kind ('response' or 'revisit'), url, ts timestamp, etag, last_modified,
    digest and headers map<string,string> with names in lower case. The response is the latest one of
    the same canonical URL that is strictly earlier; of several at one time the largest record_id.
    status is 'resolved' if a validator agrees: equal etags (weak marks ignored) where the revisit has
    one, else equal last_modified, else equal digests; 'mismatch' if it does not; 'no_validator' if the
    revisit has none; 'unresolved' without an earlier response, which is also what a revisit without
    url or time gets. Merged headers are the response's, with the permitted ones that the revisit
    sends; only resolved revisits have them. Other kinds are ignored; repeated revisits each get a row.
    """
    us = F.unix_micros("ts")
    r = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", "url", "etag", "last_modified", "digest", "headers", canonical_url(F.col("url")).alias("canon"), us.alias("us"))
    r = r.withColumn("span", F.floor(F.col("us") / (span_seconds * 1_000_000)))
    answer = F.when(F.col("kind") == "response", F.struct("us", "record_id", "etag", "last_modified", "digest", "headers_text"))
    r = r.withColumn("headers_text", F.to_json("headers")).drop("headers")
    r = r.withColumn("answer", answer)
    last = r.where("kind = 'response' and canon is not null and us is not null").groupBy("canon", "span").agg(F.max("answer").alias("last"))
    # For every span with records, the last response of the spans before it.
    spans = r.where("canon is not null and us is not null").groupBy("canon", "span").agg(F.bool_or(F.col("kind") == "revisit").alias("asked"))
    spans = spans.join(last, ["canon", "span"], "left")
    before = Window.partitionBy("canon").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("asked").select("canon", "span", "carried")
    inside = Window.partitionBy("canon", "span").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.max("answer").over(inside)).where("kind = 'revisit'").drop("answer")
    out = near.join(carried, ["canon", "span"], "left").withColumn("hit", F.coalesce("near", "carried"))
    out = out.withColumn("hit", F.when(F.col("canon").isNotNull() & F.col("us").isNotNull(), F.col("hit")))

    def strong(tag: Column) -> Column:
        return F.regexp_replace(tag, r"^W/", "")

    agrees = (F.when(F.col("etag").isNotNull(), strong(F.col("etag")) == strong(F.col("hit.etag")))
              .when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("hit.last_modified"))
              .when(F.col("digest").isNotNull(), F.col("digest") == F.col("hit.digest")))
    none = F.col("etag").isNull() & F.col("last_modified").isNull() & F.col("digest").isNull()
    status = (F.when(F.col("hit").isNull(), "unresolved").when(none, "no_validator")
              .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch"))
    kind = "map<string,string>"
    own = F.map_filter(F.coalesce(F.from_json("headers_text", kind), F.create_map().cast(kind)), lambda k, v: k.isin(*permitted))
    kept = F.map_filter(F.coalesce(F.from_json("hit.headers_text", kind), F.create_map().cast(kind)), lambda k, v: ~F.map_contains_key("own", k))
    out = out.withColumns({"own": own, "status": status})
    return out.select("record_id", "url", F.col("canon").alias("canonical"), F.col("hit.record_id").alias("response_id"), "status",
                      F.when(F.col("status") == "resolved", F.map_concat(kept, "own")).alias("headers"))


def capture_records(pages: DataFrame) -> DataFrame:
    """Records of a small crawl history over the pages table: a response for each page and three revisits.

    The first revisit comes a day later and names the etag, except that every fifth page has changed
    its tag; the second comes two days later and names the payload digest, by an equivalent URL; the
    third is from before the response. Times follow page_id, so pages of one URL overtake each other.
    """
    p = pages.where("page_id is not null").select(
        F.col("page_id").alias("id"), "url", F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')).alias("tag"),
        F.md5(F.concat_ws("|", "url", "html")).alias("digest"))
    base = F.lit(1_700_000_000) + (F.col("id") * 7919) % 864_000
    none = F.lit(None).cast("string")

    def header(k: Column, *more) -> Column:
        date = F.concat(F.lit("day "), F.floor(k / 86400).cast("string"))
        return F.create_map(F.lit("date"), date, *more)

    def record(n: int, kind: str, url: Column, k: Column, etag: Column, digest: Column, *more) -> Column:
        return F.struct(F.concat(F.lit(f"{'ra'[kind == 'response']}{n}-"), F.col("id").cast("string")).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"),
                        F.timestamp_seconds(k).alias("ts"), etag.alias("etag"), none.alias("last_modified"), digest.alias("digest"), header(k, *more).alias("headers"))

    changed = F.when(F.col("id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    rows = F.array(
        record(0, "response", F.col("url"), base, F.col("tag"), F.col("digest"), F.lit("etag"), F.col("tag"), F.lit("content-type"), F.lit("text/html")),
        record(1, "revisit", F.col("url"), base + 86_400, changed, none, F.lit("etag"), changed, F.lit("content-type"), F.lit("ignored/type")),
        record(2, "revisit", F.concat(F.col("url"), F.lit("#again")), base + 172_800, none, F.col("digest"), F.lit("expires"), F.lit("never")),
        record(3, "revisit", F.col("url"), base - 3_600, F.col("tag"), none))
    return p.select(F.inline(rows))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(capture_records(load(spark, sf_dir, "pages")))
    names = F.array_sort(F.map_keys("headers"))
    text = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.col("headers")[k])), ";")
    return out.select("record_id", "canonical", "response_id", "status", text.alias("headers"))


OP9_SQL = r"""
WITH p AS (SELECT page_id AS id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, md5(concat_ws('|', url, html)) AS digest, 1700000000 + (page_id * 7919) % 864000 AS base FROM pages WHERE page_id IS NOT NULL),
c AS (SELECT *, CASE WHEN id % 5 = 0 THEN '"changed"' ELSE 'W/' || tag END AS changed FROM p),
r AS (
  SELECT 'a0-' || id AS record_id, 'response' AS kind, url, base AS ts, tag AS etag, digest, 'content-type=text/html;date=day ' || (base // 86400) || ';etag=' || tag AS h FROM c
  UNION ALL SELECT 'r1-' || id, 'revisit', url, base + 86400, changed, NULL, NULL FROM c
  UNION ALL SELECT 'r2-' || id, 'revisit', url || '#again', base + 172800, NULL, digest, NULL FROM c
  UNION ALL SELECT 'r3-' || id, 'revisit', url, base - 3600, tag, NULL, NULL FROM c),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u0 FROM r),
v AS (SELECT *, regexp_extract(u0, '^([^?]*)', 1) AS b, regexp_extract(u0, '\?(.*)$', 1) AS q FROM u),
w AS (SELECT *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) AS head, regexp_replace(regexp_replace(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', '') AS path FROM v),
k AS (SELECT *, regexp_replace(regexp_replace(head, '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1') || path || CASE WHEN q <> '' THEN '?' || array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END AS canon FROM w),
a AS (SELECT x.*, (SELECT max(struct_pack(ts := y.ts, record_id := y.record_id, etag := y.etag, digest := y.digest)) FROM k y WHERE y.kind = 'response' AND y.canon = x.canon AND y.ts < x.ts) AS hit FROM k x WHERE x.kind = 'revisit'),
s AS (SELECT *, CASE WHEN hit IS NULL THEN 'unresolved'
  WHEN coalesce(CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(hit.etag, '^W/', '') ELSE digest = hit.digest END, false) THEN 'resolved' ELSE 'mismatch' END AS status FROM a)
SELECT record_id, canon AS canonical, hit.record_id AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=day ' || (ts // 86400) || ';etag=' || coalesce(etag, hit.etag) || CASE WHEN record_id LIKE 'r2-%' THEN ';expires=never' ELSE '' END END AS headers
FROM s
"""
