"""URL filters: dated list entries become validity intervals, joined as of each fetch time.

DataFrame functions only. A list is a log of (domain, listed_on, action), action `add` or
`remove`. An entry covers its domain and all subdomains. A capture is blocked if an entry of any
of its domain suffixes is active at its fetch time: valid_from <= fetched < valid_to.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The host of a URL: an address of IP version 6 in its brackets, or all up to a port, path, query or fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
#: Days for which the intervals of a domain meet its captures at once.
BUCKET_DAYS = 32
#: Hosts without parent domains: IP addresses.
ADDRESS = r"^(\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; null if there is none."""
    h = F.lower(F.regexp_extract(url, HOST, 1))
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def suffixes(h: Column) -> Column:
    """The host and its parent domains of two labels or more; a single label and an IP address stand for themselves."""
    parts = F.split(h, r"\.")
    n = F.size(parts)
    return F.when(h.rlike(ADDRESS), F.array(h)).when(
        h.isNotNull(),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to) from the log (domain, listed_on, action).

    The state of a domain after a date is that of its last entry by then; on one date a removal
    comes after an addition. Adjacent `add` entries continue the same interval; an open interval
    has valid_to null. Rows with null domain or date, or another action, are left out. Repeated
    rows change nothing. The log of one domain is sorted in one task, so the log is first
    reduced to one state for each domain and date.
    """
    log = (
        entries.select(F.lower("domain").alias("domain"), F.col("listed_on").cast("timestamp").alias("at"), F.lower("action").alias("action"))
        .filter(F.col("domain").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
        .groupBy("domain", "at")
        .agg((F.max("action") == "add").alias("listed"))
    )
    w = Window.partitionBy("domain").orderBy("at")
    changes = log.withColumn("before", F.lag("listed", 1, False).over(w)).filter(F.col("listed") != F.col("before"))
    return (
        changes.withColumn("valid_to", F.lead("at").over(w))
        .filter("listed")
        .select("domain", F.col("at").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, fetched, host, blocked, domain, valid_from, n_entries) for every row of captures (capture_id, url, fetched).

    domain and valid_from are those of the most specific active entry (longest domain). A null
    URL, one without a host, or a null fetch time is never blocked. Repeated capture ids share their matches by (id, host,
    time), each row being returned once. Captures of one hot host are reduced to distinct
    (host, time) before the join, and go back to their rows by a join that can be split. Intervals meet captures by domain and
    stretch of BUCKET_DAYS days, so that a domain listed and unlisted many times doesn't multiply its captures.
    """
    rows = captures.select("capture_id", F.col("fetched").cast("timestamp").alias("fetched"), host(F.col("url")).alias("host"))
    asked = rows.filter("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct()
    parts = asked.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("domain"))
    span = asked.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi")).first()
    if span["lo"] is None:
        span = (datetime(1970, 1, 1), datetime(1970, 1, 1))
    lo, hi = (F.lit(x).cast("timestamp") for x in span)
    bucket = lambda at: F.floor(F.unix_seconds(at) / F.lit(BUCKET_DAYS * 86400))
    within = intervals(entries).filter((F.col("valid_from") <= hi) & (F.col("valid_to").isNull() | (F.col("valid_to") > lo)))
    last = F.least(F.coalesce("valid_to", hi), hi)
    valid = within.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("valid_from", lo)), bucket(last))))
    active = parts.withColumn("bucket", bucket(F.col("fetched"))).join(valid, ["domain", "bucket"]).filter((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = active.groupBy("host", "fetched").agg(
        F.max(F.struct(F.length("domain").alias("size"), "domain", "valid_from")).alias("best"), F.count(F.lit(1)).alias("n_entries")
    )
    return rows.join(best, ["host", "fetched"], "left").select(
        "capture_id",
        "fetched",
        "host",
        F.col("best").isNotNull().alias("blocked"),
        F.col("best.domain").alias("domain"),
        F.col("best.valid_from").alias("valid_from"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
    )


#: Days over which the query spreads fetch times and list dates, from this date on.
EPOCH, DAYS = "2024-01-01", 360


def _day(key: Column, salt: str) -> Column:
    """A date that follows from a key: first seven hex digits of an MD5, modulo DAYS."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 7), 16, 10).cast("int"), F.lit(DAYS)))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages against a dated list made from their own hosts.

    `pages` has no fetch time and there is no list table, so both follow from MD5 rules: a page
    is fetched on a day of its page_id; each parent domain (two last labels) and each host is on
    the list if its hash says so, with one addition, one removal and one later addition.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", _day(F.col("page_id").cast("string"), "fetch").alias("fetched"))
    hosts = captures.select(host(F.col("url")).alias("domain")).filter("domain IS NOT NULL").distinct()
    domains = hosts.select(F.explode(suffixes(F.col("domain"))).alias("domain")).distinct()
    listed = domains.filter(F.substring(F.md5("domain"), 1, 1) < "4")
    log = listed.select(
        "domain",
        F.explode(
            F.array(
                F.struct(_day(F.col("domain"), "a").alias("listed_on"), F.lit("add").alias("action")),
                F.struct(_day(F.col("domain"), "b").alias("listed_on"), F.lit("remove").alias("action")),
                F.struct(_day(F.col("domain"), "c").alias("listed_on"), F.lit("add").alias("action")),
            )
        ).alias("e"),
    ).select("domain", "e.listed_on", "e.action")
    out = filter_captures(captures, log)
    return out.select(
        F.col("capture_id").alias("page_id"),
        F.date_format("fetched", "yyyy-MM-dd").alias("fetched"),
        "host",
        "blocked",
        "domain",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        "n_entries",
    )


OP8_SQL = rf"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + (('0x' || substr(md5('fetch' || page_id), 1, 7))::BIGINT % 360)::INTEGER AS fetched
  FROM pages
), d AS (
  SELECT DISTINCT array_to_string(list_slice(p, i, len(p)), '.') AS domain
  FROM (SELECT DISTINCT string_split(host, '.') AS p, regexp_matches(host, '{ADDRESS}') AS alone FROM c WHERE host IS NOT NULL) h, range(1, 129) r(i)
  WHERE i <= CASE WHEN alone THEN 1 ELSE greatest(1, len(p) - 1) END
), l AS (SELECT domain FROM d WHERE substr(md5(domain), 1, 1) < '4'
), e AS (
  SELECT domain, DATE '2024-01-01' + (('0x' || substr(md5(k || domain), 1, 7))::BIGINT % 360)::INTEGER AS since, k <> 'b' AS listed
  FROM l, (VALUES ('a'), ('b'), ('c')) v(k)
), s AS (SELECT domain, since, bool_and(listed) AS listed FROM e GROUP BY ALL
), ch AS (
  SELECT * FROM (SELECT *, lag(listed, 1, FALSE) OVER (PARTITION BY domain ORDER BY since) AS before FROM s) WHERE listed <> before
), iv AS (
  SELECT * FROM (SELECT domain, since AS valid_from, listed, lead(since) OVER (PARTITION BY domain ORDER BY since) AS valid_to FROM ch) WHERE listed
), m AS (
  SELECT c.page_id, arg_max(iv.domain, length(iv.domain)) AS domain, arg_max(iv.valid_from, length(iv.domain)) AS valid_from, count(*) AS n
  FROM c JOIN iv ON (c.host = iv.domain OR (ends_with(c.host, '.' || iv.domain) AND NOT regexp_matches(c.host, '{ADDRESS}'))) AND iv.valid_from <= c.fetched AND (iv.valid_to IS NULL OR c.fetched < iv.valid_to)
  GROUP BY 1
)
SELECT c.page_id, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, m.domain IS NOT NULL AS blocked, m.domain,
       strftime(m.valid_from, '%Y-%m-%d') AS valid_from, coalesce(m.n, 0) AS n_entries
FROM c LEFT JOIN m USING (page_id)
"""
