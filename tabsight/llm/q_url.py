"""The pages as captures, and dated lists about their hosts and directories.

The tables have neither fetch times nor lists, so both are derived from the rows: a page's day from its id, an entry's events from the MD5 of its name.
"""

from pyspark.sql import functions as F

from .common import read
from .url_lists import host, judge, path_segments


def _byte(name, at):
    return F.conv(F.substring(F.md5(F.col(name)), at, 2), 16, 10).cast("int")


def list_events(pages):
    names = pages.select(host(F.col("url")).alias("h"), F.element_at(F.concat(path_segments(F.col("url")), F.array(F.lit(""))), 1).alias("s")).where("h <> ''").distinct()
    entries = names.select(F.col("h").alias("entry"), F.lit(3).alias("of")).union(
        names.where("s <> ''").select(F.concat_ws("/", "h", "s"), F.lit(4))).distinct()
    coded = entries.select("entry", "of", _byte("entry", 1).alias("a"), _byte("entry", 3).alias("b"), _byte("entry", 5).alias("c")).where("a % of = 0")
    category = F.when(F.col("entry").rlike("casino|bets|win"), "gambling").otherwise("spam")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    event = lambda listed, n: F.struct(F.lit(listed).alias("listed"), day(n).alias("day"))
    off, again = F.col("b") + 30 + F.col("c"), F.col("b") + 90 + F.col("c")
    events = F.array(event(True, F.col("b")), F.when(F.col("a") % 2 == 0, event(False, off)), F.when(F.col("a") % 5 == 0, event(True, again)))
    return coded.select("entry", category.alias("category"), F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        "entry", "category", "e.listed", "e.day")


def op2_url_lists(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 500).cast("int")))
    return judge(captures, list_events(pages))


HOST_SQL = r"coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '')"
SEGMENTS_SQL = "list_filter(string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/'), lambda s: s <> '')"
SQL = f"""
WITH p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 500 AS INTEGER) AS DATE) AS fetched, {HOST_SQL} AS host, {SEGMENTS_SQL} AS segs FROM pages),
names AS (SELECT DISTINCT host AS h, coalesce(segs[1], '') AS s FROM p WHERE host <> ''),
entries AS (SELECT h AS entry, 3 AS o FROM names UNION SELECT h || '/' || s, 4 FROM names WHERE s <> ''),
coded AS (SELECT entry, o, CAST('0x' || substr(md5(entry), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(entry), 3, 2) AS INTEGER) AS b,
  CAST('0x' || substr(md5(entry), 5, 2) AS INTEGER) AS c FROM entries),
ev AS (SELECT entry, true AS listed, b AS d FROM coded WHERE a % o = 0
  UNION ALL SELECT entry, false, b + 30 + c FROM coded WHERE a % o = 0 AND a % 2 = 0
  UNION ALL SELECT entry, true, b + 90 + c FROM coded WHERE a % o = 0 AND a % 5 = 0),
iv AS (SELECT entry, listed, CAST(DATE '2024-01-01' + d AS DATE) AS f, CAST(DATE '2024-01-01' + lead(d) OVER (PARTITION BY entry ORDER BY d) AS DATE) AS t FROM ev),
hosts AS (SELECT page_id, url, fetched, segs, unnest(list_transform(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1)),
  lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS suffix FROM p WHERE host <> ''),
keys AS (SELECT DISTINCT page_id, url, fetched, suffix || unnest(list_transform(generate_series(0, len(segs)),
  lambda i: CASE WHEN i = 0 THEN '' ELSE '/' || array_to_string(segs[1:i], '/') END)) AS key FROM hosts),
met AS (SELECT page_id, url, fetched, entry FROM keys JOIN iv ON key = entry AND listed AND fetched >= f AND (t IS NULL OR fetched < t)),
best AS (SELECT page_id, url, fetched, count(*) AS n, arg_min(entry, (-length(entry), entry)) AS entry FROM met GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched, p.host, best.entry IS NOT NULL AS blocked, best.entry,
  CASE WHEN regexp_matches(best.entry, 'casino|bets|win') THEN 'gambling' WHEN best.entry IS NOT NULL THEN 'spam' END AS category, coalesce(n, 0) AS n_entries
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.url = best.url"""
