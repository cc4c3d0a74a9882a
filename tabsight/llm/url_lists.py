"""Dated URL lists: every capture is judged by the list entries that were active when it was fetched. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
HOST = SCHEME + "(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = SCHEME + "[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """The host in lower case without a final dot; empty for null and for what isn't an absolute URL."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), "\\.$", ""), F.lit(""))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda s: s != "")


def lookup_keys(host_col: Column, segments: Column) -> Column:
    """What a list entry may say of a URL: its host or a parent domain of two labels or more, alone or with the first segments of the path."""
    labels = F.split(host_col, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.concat(F.array(F.lit("")), F.transform(segments, lambda s, i: F.concat(
        F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))))
    return F.when(host_col == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to) from events (entry, category, listed, day): the entry is on or off the list from ``day`` on.

    valid_to is the day of the entry's next event and not in the interval; null if there is none. Of events of one day the one that takes
    the entry off counts, then the greater category. Events without entry, state or day have no effect. Each entry has at most one state per day
    before the window, however many events there are.
    """
    known = events.where("entry is not null and listed is not null and day is not null")
    daily = known.groupBy("entry", "day").agg(F.max(F.struct((~F.col("listed")).alias("off"), "category")).alias("s"))
    following = F.lead("day").over(Window.partitionBy("entry").orderBy("day"))
    return daily.withColumn("valid_to", following).where(~F.col("s.off")).select(
        "entry", F.col("s.category").alias("category"), F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``captures`` with host, blocked, entry (the longest active entry, then the smallest), category (its) and n_entries (active ones that match).

    Intervals and captures meet on (entry, month), so an entry with a long history is no large group, and distinct (url, day) are judged once, so neither is
    a URL captured again and again; a host with very many captures is split by adaptive execution. A URL that is null, empty or not absolute matches
    nothing: not blocked. Without a day, blocked is null. Equal rows stay as many. Empty lists block nothing. All other columns are kept;
    those that clash with the added ones are replaced.
    """
    own = [c for c in captures.columns if c.lower() not in ("host", "blocked", "entry", "category", "n_entries")]
    asked = captures.select(F.col(url_col).alias("_url"), F.col(day_col).alias("_day")).where("_url is not null and _day is not null").distinct()
    ranges = written(intervals(events), "url-intervals")
    # Captures meet an interval in the months they were made in: an interval is repeated for months that hold captures, not for every month of the calendar.
    made = asked.select(F.trunc("_day", "month").alias("_month")).distinct()
    months = made.agg(F.array_sort(F.collect_set("_month")).alias("_months"))  # one row with a date for each month in use
    ends = F.coalesce(F.date_sub("valid_to", 1), F.lit("9999-12-31").cast("date"))
    active = ranges.join(F.broadcast(months)).withColumn("_month", F.explode(F.filter(
        "_months", lambda m: (m >= F.trunc("valid_from", "month")) & (m <= ends)))).drop("_months")
    keyed = asked.withColumn("_key", F.explode(lookup_keys(host(F.col("_url")), path_segments(F.col("_url"))))).withColumn(
        "_month", F.trunc("_day", "month"))
    met = keyed.join(active, (F.col("_key") == F.col("entry")) & (keyed["_month"] == active["_month"]) & (F.col("_day") >= F.col("valid_from"))
                     & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    verdicts = met.groupBy("_url", "_day").agg(F.count("*").alias("n_entries"), F.min(F.struct(
        (-F.length("entry")).alias("l"), "entry", "category")).alias("best"))
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]  # names of their own, so that no column clashes
    out = captures.select(*held, F.col(url_col).alias("_u"), F.col(day_col).alias("_d")).join(
        verdicts, (F.col("_u") == F.col("_url")) & (F.col("_d") == F.col("_day")), "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], host(F.col("_u")).alias("host"),
                      F.when(F.col("_d").isNotNull(), F.col("best").isNotNull()).alias("blocked"),
                      F.col("best.entry").alias("entry"), F.col("best.category").alias("category"),
                      F.coalesce("n_entries", F.lit(0)).alias("n_entries"))
