"""URL filters as a temporal list join.

A filter list is a log of dated entries: on a day, a list adds or removes a pattern (a domain with all below it, or a
host with a path prefix). The entries of a pattern become validity intervals [from, to). A capture is looked up under
every pattern that could cover its URL - its host's parent domains and its path's prefixes - and keeps the entries
whose interval holds its fetch day: the as-of join is an equi-join on the pattern with the interval as its condition.

A day's entries of a pattern count as one, and a removal wins over an addition of the same day, so that a pattern has
at most one interval per day however often it is repeated. Hosts are skewed, so captures are salted by row and the
far smaller list is repeated for each salt. Captures with null or unreadable URL match nothing, as do those without
a fetch day; entries with a null field are ignored. Repeated captures are judged each; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def patterns_of(url: Column) -> Column:
    """All patterns that would cover a URL: domains of two labels or more, and `host/segment/...` prefixes, however many."""
    labels = F.split(host_of(url), r"\.")
    size = F.size(labels)
    upto = lambda first, last: F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    tails = F.transform(upto(2, size), lambda n: F.array_join(F.slice(labels, size - n + 1, n), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    heads = F.transform(upto(1, F.size(segments)), lambda n: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, 1, n), "/")))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(tails, heads)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: open), from entries of (list, pattern, day, added boolean)."""
    daily = entries.dropna(subset=["list", "pattern", "day", "added"]).groupBy("list", "pattern", "day").agg(F.min("added").alias("added"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("added", 1, False).over(w)).where("added <> was")
    return changes.withColumn("valid_to", F.lead("day").over(w)).where("added").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def apply_lists(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (url, fetched date, any other columns) with `active`: the sorted array of `list:pattern` that held then."""
    rows = captures.withColumn("__row", F.monotonically_increasing_id())
    looked = rows.select(
        "__row", F.col("fetched").alias("__day"), F.pmod(F.xxhash64("__row"), F.lit(SALTS)).alias("__salt"), F.explode(patterns_of(F.col("url"))).alias("__pattern"),
    )
    salted = intervals(entries).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = (F.col("__pattern") == F.col("pattern")) & (looked["__salt"] == salted["__salt"]) & (F.col("__day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to")))
    active = looked.join(salted, held).groupBy("__row").agg(F.array_sort(F.collect_list(F.concat_ws(":", "list", "pattern"))).alias("active"))
    return rows.join(active, "__row", "left").drop("__row").withColumn("active", F.coalesce("active", F.array().cast("array<string>")))
