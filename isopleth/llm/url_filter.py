"""URL filtering against dated lists: a temporal join, with DataFrame operations only.

A list entry adds or removes a domain or a URL prefix on a date.  Entries become
validity intervals, the intervals of one key within one stretch of ``STRETCH``
days become one sorted array, and each capture looks its keys up (every domain
suffix of its host, every path prefix of its URL) in the stretch of its fetch
time.  The as-of decision is then made inside the row, so a join never multiplies
captures by the history of a key.

Cases: a capture with a null or unusable URL or a null time is not blocked; list
entries with a null key or time are void; of entries with one key and time a
removal wins; repeated captures are kept; an empty list blocks nothing; other
columns of ``captures`` ride along, but those named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import columns, lookup_skewed, materialize

STRETCH = 32
RESULTS = ("n_active", "matched", "listed_since", "blocked")
_END = 2**31 - 1


def host_of(url: Column) -> Column:
    """The host in lower case: without user, password, port and the dots of its end;
    an address in brackets stays whole."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, labels: Column | int = 127, segments: Column | int = 64) -> Column:
    """``d:`` and every domain suffix of at most so many labels, ``u:`` and every prefix
    of host and path of at most so many segments.

    The keys of a URL are as long as the two bounds times the URL.  A list knows the
    most that its own keys need (``depths``), so that nothing is lost by them.
    """
    host = host_of(url)
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    names = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    upto = lambda n, most: F.filter(F.sequence(F.lit(0), F.least(F.size(n), F.lit(most) if isinstance(most, int) else most)), lambda i: i > 0)
    domains = F.transform(upto(names, labels), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(names, F.size(names) - i + 1, i), ".")))
    prefixes = F.transform(upto(parts, segments), lambda i: F.concat(F.lit("u:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes)))


def depths(lists: DataFrame) -> tuple[int, int]:
    """The most labels of a domain key and segments of a URL key."""
    key = F.col("key")
    most = lambda kind, by: F.max(F.when(key.startswith(kind), F.size(F.split(F.substring(key, 3, 2**31 - 1), by))))
    labels, parts = lists.agg(most("d:", r"\."), most("u:", "/")).first()  # two numbers
    return labels or 0, max(0, (parts or 1) - 1)


def validity(entries: DataFrame) -> DataFrame:
    """key, since and until (days, half open) of every listing."""
    key, action, day = columns(entries, "key", "action", "day")
    slim = entries.select(key.alias("key"), F.unix_date(day.cast("date")).alias("since"), (action == "add").alias("on")).where("key is not null and since is not null and on is not null")
    last = slim.groupBy("key", "since").agg(F.min("on").alias("on"))
    timeline = Window.partitionBy("key").orderBy("since")
    changed = last.withColumn("was", F.lag("on", 1, False).over(timeline)).where("on != was")
    return changed.withColumn("until", F.lead("since", 1, _END).over(timeline)).where("on").select("key", "since", "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on", broadcast_keys: int = 50_000, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``captures`` with n_active, matched (the longest active key), listed_since and blocked."""
    link, when = columns(captures, url, fetched)
    own = [c for c in captures.columns if c.lower() not in RESULTS]
    day = F.unix_date(when.cast("date"))
    at = F.when(link.isNotNull() & day.isNotNull(), F.concat_ws(" ", day.cast("string"), link))
    seen = captures.select(*(captures[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(own)), at.alias("_at"), link.alias("_url"), day.alias("_day"))
    # one row a distinct question
    asked = seen.where("_at is not null").groupBy("_at").agg(F.first("_url").alias("_url"), F.first("_day").alias("_day"), F.count("*").alias("_copies"))

    ends = asked.agg(F.min("_day").alias("first"), F.max("_day").alias("last"))  # one row
    spans = validity(entries).crossJoin(F.broadcast(ends)).where("until > first and since <= last")
    stretch = lambda c: F.floor(c / STRETCH).cast("int")
    spread = spans.withColumn("stretch", F.explode(F.sequence(stretch(F.greatest("since", "first")), stretch(F.least(F.col("until") - 1, "last")))))
    lists = materialize(spread.groupBy("key", "stretch").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("spans")), "intervals")
    keyed = asked.select("_at", "_day", "_copies", F.explode(keys_of(F.col("_url"), *depths(lists))).alias("key")).withColumn("stretch", stretch(F.col("_day")))
    n, size = lists.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 16 * F.size("spans") + 64), F.lit(0))).first()
    if n <= broadcast_keys and size <= broadcast_bytes:
        found = keyed.join(F.broadcast(lists), ["key", "stretch"])
    else:
        # a key that many captures share is dealt over salts, its list row copied to each
        salts = 32
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = keyed.withColumn("salt", F.pmod(F.xxhash64("_at"), F.lit(salts)).cast("int")).join(salted, ["key", "stretch", "salt"])
    active = found.withColumn("span", F.get(F.filter("spans", lambda s: (s["since"] <= F.col("_day")) & (F.col("_day") < s["until"])), F.lit(0))).where("span is not null")
    best = F.max(F.struct(F.length("key").alias("size"), F.col("key").alias("key"), F.col("span.since").alias("since")))
    decided = active.groupBy("_at").agg(F.count("*").alias("n_active"), best.alias("best"), F.max("_copies").alias("_copies"))
    decided = decided.select("_at", "n_active", F.col("best.key").alias("matched"), F.date_from_unix_date("best.since").alias("listed_since"), "_copies")
    out = lookup_skewed(seen, materialize(decided, "decided"), "_at", "_copies")
    made = [F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "matched", "listed_since", F.col("n_active").isNotNull().alias("blocked")]
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(own)), *made)
