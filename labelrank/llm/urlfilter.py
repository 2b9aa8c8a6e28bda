"""URL filters: a temporal join of captures with dated lists.

A list is a log of dated entries that add or remove a key: a host, a parent domain, or a host with a path
prefix. Entries become validity intervals; each capture is evaluated against the entries that were active
when it was fetched. The intervals of one key and list never overlap, so the as-of join is an equality join
on the key with the day inside the interval, at most one match per key and list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelrank.session import small_side

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; null if the address has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, parts: int | None = None) -> Column:
    """Keys that may list an address: the host, its parent domains of two labels or more, host and path prefixes.

    ``parts`` leaves out prefixes of more path segments; without it all prefixes are there.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.size(steps) if parts is None else F.least(F.lit(parts), F.size(steps))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), depth)), lambda i: F.concat(
        host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from (list, key, day, action): active on every day from ``since`` before ``until``.

    ``action`` is ``add`` or ``remove``; ``until`` is null while nothing ends the entry. Of several entries of
    a day a removal counts. Adding again what is active goes on; removing what is not listed does nothing.
    Entries with a null in any column say nothing.
    """
    days = entries.select("list", "key", "day", "action").dropna().groupBy("list", "key", "day").agg(
        F.max((F.col("action") == "remove").cast("int")).alias("off"))
    w = Window.partitionBy("list", "key").orderBy("day")
    changes = days.withColumn("_was", F.coalesce(F.lag("off").over(w), F.lit(1))).where("off <> _was")
    return changes.withColumn("until", F.lead("day").over(w)).where("off = 0").select("list", "key", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, active: DataFrame, capture_id: str, url: str, day: str) -> DataFrame:
    """(capture_id, host, day, n_active, blocked_by, allowed_by, kept) for every capture.

    A capture is dropped (``kept`` false) if an active block entry lists it and no allow entry with a key at
    least as long does. ``blocked_by`` and ``allowed_by`` are the longest such keys (the last in code point
    order among equals), null without one. A null address, or one without a host, or a null day matches nothing
    and is kept. Rows that repeat an id with the same address and day give repeated results.

    Path prefixes of any depth count: the deepest key of the list is measured, and each capture's prefixes are
    made up to that depth.

    Hot hosts: captures are first reduced to distinct (address, day), and a list that is small when measured
    is broadcast; otherwise the join shuffles on the key and AQE splits a hot one.
    """
    own = captures.select(F.col(capture_id).alias("capture_id"), F.col(url).alias("_url"), F.col(day).alias("_day"))
    asked = own.select("_url", "_day").dropna().distinct()
    deepest = active.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    asked = asked.select("*", F.explode(keys_of(F.col("_url"), deepest)).alias("key"))
    lists = small_side(active.select("list", F.col("key").alias("_key"), "since", "until"))
    hits = asked.join(lists, (F.col("key") == F.col("_key")) & (F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    longest = F.struct(F.length("key").alias("n"), "key")
    found = hits.groupBy("_url", "_day").agg(
        F.count(F.lit(1)).alias("n_active"), F.max(F.when(F.col("list") == BLOCK, longest)).alias("b"), F.max(F.when(F.col("list") == ALLOW, longest)).alias("a"))
    joined = own.join(found, ["_url", "_day"], "left")
    kept = F.col("b").isNull() | F.coalesce(F.col("a.n") >= F.col("b.n"), F.lit(False))
    return joined.select(
        "capture_id", host_of(F.col("_url")).alias("host"), F.col("_day").alias("day"), F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.col("b.key").alias("blocked_by"), F.col("a.key").alias("allowed_by"), kept.alias("kept"))
