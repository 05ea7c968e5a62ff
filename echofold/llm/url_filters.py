"""URL filters: an as-of join of captures with a dated domain list, natively in Spark.

A list is a log of dated entries (domain, action, since).  ``intervals`` turns it into validity
intervals: an entry holds from its date until the next entry of its domain.  A capture at time t
is judged by the entries active at t on its host and on every parent domain; the most specific
one decides, so an allowed subdomain of a blocked domain passes.

The list meets the distinct hosts first (one row per host and label, not per capture), which gives
each host its intervals; captures then join on their host.  Both sides of that join are salted,
the captures by their place and the hosts by replication, so a host with a third of all
captures is spread over ``SALTS`` tasks.

Defined results: a null or host-less url has host null and is kept; null fetch times match
nothing and are kept; entries with a null domain or date are ignored; equal dates of one domain:
the action last in order ("block" after "allow") holds; repeated captures are judged each on its
own; other columns pass through and columns named like a result are replaced; with an empty list
every capture is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import unused

SALTS = 16
FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host of a url without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first, the top-level label included."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until) of a dated list (domain, action, since)."""
    clean = entries.select(F.lower(F.col("domain")).alias("domain"), F.col("action"), F.col("since").cast("timestamp_ntz").alias("since")).where("domain is not null and since is not null")
    one = clean.groupBy("domain", "since").agg(F.max("action").alias("action"))
    until = F.lead("since", 1).over(W.partitionBy("domain").orderBy("since"))
    return one.select("domain", "action", "since", F.coalesce(until, F.to_timestamp_ntz(F.lit(FOREVER))).alias("until"))


def rules_of(hosts: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, rules): the intervals of each host and its parent domains.

    A parent domain may hold a great share of the hosts, so hosts are salted and the intervals
    replicated.  A host's rules are the entries of one list for its few domains."""
    pairs = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(salts)).cast("int"))
    listed = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rule = F.struct(F.length("domain").alias("depth"), "since", "until", "domain", "action")
    return dealt.join(listed, ["domain", "salt"]).groupBy("host").agg(F.collect_list(rule).alias("rules"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", salts: int = SALTS) -> DataFrame:
    """Every capture with host, matched_domain, action, active_since and kept."""
    rest = [c for c in captures.columns if c not in ("host", "matched_domain", "action", "active_since", "kept")]
    salt, rules, top = unused(captures.columns, "_salt", "_rules", "_top")
    rows = captures.select(*rest, host_of(F.col(url_col)).alias("host"))
    by_host = rules_of(rows.select("host").where("host is not null").distinct(), entries).withColumnRenamed("rules", rules)
    spread = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(spread, ["host", salt], "left")
    active = F.filter(rules, lambda r: (r["since"] <= F.col(time_col)) & (F.col(time_col) < r["until"]))
    found = joined.withColumn(top, F.array_max(active))
    blocked = F.coalesce(F.col(f"{top}.action") == "block", F.lit(False))
    return found.select(*rest, "host", F.col(f"{top}.domain").alias("matched_domain"), F.col(f"{top}.action").alias("action"), F.col(f"{top}.since").alias("active_since"), (~blocked).alias("kept"))
