"""Joins of strings by containment and by one edit, and of hosts by domain suffix, without pairing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def substrings(c: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containment(short: DataFrame, long: DataFrame) -> DataFrame:
    """Distinct pairs (short, long) of which the first, not empty, is a substring of the second; one column ``x`` each.

    A string that is contained has all its three-letter substrings in the other, so it is joined on one of them: the one that
    the fewest of the other side hold, by counts taken from it. One that is shorter is joined as it is. What a common word
    shares with all others is thus no key, as long as a string has something rarer.
    """
    short, long = short.where("x <> ''").distinct(), long.where("x <> ''").distinct()
    filed = long.select(F.col("x").alias("long"), F.explode(F.concat(*(substrings(F.col("x"), n) for n in range(1, GRAM + 1)))).alias("g"))
    counts = filed.groupBy("g").agg(F.count("*").alias("n"))
    keys = F.when(F.length("x") < GRAM, F.array("x")).otherwise(substrings(F.col("x"), GRAM))
    asked = short.select(F.col("x").alias("short"), F.explode(keys).alias("g"))
    rarest = asked.join(counts, "g", "left").groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("k")).where("k.n > 0")
    return rarest.select("short", F.col("k.g").alias("g")).join(filed, "g").where(F.contains("long", F.col("short"))).select("short", "long").distinct()


def deletions(c: Column) -> Column:
    """A string and what it is without any one of its characters."""
    less = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), less))


def one_edit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of strings exactly one substitution or insertion apart; one column ``x`` each.

    Strings one edit apart share a string in their deletion neighbourhoods, so they are joined on those.
    """
    left, right = (d.where("x <> ''").distinct().select(F.col("x").alias(n), F.explode(deletions(F.col("x"))).alias("g")) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, "g").where((F.col("a") != F.col("b")) & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)).select("a", "b").distinct()


def suffixes(host: Column) -> Column:
    """A host and the domains above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def hosts_under(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The distinct hosts (column host) that are one of the domains (column domain) or lie under one. The list is a table of
    any size: Spark broadcasts it where its size allows, and shuffles it by domain where not."""
    hosts = hosts.select("host").where("host <> ''").distinct()
    listed = domains.select(F.lower("domain").alias("domain")).where("domain <> ''").distinct()
    return hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(listed, "domain", "left_semi").select("host").distinct()
