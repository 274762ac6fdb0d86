"""Crawl rules and the fetch budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.functions.urls import url_host, url_path
from newsloom.operators.select import newest_first
from newsloom.operators.skew import lookup_join


def rules_for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """Per host, the ordered rules that bind this agent.

    Of the groups that name the agent (its name before the version), the first
    in the file decides, and without one the first for everyone.  A host's
    rules are one short document, so its array is small.
    """
    name = agent.split("/")[0].lower()
    named = F.lit(name).contains(F.lower("agent")) & (F.col("agent") != "*")
    mine = rules.where(named | (F.col("agent") == "*")).withColumn("_named", named)
    rule = F.struct("group_ord", "rule_ord", "allow", "path_prefix")
    grouped = mine.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(F.col("_named"), rule))).alias("_own"),
        F.array_sort(F.collect_list(F.when(~F.col("_named"), rule))).alias("_all"),
    )
    first = grouped.select(
        "host", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_all")).alias("_rules")
    )
    group = F.get("_rules", 0)["group_ord"]
    return first.select("host", F.filter("_rules", lambda r: r["group_ord"] == group).alias("_rules"))


def robots_join(items: DataFrame, rules: DataFrame, agent: str = "*", spread: str = "seq",
                host=None) -> DataFrame:
    """Every item with `allowed`: the first rule whose prefix matches the path decides.

    A rule without a path matches every path and allows it, whatever it says.
    One lookup per item, no fan-out over rules and no second shuffle.
    """
    keyed = items.withColumn("host", url_host(F.col("url")) if host is None else host)
    joined = lookup_join(keyed, rules_for_agent(rules, agent), "host", spread=spread)
    path = url_path(F.col("url"))
    prefix = lambda r: F.coalesce(r["path_prefix"], F.lit(""))
    first = F.get(F.filter("_rules", lambda r: F.startswith(path, prefix(r))), 0)
    return joined.withColumn("allowed", F.coalesce(first["allow"] | (prefix(first) == ""), F.lit(True))).drop("_rules")


def robots_gate(items: DataFrame, rules: DataFrame, agent: str = "*", spread: str = "seq", host=None) -> DataFrame:
    """Items we may fetch; a host without rules allows everything."""
    return robots_join(items, rules, agent, spread, host).where("allowed").drop("allowed", "host")


def fetch_budget(candidates: DataFrame, limit: int = settings.MAX_NEW_FETCHES) -> DataFrame:
    """The first candidates in final order; the rest stay without content."""
    return newest_first(candidates).limit(limit)
