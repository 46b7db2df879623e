"""URL filters: explicit rules first, empirical-Bayes host reputation for the rest.

Everything is a DataFrame expression.  A host's rate of bad outcomes is shrunk towards the rate of
its registered domain, that towards the rate of its suffix, and that towards the rate of all pages.
Each level's prior is a beta distribution whose strength comes from the spread between the groups
of that level (method of moments).  A host is blocked when the lower bound of its posterior rate
lies above a limit, so a few bad pages alone do not block it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path after the first ``://``.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A prior counts as at least one and at most this many pages.
MAX_STRENGTH = 1000.0
LEVELS = ["suffix", "domain", "host"]


@dataclass(frozen=True)
class UrlRule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null or without ``://``."""
    found = lambda group: F.coalesce(F.regexp_extract(url, URL, group), F.lit(""))
    return F.translate(found(1), UPPER, LOWER), found(2)


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits (struct of size, rule, verdict), or null; ties to the last name.

    The rules are a short list written by people and become one expression.
    """
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("rule"),
                     F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def with_levels(df: DataFrame) -> DataFrame:
    """Registered domain (last two labels) and suffix (last label) of ``host``."""
    return df.withColumns({
        "domain": F.substring_index("host", ".", -2),
        "suffix": F.substring_index("host", ".", -1),
    })


def _strength(groups: DataFrame) -> DataFrame:
    """One row: how many pages the prior of a level counts as.

    ``groups`` holds ``n``, ``bad`` and the prior rate ``prior`` of each group.
    """
    sums = groups.agg(
        F.sum("n").cast("double").alias("n"), F.count("*").cast("double").alias("g"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("seen"))
    noise = F.try_divide(F.col("within") * F.col("g"), F.col("n"))
    # ``seen`` is about noise * (1 + (n/g - 1) / (strength + 1)) when the groups differ.
    excess = F.try_divide(F.col("seen") - noise, noise)
    size = F.try_divide("n", "g") - 1
    raw = F.when(excess > 0, F.try_divide(size, excess) - 1).otherwise(F.lit(MAX_STRENGTH))
    return sums.select(F.round(F.greatest(F.lit(1.0), F.least(
        F.lit(MAX_STRENGTH), F.coalesce(raw, F.lit(MAX_STRENGTH)))), 6).alias("strength"))


def host_reputation(outcomes: DataFrame, bound_z: float = 1.0) -> DataFrame:
    """Posterior rate of bad outcomes and its lower bound, per host.

    ``outcomes`` has ``host`` and ``bad`` (0 or 1; null: not labelled); hosts without labels get
    the rate of their domain.  Empty input gives an empty table.  Counts are combined before the
    shuffle, so a host with a third of all pages is one row per task.
    """
    hosts = with_levels(outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    above = hosts.agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("rate"))
    prior, keys = F.broadcast(above.select(F.coalesce("rate", F.lit(0.0)).alias("prior"))), []
    for level in LEVELS:
        groups = hosts.groupBy(*LEVELS[:LEVELS.index(level) + 1]).agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.join(prior, keys) if keys else groups.crossJoin(prior)  # prior: one row
        strength = F.broadcast(_strength(groups.where("n > 0")))  # one row
        alpha = F.col("prior") * F.col("strength") + F.col("bad")
        total = F.col("strength") + F.col("n")
        groups = groups.crossJoin(strength).withColumns({"rate": alpha / total, "total": total})
        keys = LEVELS[:LEVELS.index(level) + 1]
        prior = groups.select(*keys, F.col("rate").alias("prior"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))
    return groups.select(
        "host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"),
        F.round("rate", 6).alias("bad_rate"),
        F.round(F.greatest(F.lit(0.0), F.col("rate") - bound_z * spread), 6).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule], limit: float = 0.25,
                bound_z: float = 1.0) -> DataFrame:
    """A verdict for every page: the longest fitting rule's, else ``block`` if the host's lower
    bound reaches ``limit``, else ``allow``.

    ``pages``: ``page_id``, ``url``; ``outcomes``: ``page_id``, ``bad`` (0, 1 or null).  Other
    columns are not read.  A null ``url`` has an empty host, which is judged like any other;
    a null ``page_id`` has no outcome.  Repeated outcomes of a page all count; repeated pages stay.
    The join by host holds one row per host on one side; the optimizer splits hosts with very many
    pages.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = parsed.select("page_id", "host").join(
        outcomes.select("page_id", "bad").where("bad is not null"), "page_id")
    unlabelled = parsed.select("host", F.lit(None).cast("int").alias("bad"))
    seen = labelled.select("host", F.col("bad").cast("int").alias("bad")).unionByName(unlabelled)
    judged = parsed.join(host_reputation(seen, bound_z), "host", "left")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_rule", rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"),
                   F.when(F.col("bad_bound") >= limit, "block").otherwise("allow")).alias("verdict"),
        "n_labelled", "n_bad", "bad_rate", "bad_bound")
