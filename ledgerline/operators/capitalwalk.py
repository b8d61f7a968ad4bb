"""From a company's equity to its common equity tier 1, step by step, shown only where it ties.

Each step is a filed, undimensioned figure; the filed ratio table gives the target. The
election on accumulated other income is rarely filed: both are tried, and the one that
ties is it. Nothing is plugged: what doesn't tie keeps its residual and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Concepts of each step, first filed wins.
CONCEPTS = {
    "total_equity": ["StockholdersEquity"],
    "preferred": ["PreferredStockValue", "PreferredStockIncludingAdditionalPaidInCapitalNetOfDiscount"],
    "goodwill": ["Goodwill"],
    "other_intangibles": ["IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"],
    "aoci": ["AccumulatedOtherComprehensiveIncomeLossNetOfTax"],
    "subordinated_debt": ["SubordinatedDebt", "SubordinatedLongTermDebt", "SubordinatedBorrowings"],
}
CONFIDENCE = ["default", "parent", "fuzzy"]


def steps(facts: DataFrame, filing: str) -> DataFrame:
    """The undimensioned figures of each step, one row a filing and period: filing, period, the names of CONCEPTS.

    ``facts``: filing, period, concept, dims (map), value, place (order in the filing). Of
    a concept's figures of one period the first counts; facts with dimensions never do.
    """
    plain = facts.where((F.coalesce(F.size("dims"), F.lit(0)) <= 0) & F.col("value").isNotNull()).withColumn("local", F.substring_index("concept", ":", -1))
    out = []
    for name, ladder in CONCEPTS.items():
        at = F.array_position(F.array(*map(F.lit, ladder)), F.col("local"))
        out.append(F.min_by("value", F.when(at > 0, F.struct(at.alias("a"), "place"))).alias(name))
    return plain.groupBy(filing, "period").agg(*out)


def targets(facts: DataFrame, filing: str) -> DataFrame:
    """The company's own capital of each filing and period: filing, period, target, basis.

    ``facts``: filing, period, basis (holdco or bank), confidence, value. Facts of the
    company itself win over those said to be its parent's, and these over likely ones; a
    bank's never count. Several values of the best kind leave the target null, basis
    ``ambiguous``.
    """
    own = facts.where((F.col("basis") == "holdco") & F.col("value").isNotNull()).withColumn("_c", F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))).where("_c > 0")
    first = own.withColumn("_best", F.min("_c").over(Window.partitionBy(filing, "period"))).where("_c = _best")
    one = F.count_distinct("value") == 1
    return first.groupBy(filing, "period").agg(F.when(one, F.min("value")).alias("target"), F.when(one, F.min("confidence")).otherwise("ambiguous").alias("basis"))


def walk(steps: DataFrame, targets: DataFrame, filing: str, share: float = 0.01, floor: float = 5e6) -> DataFrame:
    """The walk of each filing and period with steps or a target: its steps, common_equity, intangibles, target, basis, built, residual, status.

    status: ``included`` or ``excluded`` (the treatment of other income that ties within
    ``share`` of the target, ``floor`` at least; included first), ``unreconciled`` (neither;
    built and residual are those of the nearer one), ``incomplete`` (no equity, goodwill or
    target). Steps that aren't filed count as 0 in sums and stay null.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = steps.join(targets, [filing, "period"], "full")
    out = both.withColumns({
        "common_equity": F.col("total_equity") - zero(F.col("preferred")),
        "intangibles": F.col("goodwill") + zero(F.col("other_intangibles")),
    })
    base = F.col("common_equity") - F.col("intangibles")
    out = out.withColumns({"_in": base, "_out": base - zero(F.col("aoci"))})
    tie = lambda c: F.abs(F.col(c) - F.col("target")) <= F.greatest(F.col("target") * share, F.lit(floor))
    status = F.when(F.col("_in").isNull() | F.col("target").isNull(), "incomplete").when(tie("_in"), "included").when(tie("_out"), "excluded").otherwise("unreconciled")
    out = out.withColumn("status", status)
    nearer: Column = F.abs(F.col("_out") - F.col("target")) < F.abs(F.col("_in") - F.col("target"))
    takes_out = (F.col("status") == "excluded") | ((F.col("status") == "unreconciled") & nearer)
    out = out.withColumn("built", F.when(F.col("status") != "incomplete", F.when(takes_out, F.col("_out")).otherwise(F.col("_in"))))
    return out.withColumn("residual", F.col("target") - F.col("built")).drop("_in", "_out")


def stitched(walks: DataFrame, company: str, filed: str) -> DataFrame:
    """One walk a company and period, over all filings that state it: the newest that ties, else the newest."""
    ties = F.col("status").isin("included", "excluded")
    w = Window.partitionBy(company, "period").orderBy(ties.desc(), F.desc(filed))
    return walks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
