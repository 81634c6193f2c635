"""Ratios of reported facts: a catalogue of formulas, evaluated on wide rows, with a reason where one can't be."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of facts that several formulas share.
TERMS = {
    "fcf": "operating_cash_flow - capital_expenditures",
    "debt": "commercial_paper + long_term_debt_current + long_term_debt_noncurrent",
    "liquid": "cash + marketable_securities_current + marketable_securities_noncurrent",
    "lease": "operating_lease_current + operating_lease_noncurrent + finance_lease_current + finance_lease_noncurrent",
    "distributions": "dividends_paid + share_repurchases",
    "tax_rate": "income_tax / pretax_income",
}


@dataclass(frozen=True)
class Ratio:
    """A metric: ``over`` must be above zero. taxed: it rests on the tax rate, which needs a pre-tax income above zero and must
    lie between 0 and 1."""

    name: str
    top: str
    over: str | None = None
    taxed: bool = False


#: Names and formulas of the metrics.
RATIOS = [
    Ratio("asset_turnover", "revenue", "total_assets"),
    Ratio("capex_to_operating_cash_flow", "capital_expenditures", "operating_cash_flow"),
    Ratio("cash_ratio", "cash", "current_liabilities"),
    Ratio("current_financial_debt", "commercial_paper + long_term_debt_current"),
    Ratio("current_financial_debt_share", "commercial_paper + long_term_debt_current", "{debt}"),
    Ratio("current_ratio", "current_assets", "current_liabilities"),
    Ratio("diluted_eps", "diluted_eps"),
    Ratio("diluted_shares", "diluted_shares"),
    Ratio("effective_tax_rate", "{tax_rate}", taxed=True),
    Ratio("financial_debt", "{debt}"),
    Ratio("financial_debt_to_assets", "{debt}", "total_assets"),
    Ratio("financial_debt_to_equity", "{debt}", "equity"),
    Ratio("financial_debt_to_free_cash_flow", "{debt}", "{fcf}"),
    Ratio("fixed_asset_turnover", "revenue", "ppe_net"),
    Ratio("free_cash_flow", "{fcf}"),
    Ratio("free_cash_flow_margin", "{fcf}", "revenue"),
    Ratio("free_cash_flow_per_diluted_share", "{fcf}", "diluted_shares"),
    Ratio("free_cash_flow_to_net_income", "{fcf}", "net_income"),
    Ratio("gross_margin", "gross_profit", "revenue"),
    Ratio("interest_coverage", "operating_income", "interest_expense"),
    Ratio("lease_liabilities", "{lease}"),
    Ratio("net_debt", "{debt} - ({liquid})"),
    Ratio("net_debt_to_free_cash_flow", "{debt} - ({liquid})", "{fcf}"),
    Ratio("net_liquid_assets", "{liquid} - long_term_debt_current - long_term_debt_noncurrent"),
    Ratio("net_margin", "net_income", "revenue"),
    Ratio("operating_cash_flow_margin", "operating_cash_flow", "revenue"),
    Ratio("operating_cash_flow_to_net_income", "operating_cash_flow", "net_income"),
    Ratio("operating_margin", "operating_income", "revenue"),
    Ratio("research_and_development_to_revenue", "research_and_development", "revenue"),
    Ratio("return_on_assets_ending_balance", "net_income", "total_assets"),
    Ratio("return_on_equity_ending_balance", "net_income", "equity"),
    Ratio("return_on_invested_capital_ending_balance", "operating_income * (1 - {tax_rate})", "equity + {debt} - ({liquid})", taxed=True),
    Ratio("revenue_per_diluted_share", "revenue", "diluted_shares"),
    Ratio("selling_general_and_administrative_to_revenue", "selling_general_and_administrative", "revenue"),
    Ratio("share_based_compensation_to_revenue", "share_based_compensation", "revenue"),
    Ratio("shareholder_distributions", "{distributions}"),
    Ratio("shareholder_distributions_to_free_cash_flow", "{distributions}", "{fcf}"),
    Ratio("shares_outstanding", "shares_outstanding"),
    Ratio("total_financial_obligations", "{debt} + {lease}"),
    Ratio("working_capital", "current_assets - current_liabilities"),
]
CORE = [Ratio("net_margin", "net_income", "revenue"), Ratio("liabilities_to_assets", "total_liabilities", "total_assets"), Ratio("liabilities_to_net_assets", "total_liabilities", "total_assets - total_liabilities")]


def formula(text: str) -> str:
    """A formula's SQL, its shared terms written out; the tax rate is the one term with a division."""
    terms = TERMS | {"tax_rate": "try_divide(income_tax, pretax_income)"}
    return text.format(**{k: v if k == "tax_rate" else f"({v})" for k, v in terms.items()})


def _inputs(r: Ratio) -> list[str]:
    return sorted(set(re.findall(r"[a-z_]+", formula(r.top) + " " + formula(r.over or ""))) - {"try_divide"})


def evaluate(wide: DataFrame, keys: list[str], ratios: list[Ratio], places: int = 6) -> DataFrame:
    """(keys, metric, value, reason): one row for each ratio of each wide row, with a value or the first reason against it.

    Facts that wide has no column for count as missing. One projection and one unpivot, without a shuffle.
    """
    full = wide.withColumns({n: F.lit(None).cast("double") for n in sorted({n for r in ratios for n in _inputs(r)}) if n not in wide.columns})

    def one(r: Ratio) -> Column:
        top = F.expr(formula(r.top))
        missing = F.lit(False)
        for n in _inputs(r):
            missing = missing | F.col(n).isNull()
        reason = F.when(missing, "missing_inputs")
        if r.taxed:
            rate = F.expr(formula("{tax_rate}"))
            reason = reason.when(F.col("pretax_income") <= 0, "non_positive_denominator").when((rate < 0) | (rate > 1), "tax_rate_out_of_range")
        value = top
        if r.over:
            over = F.expr(formula(r.over))
            value, reason = F.try_divide(top, over), reason.when(over <= 0, "non_positive_denominator")
        return F.struct(F.lit(r.name).alias("metric"), F.when(reason.isNull(), F.round(value, places)).alias("value"), reason.alias("reason"))

    return full.select(*keys, F.explode(F.array(*[one(r) for r in ratios])).alias("m")).select(*keys, "m.metric", "m.value", "m.reason")


def year_over_year(facts: DataFrame, keys: list[str], year: str, period: str, value: str) -> DataFrame:
    """Each period's change against the same period of the year before: growth over a positive base, rate over an absolute one.

    A label that stands for more than one fact is ambiguous and takes no part.
    """
    labels = [*keys, year, period]
    one = facts.where(F.col(value).isNotNull()).groupBy(*labels).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")
    before = one.select(*keys, (F.col(year) + 1).alias(year), period, F.col(value).alias("previous"))
    joined = one.join(before, labels)
    growth = F.when(F.col("previous") > 0, F.col(value) / F.col("previous") - 1)
    return joined.withColumns({"growth": growth, "change_rate": F.when(F.col("previous") != 0, (F.col(value) - F.col("previous")) / F.abs("previous"))})


def history_statistics(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Count, ends, extremes, mean and changes of each history, by one aggregation; growth a year from positive ends at least a
    year apart. A history has one value a period, so that its periods are bounded by the calendar."""
    one = points.where(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.min(value).alias(value))
    first, last = F.min_by(value, at), F.max_by(value, at)
    years = F.datediff(F.max(at), F.min(at)) / F.lit(365.2425)
    before = F.try_element_at(F.sort_array(F.collect_list(F.struct(at, value)), False), F.lit(2))[value]
    out = one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), first.alias("first_value"), last.alias("last_value"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 4).alias("mean"),
        F.round(F.max(value) - F.min(value), 4).alias("value_range"), F.round(last - before, 4).alias("previous_change"), F.round(last - first, 4).alias("horizon_change"), F.round(F.when(first != 0, (last - first) / F.abs(first)), 6).alias("horizon_rate"),
        F.when((first > 0) & (last > 0) & (years * 365.2425 >= 365), F.round(F.pow(F.try_divide(last, first), F.lit(1.0) / F.nullif(years, F.lit(0.0))) - 1, 6)).alias("growth_a_year"),
    )
    return out


def percentile_rank(points: DataFrame, keys: list[str], at: str, value: str, least_prior: int = 3) -> DataFrame:
    """Mid-rank of each point among its history before it: (less + equal / 2) / n, from ``least_prior`` earlier points.

    Of several points at one moment the smallest value counts. Points are brought together by key and read in order of
    time; the values so far are kept sorted, so a history costs n log n. It holds one value a period of one key.
    """
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, at]) + f", `{value}` double, prior long, rank double"
    one = points.where(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.min(F.col(value).cast("double")).alias(value))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, before = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, x = row[: len(keys)], row[-1]
                if key != current:
                    current, before = key, []
                low, high = bisect_left(before, x), bisect_right(before, x)
                if len(before) >= least_prior:
                    out.append((*row, len(before), round((low + (high - low) / 2) / len(before), 6)))
                before.insert(high, x)
            if out:
                yield pd.DataFrame(out, columns=[*keys, at, value, "prior", "rank"])

    return one.repartition(*keys).sortWithinPartitions(*keys, at).mapInPandas(run, schema)
