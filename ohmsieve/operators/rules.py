"""Hard rules: a table of weighted flags, their aggregates, audit and demotion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

MIN_PRECISION = 0.995


@dataclass(frozen=True)
class Rule:
    """A flag column; only named rules can override a prediction."""

    name: str | None
    column: str
    score: float
    count: int = 1


# Rules with their score and count weights.
RULES = (
    Rule("noncanonical", "noncanonical", 3.0),
    Rule("w_gt_wmax", "w_gt_wmax_tol", 2.0),
    Rule("w_gt_wmaxrtg", "w_gt_wmaxrtg_tol", 2.0),
    Rule("va_gt_vamax", "va_gt_vamax_tol", 2.0),
    Rule("var_gt_injmax", "var_gt_injmax_tol", 2.0),
    Rule("var_lt_absmax", "var_lt_absmax_tol", 2.0),
    Rule("wsetpct_far", "wsetpct_enabled_far", 3.0, 2),
    Rule("ac_type_rare", "ac_type_is_rare", 1.5),
    Rule("dc_type_rare", "dc_port_type_rare_any", 1.5),
    Rule("enter_state", "enter_service_state_anomaly", 2.0),
    Rule("pf_abs", "pf_abs_ext_present", 1.5),
    Rule("pf_abs_rvrt", "pf_abs_rvrt_ext_present", 1.5),
    Rule("trip_power", "trip_any_power_when_outside", 2.0),
    Rule(None, "common_missing_any", 2.5),
    Rule(None, "varsetpct_enabled_far", 1.0),
    Rule(None, "enter_service_blocked_power", 0.35),
    Rule(None, "enter_service_blocked_current", 0.35),
)
NAMED = {r.name: r for r in RULES if r.name}
#: Feature families that the rules read.
NEEDS = ("identity", "envelope", "control", "ac_type", "direct_current", "enter_service", "power_factor", "trip_any")


def on(rule: Rule) -> Column:
    return E.flag(F.expr(f"try_cast(`{rule.column}` AS INT)") == 1)


def override(active: list[str] | None = None) -> Column:
    """1 where an active named rule holds."""
    return E.any_of([on(NAMED[n]) for n in (NAMED if active is None else active)]).cast("int")


def aggregates(active: list[str] | None = None) -> dict[str, Column]:
    return {
        "hard_override_anomaly": override(active),
        "hard_rule_count": E.total([on(r).cast("int") * r.count for r in RULES]),
        "hard_rule_score": E.total([on(r).cast("int") * E.dbl(r.score) for r in RULES]),
        "hard_rule_anomaly": E.any_of([on(r) for r in RULES]).cast("int"),
    }


def refreshed(df: DataFrame, active: list[str]) -> DataFrame:
    """Overrides by the active rules; ``hard_rule_anomaly`` becomes the OR of the named rules; counts and scores stay."""
    return df.withColumns({"hard_override_anomaly": override(active), "hard_rule_anomaly": override()})


def audit(df: DataFrame) -> DataFrame:
    """(rule, count, positives, precision, recall) of every named rule, from one aggregation.

    A rule without hits has precision 1.
    """
    y = F.col("Label").cast("long")
    sums = df.agg(F.sum(y).alias("_all"), *[c for n, r in NAMED.items() for c in (F.sum(on(r).cast("long")).alias(f"{n}_n"), F.sum(on(r).cast("long") * y).alias(f"{n}_p"))])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_n").alias("count"), F.col(f"{n}_p").alias("positives")) for n in NAMED])
    long = sums.select("_all", F.inline(rows)).withColumns({"count": F.coalesce("count", F.lit(0)), "positives": F.coalesce("positives", F.lit(0))})
    share = lambda a, b, other: F.when(b > 0, a / b).otherwise(E.dbl(other))
    return long.select("rule", "count", "positives", share(F.col("positives"), F.col("count"), 1).alias("precision"), share(F.col("positives"), F.coalesce("_all", F.lit(0)), 0).alias("recall"))


def demoted(audited: DataFrame, least: float = MIN_PRECISION) -> DataFrame:
    """Rules that lose their override: hit, but not precise enough."""
    return audited.filter((F.col("count") > 0) & (F.col("precision") < least))


def active_rules(df: DataFrame, least: float = MIN_PRECISION) -> list[str]:
    lost = {r["rule"] for r in demoted(audit(df), least).collect()}  # at most one row a rule
    return [n for n in NAMED if n not in lost]
