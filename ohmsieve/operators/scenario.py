"""Scenario target encoding: smoothed anomaly rates of operating states, out of fold for training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.io import scratch_table

# Smoothing, folds, support, fills, and the bins with their scales.
SMOOTHING = 50.0
FOLDS = 5
LOW_SUPPORT = 20
FAR = -999

#: Bin: (feature column, scale, fill, rounded).
STATE = {
    "throt_src": ("DERMeasureAC_0_ThrotSrc", 1.0, -1, True), "throt_pct": ("DERMeasureAC_0_ThrotPct", 5.0, -1, True), "wmaxlim_pct": ("DERCtlAC_0_WMaxLimPct", 5.0, -1, True),
    "wset_pct": ("DERCtlAC_0_WSetPct", 5.0, -1, True), "varset_pct": ("DERCtlAC_0_VarSetPct", 5.0, -1, True), "pf_set": ("DERCtlAC_0_PFWInj_PF", 0.02, -1, True),
    "fd_idx": ("DERFreqDroop_0_AdptCtlRslt", 1.0, -1, True), "vv_idx": ("DERVoltVar_0_AdptCrvRslt", 1.0, -1, True), "vw_idx": ("DERVoltWatt_0_AdptCrvRslt", 1.0, -1, True), "wv_idx": ("DERWattVar_0_AdptCrvRslt", 1.0, -1, True),
    "volt_bin": ("voltage_pct", 1.0, FAR, True), "hz_bin": ("DERMeasureAC_0_Hz", 0.1, FAR, True), "enter_idle": ("enter_service_should_idle", 1.0, 0, False), "droop_active": ("freqdroop_outside_deadband", 1.0, 0, False),
}
OUTPUT = {"w_bin": ("w_pct_of_rtg", 5.0, FAR, True), "var_bin": ("var_pct_of_limit", 5.0, FAR, True), "pf_mode": ("pf_control_any_enabled", 1.0, 0, False)}
KEYS = {"scenario": ("device_family", *STATE), "scenario_output": ("device_family", *STATE, *OUTPUT)}


def bins(df: DataFrame) -> DataFrame:
    """Adds the state and output bins; columns that the frame lacks fall into the fill bin."""
    have = set(df.columns)
    col = lambda c: F.col(c).cast("double") if c in have else E.null()
    return df.withColumns({k: E.bucketize(col(c), scale, fill, rounded) for k, (c, scale, fill, rounded) in (STATE | OUTPUT).items()})


def hash_fold(cols: tuple[str, ...], folds: int = FOLDS) -> Column:
    """A fold that all rows of one scenario share: by the md5 of its key, which other engines compute alike."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % folds).cast("int")


def smoothed(total: Column, n: Column, prior: Column) -> Column:
    return (total + E.dbl(SMOOTHING) * prior) / (n + E.dbl(SMOOTHING))


def encoded(prefix: str, total: Column, n: Column, prior: Column) -> dict[str, Column]:
    rate = smoothed(total, n, prior)
    return {f"{prefix}_rate": rate, f"{prefix}_rate_delta": rate - prior, f"{prefix}_count": n, f"{prefix}_log_count": F.log1p(n.cast("double")), f"{prefix}_low_support": (n < LOW_SUPPORT).cast("int")}


def stats(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("Label").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


def family_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("device_family").agg((F.sum(F.col("Label").cast("long")) / F.count(F.lit(1))).alias("prior"))


def leave_fold_out(df: DataFrame, keys: tuple[str, ...], fold: Column, folds: int = FOLDS) -> DataFrame:
    """Per key and fold (0 to ``folds`` - 1, or null), label sum and count over the other folds.

    One aggregate by key sums all folds side by side, so neither aggregates nor rows are joined to tell a fold from the others.
    """
    own = [F.col("_fold").eqNullSafe(k) for k in (*range(folds), None)]
    y = F.col("Label").cast("long")
    sums = [F.sum(F.when(f, y)).alias(f"_s{i}") for i, f in enumerate(own)] + [F.count_if(f).alias(f"_c{i}") for i, f in enumerate(own)]
    whole = df.withColumn("_fold", fold).groupBy(*keys).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_c"), *sums)
    each = [F.struct(F.lit(k if k < folds else None).cast("int").alias("fold"), (F.col("_s") - F.col(f"_s{k}")).alias("total"), (F.col("_c") - F.col(f"_c{k}")).alias("n"), F.col(f"_c{k}").alias("_own")) for k in range(folds + 1)]
    return whole.select(*keys, F.inline(F.array(*each))).filter("_own > 0").drop("_own")


def out_of_fold(df: DataFrame, which: tuple[str, ...] = ("scenario", "scenario_output")) -> DataFrame:
    """Training rows (binned, with Id and Label) with encodings whose sums leave out the row's own fold.

    The prior is the family's rate over all training rows, the row's own fold
    included.  The rows are written once, for they are read once for each
    aggregate and once for the result.
    """
    fold = F.pmod(F.col("Id"), F.lit(FOLDS)).cast("int")
    df = scratch_table(df, "binned")
    out = df.withColumn("fold", fold).join(F.broadcast(family_rates(df)), "device_family")  # one row a family
    for prefix in which:
        out = out.join(leave_fold_out(df, KEYS[prefix], fold), [*KEYS[prefix], "fold"], "left")
        out = out.withColumns(encoded(prefix, F.coalesce("total", F.lit(0)), F.coalesce("n", F.lit(0)), F.col("prior"))).drop("total", "n")
    return out.drop("fold", "prior")


def applied(df: DataFrame, learned: dict[str, DataFrame], rates: DataFrame, which: tuple[str, ...] = ("scenario", "scenario_output")) -> DataFrame:
    """New rows (binned) with encodings by all training rows; an unseen scenario has the prior and count 0."""
    rest = rates.agg(F.coalesce(F.avg("prior"), E.dbl(0.5)).alias("_rest"))
    out = df.join(F.broadcast(rates), "device_family", "left").join(F.broadcast(rest), F.lit(True))
    prior = F.coalesce("prior", "_rest")
    for prefix in which:
        out = out.join(learned[prefix], list(KEYS[prefix]), "left")
        out = out.withColumns(encoded(prefix, F.coalesce("total", F.lit(0)), F.coalesce("n", F.lit(0)), prior)).drop("total", "n")
    return out.drop("prior", "_rest")


INTERACTIONS = ("hard_rule_score", "scenario_rate", "scenario_output_rate", "resid_quantile_score", "mode_dispatch_w_resid")


def interactions(df: DataFrame, family: str = "canon100") -> DataFrame:
    """Each feature for one family, 0 for the others."""
    return df.withColumns({f"{family}_{c}": F.when(F.col("device_family") == family, F.col(c).cast("double")).otherwise(E.dbl(0)) for c in INTERACTIONS if c in df.columns})
