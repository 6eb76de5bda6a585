"""Named queries over the supplied tables, each with the SQL that another engine answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import decisions, features, residuals, rules, scenario
from ..sources import io
from ..sources import schema as S
from ..sources.telemetry import VIEW, as_sql, telemetry
from .session import tuned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AC, CAP, CTL, ES, DC = "DERMeasureAC_0_", "DERCapacity_0_", "DERCtlAC_0_", "DEREnterService_0_", "DERMeasureDC_0_"


def register(name: str, f: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(tuned(spark), sf_dir)


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        register(name, f)
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# -- SQL pieces -------------------------------------------------------------


def over(select: str, more: str = "") -> str:
    """A query over the telemetry view, called t."""
    return f"WITH t AS ({as_sql()}){more} {select}"


def rowed(sql: str) -> str:
    """A query over the view that joins its steps row by row: by a number of each row, for Ids may repeat."""
    sql = sql.replace(f"WITH t AS ({as_sql()})", f"WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row_no, * FROM ({as_sql()}))")
    head, _, tail = sql.partition("FROM lineitem))")
    return head + "FROM lineitem))" + tail.replace("SELECT Id,", "SELECT row_no, Id,").replace("USING (Id)", "USING (row_no)")


def cols(pairs: dict[str, str], keys: str = "Id", frm: str = "t") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{x} AS {k}" for k, x in pairs.items()) + f" FROM {frm}"


def q_div(n: str, d: str) -> str:
    return f"(CASE WHEN ({n}) IS NOT NULL AND abs({d}) > 1e-6 THEN ({n}) / ({d}) END)"


def q_bit(p: str) -> str:
    return f"CAST(coalesce({p}, FALSE) AS INTEGER)"


def q_close(a: str, b: str) -> str:
    return q_bit(f"abs(({a}) - ({b})) <= 1e-8 + 1e-5 * abs({b})")


def q_tol(c: float, p: float, x: str) -> str:
    return f"greatest({c}e0, CAST({p} AS DOUBLE) * coalesce({x}, 0e0))"


def q_sum(xs) -> str:
    return "(" + " + ".join(xs) + ")"


def q_nulls(xs) -> str:
    return q_sum(f"CAST(({x}) IS NULL AS INTEGER)" for x in xs)


def q_list(xs) -> str:
    return "list_filter([" + ", ".join(xs) + "], lambda x: x IS NOT NULL)"


def q_lo(xs) -> str:
    return f"list_min({q_list(xs)})"


def q_hi(xs) -> str:
    return f"list_max({q_list(xs)})"


def q_round(x: str, scale: str, fill: int) -> str:
    return f"CAST(coalesce(round_even(({x}) / {scale}, 0), {fill}) AS INTEGER)"


def have(raw: str) -> str:
    """A raw column in the view, or NULL."""
    s = S.safe(raw)
    return s if s in VIEW else "NULL"


MARK = "concat_ws('|', " + ", ".join(f"coalesce(common_0_{f}, '<NA>')" for f in S.IDENTITY) + ")"
FAMILY = f"CASE {MARK} WHEN 'DERSec|DER Simulator|10 kW DER|1.2.3|SN-Three-Phase' THEN 'canon10' WHEN 'DERSec|DER Simulator 100 kW|1.2.3.1|1.0.0|1100058974' THEN 'canon100' ELSE 'other' END"
W, VA, VAR, PF, A, LLV, LNV, HZ = (AC + x for x in "W VA Var PF A LLV LNV Hz".split())
RTG, WMAX, VAMAX, INJ, ABSM, VNOM, AMAX = (CAP + x for x in "WMaxRtg WMax VAMax VarMaxInj VarMaxAbs VNom AMax".split())
R3 = "CAST(1.7320508075688772 AS DOUBLE)"
VPCT, WPCT = f"(100e0 * {q_div(LLV, VNOM)})", f"(100e0 * {q_div(W, RTG)})"
QPCT = f"(100e0 * {q_div(VAR, f'(CASE WHEN {VAR} >= 0 THEN {INJ} ELSE {ABSM} END)')})"
TOLW = q_tol(50, 0.02, RTG)


FAMILY_SQL: dict[str, dict[str, str]] = {}


def family_query(name: str, *families: str, sql: dict[str, str] | None = None, only: list[str] | None = None) -> None:
    """A query that shows feature families over the view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features.planned(telemetry(spark, sf_dir), lambda r: dict(x for n in families for x in features.FAMILIES[n](r).items()), only=only)

    register(name, run)
    if sql:
        FAMILY_SQL[name] = sql
        SQL[name] = over(cols(sql))


# -- scans and sinks --------------------------------------------------------


@query("scan_project", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity < 10")
def scan_project(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity < 10").select("l_orderkey", "l_extendedprice")


@query("scan_limit_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_limit_ordered(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("coerce_numeric", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS as_number, TRY_CAST(event_type AS DOUBLE) AS bad_number FROM events")
def coerce_numeric(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.select("event_id", io.to_number(F.regexp_extract("props", "([0-9]+)", 1)).alias("as_number"), io.to_number(F.col("event_type")).alias("bad_number"))


TOKEN_CASE = "CASE o_orderkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN '<NA>' ELSE o_orderpriority END"


@query("null_tokens", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= 3 THEN {TOKEN_CASE} END AS priority FROM orders")
def null_tokens(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", io.present(F.expr(TOKEN_CASE)).alias("priority"))


CSV = ["common[0].SN", "DERMeasureAC[0].W", "DERMeasureAC[0].ThrotSrc", "DERCapacity[0].VNom", "DERVoltVar[0].Crv[1].Pt[2].V"]


@query("csv_roundtrip", over(f"SELECT Id, Label, {', '.join(S.safe(c) for c in CSV)} FROM t"))
def csv_roundtrip(spark, d):
    """A labelled CSV with the whole header of the information model, written (compressed, for it is some 3 KB a row, with like rows side by side) and scanned."""
    path, t = io.scratch(spark, "csv"), telemetry(spark, d, ("l_quantity", "l_partkey"))
    whole = [F.col(S.safe(c)).alias(c) if S.safe(c) in VIEW else F.lit(None).cast("string").alias(c) for c in S.SOURCE]
    io.write_csv(t.select("Id", "Label", *whole), path, compression="lz4")
    return io.scan_csv(spark, path, columns=[S.safe(c) for c in CSV])


HEX = lambda key, n: f"CAST(CAST('0x' || substr(md5({key}), 1, {n}) AS UBIGINT) AS HUGEINT)"


@query("row_digest", over(f"SELECT count(*) AS rows, CAST(sum({HEX('Id || chr(124) || Label', 12)}) AS VARCHAR) AS digest FROM t"))
def row_digest(spark, d):
    return io.row_digest(telemetry(spark, d), ["Id", "Label"])


@query("observed_counts", over("SELECT count(*) AS rows, CAST(sum(Label) AS BIGINT) AS positives FROM t"))
def observed_counts(spark, d):
    """Counters that a write of the labels fills in on the way."""
    counters = F.count(F.lit(1)).alias("rows"), F.sum(F.col("Label").cast("long")).alias("positives")
    rows, seen = io.observed(telemetry(spark, d).select("Id", "Label"), "labels", *counters)
    rows.write.parquet(io.scratch(spark, "observed"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["positives"])], "rows long, positives long")


@query("union_frames", over("SELECT Id, 'canon10' AS part FROM t WHERE l = 0 UNION ALL SELECT Id, 'canon100' AS part FROM t WHERE l = 1").replace("WITH t AS (SELECT ", "WITH t AS (SELECT l_linenumber % 2 AS l, "))
def union_frames(spark, d):
    t = telemetry(spark, d).select("Id", "common_0_Md")
    a = t.filter("common_0_Md = 'DER Simulator'").select("Id", F.lit("canon10").alias("part"))
    return a.unionByName(t.filter("common_0_Md <> 'DER Simulator'").select("Id", F.lit("canon100").alias("part")))


# -- identity, projections --------------------------------------------------

N_MISSING = q_nulls(f"common_0_{f}" for f in S.IDENTITY)
family_query("family_fingerprint", "identity", only=["device_fingerprint"], sql={"device_fingerprint": MARK})
family_query("family_classify", "identity", only=["device_family", "noncanonical"], sql={"device_family": FAMILY, "noncanonical": q_bit(f"({FAMILY}) = 'other'")})
family_query("identity_missing", "identity", only=["common_missing_any", "common_missing_count"], sql={"common_missing_any": q_bit(f"{N_MISSING} > 0"), "common_missing_count": N_MISSING})
family_query("sn_suffix", "identity", only=["common_sn_has_decimal_suffix"], sql={"common_sn_has_decimal_suffix": q_bit("common_0_SN LIKE '%.0'")})


@query("family_encode", over(cols({"family_code": f"CASE {FAMILY} WHEN 'canon10' THEN 0 WHEN 'canon100' THEN 1 ELSE -1 END"})))
def family_encode(spark, d):
    t = telemetry(spark, d)
    return t.select("Id", features.family_code(features.family_of(features.fingerprint(features.Raw(t.columns)))).alias("family_code"))


@query("raw_mirror", over(cols({S.safe(c): have(c) for c in S.MIRRORED if S.safe(c) in VIEW} | {S.safe(c): f"coalesce({have(c)}, '<NA>')" for c in S.STRINGS[:5]})))
def raw_mirror(spark, d):
    t = telemetry(spark, d)
    m = features.mirror(features.Raw(t.columns))
    return t.select("Id", *[c.alias(k) for k, c in m.items() if k in VIEW])


RATIOS = {
    "w_over_wmaxrtg": (W, RTG), "w_over_wmax": (W, WMAX), "va_over_vamax": (VA, VAMAX), "va_over_vamaxrtg": (VA, CAP + "VAMaxRtg"), "var_over_injmax": (VAR, INJ), "var_over_absmax": (VAR, ABSM), "a_over_amax": (A, AMAX), "llv_over_vnom": (LLV, VNOM), "lnv_over_vnom": (f"{LNV} * {R3}", VNOM),
    "wmax_over_wmaxrtg": (WMAX, RTG), "vamax_over_vamaxrtg": (VAMAX, CAP + "VAMaxRtg"), "vmax_over_vnom": (CAP + "VMax", VNOM), "vmin_over_vnom": (CAP + "VMin", VNOM),
}
family_query("safe_ratio", "ratios", only=list(RATIOS)[:9], sql={k: q_div(*v) for k, v in list(RATIOS.items())[:9]})
family_query("setting_ratios", "ratios", only=list(RATIOS)[9:], sql={k: q_div(*v) for k, v in list(RATIOS.items())[9:]})
family_query("deltas", "deltas", sql={"w_minus_wmax": f"{W} - {WMAX}", "w_minus_wmaxrtg": f"{W} - {RTG}", "va_minus_vamax": f"{VA} - {VAMAX}", "var_minus_injmax": f"{VAR} - {INJ}", "var_plus_absmax": f"{VAR} + {ABSM}", "llv_minus_lnv_sqrt3": f"{LLV} - {LNV} * {R3}", "hz_delta_60": f"{HZ} - 60e0"})
EQUAL = {"w_eq_wmaxrtg": (W, RTG), "w_eq_wmax": (W, WMAX), "var_eq_varmaxinj": (VAR, INJ), "var_eq_neg_varmaxabs": (VAR, f"-{ABSM}")}
family_query("close_eq", "envelope", only=list(EQUAL), sql={k: q_close(*v) for k, v in EQUAL.items()})
OVER = {"w_gt_wmax_tol": f"{W} > {WMAX} + {TOLW}", "w_gt_wmaxrtg_tol": f"{W} > {RTG} + {TOLW}", "va_gt_vamax_tol": f"{VA} > {VAMAX} + {q_tol(50, 0.02, VAMAX)}", "var_gt_injmax_tol": f"{VAR} > {INJ} + {q_tol(20, 0.02, INJ)}", "var_lt_absmax_tol": f"{VAR} < -{ABSM} - {q_tol(20, 0.02, ABSM)}"}
family_query("tolerance_flags", "envelope", only=list(OVER), sql={k: q_bit(p) for k, p in OVER.items()})
family_query("sign_mismatch", "envelope", only=["pf_sign_mismatch"], sql={"pf_sign_mismatch": q_bit(f"sign({PF}) <> sign({W}) AND {PF} <> 0 AND {W} <> 0")})
MAG = f"sqrt({W} * {W} + {VAR} * {VAR})"
family_query("power_triangle", "triangle", sql={"va_minus_pqmag": f"{VA} - {MAG}", "va_over_pqmag": q_div(VA, MAG), "pf_from_w_va": q_div(W, VA), "pf_error": f"{PF} - {q_div(W, VA)}"})


@query("log_count", "SELECT l_returnflag, count(*) AS n, round(ln(1 + count(*)), 9) AS log_n FROM lineitem GROUP BY l_returnflag")
def log_count(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.round(F.log1p(F.col("n").cast("double")), 9))


@query("bucketize_even", over(cols({"throt_pct": q_round(AC + "ThrotPct", "5e0", -1), "pf_set": q_round(CTL + "PFWInj_PF", "2e-2", -1), "hz_bin": q_round(HZ, "1e-1", -999), "cut": f"CAST(coalesce(trunc({AC}ThrotPct), 0) AS INTEGER)"})))
def bucketize_even(spark, d):
    c = F.col
    return telemetry(spark, d).select("Id", E.bucketize(c(AC + "ThrotPct"), 5.0).alias("throt_pct"), E.bucketize(c(CTL + "PFWInj_PF"), 0.02).alias("pf_set"), E.bucketize(c(HZ), 0.1, -999).alias("hz_bin"), E.bucketize(c(AC + "ThrotPct"), fill=0, rounded=False).alias("cut"))


@query("mod_fold", over("SELECT Id, CAST(Id % 5 AS INTEGER) AS fold, Id % 2 = 0 AS even FROM t"))
def mod_fold(spark, d):
    return telemetry(spark, d).select("Id", F.pmod("Id", F.lit(5)).cast("int").alias("fold"), residuals.fits().alias("even"))


family_query("bit_pattern", "missingness", only=["common_missing_pattern", "enter_service_missing_pattern"], sql={
    "common_missing_pattern": q_sum(f"CAST({have('common[0].' + f)} IS NULL AS INTEGER) * {1 << i}" for i, f in enumerate([*S.IDENTITY, "ID", "L"])),
    "enter_service_missing_pattern": q_sum(f"CAST({have(c)} IS NULL AS INTEGER) * {1 << i}" for i, c in enumerate(S.BLOCKS["enter_service"])),
})
BLOCK_N = {b: f"({q_nulls([have(c) for c in cs if have(c) != 'NULL'] or ['0'])} + {sum(have(c) == 'NULL' for c in cs)})" for b, cs in S.BLOCKS.items()}
family_query("block_missingness", "missingness", only=[*(f"missing_{b}_{k}" for b in S.BLOCKS for k in ("count", "any")), "missing_selected_total", "missing_selected_blocks"], sql={
    **{k: x for b, n in BLOCK_N.items() for k, x in ((f"missing_{b}_count", n), (f"missing_{b}_any", q_bit(f"{n} > 0")))},
    "missing_selected_total": q_sum(BLOCK_N.values()), "missing_selected_blocks": q_sum(q_bit(f"{n} > 0") for n in BLOCK_N.values()),
})


def _integrity_sql() -> dict[str, str]:
    out, bad, miss = {}, [], []
    for b, (prefix, model, length) in S.MODELS.items():
        i, n = S.safe(f"{prefix}.ID"), S.safe(f"{prefix}.L")
        wrong = f"coalesce({i} <> {model}, FALSE) OR coalesce({n} <> {length}, FALSE)"
        out |= {f"{b}_model_id_missing": f"CAST({i} IS NULL AS INTEGER)", f"{b}_model_len_missing": f"CAST({n} IS NULL AS INTEGER)", f"{b}_model_id_match": q_bit(f"{i} = {model}"), f"{b}_model_len_match": q_bit(f"{n} = {length}"), f"{b}_model_integrity_ok": q_bit(f"{i} = {model} AND {n} = {length}"), f"{b}_model_structure_anomaly": q_bit(wrong)}
        bad.append(q_bit(wrong))
        miss.append(f"CAST({i} IS NULL OR {n} IS NULL AS INTEGER)")
    return out | {"model_structure_anomaly_count": q_sum(bad), "model_structure_missing_count": q_sum(miss), "model_structure_anomaly_any": q_bit(f"{q_sum(bad)} > 0")}


family_query("model_integrity", "integrity", sql=_integrity_sql())

# -- row reducers and curves ------------------------------------------------

TEMPS = [AC + "Tmp" + x for x in ("Amb", "Cab", "Snk", "Trns", "Sw", "Ot")]
T_SUM, T_N = q_sum(f"coalesce({x}, 0e0)" for x in TEMPS), q_sum(f"CAST({x} IS NOT NULL AS INTEGER)" for x in TEMPS)
family_query("row_min_max_mean", "temperature", sql={"temp_min": q_lo(TEMPS), "temp_max": q_hi(TEMPS), "temp_mean": f"CASE WHEN {T_N} > 0 THEN {T_SUM} / {T_N} END", "temp_spread": f"{q_hi(TEMPS)} - {q_lo(TEMPS)}", "temp_max_over_ambient": f"{q_hi(TEMPS)} - {TEMPS[0]}"})


def q_spread(xs) -> str:
    xs = list(xs)
    return f"({q_hi(xs)} - {q_lo(xs)})"


SPREADS = {"phase_ll_spread": ("VL1L2", "VL2L3", "VL3L1"), "phase_ln_spread": ("VL1", "VL2", "VL3"), "phase_w_spread": ("WL1", "WL2", "WL3"), "phase_var_spread": ("VarL1", "VarL2", "VarL3")}
family_query("phase_spread", "phases", only=list(SPREADS), sql={k: q_spread(AC + x for x in v) for k, v in SPREADS.items()})
family_query("phase_sum_error", "phases", only=[f"{k}_phase_sum_error" for k in ("w", "va", "var")], sql={f"{k}_phase_sum_error": f"{AC}{f} - ({AC}{f}L1 + {AC}{f}L2 + {AC}{f}L3)" for k, f in (("w", "W"), ("va", "VA"), ("var", "Var"))})


@query("var_pct", over(cols({"reactive": QPCT})))
def var_pct(spark, d):
    return telemetry(spark, d).select("Id", E.var_pct(F.col(VAR), F.col(INJ), F.col(ABSM)).alias("reactive"))


family_query("percentages", "percentages", sql={"voltage_pct": VPCT, "line_neutral_voltage_pct": f"100e0 * {q_div(f'{LNV} * {R3}', VNOM)}", "w_pct_of_rtg": WPCT, "var_pct_of_limit": QPCT})


def q_index(x: str, n: int) -> str:
    return f"(CASE WHEN trunc(coalesce({x}, 1e0)) BETWEEN 1 AND {n} THEN CAST(trunc(coalesce({x}, 1e0)) AS INTEGER) - 1 ELSE 0 END)"


def q_pick(xs: list[str], index: str) -> str:
    return "(CASE " + index + "".join(f" WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END)"


def q_rev(xs: list[str]) -> str:
    return q_sum(q_bit(f"{b} - {a} < -1e-6") for a, b in zip(xs, xs[1:], strict=False))


def q_pairs(xs, ys) -> str:
    return q_sum(f"CAST({x} IS NOT NULL AND {y} IS NOT NULL AS INTEGER)" for x, y in zip(xs, ys, strict=True))


def q_interp(x: str, xs: list[str], ys: list[str]) -> str:
    """Segments in order, then the ends."""
    seg = "".join(f" WHEN abs({b} - {a}) > 1e-6 AND {ya} IS NOT NULL AND {yb} IS NOT NULL AND {x} BETWEEN least({a}, {b}) AND greatest({a}, {b}) THEN {ya} + ({x} - {a}) / ({b} - {a}) * ({yb} - {ya})" for a, b, ya, yb in zip(xs, xs[1:], ys, ys[1:], strict=False))
    end = lambda order, vals: "coalesce(" + ", ".join(f"CASE WHEN {xs[i]} IS NOT NULL AND {ys[i]} IS NOT NULL THEN {vals[i]} END" for i in order) + ")"
    n = range(len(xs))
    fx, fy, lx, ly = end(n, xs), end(n, ys), end(reversed(n), xs), end(reversed(n), ys)
    return f"(CASE WHEN {x} IS NULL THEN NULL{seg} WHEN {x} <= least({fx}, {lx}) THEN {fy} WHEN {x} >= greatest({fx}, {lx}) THEN {ly} END)"


def curve_sql(name: str) -> tuple[str, dict[str, str]]:
    """A CTE c with the selected points, and the columns over it."""
    prefix, n, xf, yf, meta = S.CURVES[name]
    p = S.safe(prefix + ".")
    index = q_index(f"{p}AdptCrvRslt", 3)
    sel = {f"x{i}": q_pick([f"{p}Crv_{c}_Pt_{i}_{xf}" for c in range(3)], "i") for i in range(n)} | {f"y{i}": q_pick([f"{p}Crv_{c}_Pt_{i}_{yf}" for c in range(3)], "i") for i in range(n)}
    sel |= {"act": q_pick([f"{p}Crv_{c}_ActPt" for c in range(3)], "i")} | {f"m_{k}": q_pick([have(f"{prefix}.Crv[{c}].{f}") for c in range(3)], "i") for k, f in meta.items()}
    m, o = {"voltvar": (f"{VPCT} - 100e0 + coalesce({p}Crv_0_VRef, 100e0)", QPCT), "voltwatt": (VPCT, WPCT), "wattvar": (WPCT, QPCT)}[name]
    cte = f", b AS (SELECT *, {index} AS i FROM t), c AS (SELECT Id, i, {m} AS m, {o} AS o, " + ", ".join(f"{x} AS {k}" for k, x in sel.items()) + " FROM b)"
    xs, ys = [f"x{i}" for i in range(n)], [f"y{i}" for i in range(n)]
    count = q_pairs(xs, ys)
    steep = [f"CASE WHEN abs({xs[i + 1]} - {xs[i]}) > 1e-6 THEN ({ys[i + 1]} - {ys[i]}) / ({xs[i + 1]} - {xs[i]}) END" for i in range(n - 1)]
    k = q_sum(f"CAST(({s}) IS NOT NULL AS INTEGER)" for s in steep)
    ex = q_interp("m", xs, ys)
    out = {"idx": "i", "point_count": count, "actpt_gap": f"act - {count}", "x_span": q_spread(xs), "y_span": q_spread(ys), "reverse_steps": q_rev(xs), "mean_slope": f"CASE WHEN {k} > 0 THEN {q_sum(f'coalesce({s}, 0e0)' for s in steep)} / {k} END", "max_abs_slope": q_hi([f"abs({s})" for s in steep]), "measure_margin_low": f"m - {q_lo(xs)}", "measure_margin_high": f"{q_hi(xs)} - m", "expected": ex, "error": f"o - {ex}"} | {k: f"m_{k}" for k in meta}
    return cte, {f"{name}_curve_{k}": x for k, x in out.items()}


def _curve_queries() -> None:
    groups = {"curve_select": ("voltvar", ["idx", *S.CURVES["voltvar"][4]]), "curve_counts": ("voltvar", ["point_count", "actpt_gap", "x_span", "y_span"]), "curve_reverse": ("wattvar", ["reverse_steps"]), "curve_slopes": ("wattvar", ["mean_slope", "max_abs_slope"]), "piecewise_interp": ("wattvar", ["expected", "error", "measure_margin_low", "measure_margin_high"]), "curve_voltvar": ("voltvar", None), "curve_voltwatt": ("voltwatt", None), "curve_wattvar": ("wattvar", None)}
    for q, (name, keep) in groups.items():
        cte, out = curve_sql(name)
        names = [f"{name}_curve_{k}" for k in keep] if keep else list(out)
        SQL[q] = over(cols({k: out[k] for k in names}, frm="c"), cte)

        def run(spark, d, name=name, names=names):
            return features.planned(telemetry(spark, d), lambda r: features.curve(r, name), only=names)

        register(q, run)


_curve_queries()

# -- feature families -------------------------------------------------------

ON = {k: f"coalesce({CTL}{f}, 0e0) > 0" for k, f in (("w", "WSetEna"), ("l", "WMaxLimPctEna"), ("v", "VarSetEna"))}
TARGET = {"w": f"{RTG} * ({CTL}WSetPct / 100e0)", "l": f"{RTG} * ({CTL}WMaxLimPct / 100e0)", "v": f"{INJ} * ({CTL}VarSetPct / 100e0)"}
ERR = {"wset_abs_error": f"CASE WHEN {ON['w']} THEN abs({W} - {CTL}WSet) END", "wsetpct_target": TARGET["w"], "wsetpct_abs_error": f"CASE WHEN {ON['w']} THEN abs({W} - {TARGET['w']}) END", "wmaxlim_target": TARGET["l"], "wmaxlim_excess": f"CASE WHEN {ON['l']} THEN {W} - {TARGET['l']} END", "varset_abs_error": f"CASE WHEN {ON['v']} THEN abs({VAR} - {CTL}VarSet) END", "varsetpct_target": TARGET["v"], "varsetpct_abs_error": f"CASE WHEN {ON['v']} THEN abs({VAR} - {TARGET['v']}) END"}
FAR = {"wset_enabled_far": ("wset_abs_error", q_tol(50, 0.05, RTG)), "wsetpct_enabled_far": ("wsetpct_abs_error", q_tol(50, 0.05, RTG)), "wmaxlim_enabled_far": ("wmaxlim_excess", q_tol(50, 0.05, RTG)), "varsetpct_enabled_far": ("varsetpct_abs_error", q_tol(20, 0.05, INJ))}
family_query("control_compliance", "control", sql=ERR | {k: q_bit(f"({ERR[e]}) > {t}") for k, (e, t) in FAR.items()})

SHARE = {f"{n}_share_{e}": q_div(f"{CAP}{f}{s}", f"{CAP}{b}{s}") for e, s in (("rtg", "Rtg"), ("setting", "")) for n, f, b in (("charge_rate", "WChaRteMax", "WMax"), ("discharge_rate", "WDisChaRteMax", "WMax"), ("charge_va", "VAChaRteMax", "VAMax"), ("discharge_va", "VADisChaRteMax", "VAMax"))}
GAP = q_sum(q_bit(f"abs({CAP}{f} - {CAP}{f}Rtg) > {q_tol(1, 0.01, f'abs({CAP}{f}Rtg)')}") for f in "WMax VAMax VarMaxInj VarMaxAbs VNom VMax VMin AMax".split())
family_query("capacity_ext", "capacity", sql={f"{k}_setting_delta": f"{CAP}{f} - {CAP}{f}Rtg" for k, f in (("vnom", "VNom"), ("vmax", "VMax"), ("vmin", "VMin"), ("amax", "AMax"), ("pfover", "PFOvrExt"), ("pfunder", "PFUndExt"))} | SHARE | {"rating_setting_gap_count": GAP})

INSIDE = f"(coalesce({VPCT} BETWEEN {ES}ESVLo AND {ES}ESVHi, FALSE) AND coalesce({HZ} BETWEEN {ES}ESHzLo AND {ES}ESHzHi, FALSE))"
IDLE = f"(NOT coalesce({ES}ES = 1, FALSE) OR NOT {INSIDE})"
family_query("enter_service", "enter_service", sql={f"enter_service_{k}": x for k, x in {
    "enabled": q_bit(f"{ES}ES = 1"), "state_anomaly": q_bit(f"{ES}ES >= 1.5"), "inside_window": q_bit(INSIDE), "outside_window": q_bit(f"NOT {INSIDE}"), "should_idle": q_bit(IDLE), "v_window_width": f"{ES}ESVHi - {ES}ESVLo", "hz_window_width": f"{ES}ESHzHi - {ES}ESHzLo",
    "v_margin_low": f"{VPCT} - {ES}ESVLo", "v_margin_high": f"{ES}ESVHi - {VPCT}", "hz_margin_low": f"{HZ} - {ES}ESHzLo", "hz_margin_high": f"{ES}ESHzHi - {HZ}", "total_delay": f"{ES}ESDlyTms + {ES}ESRndTms", "delay_remaining": f"{ES}ESDlyRemTms", "ramp_time": f"{ES}ESRmpTms", "delay_active": q_bit(f"{ES}ESDlyRemTms > 0"),
    "blocked_power": q_bit(f"{IDLE} AND abs({W}) > {TOLW}"), "blocked_va": q_bit(f"{IDLE} AND {VA} > {q_tol(50, 0.02, VAMAX)}"), "blocked_current": q_bit(f"{IDLE} AND {A} > {q_tol(1, 0.02, AMAX)}"),
}.items()})
PFC = lambda f: f"coalesce({CTL}{f}, 0e0) > 0"
family_query("pf_control", "power_factor", sql={
    "pf_control_any_enabled": q_bit(f"{PFC('PFWInjEna')} OR {PFC('PFWAbsEna')}"), "pf_control_any_reversion": q_bit(f"{PFC('PFWInjEnaRvrt')} OR {PFC('PFWAbsEnaRvrt')}"),
    "pf_inj_target_error": f"CASE WHEN {PFC('PFWInjEna')} THEN abs(abs({PF}) - {CTL}PFWInj_PF) END", "pf_inj_reversion_error": f"CASE WHEN {PFC('PFWInjEnaRvrt')} THEN abs(abs({PF}) - {CTL}PFWInjRvrt_PF) END",
    **{k: f"CAST({CTL}{f} IS NOT NULL AS INTEGER)" for k, f in (("pf_inj_ext_present", "PFWInj_Ext"), ("pf_inj_rvrt_ext_present", "PFWInjRvrt_Ext"), ("pf_abs_ext_present", "PFWAbs_Ext"), ("pf_abs_rvrt_ext_present", "PFWAbsRvrt_Ext"))},
    "pf_inj_enabled_missing_target": q_bit(f"{PFC('PFWInjEna')} AND {CTL}PFWInj_PF IS NULL"), "pf_reactive_near_limit": q_bit(f"abs({QPCT}) >= 95"),
})


def trip_sql(short: str) -> tuple[str, dict[str, str]]:
    prefix, axis, side = S.TRIPS[short]
    p = S.safe(prefix + ".")
    index = q_index(f"{p}AdptCrvRslt", 2)
    pts = {f"{a}{i}": q_pick([have(f"{prefix}.Crv[{c}].{g}.Pt[{i}].{f}") for c in range(2)], "i") for a, g, f in (("x", "MustTrip", axis), ("u", "MustTrip", "Tms"), ("y", "MomCess", axis), ("v", "MomCess", "Tms")) for i in range(5)}
    pts |= {"am": q_pick([f"{p}Crv_{c}_MustTrip_ActPt" for c in range(2)], "i"), "ac": q_pick([f"{p}Crv_{c}_MomCess_ActPt" for c in range(2)], "i")}
    may = " OR ".join(f"{p}Crv_{c}_MayTrip_Pt_{i}_{axis} IS NOT NULL" for c in range(2) for i in range(4))
    cte = f", b AS (SELECT *, {index} AS i FROM t), c AS (SELECT Id, i, {VPCT if axis == 'V' else HZ} AS m, coalesce({p}Ena, 0e0) > 0 AS ena, abs({W}) > {TOLW} AS busy, {p}AdptCrvReq - {p}AdptCrvRslt AS gap, {may} AS may, " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in pts.items()) + " FROM b)"
    x, u, y, v = ([f"{a}{i}" for i in range(5)] for a in "xuyv")
    margin = f"(m - {q_hi(x)})" if side == "low" else f"({q_lo(x)} - m)"
    out = {
        "curve_idx": "i", "enabled": q_bit("ena"), "curve_req_gap": "gap", "musttrip_count": q_pairs(x, u), "musttrip_actpt_gap": f"am - {q_pairs(x, u)}", "musttrip_axis_min": q_lo(x), "musttrip_axis_max": q_hi(x), "musttrip_axis_span": q_spread(x), "musttrip_tms_span": q_spread(u), "musttrip_reverse_steps": q_rev(x),
        "momcess_count": q_pairs(y, v), "momcess_actpt_gap": f"ac - {q_pairs(y, v)}", "momcess_axis_span": q_spread(y), "momcess_tms_span": q_spread(v), "momcess_reverse_steps": q_rev(y), "maytrip_present_any": q_bit("may"), "musttrip_margin": margin, "outside_musttrip": q_bit(f"ena AND {margin} < 0"), "power_when_outside": q_bit(f"ena AND {margin} < 0 AND busy"), "momcess_musttrip_gap": f"abs({q_lo(y)} - {q_hi(x)})",
    }
    return cte, {f"trip_{short}_{k}": z for k, z in out.items()}


def _trip_queries() -> None:
    for short in S.TRIPS:
        cte, out = trip_sql(short)
        SQL[f"trip_block_{short}"] = over(cols(out, frm="c"), cte)

        def run(spark, d, short=short):
            return features.planned(telemetry(spark, d), lambda r: features.trip(r, short))

        register(f"trip_block_{short}", run)


_trip_queries()


def trip_power_sql(key: str = "power_when_outside") -> str:
    """One 0/1 expression over t for any of the four blocks."""
    parts = []
    for short, (prefix, axis, side) in S.TRIPS.items():
        p = S.safe(prefix + ".")
        xs = [q_pick([have(f"{prefix}.Crv[{c}].MustTrip.Pt[{i}].{axis}") for c in range(2)], q_index(f"{p}AdptCrvRslt", 2)) for i in range(4)]
        m = VPCT if axis == "V" else HZ
        out = f"coalesce({p}Ena, 0e0) > 0 AND " + (f"{m} - {q_hi(xs)} < 0" if side == "low" else f"{q_lo(xs)} - {m} < 0")
        parts.append(f"coalesce({out}" + (f" AND abs({W}) > {TOLW}" if key == "power_when_outside" else "") + ", FALSE)")
    return q_bit("(" + " OR ".join(parts) + ")")


TRIP_ANY = {f"trip_any_{k}": trip_power_sql(k) for k in ("outside_musttrip", "power_when_outside")}
family_query("trip_any", "trip_any", only=list(TRIP_ANY), sql=TRIP_ANY)


def droop_sql() -> tuple[str, dict[str, str]]:
    p = "DERFreqDroop_0_"
    sel = {k: q_pick([f"{p}Ctl_{c}_{f}" for c in range(3)], "i") for k, f in (("dbof", "DbOf"), ("dbuf", "DbUf"), ("kof", "KOf"), ("kuf", "KUf"), ("rsp", "RspTms"), ("pmin", "PMin"), ("readonly", "ReadOnly"))}
    cte = f", b AS (SELECT *, {q_index(p + 'AdptCtlRslt', 3)} AS i FROM t), c AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in sel.items()) + f" FROM b), e AS (SELECT *, CASE WHEN {HZ} - (60e0 + dbof) IS NOT NULL THEN greatest({HZ} - (60e0 + dbof), 0e0) END AS oa, CASE WHEN (60e0 - dbuf) - {HZ} IS NOT NULL THEN greatest((60e0 - dbuf) - {HZ}, 0e0) END AS ua FROM c)"
    all3 = lambda *fs: [f"{p}Ctl_{c}_{f}" for f in fs for c in range(3)]
    out = {"ctl_idx": "i", **{k: k for k in sel}, "deadband_width": "dbof + dbuf", "over_activation": "oa", "under_activation": "ua", "expected_delta_pct": f"100e0 * {q_div('oa', 'kof')} - 100e0 * {q_div('ua', 'kuf')}", "outside_deadband": q_bit("coalesce(oa > 0, FALSE) OR coalesce(ua > 0, FALSE)"), "w_over_pmin_pct": f"{WPCT} - pmin", "db_span": q_spread(all3("DbOf", "DbUf")), "k_span": q_spread(all3("KOf", "KUf")), "pmin_span": q_spread(all3("PMin"))}
    return cte, {f"freqdroop_{k}": x for k, x in out.items()}


family_query("freq_droop", "droop")
SQL["freq_droop"] = over(cols(droop_sql()[1], frm="e"), droop_sql()[0])
P0, P1 = (lambda f: f"{DC}Prt_0_{f}"), (lambda f: f"{DC}Prt_1_{f}")
RARE_DC = q_bit(f"coalesce({P0('PrtTyp')} = 7, FALSE) OR coalesce({P1('PrtTyp')} = 7, FALSE)")
family_query("dc_consistency", "direct_current", sql={
    "dcw_over_w": q_div(DC + "DCW", W), "dcw_over_abs_w": q_div(DC + "DCW", f"abs({W})"), "dcw_minus_port_sum": f"{DC}DCW - ({P0('DCW')} + {P1('DCW')})", "dcv_spread": f"abs({P0('DCV')} - {P1('DCV')})", "dca_spread": f"abs({P0('DCA')} - {P1('DCA')})", "dc_port0_share": q_div(P0("DCW"), f"{P0('DCW')} + {P1('DCW')}"),
    "dc_port_type_mismatch": q_bit(f"{P0('PrtTyp')} <> {P1('PrtTyp')}"), "dc_port_type_rare_any": RARE_DC, "ac_zero_dc_positive": q_bit(f"abs({W}) <= 1e-6 AND {DC}DCW > 0"), "ac_positive_dc_zero": q_bit(f"{W} > 0 AND abs({DC}DCW) <= 1e-6"), "ac_dc_same_sign": q_bit(f"sign(coalesce({W}, 0)) = sign(coalesce({DC}DCW, 0))"), "dca_over_total": q_div(DC + "DCA", f"{P0('DCA')} + {P1('DCA')}"),
})
family_query("ac_type_rare", "ac_type", sql={"ac_type_is_rare": q_bit(f"{AC}ACType = 3")})

# -- rules ------------------------------------------------------------------

FLAG = {
    "noncanonical": q_bit(f"({FAMILY}) = 'other'"), **{k: q_bit(p) for k, p in OVER.items()}, "wsetpct_enabled_far": q_bit(f"({ERR['wsetpct_abs_error']}) > {q_tol(50, 0.05, RTG)}"), "ac_type_is_rare": q_bit(f"{AC}ACType = 3"), "dc_port_type_rare_any": RARE_DC, "enter_service_state_anomaly": q_bit(f"{ES}ES >= 1.5"),
    "pf_abs_ext_present": f"CAST({CTL}PFWAbs_Ext IS NOT NULL AS INTEGER)", "pf_abs_rvrt_ext_present": f"CAST({CTL}PFWAbsRvrt_Ext IS NOT NULL AS INTEGER)", "trip_any_power_when_outside": trip_power_sql(), "common_missing_any": q_bit(f"{N_MISSING} > 0"), "varsetpct_enabled_far": q_bit(f"({ERR['varsetpct_abs_error']}) > {q_tol(20, 0.05, INJ)}"),
    "enter_service_blocked_power": q_bit(f"{IDLE} AND abs({W}) > {TOLW}"), "enter_service_blocked_current": q_bit(f"{IDLE} AND {A} > {q_tol(1, 0.02, AMAX)}"),
}
FLAGGED = ", f AS (SELECT Id, Label, " + FAMILY + " AS device_family, " + ", ".join(f"{x} AS {k}" for k, x in FLAG.items()) + " FROM t)"
NAMED = list(rules.NAMED.values())
AGG_SQL = {"hard_override_anomaly": "greatest(" + ", ".join(r.column for r in NAMED) + ")", "hard_rule_count": q_sum(f"{r.column} * {r.count}" for r in rules.RULES), "hard_rule_score": q_sum(f"CAST({r.column} AS DOUBLE) * CAST({r.score} AS DOUBLE)" for r in rules.RULES), "hard_rule_anomaly": "greatest(" + ", ".join(r.column for r in rules.RULES) + ")"}


def flags(spark: SparkSession, d: str) -> DataFrame:
    return features.family_columns(telemetry(spark, d), *rules.NEEDS, keys=("Id", "Label"))


@query("family_table", over(f"SELECT Id, noncanonical, {AGG_SQL['hard_rule_count']} AS hard_rule_count FROM f WHERE device_family = 'canon100'", FLAGGED))
def family_table(spark, d):
    """Features written by family; reading one family leaves the others' files alone."""
    path = io.scratch(spark, "families")
    rows = flags(spark, d)
    io.write_by_family(rows.select("Id", "device_family", "noncanonical", rules.aggregates()["hard_rule_count"].alias("hard_rule_count")), path)
    return spark.read.parquet(path).filter("device_family = 'canon100'").select("Id", "noncanonical", "hard_rule_count")


@query("rule_outputs", over(cols(AGG_SQL, frm="f"), FLAGGED))
def rule_outputs(spark, d):
    return flags(spark, d).select("Id", *[c.alias(k) for k, c in rules.aggregates().items()])


AUDIT = FLAGGED + ", a AS (" + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, CAST(coalesce(sum({r.column}), 0) AS BIGINT) AS count, CAST(coalesce(sum({r.column} * Label), 0) AS BIGINT) AS positives, CAST(sum(Label) AS BIGINT) AS labels FROM f" for r in NAMED) + "), g AS (SELECT rule, count, positives, CASE WHEN count > 0 THEN positives / count ELSE 1e0 END AS precision, CASE WHEN labels > 0 THEN positives / labels ELSE 0e0 END AS recall FROM a)"


@query("rule_audit", over("SELECT * FROM g", AUDIT))
def rule_audit(spark, d):
    return rules.audit(flags(spark, d))


@query("rule_demotion", over("SELECT rule, precision FROM g WHERE count > 0 AND precision < CAST(0.995 AS DOUBLE)", AUDIT))
def rule_demotion(spark, d):
    return rules.demoted(rules.audit(flags(spark, d))).select("rule", "precision")


KEPT = ["noncanonical", "w_gt_wmax", "enter_state"]


@query("override_refresh", over("SELECT Id, greatest(" + ", ".join(rules.NAMED[n].column for n in KEPT) + ") AS hard_override_anomaly, greatest(" + ", ".join(r.column for r in NAMED) + ") AS hard_rule_anomaly FROM f", FLAGGED))
def override_refresh(spark, d):
    return rules.refreshed(flags(spark, d), KEPT).select("Id", "hard_override_anomaly", "hard_rule_anomaly")


@query("family_counts", over("SELECT device_family, count(*) AS n FROM f GROUP BY device_family", FLAGGED))
def family_counts(spark, d):
    return flags(spark, d).groupBy("device_family").agg(F.count(F.lit(1)).alias("n"))


# -- aggregates, lookups, encoding ------------------------------------------


def binned(spark: SparkSession, d: str) -> DataFrame:
    used = {x[0] for x in (scenario.STATE | scenario.OUTPUT).values()} | {"device_family"}
    build = lambda r: {k: c for f in (features.identity, features.percentages, features.power_factor, features.enter_service, features.droop) for k, c in f(r).items() if k in used}
    rows = features.planned(telemetry(spark, d), build, keys=("Id", "Label", *(c for c in VIEW if c in used)))
    return scenario.bins(rows).select("Id", "Label", *scenario.KEYS["scenario_output"])


DROOPED = droop_sql()
BIN_SQL = {"throt_src": q_round(AC + "ThrotSrc", "1e0", -1), "throt_pct": q_round(AC + "ThrotPct", "5e0", -1), "wmaxlim_pct": q_round(CTL + "WMaxLimPct", "5e0", -1), "wset_pct": q_round(CTL + "WSetPct", "5e0", -1), "varset_pct": q_round(CTL + "VarSetPct", "5e0", -1), "pf_set": q_round(CTL + "PFWInj_PF", "2e-2", -1), "fd_idx": q_round("DERFreqDroop_0_AdptCtlRslt", "1e0", -1), "vv_idx": q_round("DERVoltVar_0_AdptCrvRslt", "1e0", -1), "vw_idx": q_round("DERVoltWatt_0_AdptCrvRslt", "1e0", -1), "wv_idx": q_round("DERWattVar_0_AdptCrvRslt", "1e0", -1), "volt_bin": q_round(VPCT, "1e0", -999), "hz_bin": q_round(HZ, "1e-1", -999), "enter_idle": q_bit(IDLE), "droop_active": DROOPED[1]["freqdroop_outside_deadband"], "w_bin": q_round(WPCT, "5e0", -999), "var_bin": q_round(QPCT, "5e0", -999), "pf_mode": q_bit(f"{PFC('PFWInjEna')} OR {PFC('PFWAbsEna')}")}
BINNED = DROOPED[0] + f", s AS (SELECT Id, Label, {FAMILY} AS device_family, " + ", ".join(f"{x} AS {k}" for k, x in BIN_SQL.items()) + " FROM e)"


@query("scenario_bins", over("SELECT * FROM s", BINNED))
def scenario_bins(spark, d):
    return binned(spark, d).select("Id", "Label", "device_family", *BIN_SQL)


@query("group_rate", over("SELECT l_bin, CAST(sum(Label) AS BIGINT) AS total, count(*) AS n FROM (SELECT throt_pct AS l_bin, Label FROM s) GROUP BY l_bin", BINNED))
def group_rate(spark, d):
    return scenario.stats(binned(spark, d).select(F.col("throt_pct").alias("l_bin"), "Label"), ("l_bin",))


@query("group_mean", over("SELECT device_family, sum(Label) / count(*) AS prior FROM s GROUP BY device_family", BINNED))
def group_mean(spark, d):
    return scenario.family_rates(binned(spark, d))


@query("lookup_default", over("SELECT s.Id, CAST(coalesce(g.total, 0) AS BIGINT) AS total, CAST(coalesce(g.n, 0) AS BIGINT) AS n FROM s LEFT JOIN (SELECT throt_pct, sum(Label) AS total, count(*) AS n FROM s WHERE throt_pct < 10 GROUP BY throt_pct) g USING (throt_pct)", BINNED))
def lookup_default(spark, d):
    b = binned(spark, d)
    known = scenario.stats(b.filter("throt_pct < 10"), ("throt_pct",))
    return b.join(known, "throt_pct", "left").select("Id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


PRIOR = "p AS (SELECT device_family, sum(Label) / count(*) AS prior FROM s GROUP BY device_family)"


@query("family_prior", over("SELECT s.Id, coalesce(p.prior, 5e-1) AS prior FROM s LEFT JOIN (SELECT * FROM p WHERE device_family <> 'other') p USING (device_family)", f"{BINNED}, {PRIOR}"))
def family_prior(spark, d):
    b = binned(spark, d)
    known = scenario.family_rates(b).filter("device_family <> 'other'")
    return b.join(F.broadcast(known), "device_family", "left").select("Id", F.coalesce("prior", E.dbl(0.5)).alias("prior"))


LFO = "o AS (SELECT k.throt_pct, k.fold, CAST(coalesce(sum(x.Label), 0) AS BIGINT) AS total, count(x.Label) AS n FROM (SELECT DISTINCT throt_pct, CAST(Id % 5 AS INTEGER) AS fold FROM s) k LEFT JOIN s x ON x.throt_pct = k.throt_pct AND x.Id % 5 <> k.fold GROUP BY k.throt_pct, k.fold)"


@query("leave_fold_out", over("SELECT * FROM o", f"{BINNED}, {LFO}"))
def leave_fold_out(spark, d):
    return scenario.leave_fold_out(binned(spark, d), ("throt_pct",), F.pmod("Id", F.lit(5)).cast("int")).select("throt_pct", "fold", "total", "n")


K = ", ".join(scenario.KEYS["scenario"])
G = f"g AS (SELECT {K}, CAST(Id % 5 AS INTEGER) AS fold, sum(Label) AS s, count(*) AS c FROM s GROUP BY ALL), w AS (SELECT {K}, sum(s) AS ts, sum(c) AS tc FROM g GROUP BY ALL)"
OOF = f"r AS (SELECT s.Id, p.prior, CAST(w.ts - g.s AS BIGINT) AS total, CAST(w.tc - g.c AS BIGINT) AS n FROM s JOIN p USING (device_family) JOIN g ON (" + " AND ".join(f"s.{k} = g.{k}" for k in scenario.KEYS["scenario"]) + " AND s.Id % 5 = g.fold) JOIN w ON (" + " AND ".join(f"s.{k} = w.{k}" for k in scenario.KEYS["scenario"]) + "))"
RATE = "(total + 50e0 * prior) / (n + 50e0)"
ENC = f"{RATE} AS scenario_rate, {RATE} - prior AS scenario_rate_delta, n AS scenario_count, round(ln(1 + n), 9) AS scenario_log_count, CAST(n < 20 AS INTEGER) AS scenario_low_support"


def shown(df: DataFrame, prefix: str = "scenario") -> DataFrame:
    return df.select("Id", *[F.round(f"{prefix}_{k}", 9).alias(f"{prefix}_{k}") if k == "log_count" else f"{prefix}_{k}" for k in ("rate", "rate_delta", "count", "log_count", "low_support")])


@query("scenario_oof", over(f"SELECT Id, {ENC} FROM r", f"{BINNED}, {PRIOR}, {G}, {OOF}"))
def scenario_oof(spark, d):
    return shown(scenario.out_of_fold(binned(spark, d), ("scenario",)))


def by_output(sql: str) -> str:
    """The SQL of an encoding, by the keys that have the output bins too."""
    more = scenario.KEYS["scenario_output"][len(scenario.KEYS["scenario"]) :]
    last = scenario.KEYS["scenario"][-1]
    sql = sql.replace(K, ", ".join(scenario.KEYS["scenario_output"])).replace(" AS scenario_", " AS scenario_output_")
    for side in ("g", "w", "h"):
        sql = sql.replace(f"s.{last} = {side}.{last}", " AND ".join(f"s.{k} = {side}.{k}" for k in (last, *more)))
    return sql


@query("scenario_output_oof", over(f"SELECT Id, {by_output(ENC)} FROM r", f"{BINNED}, {PRIOR}, {by_output(G)}, {by_output(OOF)}"))
def scenario_output_oof(spark, d):
    return shown(scenario.out_of_fold(binned(spark, d), ("scenario_output",)), "scenario_output")


APPLY = f"tr AS (SELECT * FROM s WHERE Id % 3 <> 0), p AS (SELECT device_family, sum(Label) / count(*) AS prior FROM tr GROUP BY device_family), m AS (SELECT avg(prior) AS rest FROM p), h AS (SELECT {K}, sum(Label) AS total, count(*) AS n FROM tr GROUP BY ALL), r AS (SELECT s.Id, coalesce(p.prior, m.rest, 5e-1) AS prior, CAST(coalesce(h.total, 0) AS BIGINT) AS total, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM s CROSS JOIN m LEFT JOIN p USING (device_family) LEFT JOIN h ON (" + " AND ".join(f"s.{k} = h.{k}" for k in scenario.KEYS["scenario"]) + "))"


@query("scenario_apply", over(f"SELECT Id, {ENC} FROM r", f"{BINNED}, {APPLY}"))
def scenario_apply(spark, d):
    b = binned(spark, d)
    train = b.filter("Id % 3 <> 0")
    learned = {"scenario": scenario.stats(train, scenario.KEYS["scenario"])}
    return shown(scenario.applied(b, learned, scenario.family_rates(train), ("scenario",)))


@query("scenario_output_apply", over(f"SELECT Id, {by_output(ENC)} FROM r", f"{BINNED}, {by_output(APPLY)}"))
def scenario_output_apply(spark, d):
    b = binned(spark, d)
    train = b.filter("Id % 3 <> 0")
    learned = {"scenario_output": scenario.stats(train, scenario.KEYS["scenario_output"])}
    return shown(scenario.applied(b, learned, scenario.family_rates(train), ("scenario_output",)), "scenario_output")


FOLD_KEY = " || chr(124) || ".join(f"CAST({k} AS VARCHAR)" for k in scenario.KEYS["scenario"])


@query("scenario_hash_fold", over(f"SELECT DISTINCT {K}, CAST({HEX(FOLD_KEY, 8)} % 5 AS INTEGER) AS audit_fold FROM s", BINNED))
def scenario_hash_fold(spark, d):
    return binned(spark, d).select(*scenario.KEYS["scenario"], scenario.hash_fold(scenario.KEYS["scenario"]).alias("audit_fold")).distinct()


@query("interactions", over("SELECT Id, CASE WHEN device_family = 'canon100' THEN CAST(throt_pct AS DOUBLE) / 8e0 ELSE 0e0 END AS canon100_scenario_rate, CASE WHEN device_family = 'canon100' THEN CAST(w_bin AS DOUBLE) ELSE 0e0 END AS canon100_hard_rule_score FROM s", BINNED))
def interactions(spark, d):
    b = binned(spark, d).select("Id", "device_family", (F.col("throt_pct").cast("double") / 8).alias("scenario_rate"), F.col("w_bin").cast("double").alias("hard_rule_score"))
    return scenario.interactions(b).select("Id", "canon100_scenario_rate", "canon100_hard_rule_score")


# -- residuals and decisions ------------------------------------------------

def predicted(spark: SparkSession, d: str) -> DataFrame:
    families = (features.identity, features.power_factor, features.enter_service, features.droop, features.curves)
    pred = {"pred_w": F.col(W) * E.dbl(0.98), "pred_va": F.col(VA) * E.dbl(1.01), "pred_var": F.col(VAR) + E.dbl(5), "pred_pf": F.col(PF) * E.dbl(0.9), "pred_a": F.col(A) - F.col(AC + "ThrotPct") / E.dbl(100)}
    keep = [*(x for s in residuals.TARGETS.values() for x in s if x), *(S.safe(p[0] + ".Ena") for p in S.CURVES.values())]
    names = ("device_family", "pf_control_any_enabled", "enter_service_should_idle", "freqdroop_outside_deadband", *(f"{c}_curve_expected" for c in S.CURVES))
    rows = features.planned(telemetry(spark, d), lambda r: dict(x for f in families for x in f(r).items() if x[0] in names), keys=("Id", "Label", AC + "ThrotPct", *keep))
    return rows.select("Id", "Label", *keep, *names, *[c.alias(k) for k, c in pred.items()], F.lit(0).alias("hard_override_anomaly"))


RES = {}
for _t, (_seen, _scale) in residuals.TARGETS.items():
    _p = {"w": f"{W} * CAST(0.98 AS DOUBLE)", "va": f"{VA} * CAST(1.01 AS DOUBLE)", "var": f"{VAR} + 5e0", "pf": f"{PF} * CAST(0.9 AS DOUBLE)", "a": f"{A} - {AC}ThrotPct / 100e0"}[_t]
    _r = f"({_seen} - ({_p}))"
    RES[_t] = (_r, q_div(_r, _scale or f"greatest(5e-2, abs({_seen}))"))
RESID = ", u AS (SELECT Id, Label, " + FAMILY + " AS device_family, " + ", ".join(f"{n} AS norm_{t}, abs({r}) AS abs_{t}" for t, (r, n) in RES.items()) + " FROM t)"


@query("residual_columns", over("SELECT Id, " + ", ".join(f"abs_{t} AS abs_resid_{t}, norm_{t} AS norm_resid_{t}, abs(norm_{t}) AS abs_norm_resid_{t}" for t in RES) + ", " + q_sum(f"coalesce(abs(norm_{t}), 0e0)" for t in RES) + " AS resid_energy_total, abs_w / (abs_var + 1e-3) AS resid_w_var_ratio FROM u", RESID))
def residual_columns(spark, d):
    names = [f"{k}_{t}" for t in residuals.TARGETS for k in ("abs_resid", "norm_resid", "abs_norm_resid")]
    return residuals.residuals(predicted(spark, d)).select("Id", *names, "resid_energy_total", "resid_w_var_ratio")


QUANTS = ", z AS (SELECT device_family, " + ", ".join(f"greatest(coalesce(quantile_cont(abs(norm_{t}), {q}), CAST({residuals.FALLBACK[k]} AS DOUBLE)), 1e-6) AS {t}_{k}" for t in RES for k, q in residuals.LEVELS.items()) + " FROM u WHERE Label = 0 AND device_family <> 'other' AND Id % 2 = 1 GROUP BY device_family)"


@query("exact_quantiles", over("SELECT device_family, " + ", ".join(f"round({t}_{k}, 9) AS {t}_{k}" for t in RES for k in residuals.LEVELS) + " FROM z", RESID + QUANTS))
def exact_quantiles(spark, d):
    q = residuals.quantiles(residuals.residuals(predicted(spark, d)))
    return q.select("device_family", *[F.round(c, 9).alias(c) for c in q.columns if c != "device_family"])  # the last bits depend on the order of interpolation


@query("residual_calibration", over("SELECT u.Id, " + ", ".join(f"{q_bit(f'abs(norm_{t}) >= {t}_{k}')} AS {k}_resid_{t}" for t in RES for k in residuals.LEVELS) + ", round(" + q_sum(f"coalesce({q_div(f'abs(norm_{t})', f'{t}_extreme')}, 0e0)" for t in RES) + ", 6) AS resid_quantile_score, " + ", ".join(q_sum(q_bit(f"abs(norm_{t}) >= {t}_{k}") for t in RES) + f" AS resid_{k}_count" for k in residuals.LEVELS) + " FROM u LEFT JOIN z USING (device_family)", RESID + QUANTS))
def residual_calibration(spark, d):
    p = residuals.residuals(predicted(spark, d))
    names = [f"{k}_resid_{t}" for t in residuals.TARGETS for k in residuals.LEVELS]
    return residuals.calibrated(p, residuals.quantiles(p)).select("Id", *names, F.round("resid_quantile_score", 6).alias("resid_quantile_score"), *[f"resid_{k}_count" for k in residuals.LEVELS])


MODE = {
    "mode_resid_pf_pf": ("pf", BIN_SQL["pf_mode"]), "mode_resid_var_pf": ("var", BIN_SQL["pf_mode"]), "mode_resid_w_enter_idle": ("w", BIN_SQL["enter_idle"]), "mode_resid_a_enter_idle": ("a", BIN_SQL["enter_idle"]), "mode_resid_w_droop": ("w", BIN_SQL["droop_active"]),
}


@query("mode_residuals", over("SELECT e.Id, " + ", ".join(f"coalesce(abs({RES[t][1]}), 0e0) * CAST({m} AS DOUBLE) AS {k}" for k, (t, m) in MODE.items()) + " FROM e", DROOPED[0]))
def mode_residuals(spark, d):
    p = residuals.residuals(predicted(spark, d))
    return residuals.calibrated(p, residuals.quantiles(p)).select("Id", *MODE)


def nested(cte: str, columns: dict[str, str], frm: str) -> str:
    """A CTE's body that has steps of its own."""
    return "(WITH" + cte[1:] + " " + cols(columns, "row_no", frm) + ")"


ENABLED = ", ".join(f"coalesce({S.safe(S.CURVES[c][0] + '.Ena')}, 0e0) > 0 AND {c}_expected IS NOT NULL AS {c}" for c in S.CURVES)
MODES = DROOPED[0] + "".join(f", x_{c} AS {nested(curve_sql(c)[0], {f'{c}_expected': curve_sql(c)[1][f'{c}_curve_expected']}, 'c')}" for c in S.CURVES)
MODES += ", y AS (SELECT e.row_no, " + ", ".join(f"({BIN_SQL[b]}) = 1 AS {k}" for k, b in (("pf", "pf_mode"), ("droop", "droop_active"), ("enter_idle", "enter_idle"))) + f", {ENABLED} FROM e" + "".join(f" JOIN x_{c} USING (Id)" for c in S.CURVES) + ")"
MODES += ", o AS (SELECT *, voltvar OR wattvar OR pf AS curve_var, voltwatt OR droop OR enter_idle AS dispatch FROM y)" + RESID + QUANTS
PRODUCTS = {f"mode_resid_{t}_{m}": (t, m) for t, m in (("pf", "pf"), ("var", "pf"), ("var", "voltvar"), ("w", "voltwatt"), ("var", "wattvar"), ("w", "droop"), ("w", "enter_idle"), ("a", "enter_idle"))} | {"mode_curve_var_resid": ("var", "curve_var"), "mode_dispatch_w_resid": ("w", "dispatch")}
TAIL = {"mode_extreme_var_curve": f"{q_bit('abs(norm_var) >= var_extreme')} * CAST(curve_var AS INTEGER)", "mode_extreme_w_dispatch": f"{q_bit('abs(norm_w) >= w_extreme')} * CAST(dispatch AS INTEGER)"}


@query("calibration_modes", rowed(over("SELECT u.Id, " + ", ".join(f"coalesce(abs(norm_{t}), 0e0) * CAST({m} AS DOUBLE) AS {k}" for k, (t, m) in PRODUCTS.items()) + ", " + ", ".join(f"{x} AS {k}" for k, x in TAIL.items()) + f", {q_sum(TAIL.values())} AS mode_tail_count FROM u JOIN o USING (Id) LEFT JOIN z USING (device_family)", MODES)))
def calibration_modes(spark, d):
    p = residuals.residuals(predicted(spark, d))
    return residuals.calibrated(p, residuals.quantiles(p)).select("Id", *PRODUCTS, *TAIL, "mode_tail_count")


@query("calibration_ratios", over("SELECT u.Id, " + ", ".join(f"round({q_div(f'abs(norm_{t})', f'{t}_extreme')}, 6) AS q99_ratio_resid_{t}" for t in RES) + " FROM u LEFT JOIN z USING (device_family)", RESID + QUANTS))
def calibration_ratios(spark, d):
    p = residuals.residuals(predicted(spark, d))
    return residuals.calibrated(p, residuals.quantiles(p)).select("Id", *[F.round(f"q99_ratio_resid_{t}", 6).alias(f"q99_ratio_resid_{t}") for t in residuals.TARGETS])


@query("normal_mask", over("SELECT Id, Label = 0 AND device_family <> 'other' AND noncanonical = 0 AS normal FROM f", FLAGGED))
def normal_mask(spark, d):
    return rules.refreshed(flags(spark, d), ["noncanonical"]).select("Id", residuals.normal_rows().alias("normal"))


@query("surrogate_split", over("SELECT Id % 2 = 0 AS fits, count(*) AS n FROM t GROUP BY 1"))
def surrogate_split(spark, d):
    return telemetry(spark, d).groupBy(residuals.fits().alias("fits")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_weights", over("SELECT Id, CASE WHEN device_family = 'canon100' AND Label = 0 THEN 15e-1 ELSE 1e0 END * CASE WHEN w_gt_wmax_tol = 1 THEN CAST(0.35 AS DOUBLE) ELSE 1e0 END AS weight FROM f", FLAGGED))
def sample_weights(spark, d):
    return rules.refreshed(flags(spark, d), ["w_gt_wmax"]).select("Id", decisions.sample_weight().alias("weight"))


PROB = {"p": "CAST(l_partkey % 101 AS DOUBLE) / 101e0 * 6e-1 + CASE WHEN l_quantity < 20e0 THEN 2e-1 ELSE 0e0 END", "q": "CAST(l_suppkey % 89 AS DOUBLE) / 89e0 * 5e-1 + CASE WHEN l_returnflag = 'R' THEN 25e-2 ELSE 0e0 END"}
PROB |= {"ap": "CAST((l_partkey * 7) % 101 AS DOUBLE) / 101e0 * 6e-1 + CASE WHEN l_quantity < 20e0 THEN 2e-1 ELSE 0e0 END", "aq": "CAST((l_suppkey * 5) % 89 AS DOUBLE) / 89e0 * 5e-1 + CASE WHEN l_returnflag = 'R' THEN 25e-2 ELSE 0e0 END"}
PR = f"WITH v AS (SELECT {VIEW['Label']} AS Label, " + ", ".join(f"{x} AS {k}" for k, x in PROB.items()) + " FROM lineitem), g AS (SELECT CAST(i AS INTEGER) AS k, CAST(round(0.02 + 0.01 * i, 2) AS DOUBLE) AS threshold FROM range(59) r(i))"
F2_SQL = "CASE WHEN tp > 0 THEN CAST(tp * 5 AS DOUBLE) / (tp * 5 + (positives - tp) * 4 + fp) ELSE 0e0 END"


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(F.expr(VIEW["Label"]).alias("Label"), *[F.expr(x).alias(k) for k, x in PROB.items()])


COUNTS = "n AS (SELECT k, threshold, CAST(sum(CASE WHEN CAST(p AS FLOAT) >= CAST(threshold AS FLOAT) THEN Label ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN CAST(p AS FLOAT) >= CAST(threshold AS FLOAT) THEN 1 - Label ELSE 0 END) AS BIGINT) AS fp, CAST(sum(Label) AS BIGINT) AS positives FROM v CROSS JOIN g GROUP BY k, threshold)"


@query("threshold_grid", f"{PR}, {COUNTS} SELECT * FROM n")
def threshold_grid(spark, d):
    return decisions.threshold_counts(probabilities(spark, d), "p")


@query("threshold_search", f"{PR}, {COUNTS} SELECT threshold, {F2_SQL} AS f2 FROM n ORDER BY f2 DESC, k LIMIT 1")
def threshold_search(spark, d):
    return decisions.best_threshold(probabilities(spark, d), "p")


BL = f"{PR}, w AS (SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS weight FROM range(21) r(i)), x AS (SELECT Label, weight, CAST(weight * p + (1 - weight) * q AS FLOAT) AS a, CAST(weight * ap + (1 - weight) * aq AS FLOAT) AS b FROM v CROSS JOIN w), y AS (SELECT weight, k, threshold, sum(CASE WHEN a >= CAST(threshold AS FLOAT) THEN Label ELSE 0 END) AS tp, sum(CASE WHEN a >= CAST(threshold AS FLOAT) THEN 1 - Label ELSE 0 END) AS fp, sum(CASE WHEN b >= CAST(threshold AS FLOAT) THEN Label ELSE 0 END) AS atp, sum(CASE WHEN b >= CAST(threshold AS FLOAT) THEN 1 - Label ELSE 0 END) AS afp, sum(Label) AS positives FROM x CROSS JOIN g GROUP BY weight, k, threshold), j AS (SELECT weight, k, threshold, {F2_SQL} AS f2, {F2_SQL.replace('tp', 'atp').replace('fp', 'afp')} AS audit_f2 FROM y), b AS (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY f2 DESC, k) AS r FROM j)"


@query("blend_select", BL + " SELECT weight, threshold, f2, audit_f2 FROM b WHERE r = 1 AND audit_f2 >= (SELECT audit_f2 - CAST(0.003 AS DOUBLE) FROM b WHERE r = 1 AND weight = 1) ORDER BY f2 DESC, audit_f2 DESC, weight = 1 DESC, weight LIMIT 1")
def blend_select(spark, d):
    return decisions.choose_blend(decisions.blend_table(probabilities(spark, d), "p", "q", "ap", "aq")).select("weight", "threshold", "f2", "audit_f2")


MET = "SELECT coalesce(device_family, 'overall') AS device_family, CASE WHEN tp > 0 THEN CAST(tp * 5 AS DOUBLE) / (tp * 5 + fn * 4 + fp) ELSE 0e0 END AS f2, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS recall, CAST(tp + fp AS DOUBLE) / rows AS positive_rate, rows FROM (SELECT device_family, count(*) FILTER (Label = 1 AND w_gt_wmax_tol = 1) AS tp, count(*) FILTER (Label = 0 AND w_gt_wmax_tol = 1) AS fp, count(*) FILTER (Label = 1 AND w_gt_wmax_tol = 0) AS fn, count(*) AS rows FROM f GROUP BY ROLLUP (device_family))"


@query("metrics_rollup", over(MET, FLAGGED))
def metrics_rollup(spark, d):
    return decisions.metrics_by_family(flags(spark, d), "w_gt_wmax_tol")


#: Every number of the view.
NC = [c for c in VIEW if not c.startswith("common_0_") or c in ("common_0_ID", "common_0_L")]
NC = [c for c in NC if c not in ("Id", "Label")]
NC_SQL = ", ".join(f"{{'column': '{c}', 'present': count({c}), 'kept': count({c}) > 0 AND coalesce(min({c}) <> max({c}), FALSE)}}" for c in NC)


@query("nonconstant_columns", over(f"SELECT unnest([{NC_SQL}], recursive := true) FROM t"))
def nonconstant_columns(spark, d):
    return decisions.nonconstant(telemetry(spark, d), NC)


def frame_sql() -> str:
    """All features from the pieces of the other queries, put together by Id."""
    known = lambda c: have(c) if have(c) != "NULL" else "CAST(NULL AS DOUBLE)"
    simple = {"device_fingerprint": MARK, "device_family": FAMILY, "common_missing_any": q_bit(f"{N_MISSING} > 0"), "common_missing_count": N_MISSING, "common_sn_has_decimal_suffix": q_bit("common_0_SN LIKE '%.0'"), "noncanonical": q_bit(f"({FAMILY}) = 'other'")}
    simple |= {S.safe(c): known(c) for c in S.MIRRORED} | {S.safe(c): f"coalesce(CAST({have(c)} AS VARCHAR), '<NA>')" for c in S.STRINGS}
    for name in ("bit_pattern", "block_missingness", "row_min_max_mean", "safe_ratio", "setting_ratios", "deltas", "close_eq", "tolerance_flags", "sign_mismatch", "power_triangle", "phase_spread", "phase_sum_error", "control_compliance", "capacity_ext", "percentages", "enter_service", "pf_control", "dc_consistency", "ac_type_rare"):
        simple |= FAMILY_SQL[name]
    simple |= _integrity_sql()
    parts = {"agg": nested(FLAGGED, AGG_SQL, "f"), "droop": nested(*droop_sql(), "e")}
    parts |= {f"trip_{s}": nested(*trip_sql(s), "c") for s in S.TRIPS} | {f"curve_{c}": nested(*curve_sql(c), "c") for c in S.CURVES}
    return rowed(over("SELECT * EXCLUDE (row_no) FROM base" + "".join(f" JOIN p_{k} USING (Id)" for k in parts), ", base AS (" + cols(simple | TRIP_ANY, "Id, Label") + ")" + "".join(f", p_{k} AS {x}" for k, x in parts.items())))


@query("feature_frame", frame_sql())
def feature_frame(spark, d):
    return features.feature_frame(telemetry(spark, d))
