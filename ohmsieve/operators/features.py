"""Feature families as column expressions, and the feature frame.

A family is a function from a :class:`Raw` accessor to ``{name: Column}``.
Quantities that several expressions read (percentages, curve numbers, the
points of the selected curve, what is interpolated) are named by
:meth:`Raw.once` and computed in projections of their own, level by level, so
that no expression repeats them.  Then come the families, and the rule
aggregates that read them.  Asking for some families plans only those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources import schema as S
from . import rules

SQRT3 = sqrt(3.0)
# The two known identities and their families.
CANONICAL = {"canon10": "DERSec|DER Simulator|10 kW DER|1.2.3|SN-Three-Phase", "canon100": "DERSec|DER Simulator 100 kW|1.2.3.1|1.0.0|1100058974"}
FAMILY_CODE = {"canon10": 0, "canon100": 1}
ONE = E.dbl
Family = dict[str, Column]


#: Projections of shared quantities before the families'.
LEVELS = 4


class Raw:
    """Columns of a normalised table by raw name; a column that the table lacks is NULL."""

    def __init__(self, columns: Iterable[str]):
        self.have = set(columns)
        self.wanted: list[dict[str, Column]] = [{} for _ in range(LEVELS)]

    def once(self, level: int, name: str, make: Callable[[], Column]) -> Column:
        """A shared quantity: its column; what makes it is noted for that level and may read those of lower levels."""
        key = f"_once_{name}"
        if key not in self.have:
            self.have.add(key)
            self.wanted[level][key] = make()
        return F.col(key)

    def __call__(self, name: str) -> Column:
        s = S.safe(name)
        if s in self.have:
            return F.col(s)
        return F.lit(None).cast("string" if name in S.STRINGS else "double")

    def ac(self, f: str) -> Column:
        return self(f"DERMeasureAC[0].{f}")

    def cap(self, f: str) -> Column:
        return self(f"DERCapacity[0].{f}")

    def ctl(self, f: str) -> Column:
        return self(f"DERCtlAC[0].{f}")

    def es(self, f: str) -> Column:
        return self(f"DEREnterService[0].{f}")

    def dc(self, f: str) -> Column:
        return self(f"DERMeasureDC[0].{f}")


def fingerprint(r: Raw) -> Column:
    return E.joined([r(c) for c in S.STRINGS[:5]])


def family_of(mark: Column) -> Column:
    out = F.lit("other")
    for name, identity in CANONICAL.items():
        out = F.when(mark == identity, name).otherwise(out)
    return out


def family_code(family: Column) -> Column:
    out = F.lit(-1)
    for name, code in FAMILY_CODE.items():
        out = F.when(family == name, code).otherwise(out)
    return out


def identity(r: Raw) -> Family:
    parts = [r(c) for c in S.STRINGS[:5]]
    missing, mark = E.count_null(parts), fingerprint(r)
    return {"device_fingerprint": mark, "device_family": family_of(mark), "common_missing_any": (missing > 0).cast("int"), "common_missing_count": missing, "common_sn_has_decimal_suffix": E.bit(parts[4].endswith(".0")), "noncanonical": (family_of(mark) == "other").cast("int")}


def mirror(r: Raw) -> Family:
    return {S.safe(c): r(c) for c in S.MIRRORED} | {S.safe(c): F.coalesce(r(c), F.lit(E.NULL_TOKEN)) for c in S.STRINGS}


def missingness(r: Raw) -> Family:
    counts = {b: E.count_null([r(c) for c in cols]) for b, cols in S.BLOCKS.items()}
    out: Family = {}
    for b, n in counts.items():
        out |= {f"missing_{b}_count": n, f"missing_{b}_any": (n > 0).cast("int")}
    out["missing_selected_total"] = E.total(list(counts.values()))
    out["missing_selected_blocks"] = E.total([(n > 0).cast("int") for n in counts.values()])
    out["common_missing_pattern"] = E.pattern([r(f"common[0].{f}") for f in [*S.IDENTITY, "ID", "L"]])
    out["enter_service_missing_pattern"] = E.pattern([r(c) for c in S.BLOCKS["enter_service"]])
    return out


def integrity(r: Raw) -> Family:
    out, wrong, absent = {}, [], []
    for b, (prefix, model, length) in S.MODELS.items():
        i, n = r(f"{prefix}.ID"), r(f"{prefix}.L")
        no_i, no_n, ok_i, ok_n = ~E.fin(i), ~E.fin(n), E.close(i, ONE(model)), E.close(n, ONE(length))
        bad = (~no_i & ~ok_i) | (~no_n & ~ok_n)
        named = {"id_missing": no_i, "len_missing": no_n, "id_match": ok_i, "len_match": ok_n, "integrity_ok": ok_i & ok_n, "structure_anomaly": bad}
        out |= {f"{b}_model_{k}": v.cast("int") for k, v in named.items()}
        wrong.append(bad.cast("int"))
        absent.append((no_i | no_n).cast("int"))
    return out | {"model_structure_anomaly_count": E.total(wrong), "model_structure_missing_count": E.total(absent), "model_structure_anomaly_any": (E.total(wrong) > 0).cast("int")}


def temperature(r: Raw) -> Family:
    sensors = [r.ac(f"Tmp{x}") for x in ("Amb", "Cab", "Snk", "Trns", "Sw", "Ot")]
    low, high = E.row_min(sensors), E.row_max(sensors)
    return {"temp_min": low, "temp_max": high, "temp_mean": E.row_mean(sensors), "temp_spread": high - low, "temp_max_over_ambient": high - sensors[0]}


def ratios(r: Raw) -> Family:
    w, va, var = r.ac("W"), r.ac("VA"), r.ac("Var")
    pairs = {
        "w_over_wmaxrtg": (w, r.cap("WMaxRtg")), "w_over_wmax": (w, r.cap("WMax")), "va_over_vamax": (va, r.cap("VAMax")),
        "va_over_vamaxrtg": (va, r.cap("VAMaxRtg")), "var_over_injmax": (var, r.cap("VarMaxInj")), "var_over_absmax": (var, r.cap("VarMaxAbs")),
        "a_over_amax": (r.ac("A"), r.cap("AMax")), "llv_over_vnom": (r.ac("LLV"), r.cap("VNom")), "lnv_over_vnom": (r.ac("LNV") * ONE(SQRT3), r.cap("VNom")),
        "wmax_over_wmaxrtg": (r.cap("WMax"), r.cap("WMaxRtg")), "vamax_over_vamaxrtg": (r.cap("VAMax"), r.cap("VAMaxRtg")),
        "vmax_over_vnom": (r.cap("VMax"), r.cap("VNom")), "vmin_over_vnom": (r.cap("VMin"), r.cap("VNom")),
    }
    return {k: E.sdiv(n, d) for k, (n, d) in pairs.items()}


def deltas(r: Raw) -> Family:
    w, va, var = r.ac("W"), r.ac("VA"), r.ac("Var")
    return {
        "w_minus_wmax": w - r.cap("WMax"), "w_minus_wmaxrtg": w - r.cap("WMaxRtg"), "va_minus_vamax": va - r.cap("VAMax"), "var_minus_injmax": var - r.cap("VarMaxInj"),
        "var_plus_absmax": var + r.cap("VarMaxAbs"), "llv_minus_lnv_sqrt3": r.ac("LLV") - r.ac("LNV") * ONE(SQRT3), "hz_delta_60": r.ac("Hz") - ONE(60),
    }


def envelope(r: Raw) -> Family:
    w, va, var = r.ac("W"), r.ac("VA"), r.ac("Var")
    tol_w, tol_va = E.tolerance(50, 0.02, r.cap("WMaxRtg")), E.tolerance(50, 0.02, r.cap("VAMax"))
    tol_inj, tol_abs = E.tolerance(20, 0.02, r.cap("VarMaxInj")), E.tolerance(20, 0.02, r.cap("VarMaxAbs"))
    equal = {"w_eq_wmaxrtg": (w, r.cap("WMaxRtg")), "w_eq_wmax": (w, r.cap("WMax")), "var_eq_varmaxinj": (var, r.cap("VarMaxInj")), "var_eq_neg_varmaxabs": (var, -r.cap("VarMaxAbs"))}
    over = {"w_gt_wmax_tol": w > r.cap("WMax") + tol_w, "w_gt_wmaxrtg_tol": w > r.cap("WMaxRtg") + tol_w, "va_gt_vamax_tol": va > r.cap("VAMax") + tol_va, "var_gt_injmax_tol": var > r.cap("VarMaxInj") + tol_inj, "var_lt_absmax_tol": var < -r.cap("VarMaxAbs") - tol_abs}
    return {k: E.close(a, b).cast("int") for k, (a, b) in equal.items()} | {"pf_sign_mismatch": E.sign_differs(r.ac("PF"), w).cast("int")} | {k: E.bit(p) for k, p in over.items()}


def triangle(r: Raw) -> Family:
    w, va, var = r.ac("W"), r.ac("VA"), r.ac("Var")
    magnitude, factor = F.sqrt(w * w + var * var), E.sdiv(w, va)
    return {"va_minus_pqmag": va - magnitude, "va_over_pqmag": E.sdiv(va, magnitude), "pf_from_w_va": factor, "pf_error": r.ac("PF") - factor}


def phases(r: Raw) -> Family:
    of = lambda *names: [r.ac(n) for n in names]
    groups = {"w": "W", "va": "VA", "var": "Var"}
    out = {f"{k}_phase_sum_error": r.ac(f) - E.total(of(f"{f}L1", f"{f}L2", f"{f}L3")) for k, f in groups.items()}
    return out | {"phase_ll_spread": E.spread(of("VL1L2", "VL2L3", "VL3L1")), "phase_ln_spread": E.spread(of("VL1", "VL2", "VL3")), "phase_w_spread": E.spread(of("WL1", "WL2", "WL3")), "phase_var_spread": E.spread(of("VarL1", "VarL2", "VarL3"))}


def control(r: Raw) -> Family:
    w, var, rtg, inj = r.ac("W"), r.ac("Var"), r.cap("WMaxRtg"), r.cap("VarMaxInj")
    on = {k: E.nz(r.ctl(f)) > 0 for k, f in (("wset", "WSetEna"), ("wmaxlim", "WMaxLimPctEna"), ("varset", "VarSetEna"))}
    share = lambda base, f: base * (r.ctl(f) / ONE(100))
    wset_t, lim_t, var_t = share(rtg, "WSetPct"), share(rtg, "WMaxLimPct"), share(inj, "VarSetPct")
    err = {
        "wset_abs_error": F.when(on["wset"], F.abs(w - r.ctl("WSet"))), "wsetpct_target": wset_t, "wsetpct_abs_error": F.when(on["wset"], F.abs(w - wset_t)),
        "wmaxlim_target": lim_t, "wmaxlim_excess": F.when(on["wmaxlim"], w - lim_t),
        "varset_abs_error": F.when(on["varset"], F.abs(var - r.ctl("VarSet"))), "varsetpct_target": var_t, "varsetpct_abs_error": F.when(on["varset"], F.abs(var - var_t)),
    }
    far_w, far_var = E.tolerance(50, 0.05, rtg), E.tolerance(20, 0.05, inj)
    far = {"wset_enabled_far": ("wset_abs_error", far_w), "wsetpct_enabled_far": ("wsetpct_abs_error", far_w), "wmaxlim_enabled_far": ("wmaxlim_excess", far_w), "varsetpct_enabled_far": ("varsetpct_abs_error", far_var)}
    return err | {k: E.bit(err[e] > t) for k, (e, t) in far.items()}


def capacity(r: Raw) -> Family:
    settings = {"vnom": ("VNom", "VNomRtg"), "vmax": ("VMax", "VMaxRtg"), "vmin": ("VMin", "VMinRtg"), "amax": ("AMax", "AMaxRtg"), "pfover": ("PFOvrExt", "PFOvrExtRtg"), "pfunder": ("PFUndExt", "PFUndExtRtg")}
    out = {f"{k}_setting_delta": r.cap(a) - r.cap(b) for k, (a, b) in settings.items()}
    for end, tail in (("rtg", "Rtg"), ("setting", "")):
        for name, f, base in (("charge_rate", "WChaRteMax", "WMax"), ("discharge_rate", "WDisChaRteMax", "WMax"), ("charge_va", "VAChaRteMax", "VAMax"), ("discharge_va", "VADisChaRteMax", "VAMax")):
            out[f"{name}_share_{end}"] = E.sdiv(r.cap(f + tail), r.cap(base + tail))
    gaps = []
    for f in "WMax VAMax VarMaxInj VarMaxAbs VNom VMax VMin AMax".split():
        a, b = r.cap(f + "Rtg"), r.cap(f)
        gaps.append(E.bit(E.fin(a) & E.fin(b) & (F.abs(b - a) > E.tolerance(1, 0.01, F.abs(a)))))
    return out | {"rating_setting_gap_count": E.total(gaps)}


def voltage_pct(r: Raw) -> Column:
    return r.once(0, "voltage_pct", lambda: ONE(100) * E.sdiv(r.ac("LLV"), r.cap("VNom")))


def w_pct(r: Raw) -> Column:
    return r.once(0, "w_pct", lambda: ONE(100) * E.sdiv(r.ac("W"), r.cap("WMaxRtg")))


def reactive_pct(r: Raw) -> Column:
    return r.once(0, "reactive_pct", lambda: E.var_pct(r.ac("Var"), r.cap("VarMaxInj"), r.cap("VarMaxAbs")))


def percentages(r: Raw) -> Family:
    return {"voltage_pct": voltage_pct(r), "line_neutral_voltage_pct": ONE(100) * E.sdiv(r.ac("LNV") * ONE(SQRT3), r.cap("VNom")), "w_pct_of_rtg": w_pct(r), "var_pct_of_limit": reactive_pct(r)}


def enter_service(r: Raw) -> Family:
    v, hz = voltage_pct(r), r.ac("Hz")
    vlo, vhi, hlo, hhi = (r.es(f) for f in ("ESVLo", "ESVHi", "ESHzLo", "ESHzHi"))
    inside = E.flag(E.fin(v) & E.fin(vlo) & E.fin(vhi) & v.between(vlo, vhi)) & E.flag(E.fin(hz) & E.fin(hlo) & E.fin(hhi) & hz.between(hlo, hhi))
    on = E.flag(E.fin(r.es("ES")) & (r.es("ES") == 1))
    idle = ~on | ~inside
    blocked = {"power": F.abs(r.ac("W")) > E.tolerance(50, 0.02, r.cap("WMaxRtg")), "va": r.ac("VA") > E.tolerance(50, 0.02, r.cap("VAMax")), "current": r.ac("A") > E.tolerance(1, 0.02, r.cap("AMax"))}
    out = {
        "enabled": on.cast("int"), "state_anomaly": E.bit(E.fin(r.es("ES")) & (r.es("ES") >= 1.5)), "inside_window": inside.cast("int"), "outside_window": (~inside).cast("int"), "should_idle": idle.cast("int"),
        "v_window_width": vhi - vlo, "hz_window_width": hhi - hlo, "v_margin_low": v - vlo, "v_margin_high": vhi - v, "hz_margin_low": hz - hlo, "hz_margin_high": hhi - hz,
        "total_delay": r.es("ESDlyTms") + r.es("ESRndTms"), "delay_remaining": r.es("ESDlyRemTms"), "ramp_time": r.es("ESRmpTms"), "delay_active": E.bit(E.nz(r.es("ESDlyRemTms")) > 0),
    } | {f"blocked_{k}": E.bit(idle & E.flag(p)) for k, p in blocked.items()}
    return {f"enter_service_{k}": c for k, c in out.items()}


def power_factor(r: Raw) -> Family:
    on = lambda f: E.nz(r.ctl(f)) > 0
    miss = lambda ena, target: F.when(on(ena) & E.fin(r.ctl(target)), F.abs(F.abs(r.ac("PF")) - r.ctl(target)))
    there = lambda f: E.fin(r.ctl(f)).cast("int")
    return {
        "pf_control_any_enabled": E.bit(on("PFWInjEna") | on("PFWAbsEna")), "pf_control_any_reversion": E.bit(on("PFWInjEnaRvrt") | on("PFWAbsEnaRvrt")),
        "pf_inj_target_error": miss("PFWInjEna", "PFWInj.PF"), "pf_inj_reversion_error": miss("PFWInjEnaRvrt", "PFWInjRvrt.PF"),
        "pf_inj_ext_present": there("PFWInj.Ext"), "pf_inj_rvrt_ext_present": there("PFWInjRvrt.Ext"), "pf_abs_ext_present": there("PFWAbs.Ext"), "pf_abs_rvrt_ext_present": there("PFWAbsRvrt.Ext"),
        "pf_inj_enabled_missing_target": E.bit(on("PFWInjEna") & ~E.fin(r.ctl("PFWInj.PF"))), "pf_reactive_near_limit": E.bit(F.abs(reactive_pct(r)) >= 95),
    }


def trip(r: Raw, short: str) -> Family:
    prefix, axis, side = S.TRIPS[short]
    index = r.once(0, f"{short}_index", lambda: E.curve_index(r(f"{prefix}.AdptCrvRslt"), 2))
    points = lambda g, f: [r.once(1, f"{short}_{g}_{f}_{p}", lambda p=p: E.pick([r(f"{prefix}.Crv[{c}].{g}.Pt[{p}].{f}") for c in range(2)], index)) for p in range(5)]
    ends = lambda name, xs: (r.once(2, f"{short}_{name}_min", lambda: E.row_min(xs)), r.once(2, f"{short}_{name}_max", lambda: E.row_max(xs)))
    act = lambda g: E.pick([r(f"{prefix}.Crv[{c}].{g}.ActPt") for c in range(2)], index)
    must_x, must_t, mom_x, mom_t = points("MustTrip", axis), points("MustTrip", "Tms"), points("MomCess", axis), points("MomCess", "Tms")
    may = [r(f"{prefix}.Crv[{c}].MayTrip.Pt[{p}].{axis}") for c in range(2) for p in range(5)]
    measure = voltage_pct(r) if axis == "V" else r.ac("Hz")
    on = E.nz(r(f"{prefix}.Ena")) > 0
    (must_low, must_high), (mom_low, mom_high) = ends("must", must_x), ends("mom", mom_x)
    margin = measure - must_high if side == "low" else must_low - measure
    outside = on & E.flag(E.fin(margin) & (margin < 0))
    power = outside & E.flag(F.abs(r.ac("W")) > E.tolerance(50, 0.02, r.cap("WMaxRtg")))
    n_must, n_mom = E.pair_count(must_x, must_t), E.pair_count(mom_x, mom_t)
    out = {
        "curve_idx": index, "enabled": on.cast("int"), "curve_req_gap": r(f"{prefix}.AdptCrvReq") - r(f"{prefix}.AdptCrvRslt"),
        "musttrip_count": n_must, "musttrip_actpt_gap": act("MustTrip") - n_must, "musttrip_axis_min": must_low, "musttrip_axis_max": must_high, "musttrip_axis_span": must_high - must_low, "musttrip_tms_span": E.spread(must_t), "musttrip_reverse_steps": E.reverse_steps(must_x),
        "momcess_count": n_mom, "momcess_actpt_gap": act("MomCess") - n_mom, "momcess_axis_span": mom_high - mom_low, "momcess_tms_span": E.spread(mom_t), "momcess_reverse_steps": E.reverse_steps(mom_x),
        "maytrip_present_any": E.any_of([E.fin(c) for c in may]).cast("int"), "musttrip_margin": margin, "outside_musttrip": outside.cast("int"), "power_when_outside": power.cast("int"), "momcess_musttrip_gap": F.abs(mom_low - must_high),
    }
    return {f"trip_{short}_{k}": c for k, c in out.items()}


def trip_any(r: Raw) -> Family:
    """The two flags over all blocks, from each block's nearest limit only."""
    outside = []
    for short, (prefix, axis, side) in S.TRIPS.items():
        index = r.once(0, f"{short}_index", lambda prefix=prefix: E.curve_index(r(f"{prefix}.AdptCrvRslt"), 2))
        limits = [r.once(1, f"{short}_MustTrip_{axis}_{p}", lambda p=p, index=index, prefix=prefix, axis=axis: E.pick([r(f"{prefix}.Crv[{c}].MustTrip.Pt[{p}].{axis}") for c in range(2)], index)) for p in range(5)]
        measure = voltage_pct(r) if axis == "V" else r.ac("Hz")
        margin = measure - E.row_max(limits) if side == "low" else E.row_min(limits) - measure
        outside.append((E.nz(r(f"{prefix}.Ena")) > 0) & E.flag(E.fin(margin) & (margin < 0)))
    busy = E.flag(F.abs(r.ac("W")) > E.tolerance(50, 0.02, r.cap("WMaxRtg")))
    return {"trip_any_outside_musttrip": E.any_of(outside).cast("int"), "trip_any_power_when_outside": (E.any_of(outside) & busy).cast("int")}


def trips(r: Raw) -> Family:
    out: Family = {}
    for s in S.TRIPS:
        out |= trip(r, s)
    return out | trip_any(r)


def curve(r: Raw, name: str) -> Family:
    prefix, n, xf, yf, meta = S.CURVES[name]
    index = r.once(0, f"{name}_index", lambda: E.curve_index(r(f"{prefix}.AdptCrvRslt"), 3))
    of = lambda f: r.once(1, f"{name}_{S.safe(f)}", lambda: E.pick([r(f"{prefix}.Crv[{c}].{f}") for c in range(3)], index))
    xs, ys = ([of(f"Pt[{p}].{f}") for p in range(n)] for f in (xf, yf))
    v, w, q = voltage_pct(r), w_pct(r), reactive_pct(r)
    # the reference voltage of the first curve counts, whichever curve is selected
    measure, observed = {"voltvar": (v - ONE(100) + F.coalesce(r(f"{prefix}.Crv[0].VRef"), ONE(100)), q), "voltwatt": (v, w), "wattvar": (w, q)}[name]
    count, steep = E.pair_count(xs, ys), E.slopes(xs, ys)
    on_x, on_y = E.paired(xs, ys)
    on_x, on_y = ([r.once(2, f"{name}_on_{k}{i}", lambda c=c: c) for i, c in enumerate(cs)] for k, cs in (("x", on_x), ("y", on_y)))
    expected = r.once(3, f"{name}_expected", lambda: E.interpolate(r.once(2, f"{name}_at", lambda: E.finite(measure)), on_x, on_y))
    low, high = r.once(2, f"{name}_min", lambda: E.row_min(xs)), r.once(2, f"{name}_max", lambda: E.row_max(xs))
    out = {
        "idx": index, "point_count": count, "actpt_gap": of("ActPt") - count, "x_span": high - low, "y_span": E.spread(ys), "reverse_steps": E.reverse_steps(xs),
        "mean_slope": E.row_mean(steep), "max_abs_slope": E.row_max([F.abs(s) for s in steep]), "measure_margin_low": measure - low, "measure_margin_high": high - measure,
        "expected": expected, "error": observed - expected,
    } | {k: of(f) for k, f in meta.items()}
    return {f"{name}_curve_{k}": c for k, c in out.items()}


def curves(r: Raw) -> Family:
    return curve(r, "voltvar") | curve(r, "voltwatt") | curve(r, "wattvar")


def droop(r: Raw) -> Family:
    every = {f: [r(f"DERFreqDroop[0].Ctl[{c}].{f}") for c in range(3)] for f in S.DROOP_CTL}
    index = r.once(0, "droop_index", lambda: E.curve_index(r("DERFreqDroop[0].AdptCtlRslt"), 3))
    d = {f: r.once(1, f"droop_{f}", lambda cols=cols: E.pick(cols, index)) for f, cols in every.items()}
    hz = r.ac("Hz")
    over = r.once(2, "droop_over", lambda: E.clamp0(hz - (ONE(60) + d["DbOf"])))
    under = r.once(2, "droop_under", lambda: E.clamp0((ONE(60) - d["DbUf"]) - hz))
    out = {
        "ctl_idx": index, "dbof": d["DbOf"], "dbuf": d["DbUf"], "kof": d["KOf"], "kuf": d["KUf"], "rsp": d["RspTms"], "pmin": d["PMin"], "readonly": d["ReadOnly"],
        "deadband_width": d["DbOf"] + d["DbUf"], "over_activation": over, "under_activation": under, "expected_delta_pct": ONE(100) * E.sdiv(over, d["KOf"]) - ONE(100) * E.sdiv(under, d["KUf"]),
        "outside_deadband": (E.flag(over > 0) | E.flag(under > 0)).cast("int"), "w_over_pmin_pct": w_pct(r) - d["PMin"],
        "db_span": E.spread(every["DbOf"] + every["DbUf"]), "k_span": E.spread(every["KOf"] + every["KUf"]), "pmin_span": E.spread(every["PMin"]),
    }
    return {f"freqdroop_{k}": c for k, c in out.items()}


def direct_current(r: Raw) -> Family:
    w, dcw, dca = r.ac("W"), r.dc("DCW"), r.dc("DCA")
    p = lambda f: (r.dc(f"Prt[0].{f}"), r.dc(f"Prt[1].{f}"))
    (w0, w1), (v0, v1), (a0, a1), (t0, t1) = p("DCW"), p("DCV"), p("DCA"), p("PrtTyp")
    return {
        "dcw_over_w": E.sdiv(dcw, w), "dcw_over_abs_w": E.sdiv(dcw, F.abs(w)), "dcw_minus_port_sum": dcw - (w0 + w1), "dcv_spread": F.abs(v0 - v1), "dca_spread": F.abs(a0 - a1), "dc_port0_share": E.sdiv(w0, w0 + w1),
        "dc_port_type_mismatch": E.bit(E.fin(t0) & E.fin(t1) & (t0 != t1)), "dc_port_type_rare_any": (E.flag(t0 == 7) | E.flag(t1 == 7)).cast("int"),
        "ac_zero_dc_positive": E.bit((F.abs(w) <= E.EPSILON) & (dcw > 0)), "ac_positive_dc_zero": E.bit((w > 0) & (F.abs(dcw) <= E.EPSILON)), "ac_dc_same_sign": (F.signum(E.nz(w)) == F.signum(E.nz(dcw))).cast("int"), "dca_over_total": E.sdiv(dca, a0 + a1),
    }


def ac_type(r: Raw) -> Family:
    return {"ac_type_is_rare": E.bit(E.fin(r.ac("ACType")) & (r.ac("ACType") == 3))}


FAMILIES: dict[str, Callable[[Raw], Family]] = {
    "identity": identity, "mirror": mirror, "missingness": missingness, "integrity": integrity, "temperature": temperature, "ratios": ratios, "deltas": deltas, "envelope": envelope, "triangle": triangle, "phases": phases, "control": control, "capacity": capacity,
    "percentages": percentages, "enter_service": enter_service, "power_factor": power_factor, "trips": trips, "trip_any": trip_any, "curves": curves, "droop": droop, "direct_current": direct_current, "ac_type": ac_type,
}


def planned(df: DataFrame, build: Callable[[Raw], Family], keys: Iterable[str] = ("Id",), only: Iterable[str] | None = None) -> DataFrame:
    """The key columns and what ``build`` makes, or some of it, behind the shared quantities, each level in a projection of its own."""
    r = Raw(df.columns)
    made = build(r)
    for level in r.wanted:
        if level:
            df = df.select("*", *[c.alias(k) for k, c in level.items()])
    return df.select(*keys, *[made[k].alias(k) for k in (only or made)])


def family_columns(df: DataFrame, *names: str, keys: tuple[str, ...] = ("Id",)) -> DataFrame:
    """Only some families, beside the key columns: a narrow plan."""
    return planned(df, lambda r: {k: c for n in dict.fromkeys(names) for k, c in FAMILIES[n](r).items()}, keys)


def feature_frame(df: DataFrame, active: list[str] | None = None, families: Iterable[str] | None = None) -> DataFrame:
    """All features and the rule aggregates, or those of some families with all that the rules need; ``Label`` is kept where there is one."""
    keys = ("Id", "Label") if "Label" in df.columns else ("Id",)
    names = [n for n in FAMILIES if n != "trip_any"] if families is None else [*families, *rules.NEEDS]  # "trips" has the columns of "trip_any"
    out = family_columns(df, *names, keys=keys)
    return out.select("*", *[c.alias(k) for k, c in rules.aggregates(active).items()])
