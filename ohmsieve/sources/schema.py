"""The raw telemetry schema: column names by block, generated from field lists.

Rename raw names once after the scan with :func:`safe`; raw names hold dots
and brackets.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The information model's field names.
IDENTITY = "Mn Md Opt Vr SN".split()
MEASURE_AC = """
ID L ACType W VA Var PF A LLV LNV Hz TmpAmb TmpCab TmpSnk TmpTrns TmpSw TmpOt
ThrotPct ThrotSrc WL1 WL2 WL3 VAL1 VAL2 VAL3 VarL1 VarL2 VarL3 PFL1 PFL2 PFL3
AL1 AL2 AL3 VL1L2 VL2L3 VL3L1 VL1 VL2 VL3
""".split()
CAPACITY = """
ID L WMaxRtg VAMaxRtg VarMaxInjRtg VarMaxAbsRtg WChaRteMaxRtg WDisChaRteMaxRtg
VAChaRteMaxRtg VADisChaRteMaxRtg VNomRtg VMaxRtg VMinRtg AMaxRtg PFOvrExtRtg
PFUndExtRtg NorOpCatRtg AbnOpCatRtg IntIslandCatRtg WMax WMaxOvrExt WOvrExtPF
WMaxUndExt WUndExtPF VAMax VarMaxInj VarMaxAbs WChaRteMax WDisChaRteMax
VAChaRteMax VADisChaRteMax VNom VMax VMin AMax PFOvrExt PFUndExt CtrlModes
IntIslandCat
""".split()
ENTER_SERVICE = "ID L ES ESVHi ESVLo ESHzHi ESHzLo ESDlyTms ESRndTms ESRmpTms ESDlyRemTms".split()
CTL_AC = """
ID L PFWInjEna PFWInjEnaRvrt PFWInjRvrtTms PFWInjRvrtRem PFWAbsEna PFWAbsEnaRvrt
PFWAbsRvrtTms PFWAbsRvrtRem WMaxLimPctEna WMaxLimPct WMaxLimPctRvrt
WMaxLimPctEnaRvrt WMaxLimPctRvrtTms WMaxLimPctRvrtRem WSetEna WSetMod WSet
WSetRvrt WSetPct WSetPctRvrt WSetEnaRvrt WSetRvrtTms WSetRvrtRem VarSetEna
VarSetMod VarSetPri VarSet VarSetRvrt VarSetPct VarSetPctRvrt VarSetEnaRvrt
VarSetRvrtTms VarSetRvrtRem WRmp WRmpRef VarRmp AntiIslEna PFWInj.PF PFWInj.Ext
PFWInjRvrt.PF PFWInjRvrt.Ext PFWAbs.Ext PFWAbsRvrt.Ext
""".split()
CURVE_HEAD = "ID L Ena AdptCrvReq AdptCrvRslt NPt NCrv RvrtTms RvrtRem RvrtCrv".split()
VOLT_VAR_CURVE = "ActPt DeptRef Pri VRef VRefAuto VRefAutoEna VRefAutoTms RspTms ReadOnly".split()
VOLT_WATT_CURVE = "ActPt DeptRef RspTms ReadOnly".split()
WATT_VAR_CURVE = "ActPt DeptRef Pri ReadOnly".split()
DROOP_HEAD = "ID L Ena AdptCtlReq AdptCtlRslt NCtl RvrtTms RvrtRem RvrtCtl".split()
DROOP_CTL = "DbOf DbUf KOf KUf RspTms PMin ReadOnly".split()
TRIP_HEAD = "ID L Ena AdptCrvReq AdptCrvRslt NPt NCrvSet".split()
TRIP_GROUPS = "MustTrip MayTrip MomCess".split()
DC_HEAD = "ID L NPrt DCA DCW".split()
DC_PORT = "PrtTyp ID DCA DCV DCW Tmp".split()
EXTRA_NUMERIC = {
    "DERMeasureAC[0]": "A_SF V_SF Hz_SF W_SF PF_SF VA_SF Var_SF".split(),
    "DERCapacity[0]": "WOvrExtRtg WOvrExtRtgPF WUndExtRtg WUndExtRtgPF W_SF PF_SF VA_SF Var_SF V_SF A_SF".split(),
    "DERCtlAC[0]": ["WSet_SF"],
    "DERMeasureDC[0]": "DCA_SF DCW_SF".split(),
}
#: Trip block: (prefix, axis, side on which the curve trips).
TRIPS = {"lv": ("DERTripLV[0]", "V", "low"), "hv": ("DERTripHV[0]", "V", "high"), "lf": ("DERTripLF[0]", "Hz", "low"), "hf": ("DERTripHF[0]", "Hz", "high")}
#: Expected model id and length of a block.
MODELS = {"common": ("common[0]", 1, 66), "measure_ac": ("DERMeasureAC[0]", 701, 153), "capacity": ("DERCapacity[0]", 702, 50), "enter_service": ("DEREnterService[0]", 703, 17), "measure_dc": ("DERMeasureDC[0]", 714, 68)}
#: Adaptive curve: (prefix, points, x, y, {feature: field}).
CURVES = {
    "voltvar": ("DERVoltVar[0]", 4, "V", "Var", {"deptref": "DeptRef", "pri": "Pri", "vref": "VRef", "vref_auto": "VRefAuto", "vref_auto_ena": "VRefAutoEna", "vref_auto_tms": "VRefAutoTms", "rsp": "RspTms", "readonly": "ReadOnly"}),
    "voltwatt": ("DERVoltWatt[0]", 2, "V", "W", {"deptref": "DeptRef", "rsp": "RspTms", "readonly": "ReadOnly"}),
    "wattvar": ("DERWattVar[0]", 6, "W", "Var", {"deptref": "DeptRef", "pri": "Pri", "readonly": "ReadOnly"}),
}


def _curves(fields: list[str], points: int, x: str, y: str) -> list[str]:
    return CURVE_HEAD + [f"Crv[{c}].{f}" for c in range(3) for f in [*fields, *(f"Pt[{p}].{a}" for p in range(points) for a in (x, y))]]


def _trip(axis: str) -> list[str]:
    group = lambda g: [f"{g}.ActPt", *(f"{g}.Pt[{p}].{a}" for p in range(5) for a in (axis, "Tms"))]
    return TRIP_HEAD + [f"Crv[{c}].{f}" for c in range(2) for f in ["ReadOnly", *(x for g in TRIP_GROUPS for x in group(g))]]


_FIELDS = {
    "common": ("common[0]", ["ID", "L", *IDENTITY, "DA"]),
    "measure_ac": ("DERMeasureAC[0]", MEASURE_AC),
    "capacity": ("DERCapacity[0]", CAPACITY),
    "enter_service": ("DEREnterService[0]", ENTER_SERVICE),
    "ctl_ac": ("DERCtlAC[0]", CTL_AC),
    "volt_var": ("DERVoltVar[0]", _curves(VOLT_VAR_CURVE, 4, "V", "Var")),
    "volt_watt": ("DERVoltWatt[0]", _curves(VOLT_WATT_CURVE, 2, "V", "W")),
    "freq_droop": ("DERFreqDroop[0]", DROOP_HEAD + [f"Ctl[{c}].{f}" for c in range(3) for f in DROOP_CTL]),
    "watt_var": ("DERWattVar[0]", _curves(WATT_VAR_CURVE, 6, "W", "Var")),
    "measure_dc": ("DERMeasureDC[0]", DC_HEAD + [f"Prt[{p}].{f}" for p in range(2) for f in DC_PORT]),
    **{f"trip_{k}": (prefix, _trip(axis)) for k, (prefix, axis, _) in TRIPS.items()},
}
#: Raw columns of each of the 14 blocks.
BLOCKS: dict[str, list[str]] = {k: [f"{p}.{f}" for f in fields] for k, (p, fields) in _FIELDS.items()}
EXTRA = [f"{p}.{f}" for p, fields in EXTRA_NUMERIC.items() for f in fields]
STRINGS = [f"common[0].{f}" for f in IDENTITY] + [f"DERMeasureDC[0].Prt[{p}].IDStr" for p in range(2)]
SOURCE = list(dict.fromkeys([c for cols in BLOCKS.values() for c in cols] + EXTRA + STRINGS))
NUMERIC = [c for c in SOURCE if c not in STRINGS]


def _mirrored() -> list[str]:
    whole = [c for b in ("measure_ac", "capacity", "enter_service", "ctl_ac") for c in BLOCKS[b][2:]]
    heads = [f"{p}.{f}" for p in ("DERVoltVar[0]", "DERVoltWatt[0]") for f in CURVE_HEAD[2:]] + [f"DERFreqDroop[0].{f}" for f in DROOP_HEAD[2:]] + [f"DERWattVar[0].{f}" for f in CURVE_HEAD[2:]]
    trips = [f"{p}.{f}" for p, _, _ in TRIPS.values() for f in TRIP_HEAD[2:]]
    return ["common[0].DA", *whole, *heads, *BLOCKS["measure_dc"][2:], *trips, *EXTRA]


#: Numeric raw columns that the feature frame repeats.
MIRRORED = _mirrored()


def safe(name: str) -> str:
    """The column name without dots and brackets."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", name)


def raw_struct(labelled: bool = True) -> T.StructType:
    """All columns as strings, as a CSV holds them: tokens of missing values are replaced after the scan."""
    extra = ["Id", "Label"] if labelled else ["Id"]
    return T.StructType([T.StructField(c, T.StringType()) for c in [*extra, *SOURCE]])


def table_struct(labelled: bool = True) -> T.StructType:
    """The normalised table: safe names, strings and doubles."""
    fields = [T.StructField("Id", T.LongType())] + [T.StructField("Label", T.IntegerType())] * labelled
    return T.StructType(fields + [T.StructField(safe(c), T.StringType() if c in STRINGS else T.DoubleType()) for c in SOURCE])
