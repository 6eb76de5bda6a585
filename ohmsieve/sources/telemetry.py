"""A deterministic telemetry view over the supplied ``lineitem`` table.

The expressions are plain arithmetic that reads the same in Spark and in
other SQL engines, with literals that are doubles in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AC, CAP, CTL, ES, DC = "DERMeasureAC_0_", "DERCapacity_0_", "DERCtlAC_0_", "DEREnterService_0_", "DERMeasureDC_0_"


def gone(n: int, value: str, of: str = "l_suppkey") -> str:
    """The value, missing on every n-th key."""
    return f"CASE WHEN {of} % {n} = 0 THEN NULL ELSE {value} END"


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


LINE, Q, E, D = "CAST(l_linenumber AS DOUBLE)", "l_quantity", "l_extendedprice", "(l_discount + 0e0)"


def _view() -> dict[str, str]:
    v = {
        "Id": "(l_partkey * 10 + l_linenumber) * 10000000 + l_orderkey",
        "Label": "CASE WHEN l_returnflag = 'R' OR l_quantity < 20e0 THEN 1 ELSE 0 END",
        "common_0_Mn": gone(37, "'DERSec'"),
        "common_0_Md": "CASE WHEN l_linenumber % 2 = 0 THEN 'DER Simulator' ELSE 'DER Simulator 100 kW' END",
        "common_0_Opt": "CASE WHEN l_linenumber % 2 = 0 THEN '10 kW DER' ELSE '1.2.3.1' END",
        "common_0_Vr": "CASE WHEN l_linenumber % 2 = 0 THEN '1.2.3' ELSE '1.0.0' END",
        "common_0_SN": "CASE WHEN l_linenumber % 2 = 0 THEN 'SN-Three-Phase' WHEN l_partkey % 41 = 0 THEN '1100058974.0' ELSE '1100058974' END",
        "common_0_ID": "CASE WHEN l_partkey % 43 = 0 THEN NULL WHEN l_partkey % 47 = 0 THEN 2e0 ELSE 1e0 END",
        "common_0_L": gone(59, "66e0", "l_partkey"),
    }
    for block, model, length in ((AC, 701, 153), (CAP, 702, 50), (ES, 703, 17), (DC, 714, 68)):
        v[f"{block}ID"], v[f"{block}L"] = gone(model % 50 + 11, num(model), "l_partkey"), f"CASE WHEN l_suppkey % {length % 50 + 7} = 0 THEN {num(length + 1)} ELSE {num(length)} END"
    v |= {AC + k: x for k, x in {
        "ACType": "CAST(l_partkey % 4 AS DOUBLE)", "W": f"CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN 0e0 - {E} ELSE {E} END", "VA": gone(29, f"{E} * 105e-2"), "Var": f"({D} - 5e-2) * {E}",
        "PF": "CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN 0e0 - 9e-1 ELSE 95e-2 END", "A": f"{Q} * 3e0", "LLV": f"46e1 + 5e0 * {LINE}", "LNV": f"265e0 + 2e0 * {LINE}", "Hz": f"6e1 + 1e1 * ({D} - 5e-2)",
        "TmpAmb": gone(17, f"2e1 + {LINE}"), "TmpCab": f"25e0 + {Q} / 4e0", "TmpSnk": gone(19, f"3e1 + {Q} / 8e0"), "TmpTrns": "CAST(NULL AS DOUBLE)", "TmpSw": "24e0", "TmpOt": gone(13, "22e0", "l_partkey"),
        "ThrotPct": f"{Q} * 2e0", "ThrotSrc": gone(11, "CAST(l_partkey % 3 AS DOUBLE)"),
        "WL1": f"{E} / 3e0", "WL2": gone(7, f"{E} / 4e0"), "WL3": f"{E} / 5e0", "VAL1": f"{E} / 3e0", "VAL2": f"{E} / 3e0", "VAL3": f"{E} / 3e0", "VarL1": f"{D} * 1e2", "VarL2": f"{D} * 5e1", "VarL3": gone(5, f"{D} * 2e1"),
        "VL1L2": "48e1", "VL2L3": f"478e0 + {LINE}", "VL3L1": gone(9, "481e0"), "VL1": "277e0", "VL2": f"275e0 + {LINE}", "VL3": "276e0",
    }.items()}
    v |= {CAP + k: x for k, x in {
        "WMaxRtg": f"CASE WHEN l_partkey % 31 = 0 THEN 0e0 WHEN l_partkey % 37 = 0 THEN NULL ELSE 2e3 * {Q} END", "VAMaxRtg": f"21e2 * {Q}", "VarMaxInjRtg": f"4e1 * {Q}", "VarMaxAbsRtg": f"4e1 * {Q}", "WMax": f"15e2 * {Q}", "VAMax": gone(33, f"16e2 * {Q}", "l_partkey"),
        "VarMaxInj": gone(27, f"4e1 * {Q}", "l_partkey"), "VarMaxAbs": f"3e1 * {Q}", "VNomRtg": "48e1", "VMaxRtg": "528e0", "VMinRtg": "422e0", "AMaxRtg": "1e2", "VNom": gone(53, "48e1", "l_partkey"), "VMax": "525e0", "VMin": gone(21, "43e1"), "AMax": f"9e1 + {LINE}",
        "WChaRteMaxRtg": f"{Q} * 1e2", "WDisChaRteMaxRtg": f"{Q} * 2e2", "VAChaRteMaxRtg": f"{Q} * 3e2", "VADisChaRteMaxRtg": gone(25, f"{Q} * 4e2"), "WChaRteMax": f"{Q} * 9e1", "WDisChaRteMax": f"{Q} * 19e1", "VAChaRteMax": f"{Q} * 29e1", "VADisChaRteMax": f"{Q} * 39e1",
        "PFOvrExtRtg": "85e-2", "PFOvrExt": gone(15, "9e-1"), "PFUndExtRtg": "85e-2", "PFUndExt": "88e-2",
    }.items()}
    v |= {CTL + k: x for k, x in {
        "WSetEna": "CAST(l_partkey % 2 AS DOUBLE)", "WSet": f"{E} * 9e-1", "WSetPct": gone(14, f"{Q} + 1e1"), "WMaxLimPctEna": gone(3, "1e0"), "WMaxLimPct": f"{Q} + 2e1", "VarSetEna": "CAST(l_suppkey % 2 AS DOUBLE)", "VarSet": "1e2", "VarSetPct": f"{Q}",
        "PFWInjEna": "CAST(l_partkey % 3 AS DOUBLE)", "PFWInjEnaRvrt": gone(4, "1e0"), "PFWAbsEna": "0e0", "PFWAbsEnaRvrt": "0e0", "PFWInj_PF": gone(6, "93e-2"), "PFWInj_Ext": gone(8, "1e0"), "PFWInjRvrt_PF": "9e-1", "PFWInjRvrt_Ext": "CAST(NULL AS DOUBLE)",
        "PFWAbs_Ext": "CASE WHEN l_partkey % 97 = 0 THEN 1e0 ELSE NULL END", "PFWAbsRvrt_Ext": "CASE WHEN l_partkey % 89 = 0 THEN 1e0 ELSE NULL END",
    }.items()}
    v |= {ES + k: x for k, x in {"ES": "CASE WHEN l_suppkey % 61 = 0 THEN NULL WHEN l_suppkey % 67 = 0 THEN 2e0 WHEN l_suppkey % 10 = 0 THEN 0e0 ELSE 1e0 END", "ESVHi": "103e0", "ESVLo": gone(16, "97e0"), "ESHzHi": "602e-1", "ESHzLo": "598e-1", "ESDlyTms": f"{Q}", "ESRndTms": "5e0", "ESRmpTms": "3e1", "ESDlyRemTms": gone(2, f"{Q} - 25e0")}.items()}
    v |= {DC + k: x for k, x in {"DCW": f"CASE WHEN l_partkey % 13 = 0 THEN 0e0 ELSE {E} * 102e-2 END", "DCA": f"{Q}", "Prt_0_DCW": f"{E} / 2e0", "Prt_1_DCW": gone(12, f"{E} / 2e0"), "Prt_0_DCV": "6e2", "Prt_1_DCV": f"59e1 + {LINE}", "Prt_0_DCA": f"{Q} / 2e0", "Prt_1_DCA": f"{Q} / 4e0", "Prt_0_PrtTyp": "CAST(l_partkey % 8 AS DOUBLE)", "Prt_1_PrtTyp": gone(18, "CAST(l_suppkey % 8 AS DOUBLE)")}.items()}
    for k, (name, axis) in enumerate((("DERTripLV_0_", "V"), ("DERTripHV_0_", "V"), ("DERTripLF_0_", "Hz"), ("DERTripHF_0_", "Hz"))):
        v |= {f"{name}Ena": gone(3 + k, "1e0", "l_partkey"), f"{name}AdptCrvReq": "1e0", f"{name}AdptCrvRslt": gone(9, f"CAST(l_partkey % {3 + k} AS DOUBLE)")}
        base = (94, 101, 59.8, 60.2)[k]
        for c in range(2):
            for g, shift in (("MustTrip", 0), ("MayTrip", 0.25), ("MomCess", 0.5)):
                pre = f"{name}Crv_{c}_{g}_"
                v[f"{pre}ActPt"] = num(4 - c)
                for p in range(4):
                    step = (1 if k % 2 else -1) * p * (0.05 if axis == "Hz" else 2)
                    v[f"{pre}Pt_{p}_{axis}"] = gone(20 + p, f"{num(base + shift + c)} + {num(step)}", "l_partkey")
                    v[f"{pre}Pt_{p}_Tms"] = gone(30 + p, f"{num(10 * p + c)}", "l_partkey")
    for name, n, x, y, start, step in (("DERVoltVar_0_", 4, "V", "Var", 94, 4), ("DERVoltWatt_0_", 2, "V", "W", 95, 8), ("DERWattVar_0_", 6, "W", "Var", 0, 18)):
        v |= {f"{name}Ena": gone(3, "1e0"), f"{name}AdptCrvRslt": gone(10, "CAST(l_partkey % 5 AS DOUBLE)")}
        for c in range(3):
            pre = f"{name}Crv_{c}_"
            v |= {f"{pre}ActPt": num(n), f"{pre}DeptRef": num(c + 1), f"{pre}ReadOnly": gone(4, num(c % 2))}
            if name == "DERVoltVar_0_":
                v |= {f"{pre}Pri": "1e0", f"{pre}VRef": gone(6, num(100 + c)), f"{pre}VRefAuto": "0e0", f"{pre}VRefAutoEna": "1e0", f"{pre}VRefAutoTms": "3e2"}
            if name == "DERWattVar_0_":
                v[f"{pre}Pri"] = "2e0"
            else:
                v[f"{pre}RspTms"] = num(5 + c)
            for p in range(n):
                up = -1 if c == 1 else 1  # the second curve falls
                v[f"{pre}Pt_{p}_{x}"] = gone(40 + p + c, f"{num(start)} + {num(step * (p if up > 0 else n - 1 - p))}", "l_partkey")
                v[f"{pre}Pt_{p}_{y}"] = f"{num(40 - 20 * p)} + {Q} / {num(10 + c)}"
    v |= {"DERFreqDroop_0_Ena": "1e0", "DERFreqDroop_0_AdptCtlRslt": gone(8, "CAST(l_partkey % 4 AS DOUBLE)")}
    for c in range(3):
        pre = f"DERFreqDroop_0_Ctl_{c}_"
        v |= {f"{pre}DbOf": num(0.036 + 0.01 * c), f"{pre}DbUf": gone(9 + c, num(0.036), "l_partkey"), f"{pre}KOf": num((0.05, 0.0, 0.04)[c]), f"{pre}KUf": num(0.05 + 0.01 * c), f"{pre}RspTms": num(5 * c), f"{pre}PMin": f"{Q} / {num(5 + c)}", f"{pre}ReadOnly": "0e0"}
    return v


#: Column: SQL expression over ``lineitem``.
VIEW = _view()


def telemetry(spark: SparkSession, sf_dir: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The view as a normalised labelled table; columns that a query does not read are pruned down to the scan.

    A table of fewer splits than there are cores (one file of one row group, say)
    is dealt out by its key after the scan, for the view's expressions cost more
    than its rows; a larger one is left as it lies.  ``order``: columns of the
    table that each task sorts its narrow rows by, before the view widens them.
    """
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() < cores:
        table = table.repartition(cores, "l_orderkey", "l_linenumber")
    if order:
        table = table.sortWithinPartitions(*order)
    return table.select(*[F.expr(sql).alias(name) for name, sql in VIEW.items()])


def as_sql() -> str:
    """The same view for another engine."""
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in VIEW.items()) + " FROM lineitem"
