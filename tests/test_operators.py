import hashlib

import pytest
from pyspark.sql import functions as F

from ohmsieve.operators import decisions, features, residuals, rules, scenario
from ohmsieve.sources import io
from ohmsieve.sources import schema as S
from ohmsieve.sources.telemetry import telemetry
from ohmsieve.streaming import scoring


def test_schema_counts():
    want = {"common": 8, "measure_ac": 40, "capacity": 39, "enter_service": 11, "ctl_ac": 45, "volt_var": 61, "volt_watt": 34, "freq_droop": 30, "watt_var": 58, "measure_dc": 17}
    assert {k: len(S.BLOCKS[k]) for k in want} == want
    assert sum(len(v) for k, v in S.BLOCKS.items() if k.startswith("trip_")) == 300
    assert (len(S.SOURCE), len(S.NUMERIC), len(S.MIRRORED), len(S.STRINGS)) == (665, 658, 214, 7)
    assert S.safe("DERMeasureDC[0].Prt[0].IDStr") == "DERMeasureDC_0_Prt_0_IDStr"


def test_feature_frame_names(spark):
    r = features.Raw([S.safe(c) for c in S.SOURCE])
    names = [k for n, f in features.FAMILIES.items() if n != "trip_any" for k in f(r)]
    assert len(names) == len(set(names))
    assert len(names) + 1 + 4 == 564  # with Id and the four rule aggregates


def test_all_null_row(spark):
    df = spark.createDataFrame([(1,)], "Id long")
    got = features.family_columns(df, "identity", "enter_service", "envelope", "droop", "direct_current").first().asDict()
    assert got["enter_service_should_idle"] == 1 and got["w_gt_wmax_tol"] == 0 and got["noncanonical"] == 1
    assert got["common_missing_count"] == 5 and got["freqdroop_outside_deadband"] == 0 and got["ac_dc_same_sign"] == 1


def rule_frame(spark, rows, column="w_gt_wmax_tol"):
    df = spark.createDataFrame(rows, f"Id long, Label int, `{column}` int")
    return df.withColumns({r.column: F.lit(0) for r in rules.RULES if r.column != column})


def test_rule_audit_and_demotion(spark):
    df = rule_frame(spark, [(i, 0 if i == 0 else 1, 1) for i in range(200)])
    got = {r["rule"]: r for r in rules.audit(df).collect()}
    assert got["w_gt_wmax"]["precision"] == pytest.approx(0.995) and got["enter_state"]["precision"] == 1.0
    assert rules.demoted(rules.audit(df)).count() == 0
    worse = rule_frame(spark, [(i, 0 if i < 2 else 1, 1) for i in range(200)])
    assert [r["rule"] for r in rules.demoted(rules.audit(worse)).collect()] == ["w_gt_wmax"]
    assert "w_gt_wmax" not in rules.active_rules(worse)
    assert rules.audit(df.limit(0)).count() == len(rules.NAMED)


def test_rule_aggregates(spark):
    df = rule_frame(spark, [(1, 0, 1), (2, 0, 0), (3, 1, None)], "wsetpct_enabled_far")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in rules.aggregates().items()]).collect()]
    assert got == [(1, 2, 3.0, 1), (0, 0, 0.0, 0), (0, 0, 0.0, 0)]
    assert df.select(rules.override([]).alias("o")).first()["o"] == 0


def scenes(spark, rows):
    df = spark.createDataFrame(rows, "Id long, Label int, device_family string, DERMeasureAC_0_ThrotPct double")
    return scenario.bins(df)


def test_out_of_fold_leaves_own_fold_out(spark):
    rows = [(i, int(i % 5 == 0), "canon10", 5.0) for i in range(50)]
    got = {r["Id"]: r for r in scenario.out_of_fold(scenes(spark, rows), ("scenario",)).collect()}
    assert got[0]["scenario_count"] == 40 and got[0]["scenario_rate"] == pytest.approx((0 + 50 * 0.2) / 90)
    assert got[1]["scenario_rate"] == pytest.approx((10 + 50 * 0.2) / 90)


def test_unseen_scenario_has_prior(spark):
    train = scenes(spark, [(i, int(i % 4 == 0), "canon10", 5.0) for i in range(40)])
    new = scenes(spark, [(100, 0, "canon10", 95.0), (101, 0, "strange", 5.0)])
    learned = {"scenario": scenario.stats(train, scenario.KEYS["scenario"])}
    got = {r["Id"]: r for r in scenario.applied(new, learned, scenario.family_rates(train), ("scenario",)).collect()}
    assert got[100]["scenario_rate"] == 0.25 and got[100]["scenario_count"] == 0 and got[100]["scenario_low_support"] == 1
    assert got[101]["scenario_rate"] == 0.25


def test_threshold_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.01)], "Label int, p double")
    got = decisions.best_threshold(df, "p").first()
    assert got["threshold"] == 0.02 and got["f2"] == 1.0
    none = decisions.best_threshold(df.limit(0), "p").first()
    assert none["threshold"] == 0.5 and none["f2"] == 0.0


def test_metrics_of_nothing_predicted(spark):
    df = spark.createDataFrame([(1, 0, "canon10"), (0, 0, "canon10")], "Label int, prediction int, device_family string")
    got = {r["device_family"]: r for r in decisions.metrics_by_family(df).collect()}
    assert got["overall"]["f2"] == 0.0 and got["canon10"]["precision"] == 0.0 and got["overall"]["rows"] == 2


def test_csv_scan_and_tokens(spark, tmp_path):
    cols = ["Id", "Label", *S.SOURCE]
    base = {c: "" for c in cols} | {"Id": "7", "Label": "1", "DERMeasureAC[0].W": "1.5", "DERMeasureAC[0].VA": "abc", "common[0].Mn": "NA", "common[0].SN": "1100058974.0"}
    (tmp_path / "t.csv").write_text(",".join(cols) + "\n" + ",".join(base[c] for c in cols) + "\n")
    r = io.scan_csv(spark, str(tmp_path / "t.csv"), columns=["DERMeasureAC_0_W", "DERMeasureAC_0_VA", "common_0_Mn", "common_0_SN"]).first()
    assert tuple(r) == (7, 1, 1.5, None, None, "1100058974.0")
    io.write_csv(spark.createDataFrame([(2, 0), (1, 1)], "Id long, Label int"), str(tmp_path / "out"), one_file=True)
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_text() == "Id,Label\n1,1\n2,0\n"
    assert io.file_digest(str(part)) == hashlib.sha256(part.read_bytes()).hexdigest()


def test_stream_scoring(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("Id"), F.lit(2.0).alias("DEREnterService_0_ES"))
    have = {f.name for f in rows.schema}
    full = rows.select("Id", *[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in S.table_struct(False) if f.name != "Id"])
    full.write.parquet(str(tmp_path / "in"))
    stream = scoring.read_stream(spark, str(tmp_path / "in"))
    q = scoring.write_flags(stream.select("Id", "DEREnterService_0_ES"), str(tmp_path / "out"), str(tmp_path / "ck"), ["enter_state"])
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3 and all(r["hard_override_anomaly"] == 1 for r in got)


def test_blend_ties(spark):
    """Of weights that tie in everything the numeric model alone wins; else the larger audit F2, then the smaller weight."""
    pick = lambda rows: tuple(decisions.choose_blend(spark.createDataFrame(rows, "weight double, threshold double, f2 double, audit_f2 double")).first())
    assert pick([(w / 20, 0.3, 0.8, 0.7) for w in range(21)])[0] == 1.0
    assert pick([(0.0, 0.3, 0.8, 0.71), (0.5, 0.3, 0.8, 0.71), (1.0, 0.3, 0.8, 0.7)])[0] == 0.0
    assert pick([(0.0, 0.3, 0.9, 0.69), (0.5, 0.3, 0.85, 0.71), (1.0, 0.3, 0.8, 0.7)])[0] == 0.5
    p = spark.createDataFrame([(1, 0.9), (0, 0.1)] * 5, "Label int, p double")
    table = decisions.blend_table(p.withColumns({k: p["p"] for k in ("q", "ap", "aq")}), "p", "q", "ap", "aq")
    assert table.count() == 21 and decisions.choose_blend(table).first()["weight"] == 1.0


def test_reached_counts_thresholds(spark):
    import numpy as np

    grid = np.array(decisions.GRID, np.float32)
    values = [0.0, 1.0, -3.0, 0.6, 0.02, *decisions.GRID, *(float(np.nextafter(np.float32(t), np.float32(s))) for t in decisions.GRID for s in (0, 1)), *np.random.default_rng(1).random(300).tolist()]
    got = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "p double").select("p", decisions.reached(F.col("p")).alias("b")).collect()
    for r in got:
        want = 0 if r["p"] is None else len(grid) if r["p"] != r["p"] else int((np.float32(r["p"]) >= grid).sum())
        assert r["b"] == want, r


def test_exact_quantiles_with_ties_and_gaps(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(1, 601, 2):
        x = [float(v) for v in rng.exponential(0.1, 5)]
        x[1], x[2], x[3] = 0.0, 0.25, None if i % 3 else float("nan")
        rows.append((i, 0, 0, "canon10" if i % 4 == 1 else "canon100", *x))
    rows.append((2001, 0, 0, "canon10", None, None, None, None, None))
    names = [f"abs_norm_resid_{t}" for t in residuals.TARGETS]
    df = spark.createDataFrame(rows, "Id long, Label int, hard_override_anomaly int, device_family string, " + ", ".join(f"{n} double" for n in names))
    for r in residuals.quantiles(df).collect():
        for k, t in enumerate(residuals.TARGETS):
            x = [row[4 + k] for row in rows if row[3] == r["device_family"] and row[4 + k] is not None and row[4 + k] == row[4 + k]]
            for level, q in residuals.LEVELS.items():
                want = max(np.quantile(x, q), residuals.FLOOR) if x else residuals.FALLBACK[level]
                assert abs(r[f"{t}_{level}"] - want) < 1e-12


def test_scratch_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.scratch(Session(), "x")


def test_shared_quantities_are_planned_once(spark):
    """Curve picks stand in a projection of their own, which the optimiser keeps apart."""
    t = telemetry(spark, "/root/testdata/sf0.001")
    plan = features.planned(t, lambda r: features.curve(r, "wattvar"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("DERWattVar_0_Crv_2_Pt_5_W") < 12 and plan.count("Project") >= 3


def test_families_are_built_once_for_all_levels(spark):
    t, calls = telemetry(spark, "/root/testdata/sf0.001"), []

    def build(r):
        calls.append(1)
        return features.curve(r, "voltwatt")

    assert features.planned(t, build).count() > 0 and len(calls) == 1
