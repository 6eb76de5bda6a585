"""What moves, is written and is computed again does not grow faster than the rows: seen in the plans."""

from pyspark.sql import functions as F

from ohmsieve.operators import ordered, scenario, trees
from ohmsieve.plans import catalog


def plan(df):
    return df._jdf.queryExecution().toString()


def labelled(spark):
    return spark.createDataFrame([(i, i, i % 2, f"v{i % 3}", i % 2, float(i)) for i in range(40)], "row long, Id long, Label int, c string, fold int, a double")


def test_csv_is_compressed(spark):
    files = catalog.QUERIES["csv_roundtrip"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(f.endswith(".csv.lz4") for f in files)


def test_folds_are_left_out_without_a_join(spark):
    out = scenario.leave_fold_out(labelled(spark), ("c",), F.when(F.col("row") > 2, F.col("fold")))
    assert "Join" not in plan(out)
    rows = {(r["c"], r["fold"]): (r["total"], r["n"]) for r in out.collect()}
    own = {k: [i for i in range(40) if f"v{i % 3}" == k] for k in ("v0", "v1", "v2")}
    fold = lambda i: i % 2 if i > 2 else None
    assert rows == {(k, f): (sum(i % 2 for i in own[k] if fold(i) != f), sum(fold(i) != f for i in own[k])) for k in own for f in {fold(i) for i in own[k]}}


def test_cells_move_before_their_sums(spark):
    assert plan(ordered.ordered_statistics(labelled(spark), ["c"])).count("RepartitionByExpression") > 0


def test_statistics_of_a_row_meet_before_they_are_spread(spark):
    wide, _ = ordered.for_models(labelled(spark), ["c"], [("fold", 2)])
    assert "RepartitionByExpression [row" in plan(wide)


def grown(spark):
    df, s = labelled(spark), trees.Growth(trees=1, depth=1, rows=1.0, columns=1.0, bins=4)
    edges = trees.edges_of(df, ["a"], 4)
    return trees.grown(trees.binned(df, ["a"], edges, ["Id"], [F.col("Label")], [F.lit(1.0)]), ["a"], edges, 1, s)[0]


def test_rows_are_written_before_anything_reads_them(spark, monkeypatch):
    seen, margins = [], trees.base_margins
    monkeypatch.setattr(trees, "base_margins", lambda rows, *a: seen.append(plan(rows)) or margins(rows, *a))
    grown(spark)
    assert len(seen) == 1 and "MapInArrow" not in seen[0]


def test_inputs_of_a_row_are_put_together_once(spark):
    table = trees.model_table(spark, {"x": (grown(spark), 0)})
    rows = labelled(spark).withColumn("device_family", F.lit("x"))
    out = trees.scored_all(rows, {"p": (table, ["a"]), "q": (table, ["a"])})
    made = out._jdf.queryExecution().analyzed().toString()
    assert made.count("cast(a#") == 4  # one guarded value
    assert all(r["p"] == r["q"] for r in out.collect())
