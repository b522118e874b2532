"""The physical plans the design relies on."""

import re

from vintageline.functions.columns import empty_columns, source_quarter
from vintageline.models.frame import model_frame
from vintageline.operators.gold import gold_panel
from vintageline.operators.silver import keep_latest, keep_latest_marked, repeated_marks
from vintageline.operators.survival import survival_panel
from vintageline.queries.inputs import panel, releases
from vintageline.sources.snapshots import materialize
from vintageline.validation.metrics import auc
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_dedupe_prunes_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    text = plan(keep_latest(orders, ("o_custkey",), ("o_orderdate",)))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_survival_panel_shuffles_loan_months_once(spark):
    stored = materialize(panel(spark, SMALL), "panel")
    text = plan(survival_panel(stored))
    # The aggregate per loan and the loan-months; the windows find the rows where the join has put them.
    assert len(re.findall(r"Arguments: hashpartitioning\(LOAN_ID", text)) == 2
    assert "CartesianProduct" not in text and "collect_set" not in text


def test_panel_reads_only_what_a_question_needs(spark):
    stored = materialize(panel(spark, SMALL), "panel")
    text = plan(survival_panel(stored).groupBy("EXIT_TYPE").count())
    assert "CURRENT_UPB" not in text and "SERVICER" not in text


def test_gold_broadcasts_only_the_calendar_table(spark):
    stored = materialize(panel(spark, SMALL), "panel")
    out = materialize(releases(spark), "releases")
    text = plan(model_frame(gold_panel(stored, out)))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_rank_metric_orders_inside_slices_only(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("s"))
    text = plan(auc(rows, "y", "s"))
    windows = [line for line in text.splitlines() if "Arguments" in line and "windowspec" in line.lower()]
    assert any("_slice" in line for line in windows) and "CartesianProduct" not in text


def test_filters_reach_the_scan(spark, folder):
    path = f"{folder}/gold"
    gold_panel(panel(spark, SMALL), releases(spark)).write.partitionBy("MODELLING_SPLIT").parquet(path)
    text = plan(
        spark.read.parquet(path).where("MODELLING_SPLIT = 'train' AND DEFAULT_IN_12M = 1").select("LOAN_ID")
    )
    assert "PartitionFilters: [isnotnull(MODELLING_SPLIT" in text and "EqualTo(DEFAULT_IN_12M,1)" in text
    assert "CURRENT_LTV" not in text


def test_wide_rows_cross_joins_and_windows_as_one_value(spark):
    wide = panel(spark, SMALL).withColumns({f"W{i}": F.lit(str(i)) for i in range(40)})
    for rows in (gold_panel(wide, releases(spark)), keep_latest(wide, ("LOAN_ID", "ACT_PERIOD"), ("SERVICER",))):
        plan = rows._jdf.queryExecution().optimizedPlan()
        windows = plan.collectLeaves().size() and [p for p in _nodes(plan) if p.nodeName() == "Window"]
        assert windows and all(p.output().size() < 40 for p in windows)
        assert {f"W{i}" for i in range(40)} <= set(rows.columns) and len(set(rows.columns)) == len(rows.columns)


def test_only_months_loaded_again_are_shuffled(spark, folder):
    keys = [(f"L{i}", i % 7) for i in range(200)] + [("A", 1)] * 3 + [(None, 1), ("A", None), (None, None)] * 2
    rows = [(k, m, n % 5, str(n)) for n, (k, m) in enumerate(keys)]
    spark.createDataFrame(rows, "k string, m int, at int, v string").write.parquet(f"{folder}/loads")
    stored = spark.read.parquet(f"{folder}/loads")
    marks = repeated_marks(stored, ("k", "m"))
    assert 3 <= marks.count() <= 4
    kept = keep_latest_marked(stored, ("k", "m"), ("at",), marks)
    assert kept.columns == stored.columns and kept.count() == 204
    assert set(map(tuple, kept.collect())) == set(map(tuple, keep_latest(stored, ("k", "m"), ("at",)).collect()))
    # The one shuffle of rows lies above those of marked keys.
    text = kept.select("v")._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(k#") == 1
    assert text.index("LeftAnti") < text.index("hashpartitioning(k#") < text.index("LeftSemi")


def test_columns_without_a_value_stay_behind(spark, folder):
    names = [f"E{i}" for i in range(3)]
    rows = panel(spark, SMALL).drop("PURPOSE").withColumns({c: F.lit(None).cast("decimal(20,2)") for c in names})
    rows.write.parquet(f"{folder}/silver")
    silver = spark.read.parquet(f"{folder}/silver")
    empty = empty_columns(silver, [*names, "PROP", "ZERO_BAL_CODE"])
    assert empty == names and empty_columns(silver, []) == []
    plain, lean = gold_panel(silver, releases(spark)), gold_panel(silver, releases(spark), empty)
    assert lean.schema == plain.schema
    assert lean.exceptAll(plain).isEmpty() and lean.count() == plain.count()
    for frame, carried in ((plain, True), (lean, False)):
        joined = [p for p in _nodes(frame._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Join"]
        assert any("E0:decimal" in p.schema().catalogString() for p in joined) == carried


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_quarters_are_read_without_locale_rules(spark):
    rows = spark.createDataFrame([("2012q1.CSV",), ("2012Q4",), ("2012q5.csv",), (None,)], "f string")
    quarters = rows.select("f", source_quarter(F.col("f")).alias("q"))
    assert {r.f: r.q for r in quarters.collect()} == {"2012q1.CSV": "2012Q1", "2012Q4": "2012Q4", "2012q5.csv": None, None: None}
    assert "upper" not in quarters._jdf.queryExecution().optimizedPlan().toString().lower()
