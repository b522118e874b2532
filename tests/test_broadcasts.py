"""Joins of loan-months choose no broadcast, however small a side is estimated to be."""

from vintageline.operators.survival import survival_panel
from vintageline.queries.inputs import panel

SMALL = "/root/testdata/sf0.001"


def joins(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    return [line.split("Join")[0].strip(" :+-") for line in text.splitlines() if "Join " in line]


def test_loan_facts_meet_their_rows_without_a_broadcast(spark):
    assert joins(survival_panel(panel(spark, SMALL)).select("LOAN_ID", "DEFAULT_NEXT_MONTH")) == ["SortMerge"]


def test_month_merges_use_no_broadcast(spark, folder, monkeypatch):
    from vintageline.plans import publication

    written = []
    stored = publication.materialize

    def watched(frame, name):
        written.append(joins(frame))
        return stored(frame, name)

    monkeypatch.setattr(publication, "materialize", watched)
    rows = panel(spark, SMALL).select("LOAN_ID", "ACT_PERIOD", "DLQ_STATUS")
    for _ in range(2):
        publication.merge_months(rows, f"{folder}/monthly")
    assert written[-1] == ["SortMerge"]
    assert spark.read.parquet(f"{folder}/monthly").count() == rows.count()


def test_stage_scores_rows_once(spark):
    from vintageline.portfolio.loss import assign_stage

    rows = panel(spark, SMALL).selectExpr("LOAN_ID", "ACT_PERIOD", "DLQ_STATUS", "OLTV / 200 AS p")
    assert joins(assign_stage(rows, "p")) == []
