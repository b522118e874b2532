import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vintageline.operators.acquisition import (
    SummaryError,
    acquisition_summary,
    published_table,
    require_population,
    require_published_summary,
    summary_differences,
)
from vintageline.operators.quality import QualityError, quality_report, require_quality
from vintageline.operators.silver import keep_latest, label_codes, servicer_spells
from vintageline.plans import publication
from vintageline.plans.publication import (
    backfill_months,
    merge_months,
    publish_gold_from,
    publish_silver,
    require_gold_sources,
)
from vintageline.plans.stages import Places, run_stage
from vintageline.queries.inputs import panel, releases
from vintageline.sources import snapshots
from vintageline.sources.rawfiles import ingest, list_files
from vintageline.sources.snapshots import (
    latest_version,
    promote,
    publish,
    read_pinned,
    read_version,
    source_versions,
)
from vintageline.sources.synthetic import write_raw_files

SMALL = "/root/testdata/sf0.001"


def silver_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "LOAN_ID string, ACT_PERIOD date, _source_file string, _source_sha256 string, ORIG_UPB double, "
        "CURRENT_UPB double, DLQ_STATUS string",
    )


GOOD = ("A", date(2012, 1, 1), "2012Q1.csv", "h", 100.0, 90.0, "00")


def test_gate_passes_and_counts(spark):
    report = require_quality(silver_rows(spark, [GOOD, ("B", *GOOD[1:6], "XX"), ("C", *GOOD[1:4], None, 0.0, None)]))
    assert len(report) == 9 and all(r.status == "passed" for r in report)


@pytest.mark.parametrize(
    "row,rule,column",
    [
        (GOOD, "unique_key", "LOAN_ID,ACT_PERIOD"),
        ((None, *GOOD[1:]), "not_null", "LOAN_ID"),
        (("B", None, *GOOD[2:]), "not_null", "ACT_PERIOD"),
        (("B", GOOD[1], None, *GOOD[3:]), "not_null", "_source_file"),
        (("B", *GOOD[1:4], 0.0, 1.0, "00"), "above_zero", "ORIG_UPB"),
        (("B", *GOOD[1:5], -1.0, "00"), "at_least_zero", "CURRENT_UPB"),
        (("B", *GOOD[1:6], "0"), "in_domain", "DLQ_STATUS"),
        (("B", *GOOD[1:6], "RA"), "in_domain", "DLQ_STATUS"),
    ],
)
def test_gate_fails(spark, row, rule, column):
    with pytest.raises(QualityError) as caught:
        require_quality(silver_rows(spark, [GOOD, row]))
    assert [(r.expectation, r.column_name) for r in caught.value.report] == [(rule, column)]


def test_empty_table_fails_and_absent_column_is_an_error(spark):
    rows = quality_report(silver_rows(spark, [GOOD]).drop("ORIG_UPB").where("false")).collect()
    status = {(r.expectation, r.column_name): r.status for r in rows}
    assert status[("row_count", None)] == "failed"
    assert status[("above_zero", "ORIG_UPB")] == "errored"


def test_latest_version_wins_and_ties_are_stable(spark):
    rows = [
        ("A", 1, datetime(2020, 1, 1), "x", "old"),
        ("A", 1, datetime(2020, 2, 1), "a", "new"),
        ("A", 1, datetime(2020, 2, 1), "b", "newest"),
        ("B", 1, datetime(2020, 1, 1), "x", "p"),
        ("B", 1, datetime(2020, 1, 1), "x", "q"),
    ]
    frame = spark.createDataFrame(rows, "k string, m int, at timestamp, h string, v string")
    kept = {r.k: r.v for r in keep_latest(frame, ("k", "m"), ("at", "h")).collect()}
    again = {r.k: r.v for r in keep_latest(frame.repartition(5), ("k", "m"), ("at", "h")).collect()}
    assert kept["A"] == "newest" and kept == again


def test_servicer_spells(spark):
    months = [(date(2020, m, 1), s) for m, s in zip((1, 2, 3, 4), "AABB")]
    rows = [("L", m, s) for m, s in months] + [("N", date(2020, 1, 1), None)]
    spells = servicer_spells(
        spark.createDataFrame(rows, "LOAN_ID string, ACT_PERIOD date, SERVICER string")
    ).orderBy("EFFECTIVE_FROM").collect()
    assert [(r.SERVICER, r.EFFECTIVE_TO, r.IS_CURRENT) for r in spells] == [
        ("A", date(2020, 2, 1), False), ("B", None, True),
    ]
    assert len({r.LOAN_SERVICER_KEY for r in spells}) == 2


def test_labels(spark):
    rows = spark.createDataFrame(
        [("B", "00"), ("Q", "05"), (None, "12"), ("R", "XX"), ("C", "RA"), ("C", "Z1"), ("C", None)],
        "CHANNEL string, DLQ_STATUS string",
    )
    got = [(r.CHANNEL_LABEL, r.DLQ_STATUS_LABEL) for r in label_codes(rows).collect()]
    assert got == [
        ("Broker", "Current"), ("Unmapped (Q)", "150 days delinquent"), (None, "180+ days delinquent"),
        ("Retail", "Unknown"), ("Correspondent", "REO acquisition"), ("Correspondent", "Unmapped (Z1)"),
        ("Correspondent", None),
    ]


def acquisition_rows(spark, source="2012Q1.csv"):
    return spark.createDataFrame(
        [
            ("A", date(2012, 1, 1), date(2011, 12, 1), 100.0, 4.0, 60, None, 35, 720, None, source),
            ("A", date(2012, 2, 1), date(2011, 12, 1), 100.0, 4.0, 60, None, 35, 720, None, source),
            ("B", date(2012, 1, 1), date(2011, 12, 1), 300.0, 5.0, 80, 90, None, 760, 740, source),
            ("C", date(2012, 1, 1), None, 900.0, 9.0, 10, None, 1, 500, None, source),
        ],
        "LOAN_ID string, ACT_PERIOD date, ORIG_DATE date, ORIG_UPB double, ORIG_RATE double, OLTV int, OCLTV int, "
        "DTI int, CSCORE_B int, CSCORE_C int, _source_file string",
    )


def test_summary_by_hand(spark):
    year, total = acquisition_summary(acquisition_rows(spark)).collect()
    assert (year.ORIGINATION_YEAR, total.ORIGINATION_YEAR) == ("2011", "Total")
    assert year[1:] == total[1:]
    assert year.LOAN_COUNT == 2 and year.AVERAGE_ORIGINAL_UPB == 200.0
    assert year.CLASSIC_FICO == pytest.approx((720 * 100 + 740 * 300) / 400)
    assert year.OCLTV == pytest.approx((60 * 100 + 90 * 300) / 400)
    assert year.DTI == 35.0 and year.NOTE_RATE == pytest.approx(4.75)


def test_summary_comparison(spark):
    expected = published_table(spark)
    assert summary_differences(expected, expected).isEmpty()
    near = expected.withColumn("OLTV", F.col("OLTV") + 0.04)
    assert summary_differences(near, expected).isEmpty()
    far = summary_differences(expected.withColumn("OLTV", F.col("OLTV") + 0.06), expected)
    assert {r.metric for r in far.collect()} == {"OLTV"} and far.count() == 6
    short = summary_differences(expected.where("ORIGINATION_YEAR <> '2012'"), expected)
    assert {r.ORIGINATION_YEAR for r in short.collect()} == {"2012"}


def test_population_fails_closed(spark):
    with pytest.raises(SummaryError, match="missing"):
        require_published_summary(acquisition_rows(spark))
    with pytest.raises(ValueError, match="no acquisition quarter"):
        require_population(acquisition_rows(spark, "notes.txt"))
    assert require_population(acquisition_rows(spark, "2012q1"), ["2012Q1"]) == ["2012Q1"]


def test_versions(spark, folder):
    path = f"{folder}/t"
    with pytest.raises(FileNotFoundError):
        read_pinned(spark, path)
    publish(spark.range(3).toDF("a"), path, {"x": 4})
    publish(spark.range(5).selectExpr("id AS a", "id % 2 AS b"), path, partition_by=("b",))
    assert latest_version(spark, path) == 1
    assert read_version(spark, path, 0).count() == 3
    frame, version = read_pinned(spark, path)
    assert (frame.columns, frame.count(), version) == (["a", "b"], 5, 1)
    assert source_versions(spark, path, 0) == {"x": 4}
    with pytest.raises(FileNotFoundError):
        read_version(spark, path, 7)
    with pytest.raises(ValueError):
        read_version(spark, path, -1)


def test_month_merge_is_idempotent(spark, folder):
    path = f"{folder}/m"
    rows = panel(spark, SMALL).select("LOAN_ID", "ACT_PERIOD", "DLQ_STATUS")
    merge_months(rows, path)
    before = spark.read.parquet(path).groupBy("ACT_PERIOD").count().collect()
    backfill_months(rows, path, date(2012, 1, 1), date(2012, 6, 1))
    merge_months(rows.where(F.col("ACT_PERIOD") == F.lit(date(2016, 3, 1))), path)
    after = spark.read.parquet(path).groupBy("ACT_PERIOD").count().collect()
    assert sorted(before) == sorted(after)


def test_month_merge_keeps_other_loans(spark, folder):
    path = f"{folder}/m"
    month = date(2017, 1, 1)
    kind = "LOAN_ID string, ACT_PERIOD date, x int"
    merge_months(spark.createDataFrame([("A1", month, 1), ("A2", month, 1)], kind), path)
    merge_months(spark.createDataFrame([("B1", month, 2), ("A2", month, 3)], kind), path)
    rows = {(r.LOAN_ID, r.x) for r in spark.read.parquet(path).collect()}
    assert rows == {("A1", 1), ("A2", 3), ("B1", 2)}


def test_stages_by_name(spark, folder):
    write_raw_files(panel(spark, SMALL), f"{folder}/raw")
    places = Places(folder, [f"{folder}/raw"])
    assert run_stage(spark, "bronze", places).rows_written == panel(spark, SMALL).count()
    assert run_stage(spark, "silver", places).version == 0
    publish(releases(spark), places.table("macro"))
    assert run_stage(spark, "gold", places).source_versions == {"silver": 0, "macro": 0}
    with pytest.raises(ValueError, match="not one of"):
        run_stage(spark, "copper", places)


def test_promotion_writes_no_data(spark, folder):
    publish(spark.range(7).toDF("a"), f"{folder}/staged")
    assert promote(spark, f"{folder}/staged", 0, f"{folder}/final", {"x": 2}) == 0
    assert os.listdir(f"{folder}/final") == ["manifest"]
    assert read_version(spark, f"{folder}/final").count() == 7
    assert source_versions(spark, f"{folder}/final", 0) == {"x": 2}


@pytest.mark.parametrize("width", [108, 113])
def test_raw_files_take_little_disk_and_load_whole(spark, folder, width):
    rows = panel(spark, SMALL)
    write_raw_files(rows, f"{folder}/raw", width)
    on_disk = list_files(spark, [f"{folder}/raw"]).agg(F.sum("size")).first()[0]
    lines = spark.read.text(f"{folder}/raw").agg(F.count("value"), F.sum(F.length("value"))).first()
    assert lines[0] == rows.count() and on_disk < lines[1] / 8
    assert ingest(spark, [f"{folder}/raw"], f"{folder}/bronze", width).rows_written == lines[0]


def test_raw_to_gold(spark, folder):
    write_raw_files(panel(spark, SMALL), f"{folder}/raw")
    ingest(spark, [f"{folder}/raw"], f"{folder}/bronze")
    run = publish_silver(spark, f"{folder}/bronze", f"{folder}/silver", f"{folder}/servicer")
    rows = panel(spark, SMALL).count()
    assert run.silver_rows == rows and run.version == 0
    publish(releases(spark), f"{folder}/macro")
    gold = publish_gold_from(spark, f"{folder}/silver", f"{folder}/macro", f"{folder}/gold")
    assert gold.counts.silver_rows == rows
    assert gold.counts.gold_rows == read_version(spark, f"{folder}/gold").count()
    assert source_versions(spark, f"{folder}/gold", 0) == {"silver": 0, "macro": 0}


@pytest.mark.parametrize("most", [0, 100_000])
def test_corrections_replace_their_months(spark, folder, monkeypatch, most):
    rows = panel(spark, SMALL)
    corrected = rows.where("STATE = 'CA' AND LOAN_AGE < 5").withColumn("DLQ_STATUS", F.lit("77"))
    for at, (name, lines) in enumerate((("first", rows), ("second", corrected)), start=1):
        write_raw_files(lines, f"{folder}/{name}")
        ingest(spark, [f"{folder}/{name}"], f"{folder}/bronze", ingested_at=datetime(2026, at, 1))
    monkeypatch.setattr(publication, "MOST_MARKED", most)
    written, stored = [], publication.publish

    def watched(frame, *rest, **named):
        written.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return stored(frame, *rest, **named)

    monkeypatch.setattr(publication, "publish", watched)
    run = publish_silver(spark, f"{folder}/bronze", f"{folder}/silver", f"{folder}/servicer")
    assert run.silver_rows == rows.count()
    fixed = read_version(spark, f"{folder}/silver").where("DLQ_STATUS = '77'")
    assert fixed.count() == corrected.count() > 0
    assert ("LeftSemi" in written[0]) == (most > 0)


def test_quarantine(spark, folder):
    lines = panel(spark, SMALL).withColumn(
        "DLQ_STATUS", F.when(F.col("STATE") == "CA", "7").otherwise(F.col("DLQ_STATUS"))
    )
    write_raw_files(lines, f"{folder}/raw")
    ingest(spark, [f"{folder}/raw"], f"{folder}/bronze")
    with pytest.raises(QualityError):
        publish_silver(spark, f"{folder}/bronze", f"{folder}/silver", f"{folder}/servicer", f"{folder}/bad")
    assert latest_version(spark, f"{folder}/silver") is None
    assert read_version(spark, f"{folder}/bad").count() == lines.count()


def test_gold_sources_are_named_exactly(spark):
    assert require_gold_sources({"silver": 2, "macro": 0}) == {"silver": 2, "macro": 0}
    for wrong in ({"silver": 1}, {"silver": 1, "macro": 1, "x": 1}, {"silver": -1, "macro": 0}):
        with pytest.raises(ValueError):
            require_gold_sources(wrong)


def test_one_writer_wins_a_version(spark, folder, monkeypatch):
    path = f"{folder}/raced"
    publish(spark.range(2).toDF("a"), path)
    # Both writers look for the next version before either commits.
    monkeypatch.setattr(snapshots, "_next_version", lambda *_: 1)
    assert publish(spark.range(3).toDF("a"), path) == 1
    with pytest.raises(snapshots.CommitConflict):
        publish(spark.range(9).toDF("a"), path)
    monkeypatch.undo()
    assert read_version(spark, path).count() == 3
    assert publish(spark.range(4).toDF("a"), path) == 2
    assert [read_version(spark, path, v).count() for v in range(3)] == [2, 3, 4]


def test_corrected_months_are_chosen_before_they_become_text(spark):
    """Raw lines have a cell per field though empty neighbours are one text, and the dedupe filters months, not text."""
    from vintageline.queries.inputs import panel
    from vintageline.queries.table_queries import win1_silver_dedupe
    from vintageline.sources.synthetic import raw_lines

    lines = raw_lines(panel(spark, "/root/testdata/sf0.001"))
    assert [r[0] for r in lines.selectExpr("size(split(value, '[|]', -1))").distinct().collect()] == [108]
    plan = win1_silver_dedupe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "% 5) = 0)" in plan and "as int) % 5)" not in plan
