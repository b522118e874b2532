import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from vintageline.operators.checks import (
    declared_digits,
    declared_text_lengths,
    require_valid,
    split_lines,
    text_length_report,
    violations,
    width_counts,
)
from vintageline.sources.contract import ContractError, all_fields, fields_of_width, raw_schema
from vintageline.sources.rawfiles import ingest, read_bronze, read_raw, scan_files

WHEN = datetime(2026, 1, 1, tzinfo=UTC)


def line(width=108, **values):
    cells = [""] * width
    for field in fields_of_width(108 if width not in (108, 110, 113) else width):
        if field.name in values:
            cells[field.position - 1] = str(values[field.name])
    return "|".join(cells)


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + ("\n" if lines else ""))
    return path


def test_table_shape():
    fields = all_fields()
    assert [f.position for f in fields] == list(range(1, 114))
    assert len({f.name for f in fields}) == 113
    kinds = {k: sum(f.kind == k for f in fields) for k in ("string", "month", "integer", "decimal")}
    assert kinds == {"string": 39, "month": 16, "integer": 23, "decimal": 35}
    assert all((f.max_length is not None) == (f.kind == "string") for f in fields)
    assert {f.name: f.scale for f in fields}["ORIG_RATE"] == 3
    assert {f.name: f.scale for f in fields}["MARGIN"] == 4
    assert declared_text_lengths()["SELLER"] == 50 and declared_digits()["ORIG_UPB"] == 10


@pytest.mark.parametrize("width", [108, 110, 113])
def test_supported_widths(width):
    assert len(raw_schema(width)) == width


@pytest.mark.parametrize("width", [0, 107, 109, 114])
def test_other_widths_are_refused(width):
    with pytest.raises(ContractError):
        raw_schema(width)


def test_violations_name_the_rule(spark):
    good = line(LOAN_ID="A", ACT_PERIOD="012015", ORIG_UPB="100.25", OLTV="80", ORIG_RATE="4.125")
    cases = {
        "month": line(LOAN_ID="B", ACT_PERIOD="132015"),
        "scale": line(LOAN_ID="C", ACT_PERIOD="012015", ORIG_UPB="1.125"),
        "decimal": line(LOAN_ID="D", ACT_PERIOD="012015", ORIG_UPB="NaN"),
        "integer": line(LOAN_ID="E", ACT_PERIOD="012015", OLTV="8O"),
    }
    short_month = line(LOAN_ID="F", ACT_PERIOD="12015")
    lines = spark.createDataFrame([(v,) for v in [good, *cases.values(), short_month]], "value string")
    rows = violations(split_lines(lines), fields_of_width()).collect()
    found = {(r.ROW_LOAN_ID, r.rule) for r in rows}
    assert found == {("B", "month"), ("C", "scale"), ("D", "decimal"), ("E", "integer"), ("F", "month")}
    with pytest.raises(ContractError):
        require_valid(split_lines(lines))
    require_valid(split_lines(spark.createDataFrame([(good,)], "value string")))


@pytest.mark.parametrize(
    "text,places_ok", [("1.10", True), ("-5", True), ("1E2", True), ("1.5E-2", False), ("Infinity", False), (".5", True)]
)
def test_decimal_forms(spark, text, places_ok):
    lines = spark.createDataFrame([(line(LOAN_ID="A", ORIG_UPB=text),)], "value string")
    assert violations(split_lines(lines), fields_of_width()).isEmpty() == places_ok


def test_long_text_is_reported_not_fatal(spark):
    lines = spark.createDataFrame([(line(LOAN_ID="A", SELLER="s" * 68),)], "value string")
    raw = split_lines(lines)
    require_valid(raw)
    row = text_length_report(raw, declared_text_lengths()).first()
    assert (row.column_name, row.declared_length, row.longest, row.rows_over) == ("SELLER", 50, 68, 1)


def test_width_counts(spark):
    lines = spark.createDataFrame([(line(),), (line(),), ("a|b",)], "value string")
    assert {(r.field_count, r.line_count) for r in width_counts(lines).collect()} == {(108, 2), (2, 1)}


def test_stray_quote_keeps_fields_aligned(spark, folder):
    path = write(f"{folder}/2012Q1.csv", [line(LOAN_ID="A", SELLER='Bank "X', SERVICER="S", STATE="CA")])
    row = read_raw(spark, [path]).first()
    assert (row.SELLER, row.SERVICER, row.STATE) == ('Bank "X', "S", "CA")
    assert row.MSA is None


def test_ingest_and_replay(spark, folder):
    rows = [line(LOAN_ID=f"L{i}", ACT_PERIOD="012012") for i in range(5)]
    path = write(f"{folder}/2012Q1.csv", rows)
    bronze = f"{folder}/bronze"
    first = ingest(spark, [path], bronze, ingested_at=WHEN)
    again = ingest(spark, [path], bronze, ingested_at=WHEN)
    assert (first.files_ingested, first.rows_written, first.final_rows) == (1, 5, 5)
    assert (again.files_skipped, again.rows_written, again.final_rows) == (1, 0, 5)
    write(path, [*rows, line(LOAN_ID="L9", ACT_PERIOD="012012")])
    changed = ingest(spark, [path], bronze, ingested_at=WHEN)
    assert changed.rows_written == 6 and changed.final_rows == 11
    row = read_bronze(spark, bronze).first()
    assert row._source_file == "2012Q1.csv" and row._source_field_count == 108


def test_ingest_refuses_bad_files(spark, folder):
    bronze = f"{folder}/bronze"
    with pytest.raises(ContractError, match="107"):
        ingest(spark, [write(f"{folder}/a.csv", [line(107)])], bronze)
    with pytest.raises(ContractError, match="114"):
        ingest(spark, [write(f"{folder}/b.csv", [line(114)])], bronze)
    with pytest.raises(ContractError, match="no lines"):
        ingest(spark, [write(f"{folder}/c.csv", [])], bronze)
    with pytest.raises(ContractError):
        ingest(spark, [f"{folder}/a.csv"], bronze, width=109)
    with pytest.raises(ValueError):
        ingest(spark, [], bronze)
    with pytest.raises(FileNotFoundError):
        read_bronze(spark, f"{folder}/none")


def test_empty_file_beside_a_like_named_one(spark, folder):
    full = write(f"{folder}/2005Q1.csv", [line(LOAN_ID="A", ACT_PERIOD="012005")])
    empty = write(f"{folder}/2005Q1", [])
    with pytest.raises(ContractError, match="no lines"):
        ingest(spark, [empty, full], f"{folder}/bronze")
    with pytest.raises(ContractError, match="no lines"):
        ingest(spark, [folder], f"{folder}/bronze")


def test_paths_with_blanks_and_signs(spark, folder):
    os.makedirs(f"{folder}/raw x+y")
    path = write(f"{folder}/raw x+y/2007Q1.csv", [line(LOAN_ID="A", ACT_PERIOD="012007")])
    done = ingest(spark, [path], f"{folder}/bronze")
    assert (done.files_ingested, done.final_rows) == (1, 1)
    assert read_bronze(spark, f"{folder}/bronze").first()._source_path.endswith("/raw x+y/2007Q1.csv")


@pytest.mark.parametrize("order", [(108, 113), (113, 108)])
def test_bronze_keeps_columns_of_wider_files(spark, folder, order):
    for width in order:
        cells = line(width, LOAN_ID=f"L{width}", ACT_PERIOD="012012")
        cells = cells[: cells.rindex("|") + 1] + f"last{width}"
        ingest(spark, [write(f"{folder}/{width}.csv", [cells])], f"{folder}/bronze", width)
    stored = read_bronze(spark, f"{folder}/bronze")
    last = raw_schema(113).names[-1]
    assert {(r._source_field_count, r[last]) for r in stored.collect()} == {(108, None), (113, "last113")}


def test_fingerprint_sees_content_not_order_of_files(spark, folder):
    a = write(f"{folder}/a.csv", ["x|1", "y|2", "y|2"])
    b = write(f"{folder}/b.csv", ["x|1", "y|2"])
    c = write(f"{folder}/c.csv", ["y|2", "x|1", "y|2"])
    prints = {r.file_name: r.fingerprint for r in scan_files(spark, [a, b, c]).collect()}
    assert prints["a.csv"] != prints["b.csv"] and prints["a.csv"] == prints["c.csv"]


def test_a_known_file_is_not_read_again(spark, folder):
    """A file that was read is known by path, size and time: what is in it by now is not looked at."""
    first = write(f"{folder}/raw/2012Q1.csv", [line(108), line(108)])
    bronze = f"{folder}/bronze"
    assert ingest(spark, [f"{folder}/raw"], bronze, ingested_at=WHEN).final_rows == 2
    before = os.stat(first)
    with open(first, "r+", encoding="utf-8") as file:
        file.write("x" * 20)
    os.utime(first, ns=(before.st_atime_ns, before.st_mtime_ns))
    write(f"{folder}/raw/2012Q2.csv", [line(108)])
    done = ingest(spark, [f"{folder}/raw"], bronze, ingested_at=WHEN)
    assert (done.files_ingested, done.files_skipped, done.rows_written, done.final_rows) == (1, 1, 1, 3)
    assert read_bronze(spark, bronze).where(F.col("LOAN_ID").startswith("x")).count() == 0


def test_an_empty_namesake_is_refused(spark, folder):
    write(f"{folder}/a/2012Q1.csv", [line(108)])
    write(f"{folder}/b/2012Q1.csv", [])
    with pytest.raises(ContractError, match="b/2012Q1.csv"):
        ingest(spark, [f"{folder}/a", f"{folder}/b"], f"{folder}/bronze")


def test_equal_parts_of_one_file_are_all_loaded(spark, folder):
    for part in ("p0", "p1"):
        write(f"{folder}/raw/quarter=2012Q1/{part}.csv", [line(108)])
    write(f"{folder}/raw/quarter=2012Q1/p2.csv", [])
    done = ingest(spark, [f"{folder}/raw"], f"{folder}/bronze", ingested_at=WHEN)
    assert (done.files_ingested, done.rows_written, done.final_rows) == (1, 2, 2)
    assert read_bronze(spark, f"{folder}/bronze").count() == 2
    again = ingest(spark, [f"{folder}/raw"], f"{folder}/bronze", ingested_at=WHEN)
    assert (again.files_ingested, again.final_rows) == (0, 2)


def test_a_call_that_stopped_before_its_note_is_made_good(spark, folder):
    path = write(f"{folder}/raw/2012Q1.csv", [line(108)])
    bronze = f"{folder}/bronze"
    ingest(spark, [path], bronze, ingested_at=WHEN)
    os.rename(f"{bronze}/_files", f"{folder}/lost")
    again = ingest(spark, [path], bronze, ingested_at=WHEN)
    assert (again.files_ingested, again.rows_written, again.final_rows) == (0, 0, 1)
    assert read_bronze(spark, bronze).count() == 1
    copied = write(f"{folder}/other/2012Q1.csv", [line(108)])
    assert ingest(spark, [copied], bronze, ingested_at=WHEN).final_rows == 1


def test_odd_values_meet_the_full_rules_once(spark):
    """Values that no plain pattern passes are judged by the full rules, which no filter of the plan repeats."""
    odd = {"DTI": (" 12 ", "+5", "1_000", "x1"), "ORIG_UPB": (".5", "1e2", "1.25e-1", "1.5e1")}
    for name, values in odd.items():
        found = violations(spark.createDataFrame([(v,) for v in values], f"{name} string"), fields_of_width())
        assert sorted((r.rule, r.value) for r in found.collect()) == [("integer", "x1") if name == "DTI" else ("scale", "1.25e-1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and plan.count("filter(") == 1
