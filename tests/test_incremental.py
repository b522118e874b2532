from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vintageline.operators.gold import gold_panel
from vintageline.plans.incremental import first_changed_day, merge_silver, read_gold, refresh_gold
from vintageline.queries.inputs import panel, releases
from vintageline.sources.parts import open_parts, read_parts
from vintageline.sources.snapshots import publish

SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def places(spark, folder):
    publish(releases(spark), f"{folder}/macro")
    return tuple(f"{folder}/{name}" for name in ("silver", "macro", "gold"))


def same_rows(left, right):
    names = sorted(left.columns)
    return left.select(names).exceptAll(right.select(names)).isEmpty() and right.select(names).exceptAll(left.select(names)).isEmpty()


def test_a_delivery_leaves_parts_of_other_loans_alone(spark, places):
    silver, macro, gold = places
    rows = panel(spark, SMALL)
    merge_silver(rows.where("ACT_PERIOD <= date'2013-12-01'"), silver, slots=4)
    first = refresh_gold(spark, silver, macro, gold)
    before, old_rows = open_parts(spark, silver), read_gold(spark, gold).count()
    merge_silver(rows.where("ACT_PERIOD > date'2013-12-01'"), silver, slots=4)
    after = open_parts(spark, silver)
    closed = {name for name in before.places if "closed" in name}
    assert closed and closed <= set(after.places)
    second = refresh_gold(spark, silver, macro, gold)
    assert not first.kept and closed <= set(second.kept) and not closed & set(second.built)
    assert set(second.built) | set(second.kept) == set(after.places)
    assert same_rows(read_gold(spark, gold), gold_panel(rows, releases(spark)))
    assert read_gold(spark, gold, first.version).count() == old_rows
    assert same_rows(read_parts(spark, silver, after).drop("PART"), rows)
    again = refresh_gold(spark, silver, macro, gold)
    assert not again.built and same_rows(read_gold(spark, gold), read_gold(spark, gold, second.version))


def test_one_corrected_loan_rebuilds_its_part_only(spark, places):
    silver, macro, gold = places
    rows = panel(spark, SMALL)
    merge_silver(rows, silver, slots=16)
    refresh_gold(spark, silver, macro, gold)
    loan = rows.select(F.min("LOAN_ID")).first()[0]
    fixed = rows.where(F.col("LOAN_ID") == loan).withColumn("DLQ_STATUS", F.lit("03"))
    part = read_parts(spark, silver, open_parts(spark, silver)).where(F.col("LOAN_ID") == loan).first().PART
    for _ in range(2):
        merge_silver(fixed, silver, slots=16)
        run = refresh_gold(spark, silver, macro, gold)
        assert part not in run.kept and 1 <= len(run.built) <= 2 and len(run.kept) > 10
        other = rows.where(F.col("LOAN_ID") != loan)
        assert same_rows(read_gold(spark, gold), gold_panel(other.unionByName(fixed), releases(spark)))


def test_a_release_touches_rows_from_its_day_on(spark, places):
    silver, macro, gold = places
    known = releases(spark)
    merge_silver(panel(spark, SMALL), silver, slots=4)
    refresh_gold(spark, silver, macro, gold)
    late = known.where("SERIES_ID = 'UNRATE'").orderBy(F.col("OBSERVATION_DATE").desc()).limit(1)
    row = late.first().asDict() | {"AVAILABLE_DATE": date(2030, 1, 1), "VALUE": Decimal("9.5")}
    more = known.unionByName(spark.createDataFrame([row], known.schema))
    assert first_changed_day(known, more) == date(2030, 1, 1)
    publish(more, macro)
    assert not refresh_gold(spark, silver, macro, gold).built
    row |= {"OBSERVATION_DATE": date(2012, 1, 15), "AVAILABLE_DATE": date(2018, 6, 1)}
    more = more.unionByName(spark.createDataFrame([row], known.schema))
    publish(more, macro)
    run = refresh_gold(spark, silver, macro, gold)
    assert run.built and run.kept
    assert same_rows(read_gold(spark, gold), gold_panel(panel(spark, SMALL), more))


def test_keys_must_be_whole_and_alone(spark, places):
    silver = places[0]
    rows = panel(spark, SMALL).where("LOAN_AGE < 2")
    one = rows.limit(1)
    for broken in (one.withColumn("LOAN_ID", F.lit(None).cast("string")), one.unionByName(one)):
        with pytest.raises(ValueError, match="share it"):
            merge_silver(broken, silver)
    assert open_parts(spark, silver) is None
    with pytest.raises(FileNotFoundError):
        read_gold(spark, places[2])


def test_empty_deliveries(spark, places):
    silver, macro, gold = places
    rows = panel(spark, SMALL)
    merge_silver(rows.limit(0), silver)
    refresh_gold(spark, silver, macro, gold)
    assert read_gold(spark, gold).count() == 0
    merge_silver(rows, silver, slots=2)
    merge_silver(rows.limit(0), silver, slots=2)
    assert read_parts(spark, silver, open_parts(spark, silver)).count() == rows.count()
    run = refresh_gold(spark, silver, macro, gold)
    assert run.built and read_gold(spark, gold).count() == gold_panel(rows, releases(spark)).count()
