"""Survival framing, as-of joins, splits and leakage, against brute force in pandas."""

import json
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vintageline.operators.asof import (
    CoverageError,
    MacroError,
    join_releases,
    lookahead_rows,
    require_coverage,
    require_valid_releases,
)
from vintageline.operators.features import indexed_ltv, loan_features
from vintageline.operators.gold import ReconciliationError, gold_panel, require_reconciled
from vintageline.operators.splits import (
    SplitError,
    assign_splits,
    require_quarters,
    require_split_integrity,
)
from vintageline.operators.survival import survival_panel
from vintageline.queries.inputs import panel, releases
from vintageline.settings import MACRO_SERIES, OUTCOME_COLUMNS
from vintageline.sources.releases import load_releases, publish_releases
from vintageline.sources.snapshots import read_version
from vintageline.validation.leakage import LeakageError, changed_cells, require_no_leakage

SMALL = "/root/testdata/sf0.001"
RELEASE = "SERIES_ID string, OBSERVATION_DATE date, AVAILABLE_DATE date, VALUE decimal(20,6)"


def month(n):
    return date(2010 + n // 12, n % 12 + 1, 1)


def loans(spark, histories):
    rows = [
        (loan, month(i), status, code)
        for loan, cells in histories.items()
        for i, (status, code) in cells
    ]
    return spark.createDataFrame(rows, "LOAN_ID string, ACT_PERIOD date, DLQ_STATUS string, ZERO_BAL_CODE string")


def plain(n):
    return [(i, ("00", None)) for i in range(n)]


def test_exits_and_labels(spark):
    histories = {
        "healthy": plain(20),
        "default": plain(10) + [(10, ("03", None)), (11, ("04", None))],
        "prepaid": plain(8) + [(8, ("00", " 01 "))],
        "tie": plain(5) + [(5, ("03", "06"))],
        "late": plain(5) + [(5, ("00", "06")), (6, ("03", None))],
        "other": plain(3) + [(3, ("XX", "09"))],
        "blank": plain(3) + [(3, ("00", "  "))],
        "gap": [(0, ("00", None)), (5, ("00", None)), (6, ("99", None))],
    }
    rows = survival_panel(loans(spark, histories)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.LOAN_ID, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.ACT_PERIOD)
    kinds = {k: g[0].EXIT_TYPE for k, g in by.items()}
    assert kinds == {
        "healthy": "right_censored", "default": "default", "prepaid": "prepaid", "tie": "default",
        "late": "repurchased", "other": "other_exit", "blank": "right_censored", "gap": "default",
    }
    assert {k: len(g) for k, g in by.items()} == {
        "healthy": 20, "default": 10, "prepaid": 8, "tie": 5, "late": 5, "other": 3, "blank": 4, "gap": 2,
    }
    healthy = by["healthy"]
    assert [r.DEFAULT_IN_12M for r in healthy] == [0] * 8 + [None] * 12
    assert [r.DEFAULT_NEXT_MONTH for r in healthy] == [0] * 19 + [None]
    default = by["default"]
    assert [r.DEFAULT_IN_12M for r in default] == [1] * 10
    assert [r.DEFAULT_NEXT_MONTH for r in default] == [0] * 9 + [1]
    assert [r.DEFAULT_IN_12M for r in by["prepaid"]] == [None] * 8
    assert [r.AT_RISK_MONTH_NUMBER for r in by["gap"]] == [1, 2]
    assert by["late"][0].FIRST_D90_DATE is None and by["prepaid"][0].FIRST_CENSOR_CODE == "01"
    assert default[0].SOURCE_OBSERVED_MONTHS == 12 and default[0].AT_RISK_OBSERVED_MONTHS == 10


def brute_force(histories, horizon, threshold):
    out = {}
    for loan, cells in histories.items():
        late = [i for i, (s, _) in cells if s.isdigit() and int(s) >= threshold]
        closed = [i for i, (_, c) in cells if c and c.strip()]
        censor = min(closed, default=None)
        default = min(late, default=None)
        if default is not None and censor is not None and default > censor:
            default = None
        exits = [x for x in (default, censor) if x is not None]
        known = max(i for i, _ in cells)
        known = min(known, censor) if censor is not None else known
        kept = sorted(i for i, _ in cells if not exits or i < min(exits))
        for rank, i in enumerate(kept, start=1):
            label = 1 if default is not None and i < default <= i + horizon else (0 if known >= i + horizon else None)
            out[(loan, month(i))] = (label, rank, len(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_survival_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    histories = {}
    for n in range(60):
        months = sorted(rng.sample(range(40), rng.randint(1, 30)))
        histories[f"L{n}"] = [
            (i, (rng.choice(["00"] * 12 + ["01", "02", "03", "12", "XX"]), rng.choice([None] * 25 + ["01", "06", "09", " "])))
            for i in months
        ]
    horizon, threshold = rng.choice([3, 6, 12]), rng.choice([1, 2, 3])
    rows = survival_panel(loans(spark, histories), horizon, threshold).collect()
    got = {(r.LOAN_ID, r.ACT_PERIOD): (r.DEFAULT_IN_12M, r.AT_RISK_MONTH_NUMBER, r.AT_RISK_OBSERVED_MONTHS) for r in rows}
    assert got == brute_force(histories, horizon, threshold)
    assert len(rows) == len(got) and any(v[0] == 1 for v in got.values())


def test_bad_arguments(spark):
    frame = loans(spark, {"A": plain(2)})
    for horizon, threshold in ((0, 3), (12, 0)):
        with pytest.raises(ValueError):
            survival_panel(frame, horizon, threshold)
    with pytest.raises(ValueError, match="DLQ_STATUS"):
        survival_panel(frame.drop("DLQ_STATUS"))


def release_frame(spark, rows):
    return spark.createDataFrame([(s, o, a, Decimal(str(v))) for s, o, a, v in rows], RELEASE)


def test_release_known_only_after_it_is_out(spark):
    out = release_frame(
        spark,
        [
            ("UNRATE", date(2015, 8, 1), date(2015, 9, 4), 5.1),
            ("UNRATE", date(2015, 9, 1), date(2015, 10, 2), 5.0),
            ("UNRATE", date(2015, 8, 1), date(2020, 1, 1), 999999),
        ],
    )
    asked = spark.createDataFrame([("A", date(2015, 10, 1)), ("B", date(2015, 9, 4)), ("C", date(2015, 9, 3)), ("D", None)], "LOAN_ID string, ACT_PERIOD date")
    got = {r.LOAN_ID: r for r in join_releases(asked, out, series=("UNRATE",)).collect()}
    assert got["A"].UNRATE == Decimal("5.1") and got["A"].UNRATE_AVAILABLE_DATE == date(2015, 9, 4)
    assert got["B"].UNRATE == Decimal("5.1")
    assert got["C"].UNRATE is None and got["D"].UNRATE is None


@pytest.mark.parametrize("seed", [5, 6])
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(150):
        o = date(2010 + rng.randrange(5), rng.randrange(1, 13), 1)
        a = date.fromordinal(o.toordinal() + rng.randrange(-20, 500))
        rows[(rng.choice(MACRO_SERIES), o, a)] = rng.randrange(1000)
    frame = release_frame(spark, [(*k, v) for k, v in rows.items()])
    days = [date(2010 + rng.randrange(7), rng.randrange(1, 13), rng.randrange(1, 28)) for _ in range(40)]
    asked = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    got = join_releases(asked, frame, "d", prefix="X_").collect()
    assert len(got) == len(days)
    for r in got:
        for s in MACRO_SERIES:
            usable = [(o, a, v) for (n, o, a), v in rows.items() if n == s and o <= r.d and a <= r.d]
            expected = max(usable, key=lambda t: t[:2]) if usable else (None, None, None)
            assert (r[f"X_{s}_OBSERVATION_DATE"], r[f"X_{s}_AVAILABLE_DATE"], r[f"X_{s}"]) == expected


def test_asof_arguments(spark):
    asked = spark.createDataFrame([(date(2015, 1, 1),)], "ACT_PERIOD date")
    out = releases(spark)
    for options in ({"series": ()}, {"series": ("GDP",)}, {"prefix": "x_"}, {"prefix": "X"}, {"as_of_column": "NOPE"}):
        with pytest.raises(ValueError):
            join_releases(asked, out, **options)


def test_release_rules(spark):
    require_valid_releases(releases(spark))
    good = ("UNRATE", date(2015, 1, 1), date(2015, 2, 1), 1)
    for extra, rule in (
        (good, "duplicate_vintage"),
        (("GDP", *good[1:]), "unknown_series"),
        ((None, *good[1:]), "null_value"),
        (("UNRATE", None, *good[2:]), "null_value"),
    ):
        with pytest.raises(MacroError, match=rule):
            require_valid_releases(release_frame(spark, [good, extra]))


def test_coverage(spark):
    out = release_frame(spark, [(s, date(2014, 12, 1), date(2014, 12, 30), 166.57) for s in MACRO_SERIES])
    asked = spark.createDataFrame([(date(2005, 1, 1),), (date(2015, 1, 1),)], "ACT_PERIOD date")
    with pytest.raises(CoverageError, match="without a release"):
        require_coverage(asked, out)
    require_coverage(asked, out, allow_early_gaps=True)
    require_coverage(asked.where("ACT_PERIOD > '2010-01-01'"), out)
    with pytest.raises(CoverageError, match="no releases at all"):
        require_coverage(asked, out.where("SERIES_ID <> 'UNRATE'"), allow_early_gaps=True)


def archive(folder, **bodies):
    for name in MACRO_SERIES:
        body = bodies.get(name, {"observations": [{"date": "2015-01-01", "realtime_start": "2015-02-06", "value": "5.7"}]})
        if body is not None:
            with open(f"{folder}/{name}.json", "w") as out:
                out.write(body if isinstance(body, str) else json.dumps(body))


def test_release_archive(spark, folder):
    archive(folder, UNRATE={"observations": [
        {"date": "2015-01-01", "realtime_start": "2015-02-06", "value": "5.7"},
        {"date": "2015-02-01", "realtime_start": "2015-03-06", "value": "."},
        {"date": "2015-03-01", "realtime_start": "2015-04-03", "value": 5.5},
    ]})
    assert publish_releases(spark, folder, f"{folder}/table") == {"UNRATE": 2, "CSUSHPINSA": 1, "MORTGAGE30US": 1}
    row = read_version(spark, f"{folder}/table").where("SERIES_ID = 'UNRATE'").orderBy("OBSERVATION_DATE").first()
    assert (row.OBSERVATION_DATE, row.AVAILABLE_DATE, row.VALUE) == (date(2015, 1, 1), date(2015, 2, 6), Decimal("5.7"))


@pytest.mark.parametrize(
    "body",
    [
        "not json", "[]", {"other": 1}, {"observations": []}, {"observations": ["x"]},
        {"observations": [{"date": "2015-13-01", "realtime_start": "2015-02-06", "value": "1"}]},
        {"observations": [{"realtime_start": "2015-02-06", "value": "1"}]},
        {"observations": [{"date": "2015-01-01", "value": "1"}]},
        {"observations": [{"date": "2015-01-01", "realtime_start": "2015-02-06", "value": "high"}]},
        {"observations": [{"date": "2015-01-01", "realtime_start": "2015-02-06"}]},
        {"observations": [{"date": "2015-01-01", "realtime_start": "2015-02-06", "value": "."}]},
    ],
)
def test_broken_archive(spark, folder, body):
    archive(folder, UNRATE=body)
    with pytest.raises(MacroError):
        load_releases(spark, folder)


def test_missing_archive_file(spark, folder):
    archive(folder, UNRATE=None)
    with pytest.raises(FileNotFoundError):
        load_releases(spark, folder)


def test_features_and_zero_index(spark):
    rows = spark.createDataFrame(
        [
            (date(2012, 3, 1), date(2011, 12, 1), 90.0, 100.0, 80, 700, None, 120.0, 100.0),
            (date(2012, 3, 1), date(2011, 12, 1), 90.0, 100.0, 0, 700, 650, 120.0, 0.0),
        ],
        "ACT_PERIOD date, ORIG_DATE date, CURRENT_UPB double, ORIG_UPB double, OLTV int, CSCORE_B int, CSCORE_C int, "
        "CSUSHPINSA double, ORIG_CSUSHPINSA double",
    )
    a, b = indexed_ltv(loan_features(rows)).collect()
    assert (a.SEASONING_MONTHS, a.CLASSIC_FICO, b.CLASSIC_FICO) == (3, 700, 650)
    assert a.ORIGINAL_PROPERTY_VALUE == 125.0 and a.CURRENT_LTV_UNINDEXED == pytest.approx(72.0)
    assert a.CURRENT_LTV == pytest.approx(60.0)
    assert b.ORIGINAL_PROPERTY_VALUE is None and b.CURRENT_LTV is None


def split_frame(spark, rows):
    return spark.createDataFrame(rows, "LOAN_ID string, ACT_PERIOD date, _source_file string")


def test_splits(spark):
    rows = [
        ("A", date(2015, 12, 1), "2012Q1.csv"), ("A", date(2016, 1, 1), "2012q1.CSV"),
        ("A", date(2018, 1, 1), "2012Q1"), ("B", date(2014, 1, 1), "2016Q1.csv"), ("C", date(2014, 1, 1), None),
    ]
    got = assign_splits(split_frame(spark, rows)).collect()
    assert [r.MODELLING_SPLIT for r in got[:4]] == ["train", "validation", "out_of_time", "out_of_vintage"]
    assert got[3].TEMPORAL_SPLIT == "train" and got[1].ACQUISITION_QUARTER == "2012Q1"
    for bad in (None, "", "loans.csv", "2012Q5.csv"):
        with pytest.raises(SplitError):
            require_quarters(split_frame(spark, [rows[0], ("C", date(2014, 1, 1), bad)]))
    require_quarters(split_frame(spark, rows[:4]))


def test_split_contamination(spark):
    rows = [("A", date(2014, 1, 1), "2012Q1.csv"), ("A", date(2016, 1, 1), "2016Q1.csv")]
    with pytest.raises(SplitError):
        require_split_integrity(assign_splits(split_frame(spark, rows)))
    require_split_integrity(assign_splits(panel(spark, SMALL)))


def test_reconciliation(spark):
    silver = panel(spark, SMALL)
    gold = survival_panel(silver)
    require_reconciled(silver, gold)
    with pytest.raises(ReconciliationError):
        require_reconciled(silver, gold.where("AT_RISK_MONTH_NUMBER <> 2"))


@pytest.mark.parametrize("cutoff", [date(2006, 9, 1), date(2013, 6, 1), date(2017, 2, 1)])
def test_only_outcomes_depend_on_later_rows(spark, cutoff):
    out = releases(spark)
    changes = changed_cells(lambda rows: gold_panel(rows, out), panel(spark, SMALL), cutoff)
    changed = require_no_leakage(changes)
    assert changes.first().rows_compared > 0
    assert {"DEFAULT_IN_12M", "LAST_OBSERVED_DATE", "SOURCE_OBSERVED_MONTHS"} <= set(changed) <= set(OUTCOME_COLUMNS)


def test_leak_is_caught(spark):
    from pyspark.sql import Window

    peek = F.max("ACT_PERIOD").over(Window.partitionBy("LOAN_ID"))
    changes = changed_cells(lambda rows: rows.select("LOAN_ID", "ACT_PERIOD", peek.alias("PEEK")), panel(spark, SMALL), date(2013, 6, 1))
    with pytest.raises(LeakageError, match="PEEK"):
        require_no_leakage(changes)


def test_no_lookahead_in_macro(spark):
    gold = gold_panel(panel(spark, SMALL), releases(spark))
    late = lookahead_rows(gold, {"ACT_PERIOD": MACRO_SERIES})
    assert late.count() == 6 and late.where("late_rows > 0").isEmpty()
