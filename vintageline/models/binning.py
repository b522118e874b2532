"""Weight-of-evidence bins (MOD2, MOD3).

Two passes over the rows: approximate quantiles for the first cuts, then event counts per bin. What
remains is at most a dozen rows per feature, and dynamic programming finds the join of neighbours with
the most information in which every bin is large enough and the event rate moves in the declared direction.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.settings import FEATURES, MAX_PREBINS, MIN_BIN_SHARE, RISK_DIRECTION

MISSING = -1


@dataclass(frozen=True)
class FeatureBins:
    """Cuts of a feature and the weight of evidence of each bin, the missing bin apart."""

    feature: str
    cuts: tuple[float, ...]
    woe: tuple[float, ...]
    missing_woe: float

    def index(self) -> Column:
        return bin_index(F.col(self.feature), self.cuts)

    def weight(self) -> Column:
        value = F.lit(float(self.woe[-1]))
        for cut, woe in reversed(list(zip(self.cuts, self.woe))):
            value = F.when(F.col(self.feature) < cut, F.lit(float(woe))).otherwise(value)
        return F.when(F.col(self.feature).isNull(), F.lit(float(self.missing_woe))).otherwise(value)


def bin_index(value: Column, cuts: Sequence[float]) -> Column:
    """0-based bin of a value, bins closed on the left; NULL values sit in their own bin."""
    index = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        index = F.when(value < F.lit(float(cuts[k])), F.lit(k)).otherwise(index)
    return F.when(value.isNull(), F.lit(MISSING)).otherwise(index)


def bin_counts(rows: DataFrame, target: str, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows and events per feature and bin from one pass."""
    cells = F.array(
        *(
            F.struct(F.lit(f).alias("feature"), bin_index(F.col(f), c).cast("int").alias("bin"))
            for f, c in cuts.items()
        )
    )
    return (
        rows.select(F.col(target).cast("bigint").alias("y"), F.inline(cells))
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("events"))
    )


def woe_table(counts: DataFrame) -> DataFrame:
    """Event rate, weight of evidence and information value per bin.

    Weight of evidence is ln(non-event share / event share). A bin holding one class only has half a
    row added to both of its counts, which keeps the log finite.
    """
    totals = counts.groupBy("feature").agg(
        F.sum("events").alias("E"), F.sum(F.col("rows") - F.col("events")).alias("G")
    )
    others = F.col("rows") - F.col("events")
    pad = F.when((F.col("events") == 0) | (others == 0), 0.5).otherwise(0.0)
    bad, good = (F.col("events") + pad) / F.col("E"), (others + pad) / F.col("G")
    return (
        counts.join(totals, "feature")
        .select(
            "feature", "bin", "rows", "events",
            (F.col("events") / F.col("rows")).alias("event_rate"),
            F.ln(good / bad).alias("woe"),
            ((good - bad) * F.ln(good / bad)).alias("iv"),
        )
    )


def quantile_cuts(rows: DataFrame, features: Sequence[str], prebins: int = MAX_PREBINS) -> dict:
    """Inner approximate quantiles of every feature; a fixed few numbers reach the driver."""
    shares = F.array(*(F.lit(k / prebins) for k in range(1, prebins)))
    found = rows.agg(
        *(F.percentile_approx(F.col(f).cast("double"), shares).alias(f) for f in features)
    ).first()
    return {f: tuple(sorted(set(found[f] or ()))) for f in features}


@dataclass(frozen=True)
class Bin:
    """Neighbouring first cuts joined into one bin."""

    upper: float
    rows: int
    events: int


def weight_of(rows: int, events: int, all_rows: int, all_events: int) -> tuple[float, float]:
    """Weight of evidence and information value of one bin; half a row is added where a class is absent."""
    pad = 0.5 if events in (0, rows) else 0.0
    good, bad = (rows - events + pad) / (all_rows - all_events), (events + pad) / all_events
    return math.log(good / bad), (good - bad) * math.log(good / bad)


def optimal_bins(
    cuts: Sequence[float],
    counts: Mapping[int, tuple[int, int]],
    least: float,
    direction: int,
    all_rows: int,
    all_events: int,
) -> list[Bin]:
    """The bins of most information among all joins of neighbouring first bins (MOD2).

    Every bin holds ``least`` rows and event rates never move against ``direction`` (0: free). The best division
    whose last bin spans the first bins i to j extends the best one that ends before i, so some n^3 steps over the at
    most n = 12 first bins weigh all 2^(n-1) divisions. Equal values go to the division with the later first cut. With
    fewer than ``least`` rows in all, everything is one bin.
    """
    uppers = [*cuts, math.inf]
    size = len(uppers)
    rows = [0, *itertools.accumulate(counts.get(k, (0, 0))[0] for k in range(size))]
    events = [0, *itertools.accumulate(counts.get(k, (0, 0))[1] for k in range(size))]
    if not rows[-1]:
        return []
    # (value, first of the bin before or None) of the best division of 0..j whose last bin is i..j.
    best: dict[tuple[int, int], tuple[float, int | None]] = {}
    for j in range(size):
        for i in range(j + 1):
            n, e = rows[j + 1] - rows[i], events[j + 1] - events[i]
            if n < least or not n:
                continue
            own = weight_of(n, e, all_rows, all_events)[1]
            if i == 0:
                best[i, j] = (own, None)
            for k in range(i):
                before = best.get((k, i - 1))
                if before is None:
                    continue
                m, d = rows[i] - rows[k], events[i] - events[k]
                if direction * (e * m - d * n) < 0:
                    continue
                if (i, j) not in best or before[0] + own > best[i, j][0] + 1e-12:
                    best[i, j] = (before[0] + own, k)
    last = [(value[0], -i, i) for (i, j), value in best.items() if j == size - 1]
    if not last:
        return [Bin(math.inf, rows[-1], events[-1])]
    found, i, j = [], max(last)[2], size - 1
    while True:
        found.append(Bin(uppers[j], rows[j + 1] - rows[i], events[j + 1] - events[i]))
        before = best[i, j][1]
        if before is None:
            return found[::-1]
        i, j = before, i - 1


def fit_bins(
    rows: DataFrame,
    target: str,
    features: Sequence[str] = FEATURES,
    directions: Mapping[str, int] = RISK_DIRECTION,
) -> dict[str, FeatureBins]:
    """Fit the bins of all features from two jobs over the rows."""
    absent = sorted(set(directions) - set(features))
    if absent:
        raise ValueError(f"features lack the directed drivers {absent}")
    cuts = quantile_cuts(rows, features)
    counted: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
    for r in bin_counts(rows, target, cuts).collect():
        counted[r.feature][r.bin] = (r.rows, r.events)
    bins = {}
    for feature in features:
        table = counted[feature]
        total = sum(n for n, _ in table.values())
        events = sum(e for _, e in table.values())
        groups = optimal_bins(
            cuts[feature], table, MIN_BIN_SHARE * total, directions.get(feature, 0), total, events
        )
        woe = tuple(weight_of(g.rows, g.events, total, events)[0] for g in groups) or (0.0,)
        missing = weight_of(*table[MISSING], total, events)[0] if MISSING in table else 0.0
        kept = [g.upper for g in groups[:-1]]
        bins[feature] = FeatureBins(feature, tuple(kept), woe, missing)
    return bins
