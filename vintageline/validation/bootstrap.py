"""Loan-clustered bootstrap of a paired Gini difference (VAL3).

A replicate gives every loan a whole weight from a Poisson distribution of mean 1, the limit of drawing
as many loans as there are with replacement. The weight comes from one number per loan and a linear
hash of it per replicate, so it needs no draw table: every task sums, for each distinct score among its
rows, the weighted events of all replicates side by side. Rows are dealt out in ranges of the candidate's
score, so that one score meets in few tasks. What is ranked grows with the distinct scores times the
replicates, whatever the number of loans.

``exact_draws`` draws exactly as many loans as there are instead: draw ``j`` of replicate ``r`` picks the
loan numbered ``hash(seed, r, j) mod n``. It makes a row per loan and replicate, for small samples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vintageline.functions.ordered import dense_index
from vintageline.settings import BOOTSTRAP_ALPHA, BOOTSTRAP_REPLICATES, SEED
from vintageline.sources.snapshots import materialize
from vintageline.validation.metrics import auc


def _portable_draw(seed: int, rep: Column, slot: Column) -> Column:
    """md5-based draw that any SQL engine reproduces; 60 bits of the digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), slot.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _fast_draw(seed: int, rep: Column, slot: Column) -> Column:
    return F.xxhash64(F.lit(seed), rep, slot)


def replicate_weights(
    numbered: DataFrame, replicates: int, seed: int = SEED, portable: bool = False
) -> DataFrame:
    """(rep, idx, times drawn); replicate 0 takes every loan once, undrawn loans have no row."""
    size = numbered.agg(F.count(F.lit(1))).scalar()
    draw = (_portable_draw if portable else _fast_draw)(seed, F.col("rep"), F.col("idx"))
    picked = F.when(F.col("rep") == 0, F.col("idx")).otherwise(F.pmod(draw, F.col("_n")))
    return (
        numbered.select("idx", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep"))
        .withColumn("_n", size)
        .groupBy("rep", picked.alias("idx"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


PRIME = (1 << 31) - 1
# Scores a task sums up at a time, each with a number per replicate.
HELD_SCORES = 4096
MODELS = (
    "inline(array(struct('candidate' AS model, candidate AS score), struct('baseline' AS model, baseline AS score)))"
)


def poisson_limits() -> list[int]:
    """Upper ends of the hash ranges that give weights 0, 1, 2, ..."""
    shares, term = [], math.exp(-1)
    total = term
    while (limit := math.floor(total * PRIME)) < PRIME - 1 and len(shares) < 12:
        shares.append(limit)
        term /= len(shares)
        total += term
    return shares


def linear_hash(seed: int, rep: int) -> tuple[int, int]:
    """Factor and summand of a replicate."""
    first, second = (
        int(hashlib.md5(f"{seed}|{rep}|{part}".encode()).hexdigest()[:15], 16) for part in ("a", "b")
    )
    return 1 + first % (PRIME - 1), second % PRIME


def _poisson_rows(rows: DataFrame, replicates: int, seed: int, portable: bool) -> DataFrame:
    """rep, model, score, y, w: weights summed over loans; replicate 0 takes every loan once."""
    if portable:
        digest = F.md5(F.col("loan").cast("string").cast("binary"))
        number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % PRIME
    else:
        number = F.pmod(F.xxhash64("loan"), F.lit(PRIME))
    factors, summands = np.array([linear_hash(seed, r) for r in range(1, replicates + 1)], np.int64).T
    limits = np.array(poisson_limits())

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted counts of all replicates side by side, per model, score and label.

        They are held for up to ``HELD_SCORES`` scores of a task, then handed on."""
        held: dict[tuple, int] = {}
        sums = np.zeros((HELD_SCORES, replicates + 1), np.int64)

        def handed():
            out = pd.DataFrame(list(held), columns=["model", "score", "y"]).assign(w=list(sums[: len(held)]))
            return pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096).to_pandas().sort_values(["model", "score", "y"])
                weights = np.searchsorted(limits, (part.h.to_numpy()[:, None] * factors + summands) % PRIME, "right")
                weights = np.hstack([np.ones((len(part), 1), np.int64), weights]) * part.n.to_numpy()[:, None]
                keys = part[["model", "score", "y"]]
                first = np.nonzero((keys != keys.shift()).any(axis=1).to_numpy())[0]
                found = np.add.reduceat(weights, first, axis=0)
                for key, row in zip(keys.iloc[first].itertuples(index=False, name=None), found):
                    if key not in held and len(held) == HELD_SCORES:
                        yield handed()
                        held.clear()
                        sums[:] = 0
                    sums[held.setdefault(key, len(held))] += row
        if held:
            yield handed()

    numbered = rows.select("y", "n", number.alias("h"), F.expr(MODELS))
    kind = f"model string, score double, y {numbered.schema['y'].dataType.simpleString()}, w array<bigint>"
    label = to_arrow_type(numbered.schema["y"].dataType)
    schema = pa.schema([("model", pa.string()), ("score", pa.float64()), ("y", label), ("w", pa.list_(pa.int64()))])
    side_by_side = numbered.mapInArrow(summed, kind)
    return side_by_side.select("model", "score", "y", F.posexplode("w").alias("rep", "w")).where("w > 0")


def _drawn_rows(rows: DataFrame, replicates: int, seed: int, portable: bool) -> DataFrame:
    numbered = materialize(dense_index(rows, "loan"), "bootstrap-loans")
    weights = replicate_weights(numbered, replicates, seed, portable)
    weighted = rows.join(numbered, "loan").join(weights, "idx")
    return weighted.select("rep", "y", (F.col("n") * F.col("times")).alias("w"), F.expr(MODELS))


def gini_differences(
    scored: DataFrame,
    label: str,
    candidate: str,
    baseline: str,
    loan: str = "LOAN_ID",
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = SEED,
    portable: bool = False,
    exact_draws: bool = False,
) -> DataFrame:
    """Gini difference per replicate; replicate 0 is the full data. One-class replicates are NULL."""
    pairs = scored.where(
        F.col(label).isNotNull() & F.col(candidate).isNotNull() & F.col(baseline).isNotNull()
    ).groupBy(
        F.col(loan).alias("loan"),
        F.col(candidate).cast("double").alias("candidate"),
        F.col(baseline).cast("double").alias("baseline"),
        F.col(label).alias("y"),
    ).agg(F.count(F.lit(1)).alias("n"))
    # A row's work is that of all replicates, which its size does not show: the number of tasks is set here.
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = materialize(pairs.repartitionByRange(tasks, "candidate", "loan"), "bootstrap-rows")
    spread = _drawn_rows if exact_draws else _poisson_rows
    long = spread(rows, replicates, seed, portable)
    per_model = auc(long, "y", "score", ("rep", "model"), F.col("w"), cuts_from=rows.select(F.expr(MODELS)))

    def gini(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("gini")))

    return per_model.groupBy("rep").agg((gini("candidate") - gini("baseline")).alias("difference"))


def interval(
    differences: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, alpha: float = BOOTSTRAP_ALPHA
) -> DataFrame:
    """Estimate, percentile bounds and usable replicates, as one row.

    ``usable`` is false when fewer than half of the replicates (and at least ten) held both classes.
    """
    if replicates <= 0 or not 0 < alpha < 1:
        raise ValueError("replicates must be positive and alpha inside (0, 1)")
    drawn = F.when(F.col("rep") > 0, F.col("difference"))
    return differences.agg(
        F.max(F.when(F.col("rep") == 0, F.col("difference"))).alias("estimate"),
        F.percentile(drawn, alpha / 2).alias("lower"),
        F.percentile(drawn, 1 - alpha / 2).alias("upper"),
        F.count(drawn).alias("successful_replicates"),
    ).withColumn(
        "usable",
        F.col("estimate").isNotNull()
        & (F.col("successful_replicates") >= max(10, replicates // 2)),
    )


def clustered_gini_interval(
    scored: DataFrame,
    label: str,
    candidate: str,
    baseline: str,
    loan: str = "LOAN_ID",
    replicates: int = BOOTSTRAP_REPLICATES,
    alpha: float = BOOTSTRAP_ALPHA,
    seed: int = SEED,
    portable: bool = False,
) -> DataFrame:
    differences = gini_differences(
        scored, label, candidate, baseline, loan, replicates, seed, portable
    )
    return interval(differences, replicates, alpha)


def require_interval(scored: DataFrame, label: str, candidate: str, baseline: str, **options):
    """Evaluate the interval; raise for a single loan, one class, or too few usable replicates."""
    loan = options.get("loan", "LOAN_ID")
    if scored.select(loan).distinct().limit(2).count() < 2:
        raise ValueError("a clustered bootstrap needs at least two loans")
    row = clustered_gini_interval(scored, label, candidate, baseline, **options).first()
    if row.estimate is None:
        raise ValueError("the label needs both classes")
    if not row.usable:
        raise ValueError("too few replicates held both classes")
    return row
