"""Logistic fits by Newton steps (MOD4, MOD5, MOD7): each step is one pass that adds up a small matrix.

A pass computes the weighted cross-products of the terms in Arrow batches. A task emits the sums of its rows, a
shuffle of a few numbers per task adds them, and only the totals reach the driver, whose number is the square of the
number of terms. The ridge leaves the intercept free. A fit takes some six to eight passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 30


class FitError(ArithmeticError):
    """A fit that has no finite solution or does not settle."""


@dataclass(frozen=True)
class LogisticFit:
    coefficients: tuple[float, ...]
    intercept: float
    steps: int
    # Largest entry of the penalised score at the solution, over the total weight.
    gradient: float


def moment_sums(data: DataFrame, width: int, beta: np.ndarray) -> np.ndarray:
    """Totals over rows (x0.., label, weight): loss, score and information of a logistic model at ``beta``.

    ``beta`` has the intercept first. The result is one array: loss, the scores, the upper triangle of the information.
    """
    size = width + 1
    upper = np.triu_indices(size)
    names = [f"x{i}" for i in range(width)]

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1 + size + len(upper[0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in (*names, "label", "weight")]
            x = np.column_stack([np.ones(batch.num_rows), *columns[:width]])
            y, w = columns[width], columns[width + 1]
            z = x @ beta
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[0] += np.sum(w * (np.logaddexp(0, z) - y * z))
            total[1 : 1 + size] += x.T @ (w * (y - p))
            total[1 + size :] += (x.T @ (x * (w * p * (1 - p))[:, None]))[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

    sums = data.mapInArrow(add, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    result = np.zeros(1 + size + len(upper[0]))
    for row in sums.collect():
        result[row.place] = row.value
    return result


def fit_newton(
    rows: DataFrame,
    terms: Sequence[Column],
    label: Column,
    weight: Column | None = None,
    penalty: float = 1.0,
    tolerance: float = 1e-9,
    start: LogisticFit | None = None,
) -> LogisticFit:
    """Minimise the weighted log-loss plus ``penalty`` / 2 times the squared coefficients.

    ``rows`` is read once per step, so hand in a stored table. A step that does not lower the loss is halved. The steps
    begin at ``start``, or at zero; where they end does not depend on it.
    """
    width = len(terms)
    weight = F.lit(1.0) if weight is None else weight
    named = [t.cast("double").alias(f"x{i}") for i, t in enumerate(terms)]
    data = rows.select(*named, label.cast("double").alias("label"), weight.cast("double").alias("weight"))
    ridge = np.diag([0.0] + [penalty] * width)
    upper = np.triu_indices(width + 1)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = moment_sums(data, width, beta)
        information = np.zeros((width + 1, width + 1))
        information[upper] = sums[2 + width :]
        information = information + np.triu(information, 1).T
        return sums[0] + beta @ ridge @ beta / 2, sums[1 : 2 + width] - ridge @ beta, information + ridge

    beta = np.zeros(width + 1) if start is None else np.array([start.intercept, *start.coefficients])
    loss, score, information = at(beta)
    # At zero every row has information weight / 4.
    total = 4 * information[0, 0] if start is None else rows.agg(F.sum(weight.cast("double"))).first()[0] or 0.0
    if not total > 0:
        raise FitError("no rows to fit")
    for step in range(1, MOST_STEPS + 1):
        if np.max(np.abs(score)) <= tolerance * total:
            return LogisticFit(tuple(map(float, beta[1:])), float(beta[0]), step, float(np.max(np.abs(score)) / total))
        move, share = np.linalg.lstsq(information, score, rcond=None)[0], 1.0
        while True:
            found = at(beta + share * move)
            if found[0] <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        beta = beta + share * move
        loss, score, information = found
    raise FitError(f"not settled after {MOST_STEPS} steps: score {np.max(np.abs(score)) / total:.3g} of the weight")


def signed_minimum(matrix: np.ndarray, pull: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The x of least x'Ax / 2 - b'x whose entries have the given signs (1, -1) or are free (0).

    Entries held at zero are let go one at a time, that of the strongest pull first, and those that would change
    their sign are held again, so that every round lowers the value and their number is finite (Lawson and Hanson).
    """
    x, loose = np.zeros(len(pull)), signs == 0

    def solved() -> np.ndarray:
        found = np.zeros(len(pull))
        found[loose] = np.linalg.lstsq(matrix[np.ix_(loose, loose)], pull[loose], rcond=None)[0]
        return found

    x = solved()
    least = 1e-12 * max(1.0, float(np.max(np.abs(pull))))
    for _ in range(10 * len(pull)):
        gain = np.where(loose, 0.0, signs * (pull - matrix @ x))
        best = int(np.argmax(gain))
        if gain[best] <= least:
            break
        loose[best] = True
        while True:
            found = solved()
            wrong = loose & (signs * found < 0)
            if not wrong.any():
                break
            share = np.min(x[wrong] / (x[wrong] - found[wrong]))
            x = x + share * (found - x)
            held = wrong & (signs * x <= 1e-15)
            x[held], loose[held] = 0.0, False
        x = found
    return x
