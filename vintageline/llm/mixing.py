"""Mixing sources to target weights (operator 5) by weighted fair queueing, in DataFrame functions only.

Every source gets a target: its weight's share of the budget, at most ``most`` times its own words, the
excess shared again by weight. A source's documents queue in shuffled order, pass after pass (a second
pass repeats them), and each waiting copy has a virtual finish time: the source's words up to and
including it, over the source's target. The copies of all sources are sorted by that time and taken
from the front while the running total of words stays within the budget.

A third of all rows may lie in one source: running totals are taken in slices of (source, pass) by hash
and over slices of the finish time, never over a whole source in one task. Only one row per source and
slice is ever ordered together.

Nulls: a null text has size 0, a null source is a source of its own, listed last; rows are
shuffled by doc_id and text together, so rows that share a null or repeated doc_id are spread as well. Documents of size 0 finish at once and are taken 0 words. Repeated rows
are documents of their own, ordered among themselves as the table is read. An empty table gives an empty
mix. Other columns are not touched; ``mixed_documents`` returns them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.llm.common import WORD_PATTERN, free_name, materialize, row_hash

# The weights that the sources get in turn.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    The level at which capped sources stop is found in closed form: sources are ordered by cap over
    weight, and the first whose cap the remaining budget per remaining weight does not reach, sets it;
    counting it or later ones as capped too would only lower the level, hence the maximum.
    One row per source is ordered in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(listed)
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    weighted = totals.withColumn("weight", F.element_at(weights, ((place - 1) % len(WEIGHTS) + 1).cast("int")))
    capped = weighted.withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    words = F.sum("source_size").over(everything).cast("double")
    left = words * share - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = left / weight_left
    stepped = capped.withColumn("level", level).withColumn(
        "open_level", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    )
    final = F.max("open_level").over(everything)
    return stepped.select(
        "source",
        "source_size",
        "weight",
        F.when(final.isNull() | (F.col("cap") / F.col("weight") <= final), F.col("cap").cast("double"))
        .otherwise(final * F.col("weight"))
        .alias("target"),
    )


def _running(frame: DataFrame, groups: list[str], order: list, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the group's rows up to and including each row, by ``_slice``, then ``order``.

    Slices are summed on their own; the slice totals of a group, about the square root of its rows, are
    accumulated in one window.
    """
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frame.groupBy(*groups, "_slice")
        .agg(F.sum(value).alias("_part"))
        .select(
            *(F.col(g).alias(f"_k_{g}") for g in groups),
            F.col("_slice").alias("_k_slice"),
            F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    same = F.col("_slice") == F.col("_k_slice")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        frame.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, same)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_slice", "_k_slice", *(f"_k_{g}" for g in groups))
    )


def mixed(
    documents: DataFrame, share: float = SHARE, most: int = MOST, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document: doc_id, source, ``keep``, size, source_size, target, copies, taken."""
    kept = {c: f"_k{i}" for i, c in enumerate(keep)}
    sizes = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        "source",
        *(F.col(c).alias(k) for c, k in kept.items()),
        word_count().alias("size"),
        F.md5("text").alias("_content"),
    )
    sized = materialize(sizes, "mix-sizes")
    rows, words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    slices = math.isqrt(rows) + 1
    named = source_targets(sized, share, most).withColumnRenamed("source", "_name").drop("weight")
    known = sized.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    shuffled = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in ("doc_id", "pass", "_content"))))
    part = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    queued = (
        known.where("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(most))))
        .withColumn("shuffled", shuffled)
        .withColumn("_slice", F.col("pass") * slices + F.floor(part * slices / F.lit(2**32)))
    )
    in_line = [F.col("pass"), F.col("shuffled"), F.col("doc_id"), F.col("_row")]
    timed = (
        _running(queued, ["source"], in_line, "size", "queued_words")
        .withColumn("finish", F.col("queued_words") / F.col("target"))
        .withColumn("_slice", F.floor(F.col("finish") * slices))
    )
    by_finish = [F.col("finish"), F.col("source").asc_nulls_last(), *in_line]
    taken = (
        _running(timed, [], by_finish, "size", "mixed_words")
        .where(F.col("mixed_words") <= F.lit(float(words)) * share)
        .groupBy(F.col("_row").alias("_taken_row"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    copies = F.coalesce(F.col("copies"), F.lit(0))
    return known.join(taken, F.col("_row") == F.col("_taken_row"), "left").select(
        "doc_id",
        "source",
        *(F.col(k).alias(c) for c, k in kept.items()),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(documents: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    Equal rows are interchangeable, so one of them is repeated as often as all of them are taken. The
    texts cross one shuffle and are not written.
    """
    name, key, found, times, copy = (
        free_name(documents.columns, c) for c in ("_hash", "_key", "_found", "_times", "_copy")
    )
    hashed = documents.withColumn(name, row_hash(documents))
    decided = (
        mixed(hashed, share, most, [name])
        .groupBy(F.col("doc_id").alias(key), F.col(name).alias(found))
        .agg(F.sum("copies").cast("int").alias(times))
        .where(F.col(times) > 0)
    )
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(name) == F.col(found))
    chosen = hashed.dropDuplicates(["doc_id", name]).join(decided, same)
    repeated = F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(copy)
    return chosen.select(*documents.columns, repeated).drop(copy)


def mix_digest(documents: DataFrame) -> DataFrame:
    return mixed(documents).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = f"""
WITH sized AS (
    SELECT row_number() OVER () AS r, doc_id, source, md5(text) AS content,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1)
                                               % {len(WEIGHTS)} + 1)::INT] AS weight,
           source_size * {MOST} AS cap
    FROM totals),
stepped AS (
    SELECT *, cap::DOUBLE / weight AS ratio,
           ((sum(source_size) OVER ())::DOUBLE * {SHARE} - coalesce(sum(cap) OVER before, 0)::DOUBLE)
           / (sum(weight) OVER after)::DOUBLE AS level
    FROM weighted
    WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
opened AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS final FROM stepped),
targets AS (
    SELECT source, source_size,
           CASE WHEN final IS NULL OR ratio <= final THEN cap::DOUBLE ELSE final * weight END AS target
    FROM opened),
known AS (
    SELECT s.r, s.doc_id, s.source, s.content, s.size, t.source_size, t.target
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queued AS (
    SELECT *, md5(concat_ws(':', doc_id::VARCHAR, pass::VARCHAR, content)) AS shuffled
    FROM known, (SELECT unnest(range(1, {MOST} + 1)) AS pass) WHERE size > 0),
timed AS (
    SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY pass, shuffled, doc_id, r
                               ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish
    FROM queued),
ordered AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, shuffled, doc_id, r
                              ROWS UNBOUNDED PRECEDING) AS mixed_words
    FROM timed),
taken AS (
    SELECT r, count(*) AS copies FROM ordered
    WHERE mixed_words::DOUBLE <= (SELECT sum(size)::DOUBLE FROM sized) * {SHARE}
    GROUP BY r)
SELECT k.doc_id, k.size::BIGINT AS size, k.source_size, k.target,
       (coalesce(t.copies, 0) * k.size)::BIGINT AS taken
FROM known k LEFT JOIN taken t ON k.r = t.r
"""
