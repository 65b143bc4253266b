"""Mixing sources to target weights: repetition rates per source, whole copies and one Bernoulli copy.

Words are summed per source, targets follow from the sources' weights, and a source's rate is its
target over its words. A document is emitted floor(rate) times and once more where a hash of its
id, seeded per source, falls below the fraction. Of SEEDS seeds a source takes the one whose sum
comes nearest to its target, found in one pre-aggregated pass; every draw stays a function of the
id and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.llm.session import staged

WORDS = r"[^\x20\x09-\x0D]+"
#: Seeds tried for each source.
SEEDS = 16


def n_words(text: str) -> Column:
    """Words of a text; none where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _draw(id_col: Column, seed: Column) -> Column:
    """Uniform in [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), seed, id_col), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share `share` times all
    sizes; none gets more than `most` times its own size, and what that leaves is shared anew by
    weight among the others. With sources ordered by most * size / weight those that stop come
    first, so sums along that order give the level of the rest. One row per source is ordered here;
    documents never are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))
    per = per.withColumns({"top": most * F.col("source_size"), "all": share * F.sum("source_size").over(W.partitionBy())})
    by_ratio = W.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("top").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    per = per.withColumn("level", (F.col("all") - stopped) / left)
    fits = F.when(F.col("level") <= F.col("top") / F.col("weight"), F.struct(F.col("top") / F.col("weight"), F.col("source").isNull(), "source", F.col("level").alias("level")))
    per = per.withColumn("level", F.min(fits).over(W.partitionBy()).getField("level"))
    return per.select("source", "source_size", F.coalesce(F.least("top", F.col("level") * F.col("weight")), "top").alias("target"))


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"))


def plan(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """targets() with the whole copies, the fraction and the seed of each source, as a staged table (one row per source)."""
    per = staged(targets(sizes, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumns({"whole": F.floor(rate), "part": rate - F.floor(rate)})
    drawn = sizes.join(per.select(F.col("source").alias("of"), "part"), F.col("source").eqNullSafe(F.col("of")))
    sums = drawn.groupBy("source").agg(*(F.sum(F.when(_draw(F.col("id"), F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)))
    sums = sums.select(F.col("source").alias("of"), F.array(*(f"s{k}" for k in range(SEEDS))).alias("sums"))
    per = per.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
    miss = F.transform("sums", lambda s, k: F.struct(F.abs(F.col("whole") * F.col("source_size") + s - F.col("target")), k.alias("seed")))
    return staged(per.select("source", "source_size", "target", "whole", "part", F.coalesce(F.array_min(miss)["seed"], F.lit(0)).alias("seed")))


def _copies() -> Column:
    return (F.col("whole") + (_draw(F.col("id"), F.col("seed")) < F.col("part")).cast("long")).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of df: its id, size, source_size, target, copies and taken (= copies * size).

    A null text has size 0, a null source is a source of its own, and a source without words has
    target and copies 0. Rows with a null id draw as one; repeated rows draw alike. Words of texts of
    any length are counted. An empty table gives no rows. Other columns of df are left out and may
    have any name.
    """
    sizes = staged(_sizes(df, id_col, text_col, source_col))
    per = plan(sizes, weights, share, most).withColumnRenamed("source", "of")
    out = sizes.join(per, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of df as the mix takes them: each `copies` times, with df's columns. Texts are not shuffled.

    Null texts and sources, repeated rows and rows without an id are as for mix(); an empty table
    gives no rows; df's columns may have any name.
    """
    names = df.columns
    per = plan(staged(_sizes(df, id_col, text_col, source_col)), weights, share, most)
    per = per.select(F.struct(F.col("source").alias("of"), "whole", "part", "seed").alias("mix"))
    rows = df.select(F.struct(*(df[c] for c in names)).alias("row"))
    rows = rows.join(per, F.col(f"row.{source_col}").cast("string").eqNullSafe(F.col("mix.of")))
    drawn = (_draw(F.col(f"row.{id_col}"), F.col("mix.seed")) < F.col("mix.part")).cast("int")
    times = F.array_repeat(F.lit(True), F.col("mix.whole").cast("int") + drawn)
    return rows.select("row", F.explode(times).alias("copy")).select("row.*")
