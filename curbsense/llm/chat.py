"""Chat formatting with built-in functions only: every participant's view of a dialogue.

For each participant the whole dialogue is rendered with that speaker as assistant and the others as
named users; the mask lists the spans of the assistant's words, which a loss would count. Names and
words that hold a marker's signs are escaped, so no speaker can forge a turn.

A view is one text, and it is one row for any dialogue of up to PART_TURNS turns. A longer one is
stored as several rows, which joined in order of `part` give the view: turns are numbered over the
whole dialogue, spans count from the view's start, and no turn is left out or repeated. Numbers come
from a range partitioning by dialogue and place, so one that holds a third of all turns is spread
over tasks, and no task gathers more than PART_TURNS turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.llm.columns import let, running
from curbsense.llm.session import staged

#: Turns of a view in one row; None for no limit, where dialogues are known to be short.
PART_TURNS = 4096
#: Speakers that no view is rendered for; they keep their own role.
NARRATORS = ("system",)
UNNAMED = "unknown"
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    """Text in which "<|" and "|>" can't stand: a backslash goes between their signs, and one more between signs that have some."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def _header(speaker: Column, viewer: Column) -> Column:
    narrates = speaker.isin(*NARRATORS)
    return F.when(speaker == viewer, F.lit("<|assistant|>\n")).when(narrates, F.concat(F.lit("<|"), speaker, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), escaped(F.regexp_replace(speaker, "[\\r\\n]", " ")), F.lit("|>\n")))


def numbered(turns: DataFrame, part_turns: int | None) -> DataFrame:
    """turns (conv_id, turn, speaker, said) with their number in the dialogue (n) and its part, by turn, speaker, then words."""
    if part_turns is None:
        return turns.withColumn("part", F.lit(0).cast("long"))
    order = ["turn", "speaker", "said"]
    ranged = staged(turns.repartitionByRange("conv_id", *order).withColumn("piece", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("size"))
    # Pieces of a dialogue are few: partitions that hold some of it.
    before = F.sum("size").over(W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("of"), F.col("piece").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))
    n = F.row_number().over(W.partitionBy("conv_id", "piece").orderBy(*order)) - 1
    rows = ranged.withColumn("n", n).join(sizes, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at")))
    return rows.withColumn("part", F.floor((F.col("n") + F.col("before")) / part_turns)).drop("piece", "n", "of", "at", "before")


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int | None = PART_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, n_target, rendered, mask).

    n_turns counts the row's turns, n_target those of the perspective's speaker; mask has their
    spans as start:end, joined by commas (code points of the whole view, end exclusive). Turns stand
    by turn number (null first), then speaker, then text. A row that repeats another is one turn. A
    null text is empty, a null speaker is called unknown, rows without a conversation form one of
    their own. Texts of any length are rendered whole. A conversation of narrators alone has no
    participant and no row; an empty table gives none. Other columns of df are left out and may have
    any name.
    """
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("said"),
    ).distinct()
    viewers = turns.select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).where(~F.col("perspective").isin(*NARRATORS)).distinct()
    parts = numbered(turns, part_turns).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    views = parts.join(viewers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    views = views.withColumn("turns", F.transform("turns", lambda t: F.struct((t["speaker"] == F.col("perspective")).alias("own"), _header(t["speaker"], F.col("perspective")).alias("head"), escaped(t["said"]).alias("said"))))
    views = views.withColumn("ends", running(F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["said"]) + len(END)), lambda a, b: a + b))
    # Where a part begins in the view: sums over the earlier parts, one number each, for the dialogues that have some.
    several = parts.where("part > 0").select(F.col("conv_id").alias("of")).distinct()
    sizes = views.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("conv_id", "perspective", "part", F.element_at("ends", -1).cast("long").alias("size"))
    earlier = F.sum("size").over(W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("of"), F.col("perspective").alias("by"), F.col("part").alias("nth"), earlier.alias("at"))
    views = views.join(sizes, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("perspective") == F.col("by")) & (F.col("part") == F.col("nth")), "left")
    views = views.withColumn("at", F.coalesce("at", F.lit(0).cast("long")))

    def span(t: Column, i: Column) -> Column:
        end = F.col("at") + F.get("ends", i + 1) - len(END)
        return F.when(t["own"], F.concat_ws(":", (end - F.length(t["said"])).cast("string"), end.cast("string")))

    return views.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["own"])).cast("long").alias("n_target"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END))), "").alias("rendered"),
        F.array_join(F.array_compact(F.transform("turns", span)), ",").alias("mask"),
    )


def _sql_escaped(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g')"


#: The same rows in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH turns AS (
    SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, said) - 1) // {PART_TURNS} AS part
    FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '{UNNAMED}') AS speaker, coalesce(text, '') AS said FROM conversations)
), viewers AS (
    SELECT DISTINCT conv_id AS of_conv, speaker AS perspective FROM turns WHERE speaker <> 'system'
), heads AS (
    SELECT conv_id, perspective, part, turn, speaker, said AS raw, {_sql_escaped("said")} AS said,
        CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
             WHEN speaker = 'system' THEN '<|system|>' || chr(10)
             ELSE '<|user name=' || {_sql_escaped("regexp_replace(speaker, '[\r\n]', ' ', 'g')")} || '|>' || chr(10) END AS head
    FROM turns JOIN viewers ON conv_id IS NOT DISTINCT FROM of_conv
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(said) + {len(END)}) OVER (
        PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
    FROM heads
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (speaker = perspective) AS n_target,
    string_agg(head || said || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, speaker, raw) AS rendered,
    coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(said) AS BIGINT), ',' ORDER BY turn NULLS FIRST, speaker, raw) FILTER (speaker = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
