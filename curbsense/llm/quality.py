"""Quality rules with built-in functions only: repetition inside a text, and line frequency across documents.

Lines are normalised (lower case, digits as 0, blanks as one space) and hashed, and for each host the
distinct documents that hold a line are counted; equal texts of a host count as one document. A line is
boilerplate where more than `limit` documents hold it. Boilerplate lines are removed from the texts
(clean), and a document that is left with less than `least` of its words is rejected as depleted.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbsense.llm.columns import BLANKS, has_word, let, text_key, words
from curbsense.llm.session import staged

WINDOW = 5
SYMBOLS = "#*$%&|<>"
LIMIT, LEAST = 20, 0.3
KEY = ["host", "text_key"]
#: Most keys of texts that lose lines or are rejected, and hashes of their lines, that may be broadcast (some 40 and 8 bytes each); beyond, they are joined by shuffle.
BROADCAST_KEYS = 300_000


def repeated_words(tokens: Column) -> Column:
    """Words covered by windows of five words that occur twice or more among the tokens, first ones included."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, step: F.coalesce(F.get(s, k)["h"] == F.get(s, k + step)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x)

        return let(pairs, lambda s: let(starts(s), total))

    def of(t: Column) -> Column:
        # Few texts repeat a window; the others stop at a comparison of counts.
        windows = F.transform(F.sequence(F.lit(0), F.size(t) - WINDOW), lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(WINDOW))))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))

    return F.when(F.size(tokens) > WINDOW, let(F.transform(tokens, lambda w: F.xxhash64(w)), of)).otherwise(0).cast("long")


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(line)), "[0-9]", "0"), r"\s+", " ")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, text_key, the base measures and the lines (hash, words) of every row, as a staged table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    rows = rows.withColumns({"words": words(F.col("text")), "lines": F.filter(F.split("text", "\n"), has_word)})
    bare = F.length(F.translate("text", BLANKS, "")).cast("long")
    return staged(
        rows.select(
            "id",
            "host",
            text_key(F.col("text")).alias("text_key"),
            F.size("words").cast("long").alias("n_words"),
            bare.alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
            F.transform("lines", lambda x: F.struct(_line_hash(x).alias("line"), F.size(words(x)).alias("w"))).alias("lines"),
        ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def _on(a: str, b: str, *names: str) -> Column:
    """Equality of columns of two aliases, nulls equal; a pair of names may differ as left=right."""
    left_right = [n.split("=") * 2 for n in names]
    return reduce(and_, (F.col(f"{a}.{n[0]}").eqNullSafe(F.col(f"{b}.{n[1]}")) for n in left_right))


def removals(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (host, text_key, lines, removed): the boilerplate lines of each text that holds some, and their words, as a staged table."""
    units = rows.where("n_words > 0").select(*KEY, "lines").dropDuplicates(KEY)
    lines = units.select(*KEY, F.explode("lines").alias("l")).groupBy(*KEY, F.col("l.line").alias("line")).agg(F.sum("l.w").alias("w"))
    frequent = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    gone = lines.alias("a").join(frequent.alias("b"), _on("a", "b", "host", "line"), "left_semi")
    return staged(gone.groupBy(*KEY).agg(F.collect_list("line").alias("lines"), F.sum("w").cast("long").alias("removed")))


def _verdicts(rows: DataFrame, limit: int, least: float) -> DataFrame:
    """rows with removed, lines (null where a text keeps all its lines) and kept."""
    out = rows.drop("lines").alias("a").join(removals(rows, limit).alias("b"), _on("a", "b", *KEY), "left").select("a.*", F.coalesce("removed", F.lit(0).cast("long")).alias("removed"), "b.lines")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed") >= least * F.col("n_words")))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, least: float = LEAST) -> DataFrame:
    """One row per row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and n_boilerplate_words.

    n_boilerplate_words are those of the lines that clean() removes. A null, empty or blank text has
    no words and fails. A null host is a host of its own. Repeated rows and equal texts of a host
    count as one document and share its verdict. Whole texts are read, whatever their length. An
    empty table gives no rows. Other columns of df are left out and may have any name.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _verdicts(measured(df, id_col, text_col, host_col), limit, least).select(F.col("id").alias(id_col), *names, F.col("removed").alias("n_boilerplate_words"))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, least: float = LEAST) -> DataFrame:
    """The rows of df, with its columns, that quality() keeps, their texts without boilerplate lines.

    Null, empty and blank texts go, as they fail. Texts without boilerplate stay as they are, and so
    do lines without a word. Repeated rows stay repeated; an empty table gives no rows; df's columns
    may have any name. Only keys of texts that go or lose lines are joined to the texts, so texts
    are moved only where these are more than BROADCAST_KEYS.
    """
    verdicts = _verdicts(measured(df, id_col, text_col, host_col), limit, least)
    marks = verdicts.where(~F.col("kept") | F.col("lines").isNotNull()).select(F.struct(F.col("host").alias("h"), F.col("text_key").alias("k")).alias("mark"), F.when(F.col("kept"), F.col("lines")).alias("lines"), "kept")
    marks = staged(marks.dropDuplicates(["mark"]))
    if (marks.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.greatest(F.size("lines"), F.lit(0))), F.lit(0))).first()[0]) <= BROADCAST_KEYS:
        marks = F.broadcast(marks)
    text = F.col(f"row.{text_col}")
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row")).withColumn("key", F.struct(F.col(f"row.{host_col}").cast("string").alias("h"), text_key(F.coalesce(text, F.lit(""))).alias("k")))
    rows = rows.join(marks, F.col("key").eqNullSafe(F.col("mark")), "left").where(F.coalesce("kept", F.lit(True)))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(has_word(x) & F.array_contains("lines", _line_hash(x)))), "\n")
    new = F.when(F.col("lines").isNull(), text).otherwise(left)
    return rows.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))


#: The same with lines in clear text. Digests of texts and lines aren't needed there.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, regexp_replace(regexp_replace(trim(lower(line), ' '), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
frequent AS (SELECT source, normal FROM worded GROUP BY source, normal HAVING count(DISTINCT text) > 20),
per_doc AS (SELECT l.r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(l.w) FILTER (f.normal IS NOT NULL), 0) AS removed FROM worded l LEFT JOIN frequent f ON f.source IS NOT DISTINCT FROM l.source AND f.normal = l.normal GROUP BY l.r),
starts AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM docs WHERE len(w) >= 5),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS n FROM starts),
repeats AS (SELECT r, count(DISTINCT k) AS covered FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM windows WHERE n > 1) GROUP BY r),
base AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_boilerplate_words
         FROM docs d LEFT JOIN per_doc USING (r) LEFT JOIN repeats USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_boilerplate_words >= 0.3 * n_words AS kept, n_boilerplate_words FROM failed
"""
