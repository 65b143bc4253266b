"""Secret scans with built-in functions only: patterns, and multipart credentials linked by an interval join.

Three patterns are secrets on their own (assign, access, hex). Weaker parts are reported only with
their complement: an identifier assignment (keyid) near a secret, an opaque 40-character token
(opaque) near an identifier, a service address (endpoint) near an identifier. Near means at most SCOPE code
points apart, end to start: a complement lies in every scope cell that its span touches, a weak part looks
into every cell within SCOPE of its own span, and parts are joined on document and cell, with the distance
as condition, so a cell holds few parts and no document is compared with itself whole. The pairs found are
the links, which tell which identifier a secret or an address belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbsense.llm.columns import blocks, let, piece, running, text_key
from curbsense.llm.session import staged

#: Kinds in the order in which spans that start together are listed, with pattern, part and own standing.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, "secret", True),
    ("access", r"AKIA[A-Z0-9]{16,}", "id", True),
    ("hex", r"[0-9a-f]{24,}", "secret", True),
    ("keyid", r"""(?i:access_?key_?id|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_-]{8,}""", "id", False),
    ("opaque", r"(?<![A-Za-z0-9/+])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])", "secret", False),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?", "endpoint", False),
]
NAMES = [k[0] for k in KINDS]
#: Parts of which one must be near for a weak kind to be reported.
NEEDS = {"keyid": "secret", "opaque": "id", "endpoint": "id"}
#: Characters of an assignment's value, at least.
VALUE = 6
#: Code points of a scope, and the largest distance of linked parts.
SCOPE = 200
#: Most spans that may be broadcast to redact texts; beyond, they are joined by shuffle.
BROADCAST_SPANS = 500_000
SPANS, LINKS = "array<struct<kind:int,start:int,end:int>>", "array<struct<start:int,kind:int,end:int,near_start:int,near_kind:int,near_end:int>>"


def _matches(text: Column, kind: int) -> Column:
    """Array of (kind, start, end) of a pattern's matches, leftmost and non-overlapping; code points, end exclusive."""
    name, pattern, _, _ = KINDS[kind]
    empty = F.array().cast(SPANS)

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        sizes = let(gaps, lambda g: F.transform(found, lambda m, i: F.get(g, i) + F.length(m)))
        spans = let(running(sizes, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), (F.get(ends, i + 1) - F.length(m)).alias("start"), F.get(ends, i + 1).alias("end"))))
        if name != "assign":
            return spans
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return let(values, lambda v: F.filter(spans, lambda s, i: F.length(F.get(v, i)) >= VALUE))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(located(found)))


def _span(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), kind), start.cast("string"), end.cast("string"))


def _listed(spans: Column) -> Column:
    """Spans by start, then kind, as text."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: _span(s["kind"], s["start"], s["end"])), ",")


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_key, base, weak) for every row of df: arrays of spans (kind, start, end), as a staged table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_key", text_key(F.col("text")))
    every = [_matches(F.col("text"), k) for k in range(len(KINDS))]
    return staged(rows.select("id", "text_key", F.concat(*every[:3]).alias("base"), F.concat(*every[3:]).alias("weak")))


def links(rows: DataFrame) -> DataFrame:
    """Rows (text_key, kind, start, end, near_kind, near_start, near_end): each weak part of parts() with every complement within SCOPE."""
    # One row per text is enough to link its parts: equal texts have equal spans.
    units = rows.where("size(weak) > 0").select("text_key", "base", "weak").dropDuplicates(["text_key"])
    of = F.element_at(F.array(*(F.lit(k[2]) for k in KINDS)), F.col("s.kind") + 1)
    spans = units.select("text_key", F.explode(F.concat("base", "weak")).alias("s")).select("text_key", "s.*", of.alias("part"))
    cell = lambda at: F.floor(at / SCOPE)
    near = spans.select("text_key", F.col("kind").alias("near_kind"), F.col("start").alias("near_start"), F.col("end").alias("near_end"), F.col("part").alias("need"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell"))
    need = F.element_at(F.array(*(F.lit(NEEDS.get(n)) for n in NAMES)), F.col("kind") + 1)
    weak = spans.where(F.col("kind") >= 3).withColumn("need", need).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - SCOPE), cell(F.col("end") + SCOPE))))
    apart = F.greatest(F.col("near_start") - F.col("end"), F.col("start") - F.col("near_end"))
    # Of the cells that a pair has in common, the first one gives it.
    once = F.col("cell") == F.greatest(cell(F.col("start") - SCOPE), cell(F.col("near_start")))
    return weak.join(near, ["text_key", "cell", "need"]).where((apart <= SCOPE) & once).select("text_key", "kind", "start", "end", "near_kind", "near_start", "near_end")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_key, base, linked, links) for every row of df: arrays of spans, and of weak spans with their complements."""
    rows = parts(df, id_col, text_col)
    linked = links(rows).groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked"), F.sort_array(F.collect_list(F.struct("start", "kind", "end", "near_start", "near_kind", "near_end"))).alias("links"))
    out = rows.select("id", "text_key", "base").join(staged(linked), "text_key", "left")
    return out.withColumns({"linked": F.coalesce("linked", F.array().cast(SPANS)), "links": F.coalesce("links", F.array().cast(LINKS))})


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, by start, then kind) and links.

    links has every weak span that is reported with each of its complements, as span>span, by the
    weak span's start and kind, then those of the complement. A null or empty text has no spans, and
    base_sha256 is that of the empty string. A null id stays null; repeated rows give equal rows; an
    empty table gives none. Whole texts are searched, whatever their length, at a cost in proportion
    to it. Other columns of df are left out and may have any name.
    """
    rows = found(df, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    told = F.transform("links", lambda x: F.concat_ws(">", _span(x["kind"], x["start"], x["end"]), _span(x["near_kind"], x["near_start"], x["near_end"])))
    return rows.select(F.col("id").alias(id_col), *(count(k).alias(f"n_{NAMES[k]}") for k in range(3)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"), F.array_join(told, ",").alias("links"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of df, with its columns, every span in the text replaced by `mark` (overlapping spans by one).

    A text without spans, null or empty, stays as it is; repeated rows stay repeated; an empty table
    gives no rows; df's columns may have any name. A text of any length is cut into blocks once, so
    its cost is in proportion to it.
    """
    rows = found(df, id_col, text_col)
    hits = staged(rows.where("size(base) + size(linked) > 0").select(F.col("text_key").alias("hit_key"), F.concat("base", "linked").alias("hit_spans")).dropDuplicates(["hit_key"]))
    if (hits.agg(F.sum(F.size("hit_spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        hits = F.broadcast(hits)
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    out = df.select(F.struct(*(df[c] for c in df.columns)).alias("row")).withColumn("key", text_key(text))
    out = out.join(hits, F.col("key") == F.col("hit_key"), "left")

    def cut(spans: Column, text: Column) -> Column:
        # Where spans overlap, the furthest end so far tells what is left between them.
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def kept(b: Column) -> Column:
            before = let(ends, lambda e: F.flatten(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(e, i), F.array(piece(b, F.get(e, i), s["start"]), F.lit(mark))).otherwise(F.array().cast("array<string>")))))
            rest = piece(b, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
            return F.concat(F.array_join(before, ""), rest)

        return let(blocks(text), kept)

    ordered = F.sort_array(F.transform("hit_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    new = F.when(F.col("hit_spans").isNull(), F.col(f"row.{text_col}")).otherwise(let(ordered, lambda s: cut(s, text)))
    return out.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))


def _sql_spans(kind: int, pattern: str, keep: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, CAST(before + sum(length(gap) + length(m)) OVER w AS BIGINT) - length(m) AS s, CAST(before + sum(length(gap) + length(m)) OVER w AS BIGINT) AS e, m FROM (
        SELECT doc_id, 0 AS before, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_split_to_array(text, '{pattern}')) AS gap, unnest(range(len(regexp_extract_all(text, '{pattern}')) + 1)) AS i
        FROM docs WHERE regexp_matches(text, '{pattern}')) WHERE m IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY {keep}"""


_SHORT = ASSIGN.replace("'", "''")
_CASES = "CASE {} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
#: The same rows in DuckDB's SQL, for ids without null or repetition. Its patterns have no lookaround: an opaque token is a run of 40 characters.
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS (
    {_sql_spans(0, ASSIGN, f"length(regexp_extract(m, '{_SHORT}', 2)) >= {VALUE}")}
    UNION ALL {_sql_spans(1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
    UNION ALL {_sql_spans(2, "[0-9a-f]+", "length(m) >= 24")}
    UNION ALL {_sql_spans(3, KINDS[3][1], "true")}
    UNION ALL {_sql_spans(4, "[A-Za-z0-9/+]+", "length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")}
    UNION ALL {_sql_spans(5, KINDS[5][1], "true")}
), named AS (
    SELECT *, {_CASES.format("kind")} || ':' || s || ':' || e AS said, CASE WHEN kind IN (0, 2, 4) THEN 'secret' WHEN kind IN (1, 3) THEN 'id' ELSE 'endpoint' END AS part, CASE kind WHEN 3 THEN 'secret' WHEN 4 THEN 'id' WHEN 5 THEN 'id' END AS need FROM spans
), linked AS (
    SELECT a.doc_id, a.kind, a.s, a.e, a.said, b.kind AS near_kind, b.s AS near_s, b.e AS near_e, b.said AS near_said
    FROM named a JOIN named b ON a.doc_id = b.doc_id AND a.need = b.part AND greatest(b.s - a.e, a.s - b.e) <= {SCOPE}
), shown AS (
    SELECT doc_id, kind, s, said FROM named WHERE kind < 3 UNION SELECT doc_id, kind, s, said FROM linked
), counts AS (
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans FROM shown GROUP BY doc_id
), told AS (
    SELECT doc_id, string_agg(said || '>' || near_said, ',' ORDER BY s, kind, e, near_s, near_kind, near_e) AS links FROM linked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN told USING (doc_id)
"""
