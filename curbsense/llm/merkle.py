"""A Merkle manifest of a dataset: one tree of documents for each source, and a tree of the sources over them.

Leaves are digests of rows. They are ordered by one range shuffle of digests (never of texts) by source
and id, so a leaf's place in its tree follows from its place in its partition and a small table of how
many leaves of a source earlier partitions hold: no source is gathered anywhere.

Trees are hashed by supersteps over RDDs. A vertex of a superstep is the part of a tree LEVELS high over
up to ARITY ** LEVELS nodes. Its children message it their digests; complete vertices hash their runs
level by level and forward the top to the vertex above. The number of supersteps is the logarithm of the
largest tree's size, and the messages get fewer by the same factor in each. A tree that is down to one
node passes it on as it is. Then supersteps run in reverse: from the root downwards every vertex tells its
children their siblings on the way up (their proof), and the last ones, at the documents, fold the
digests of the rows as they are now with these siblings and compare the outcome with the root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbsense.llm.session import staged

#: Children of a node, and levels of the tree that one superstep climbs: a vertex gets at most 3**4 messages.
ARITY, LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(*digests: bytes) -> bytes:
    """SHA-256 of digests as hex text, one after another."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def climb(digests: list[bytes], size: int) -> tuple[list[list[bytes]], int]:
    """The levels over some neighbouring nodes, lowest first, and the size of the tree's level on top.

    `size` is the number of nodes of the whole tree on the lowest level; a level of one isn't hashed.
    """
    levels = [digests]
    while size > 1 and len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([sha(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        size = -(-size // ARITY)
    return levels, size


def siblings(levels: list[list[bytes]], at: int) -> list[tuple[int, tuple[bytes, ...]]]:
    """For each level but the top, the place of node `at` in its run and the run's other nodes."""
    out = []
    for level in levels[:-1]:
        first = at - at % ARITY
        run = level[first : first + ARITY]
        out.append((at - first, tuple(x for i, x in enumerate(run) if i != at - first)))
        at //= ARITY
    return out


def fold(digest: bytes, path: list[tuple[int, tuple[bytes, ...]]]) -> bytes:
    for at, others in path:
        digest = sha(*others[:at], digest, *others[at:])
    return digest


def _levels(vertex: tuple) -> tuple[list[tuple], list[list[bytes]], int]:
    """A vertex's messages in order, the levels over them, and the size of the tree's level on top."""
    ordered = sorted(vertex[1], key=lambda m: m[0])
    levels, size = climb([m[2] for m in ordered], ordered[0][1])
    return ordered, levels, size


def _forwarded(vertex: tuple) -> tuple:
    (tree, number), _ = vertex
    _, levels, size = _levels(vertex)
    return tree, number, size, levels[-1][0]


def up(nodes: RDD, most: int, share: float) -> tuple[list[RDD], RDD]:
    """Supersteps from rows (tree, number, size of the tree, digest, more...) to a row (tree, 0, 1, digest) for each tree; with the vertices of each step, for down().

    most is the size of the largest tree, and share how many trees there are for each node.
    """
    steps, span, all_parts = [], ARITY**LEVELS, nodes.getNumPartitions()
    while not steps or most > 1:
        parts = math.ceil(all_parts * min(1, span ** -len(steps) + share))
        steps.append(nodes.map(lambda x: ((x[0], x[1] // span), x[1:])).groupByKey(parts))
        nodes, most = steps[-1].map(_forwarded), -(-most // span)
    return steps, nodes


def down(steps: list[RDD], told: RDD, emit) -> RDD:
    """Supersteps in reverse, from rows ((tree, 0), (news, path)): each vertex tells its children the news, and their siblings before its own path.

    The children of the lowest step are emit(message, news, path).
    """
    for i in reversed(range(len(steps))):
        parts = steps[i].getNumPartitions()
        told = steps[i].join(told.partitionBy(parts), parts).flatMap(_telling(emit if i == 0 else None))
    return told


def _telling(emit):
    def telling(vertex: tuple) -> Iterator[tuple]:
        (tree, _), (messages, (news, above)) = vertex
        ordered, levels, _ = _levels((None, messages))
        for m in ordered:
            path = siblings(levels, m[0] - ordered[0][0]) + above
            yield emit(m, news, path) if emit else ((tree, m[0]), (news, path))

    return telling


def _verified(message: tuple, news: tuple[bytes, bytes], path: list) -> tuple:
    _, _, leaf, doc_id, now = message
    subroot, root = news
    folded = fold(now, path)
    proof = sha(*(x for _, others in path for x in others))
    return doc_id, leaf.hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root


def encoded(value: Column) -> Column:
    """A field as its byte count, `:` and its text; `-` where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ordered_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (tree, number, size, leaf, id, now), and one row (source, tree, size) for each source, in whose order trees are numbered.

    Equal leaves of one id may take one another's places, which changes no result.
    """
    key = ["source", "id", "leaf", "salt"]
    # The salt only deals out rows that are repeated.
    rows = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    # Partition and place in it: (partition << 33) + row.
    rows = staged(rows.drop("salt").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.select("part", "source", "first", F.min("first").over(own).alias("tree"), F.sum("n").over(own).alias("size"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    placed = rows.alias("a").join(runs.alias("b"), (F.col("a.part") == F.col("b.part")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    placed = placed.select("tree", (F.col("before") + F.col("at") - F.col("first")).alias("number"), "size", "leaf", "id", "now")
    return placed, runs.select("source", "tree", "size").distinct()


def manifest(df: DataFrame, now: dict[str, Column] | None = None, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of df: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    leaf is the digest of the row's fields, subroot that of its source's tree, root that of all. now
    gives columns as they are at the time of verification, where they differ from those that were
    hashed; folded_root is the root as recomputed from the row of that time and the siblings that
    were stored, and verified says that it is the root. proof_sha256 is the digest of the siblings.

    A null field is `-` and an empty text `0:`. A null source has a tree of its own, before all others,
    and a null id comes before others. Rows that repeat an id are leaves of their own, ordered by
    digest. Whole texts are hashed, whatever their length. An empty table gives no rows. Other columns
    of df are left out and may have any name.
    """
    spark = df.sparkSession
    digest = lambda columns: F.unhex(F.sha2(F.concat(*(encoded(c) for c in columns)), 256))
    leaf, changed = digest(F.col(c) for c in fields), digest((now or {}).get(c, F.col(c)) for c in fields)
    leaves = staged(df.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), changed.alias("now")))
    placed, sources = ordered_leaves(leaves)
    trees, most, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not trees:
        return spark.createDataFrame([], OUT)
    nodes = placed.rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]), r[4], bytes(r[5])))
    steps, tops = up(nodes, most, trees / total)
    # Trees are numbered in the order of their sources.
    heads = tops.map(lambda x: (x[0], x[3])).sortByKey().zipWithIndex().map(lambda x: (-1, x[1], trees, x[0][1], x[0][0]))
    head_steps, head = up(heads, trees, 1 / trees)
    root = head.first()[3]
    told = down(head_steps, spark.sparkContext.parallelize([((-1, 0), (root, []))], 1), lambda m, news, path: ((m[3], 0), ((m[2], news), path)))
    return spark.createDataFrame(down(steps, told, _verified), OUT, verifySchema=False)


#: Every leaf's path by a join with all nodes of its runs; crc32 by its definition, as DuckDB has none.
ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, row_number() OVER () AS row_id,
    concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    text, CASE WHEN list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384::UBIGINT))) % 2 = 1
      THEN replace(text, chr(10), '') ELSE text END AS text_now
  FROM documents),
leaves AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text_now) || ':' || text_now, '-')) AS now FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, count(*) OVER (PARTITION BY source) AS size FROM leaves),
tree AS (
  SELECT source, 0 AS level, number, size, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, number // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY number)) FROM tree WHERE size > 1 GROUP BY ALL),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS number, count(*) OVER () AS size FROM tree WHERE size = 1),
top AS (
  SELECT 0 AS level, number, size, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, number // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY number)) FROM top WHERE size > 1 GROUP BY ALL),
nodes AS (
  SELECT 0 AS part, coalesce('s' || source, '-') AS tree, level, number, size, digest FROM tree
  UNION ALL
  SELECT 1, '', level, number, size, digest FROM top),
runs AS (
  SELECT part, tree, level, number // 3 AS run, list(digest ORDER BY number) AS digests FROM nodes WHERE size > 1 GROUP BY ALL),
steps AS (
  SELECT p.row_id, coalesce('s' || p.source, '-') AS tree, 0 AS part, t.level, p.number // (3 ** t.level)::BIGINT AS number
  FROM placed p JOIN (SELECT DISTINCT source, level FROM tree WHERE size > 1) t ON t.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT p.row_id, '', 1, t.level, s.number // (3 ** t.level)::BIGINT FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, (SELECT DISTINCT level FROM top WHERE size > 1) t),
paths AS (
  SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY part, level) AS step, (s.number % 3)::INTEGER AS place, digests
  FROM steps s JOIN runs r USING (part, tree, level) WHERE r.run = s.number // 3),
folded AS (
  SELECT row_id, 0::BIGINT AS step, now AS digest FROM placed
  UNION ALL
  SELECT f.row_id, p.step, sha256(concat(list_aggregate(list_concat(['', ''], digests[1:place]), 'string_agg', ''), f.digest, list_aggregate(list_concat(['', ''], digests[place + 2:]), 'string_agg', '')))
  FROM folded f JOIN paths p ON p.row_id = f.row_id AND p.step = f.step + 1),
proofs AS (
  SELECT row_id, sha256(string_agg(list_aggregate(list_concat(['', ''], digests[1:place], digests[place + 2:]), 'string_agg', ''), '' ORDER BY step)) AS proof FROM paths GROUP BY row_id)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM top WHERE size = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = (SELECT digest FROM top WHERE size = 1) AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN proofs q USING (row_id)
JOIN (SELECT row_id, arg_max(digest, step) AS digest FROM folded GROUP BY row_id) f ON f.row_id = p.row_id
"""
