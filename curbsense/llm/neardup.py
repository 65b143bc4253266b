"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

One pass over the texts gives each document the set of its word shingles (64-bit hashes), a digest
of that set, and a one-permutation signature: the top bits of a shingle's hash choose a bin, the
least hash of each bin is kept, and an empty bin borrows from a bin that a fixed sequence of
universal hashes leads to (optimal densification). Bands of bins name buckets.

Equal sets fall together by digest, so copies of any number cost one row each. Of every bucket the
member that shares most buckets with others is the centre (of a family of edited copies that is the
one nearest to the original), and the others link to it alone: candidates grow with the members, not
with their square. Candidate pairs are confirmed on full sets, computed anew from the whole texts.

A star may miss links that do not touch its centre. So buckets whose members still lie in different
components get a second star about another centre, and then an exact bound decides the rest: a
document whose set shares c of its n shingles with any other such document can link to a document
(c', n') only if 100 * min(c, c') >= percent * (n + n' - min(c, c')). Signatures then rule out pairs
whose share of equal bins is SLACK below the threshold, 5 standard errors of 512 bins; with slack
None every pair within the bound is confirmed on full sets instead. No bucket is capped. (Joining
such documents on their rarest shingles, by prefix filtering, was tried in place of blocks: a family
just below the threshold shares these too, and every pair of it met many times over.)

A bucket's rows meet by joins and pre-aggregated minima on its band, which skew handling may split.
(Dealing them over salted keys was tried: it took a third more CPU time and more memory.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbsense.llm.components import components
from curbsense.llm.session import python_batches, staged
from curbsense.llm.wordhash import U64, Words, mix

BINS, BANDS, ROWS = 512, 42, 6
#: Attempts of a bin to borrow before it takes the next filled one.
ATTEMPTS = 1024
#: Most documents whose ids (8 bytes each) may be broadcast to select texts; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 500_000
#: Share of equal bins, less than the threshold, below which a pair is not confirmed: 5 standard errors of 512 bins.
SLACK = 0.09
#: Members of one bucket compared with one another in one task; larger buckets are cut into blocks.
BLOCK = 512


def _borrow_order() -> np.ndarray:
    """[bin, attempt] -> the bin to borrow from."""
    n = np.arange(BINS * ATTEMPTS, dtype=U64).reshape(BINS, ATTEMPTS)
    return (mix(n + U64(0x5851F42D4C957F2D)) >> U64(55)).astype(np.int64) % BINS


def signature(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The densified one-permutation MinHash of a sorted set of 64-bit hashes (not empty)."""
    bins = (shingles >> U64(55)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, filled = np.zeros(BINS, dtype=U64), np.zeros(BINS, dtype=bool)
    out[bins[first]] = mix(shingles[first])
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty) and attempt < ATTEMPTS:
        wide = order[empty, attempt : attempt + 16]
        hit = filled[wide]
        found = hit.any(axis=1)
        out[empty[found]] = out[wide[found, hit[found].argmax(axis=1)]]
        empty, attempt = empty[~found], attempt + 16
    if len(empty):
        known = np.flatnonzero(filled)
        out[empty] = out[known[np.searchsorted(known, empty) % len(known)]]
    return out


def _sketcher(shingle: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _borrow_order()
        salt = mix(np.arange(BANDS * ROWS, dtype=U64)).reshape(BANDS, ROWS) | U64(1)
        for batch in batches:
            sizes, digests, low, bands = [], [], [], []
            words = Words(batch.column("text"), lower=True)
            for d, s in enumerate(words.shingle_sets(shingle)):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    low.append(None)
                    bands.append(None)
                    continue
                # Two hashes or more are over 128 bits; a single shingle is known by its words.
                digests.append(hashlib.blake2b(s.tobytes() if len(s) > 1 else words.text(d), digest_size=16).digest())
                values = signature(s, order)
                low.append((values & U64(255)).astype(np.uint8).tobytes())
                bands.append(mix((values[: BANDS * ROWS].reshape(BANDS, ROWS) * salt).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "text_key", "n_shingles", "digest", "low", "bands"],
            )

    return sketch


def _alike(shingle: int, percent: int):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (Words(batch.column(c), lower=True).shingle_sets(shingle) for c in ("text_a", "text_b"))
            keep = []
            for x, y in zip(left, right, strict=True):
                union = len(np.unique(np.concatenate([x, y])))
                keep.append(union > 0 and 100 * (len(x) + len(y) - union) >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return alike


def _estimate(percent: int, slack: float):
    least = int(BINS * max(0.0, percent / 100 - slack))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("low_a", "low_b"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return estimate


def _estimated(nodes: DataFrame, pairs: DataFrame, percent: int, slack: float | None) -> DataFrame:
    """Of the pairs (a, b) those whose signatures leave room for a link; all of them where slack is None."""
    if slack is None:
        return pairs
    low = nodes.select("id", "low")
    near = pairs.join(low.select(F.col("id").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("low_b")), "b")
    return near.select("a", "b", "low_a", "low_b").mapInArrow(_estimate(percent, slack), "a long, b long")


def _confirmed(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are alike, as a staged table."""
    near = staged(pairs)
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct().join(nodes.select("id", "text_key"), "id")
    own = _of(texts, ids).select("id", "text")
    both = near.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return staged(both.select("a", "b", "text_a", "text_b").mapInArrow(_alike(shingle, percent), "a long, b long"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star(buckets: DataFrame, rank) -> DataFrame:
    """Pairs of every member with the first of its bucket by (rank, hash), one row each; not those in one component."""
    own = F.col("component") if "component" in buckets.columns else F.col("id")
    ranked = buckets.withColumns({"rank": rank, "own": own})
    centre = ranked.groupBy("band").agg(F.min(F.struct("rank", F.xxhash64("id").alias("h"), "id", "own")).alias("centre"))
    return ranked.join(centre, "band").where("centre.own <> own").select(*_pair("id", "centre.id")).distinct()


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (band, id, component) of buckets that hold several components, as a staged table."""
    placed = buckets.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band")
    return staged(placed.join(several, "band"))


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the nodes in ids (id, text_key), each once; the ids are broadcast only where they are few."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])


def _exploded(shingle: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in Words(batch.column("text"), lower=True).shingle_sets(shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return explode


def _within_bound(texts: DataFrame, nodes: DataFrame, mixed: DataFrame, shingle: int, percent: int, slack: float | None) -> DataFrame:
    """Pairs of one bucket and different components that neither the shared parts of their sets nor their signatures rule out.

    A bucket is compared in blocks of about BLOCK members, so no task holds more than two of them.
    """
    ids = mixed.select("id").distinct().join(nodes.select("id", "text_key"), "id")
    own = _of(texts, ids).select("id", "text").mapInArrow(_exploded(shingle), "id long, shingles array<long>")
    rows = own.select("id", F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")
    shared = rows.join(common, "s", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    able = shared.join(nodes.select("id", F.col("n_shingles").alias("n")), "id").where(f"100 * c >= {percent} * n")
    able = mixed.join(able, "id").join(nodes.select("id", "low", "bands"), "id")
    size = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    cut = mixed.groupBy("band").agg(size.alias("blocks"))
    able = able.join(cut, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    able = able.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    able = able.withColumn("task", F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")))
    return able.drop("blocks").groupBy("band", "task").applyInArrow(_compared(percent, slack), "a long, b long")


def _compared(percent: int, slack: float | None):
    least = 0 if slack is None else int(BINS * max(0.0, percent / 100 - slack))

    def compared(table: pa.Table) -> pa.Table:
        """Pairs of a task's two blocks (one, where they are the same) whose first common bucket is this one."""
        low = np.frombuffer(b"".join(table["low"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64).reshape(-1, BANDS)
        ids, part, c, n, block, band, other = (table[x].to_numpy() for x in ("id", "component", "c", "n", "block", "band", "other"))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(len(ids)):
            # Each pair once: within a block by id, across blocks from the lower block.
            near = (ids > ids[i]) if block[i] == other[i] else (block > block[i])
            shared = np.minimum(c, c[i])
            near &= (part != part[i]) & (100 * shared >= percent * (n + n[i] - shared))
            at = np.flatnonzero(near)
            at = at[(low[at] == low[i]).sum(axis=1) >= least]
            at = at[bands[i][(bands[at] == bands[i]).argmax(axis=1)] == band[0]]
            out.append((np.full(len(at), ids[i]), ids[at]))
        x, y = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return compared


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, slack: float | None = SLACK) -> DataFrame:
    """One row per row of df: its id, n_shingles, component_id and kept.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of
    `shingle`-word shingles (A-Z lower-cased; a shorter document has its whole word sequence as
    one shingle). component_id is the smallest id reachable over links, the own id included, and
    kept says that it is the own id.

    A null or empty text, or one of spaces, has an empty set: it links with nothing and is kept.
    A row without id is kept with a null component_id. Rows that repeat an id are one document.
    Texts of any length are compared whole. An empty table gives no rows; other columns of df are
    left out and may have any name.
    """
    spark = df.sparkSession
    python_batches(spark)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketches = staged(texts.mapInArrow(_sketcher(shingle), "id long, text_key long, n_shingles long, digest binary, low binary, bands array<long>"))
    # One node for each different set: the smallest id that has it.
    heads = sketches.where("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "text_key")).alias("head"))
    heads = staged(heads.select("digest", F.col("head.id").alias("id"), F.col("head.text_key").alias("text_key")))
    nodes = staged(sketches.drop("digest").join(heads.select("id", "text_key"), ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]))

    member = nodes.select("id", F.explode("bands").alias("band"))
    crowd = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = staged(member.join(crowd, "band"))
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    first = _star(buckets.join(degree, "id"), -F.col("degree"))
    links = _confirmed(texts, nodes, _estimated(nodes, first, percent, slack), shingle, percent)
    for last in (False, True):
        found = components(links)
        mixed = _mixed(buckets.select("band", "id"), found)
        if mixed.isEmpty():
            break
        pairs = _within_bound(texts, nodes, mixed, shingle, percent, slack) if last else _estimated(nodes, _star(mixed, F.lit(0)), percent, slack)
        more = _confirmed(texts, nodes, pairs, shingle, percent)
        if last and not more.isEmpty():
            found = components(links.unionByName(more))
        links = links.unionByName(more)

    heads = heads.select("digest", F.col("id").alias("head")).join(found.withColumnRenamed("node", "head"), "head", "left").select("digest", F.coalesce("component", "head").alias("component"))
    out = sketches.select("id", "n_shingles", "digest").join(heads, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, with its columns, of the documents that near_duplicates() keeps: one of each group, the smallest id.

    Null and empty texts, and rows without an id, stay; rows that repeat a kept id stay repeated. An
    empty table gives no rows; df's columns may have any name. Texts aren't moved where the ids that
    go are few enough to be broadcast.
    """
    gone = staged(near_duplicates(df, id_col, text_col, shingle, percent).where("not kept").select(F.col(id_col).alias("gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))
    return rows.join(gone, F.col(f"row.{id_col}").cast("long") == F.col("gone"), "left_anti").select("row.*")
