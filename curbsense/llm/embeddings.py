"""Near-duplicate embeddings: cross-polytope hashing with multiprobe, and candidate pairs verified by cosine.

Equal vectors are one class, found by grouping. The vector of a class is padded to a power of two and
rotated by Hadamard transforms of three random sign flips each; a hash is the axis, with its sign, that
the rotated vector is nearest to. FUNCTIONS hashes name a bucket of a table. In each of TABLES tables a
class has its base bucket, and PROBES - 1 further ones that it would fall into if the least loss of
nearness were accepted. Two classes are candidates where one's base bucket is among the other's.

Only buckets that a base and another class share are built. Buckets are dealt into groups of about GROUP
rows, and a group compares its buckets by matrix products; a bucket of over BLOCK classes is cut into
blocks, and each two blocks are a task, so no task holds more than two blocks of a bucket. Pairs never leave a
task: it counts a pair's links only in the first bucket where the two meet, and emits a class's number
of links and one link to the least class that it can reach inside the task. Components follow from these.

At a cosine of 0.95 a pair of 64 dimensions is missed about once in 1,000 times; recall is measured in the
tests. Comparing a family of classes that are all alike takes time (not rows) with the square of the family.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from curbsense.llm.components import components
from curbsense.llm.session import python_batches, staged

TABLES, FUNCTIONS, PROBES = 6, 3, 6
#: Axes of one hash that probes choose among.
AXES = 3
#: Classes of a bucket in a block, rows of a group, and pairs that are looked at together.
BLOCK, GROUP, PAIRS = 2048, 16384, 1 << 16
#: Bucket sizes up to which the buckets of one size are compared in one product.
SMALL = 48
#: Bits of a bucket's number below the table's.
TABLE_BITS = 56


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the last axis, whose length is a power of two; not normalised."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


def buckets(vectors: np.ndarray) -> np.ndarray:
    """[vector, table, probe] -> bucket; the first probe is the base. Vectors are rows of one length."""
    n, dim = vectors.shape
    wide = 1 << max(1, (dim - 1).bit_length())
    unit = np.zeros((n, wide))
    unit[:, :dim] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    axes = min(AXES, wide)
    combos = np.array(list(itertools.product(range(axes), repeat=FUNCTIONS)))
    out = np.empty((n, TABLES, PROBES), dtype=np.int64)
    for t in range(TABLES):
        loss, code = np.zeros((n, len(combos))), np.zeros((n, len(combos)), dtype=np.int64)
        for k in range(FUNCTIONS):
            signs = np.random.default_rng((wide, t, k)).choice([-1.0, 1.0], (3, wide))
            y = unit
            for s in signs:
                y = hadamard(y * s) / math.sqrt(wide)
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, :axes]
            size = np.take_along_axis(size, near, 1)
            loss += ((size[:, :1] - size) ** 2)[:, combos[:, k]]
            code = code * (2 * wide) + (2 * near + (np.take_along_axis(y, near, 1) < 0))[:, combos[:, k]]
        # The base has no loss and stays first, as equal losses keep their order.
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        out[:, t] = np.take_along_axis(code, best, 1) + (t << TABLE_BITS)
    return out


def _hashed(kind: str):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            dims = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy()
            cuts = np.concatenate([[0], np.cumsum(dims)])
            codes = np.empty((len(dims), TABLES * PROBES), dtype=np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes[at] = buckets(values[cuts[at][:, None] + np.arange(dim)].astype(np.float64)).reshape(len(at), -1)
            vectors = [values[a:b].astype(kind).tobytes() for a, b in itertools.pairwise(cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("weight"), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], names=["id", "weight", "dim", "vec", "codes"]
            )

    return hashed


def _pairs(table: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of one task, of cosine >= least, one of them with its base bucket there; rows are sorted by task.

    Within a block rows of smaller place come first; across blocks x is of the lower one.
    """
    task, base, block, vec = table["task"], table["base"], table["block"], table["vec"]
    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    sizes = np.diff(np.append(starts, len(task)))

    def told(x: np.ndarray, y: np.ndarray, cosine: np.ndarray):
        fit = (cosine >= least) & (base[x] | base[y])
        # A task of two blocks compares only across them; one of a single block has the same block throughout.
        fit &= (block[x] != block[y]) | (table["alone"][x])
        return x[fit], y[fit]

    for m in np.unique(sizes):
        if m < 2:
            continue
        of_size = starts[sizes == m]
        if m <= SMALL:
            i, j = np.triu_indices(m, 1)
            for part in range(0, len(of_size), max(1, PAIRS // (m * m))):
                at = of_size[part : part + max(1, PAIRS // (m * m))][:, None] + np.arange(m)
                own = vec[at]
                cosine = np.matmul(own, own.transpose(0, 2, 1))[:, i, j]
                yield told(at[:, i].ravel(), at[:, j].ravel(), cosine.ravel())
        else:
            for start in of_size:
                step = max(1, PAIRS * 4 // m)
                for a in range(start, start + m, step):
                    x, y = np.nonzero(vec[a : min(a + step, start + m)] @ vec[a : start + m].T >= least)
                    x, y = x[x < y], y[x < y]
                    for cut in range(0, len(x), PAIRS):
                        u, v = x[cut : cut + PAIRS] + a, y[cut : cut + PAIRS] + a
                        yield told(u, v, np.ones(len(u)))


def _first_meeting(codes: np.ndarray, bucket: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs that meet in bucket[x], whether it is the first place where they do: by table, then the base of the smaller id."""
    swap = ids[x] > ids[y]
    a, b = codes[np.where(swap, y, x)], codes[np.where(swap, x, y)]
    table = (bucket[x] >> TABLE_BITS).astype(np.int64)
    meets = np.stack([(b == a[:, :, :1]).any(axis=2), (a == b[:, :, :1]).any(axis=2)], axis=2).reshape(len(x), 2 * TABLES)
    here = 2 * table + (a[np.arange(len(x)), table, 0] != bucket[x])
    return meets.argmax(axis=1) == here


def _least_reached(n: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For n nodes and edges between them, the smallest id that each can reach."""
    label = ids.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        # A node takes on what its label's node has reached.
        label = np.minimum(label, label[np.searchsorted(ids, label)])
        if (label == before).all():
            return label


def _compared(least: float, kind: str):
    def compared(rows: pa.Table) -> pa.Table:
        """Rows (id, n, reached): links of classes counted in this group, and the least class that each reaches in it."""
        order = np.lexsort((rows["id"].to_numpy(), rows["block"].to_numpy(), *(rows[c].to_numpy() for c in ("high", "low", "bucket", "dim"))))
        # Rows that share a bucket have one dimension; groups of several are handled one after another.
        get = lambda c: rows[c].to_numpy()[order]
        ids, weight, dims, bucket, low, high, block = (get(c) for c in ("id", "weight", "dim", "bucket", "low", "high", "block"))
        base = rows["base"].to_numpy(zero_copy_only=False)[order]
        raw = rows["vec"].take(pa.array(order))
        codes = rows["codes"].combine_chunks().flatten().to_numpy().reshape(len(order), TABLES, PROBES)[order]
        nodes, node = np.unique(ids, return_inverse=True)
        count, edges = np.zeros(len(nodes), dtype=np.int64), []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            vec = np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), dtype=kind).reshape(len(at), dim).astype(np.float64)
            vec /= np.linalg.norm(vec, axis=1)[:, None]
            new = (np.diff(bucket[at]) != 0) | (np.diff(low[at]) != 0) | (np.diff(high[at]) != 0)
            table = {"task": np.concatenate([[0], np.cumsum(new)]), "base": base[at], "block": block[at], "alone": low[at] == high[at], "vec": vec}
            for x, y in _pairs(table, least):
                if not len(x):
                    continue
                x, y = at[x], at[y]
                first = _first_meeting(codes, bucket, ids, x, y)
                x, y = x[first], y[first]
                np.add.at(count, node[x], weight[y])
                np.add.at(count, node[y], weight[x])
                edges.append((node[x], node[y]))
        x, y = (np.concatenate(z) for z in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
        reached = _least_reached(len(nodes), x, y, nodes)
        some = count > 0
        return pa.table({"id": nodes[some], "n": count[some], "reached": reached[some]})

    return compared


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no component null or not finite, and not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of df: its id, n_links, component_id and kept.

    Vectors of one length are linked where a candidate pair's cosine, in double precision, is >= least.
    n_links counts the other vectors that are linked directly, component_id is the smallest id
    reachable over links, the own id included, and kept says that it is the own id.

    A vector that is null, empty or zero, or has null or non-finite components, links with nothing, and
    so does a row without id, whose component_id is null; both are kept. Vectors of different lengths
    don't link. Rows that repeat an id are one vector, the least of those that are usable. Equal vectors link;
    however many there are, they are compared once. An empty table gives no rows; other columns of df
    are left out and may have any name.
    """
    python_batches(df.sparkSession)
    kind = "f4" if isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>").alias("vec"))
    one = rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).groupBy("id").agg(F.min("vec").alias("vec"))
    one = staged(one.withColumn("digest", F.unhex(F.sha2(F.array_join(F.col("vec").cast("array<string>"), ","), 256))))
    classes = staged(one.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    coded = one.drop("digest").join(classes.drop("digest"), "id").select("id", "weight", "vec")
    coded = staged(coded.mapInArrow(_hashed(kind), "id long, weight long, dim int, vec binary, codes array<long>"))

    member = coded.select("id", "dim", F.posexplode("codes").alias("at", "bucket")).select("id", "dim", "bucket", (F.col("at") % PROBES == 0).alias("base"))
    size = member.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("size"), F.max("base").alias("some_base")).where("size > 1 and some_base")
    size = size.select("dim", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = member.join(size, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = staged(placed.select("id", "dim", "bucket", "base", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    groups = max(1, math.ceil(placed.count() / GROUP))
    tasks = placed.join(coded, ["id", "dim"]).withColumn("group", F.pmod(F.xxhash64("dim", "bucket", "low", "high"), F.lit(groups)))
    found = staged(tasks.groupBy("group").applyInArrow(_compared(least, kind), "id long, n long, reached long"))
    reach = components(found.select(F.col("id").alias("a"), F.col("reached").alias("b")))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))

    classes = classes.join(links, "id", "left").join(reach.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    known = one.select("id", "digest").join(classes, "digest").drop("digest")
    out = rows.select("id").join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
