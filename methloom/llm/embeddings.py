"""Exact metric range join of embeddings by cosine, by pivots.

On unit vectors the angle is a metric and cosine >= c is an angle of at most eps. Each vector goes
to the cell of its nearest pivot; a cell has a radius, the largest angle to its pivot. A vector x has
partners in another cell q only if angle(x, q) <= radius(q) + eps (triangle inequality) and x is
within eps of the plane half way between the two pivots; only then x is copied there. Of two cells
one sends to the other, so a pair is met once. Cells are cut into chunks, and a chunk of
home vectors meets a chunk of home or copied ones as a unit of its own: no task holds more than two
chunks, however many vectors a cell has. A unit returns counts and one edge a linked vector (a local
union-find), never pairs. Equal vectors are one vector from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mixed, scratch, written

COSINE = 0.9
#: Slack in angles for arithmetic in doubles, so that bounds never exclude a partner.
SLACK = 1e-6


def unit(batch_column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column; all lists have one length and are finite and not zero."""
    x = np.asarray(batch_column.flatten(), dtype=np.float64).reshape(len(batch_column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(vectors: DataFrame, cosine: float = COSINE, chunk: int = 8192, pivots: tuple[int, int] = (8, 1024), seed: int = 1) -> DataFrame:
    """(gid, n, root) of the linked ones among distinct valid vectors (gid, embedding, copies) of one
    length: n rows (with their copies) linked in one unit, root the smallest gid linked there. There is
    a pivot for each ``chunk`` vectors, within the bounds given; they are chosen by a hash of gid and
    are the only vectors that the driver sees."""
    eps = math.acos(cosine) + SLACK
    n_pivots = int(min(pivots[1], max(pivots[0], vectors.count() // chunk)))
    chosen = vectors.orderBy(F.xxhash64("gid", F.lit(seed)), "gid").limit(n_pivots).select("embedding").toPandas()
    p = unit(pa.array(list(chosen["embedding"])))
    chord = np.maximum(np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)), 1e-9)
    reach = 2 * math.sin(min(eps, math.pi) / 2) + SLACK
    cells = np.arange(len(p))

    def place(b):
        """Cell and angles of each vector of a batch."""
        cos = np.clip(unit(b.column("embedding")) @ p.T, -1, 1)
        cell = cos.argmax(axis=1)
        return cell, cos, np.arccos(cos)

    def sent(cell, cos, angle, radius):
        """Which other cells each vector is copied to."""
        own = np.arange(len(cell))
        plane = (cos[own, cell][:, None] - cos) / chord[cell]
        turn = (cell[:, None] < cells) ^ ((cell[:, None] + cells) % 2 == 1)
        return turn & (cell[:, None] != cells) & (angle <= radius + eps) & (plane <= reach)

    def homes(batches):
        for b in batches:
            if b.num_rows:
                cell, _, angle = place(b)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], names=["cell", "angle"])

    def copies(batches):
        for b in batches:
            if b.num_rows:
                n = sent(*place(b), radius).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    by_cell = vectors.select("embedding").mapInArrow(homes, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).toPandas()
    radius, own_chunks, sent_chunks = np.full(len(p), -np.inf), np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    radius[by_cell["cell"]] = by_cell["r"]
    own_chunks[by_cell["cell"]] = -(-by_cell["n"].to_numpy() // chunk)
    by_sent = vectors.select("embedding").mapInArrow(copies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sent_chunks[by_sent["cell"]] = -(-by_sent["n"].to_numpy() // chunk)

    def deal(batches):
        """Each vector once for every unit: a cell's home chunk a with its home chunk or sent chunk b."""
        for b in batches:
            if not b.num_rows:
                continue
            cell, cos, angle = place(b)
            spread = mixed(np.asarray(b.column("gid"), dtype=np.int64).view(np.uint64)) >> np.uint64(1)
            out: list[tuple] = []

            def add(rows, q, low, high, right, out=out):
                shape = np.broadcast(rows, q, low, high, right).shape
                out.append(tuple(np.broadcast_to(x, shape).ravel() for x in (rows, q << 40 | low << 20 | high, right)))

            for q in np.unique(cell):
                rows = np.flatnonzero(cell == q)
                own = (spread[rows] % np.uint64(own_chunks[q])).astype(np.int64)
                for k in range(own_chunks[q]):
                    add(rows, q, np.minimum(own, k), np.maximum(own, k), own > k)
                for k in range(sent_chunks[q]):
                    add(rows, q, own, own_chunks[q] + k, False)
            goes = sent(cell, cos, angle, radius)
            for q in np.flatnonzero(goes.any(axis=0)):
                rows = np.flatnonzero(goes[:, q])
                at = (spread[rows] % np.uint64(sent_chunks[q])).astype(np.int64)
                for k in range(own_chunks[q]):
                    add(rows, q, k, own_chunks[q] + at, True)
            rows, units, right = (np.concatenate(x) for x in zip(*out, strict=True))
            for a in range(0, len(rows), 8192):
                take = pa.array(rows[a : a + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units[a : a + 8192]), pa.array(right[a : a + 8192]), *(b.column(c).take(take) for c in ("gid", "copies", "embedding"))],
                    names=["unit", "side", "gid", "copies", "embedding"],
                )

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        code = t.column("unit")[0].as_py()
        alone = (code >> 20 & 0xFFFFF) == (code & 0xFFFFF)
        gid, many, side = (np.asarray(t.column(c)) for c in ("gid", "copies", "side"))
        order = np.lexsort((gid, side))
        gid, many, side = gid[order], many[order], side[order]
        x = unit(t.column("embedding").combine_chunks())[order]
        x4 = x.astype(np.float32)
        n_left = len(x) if alone else int((~side).sum())
        base = 0 if alone else n_left
        n, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for a in range(0, n_left, 512):
            z = min(a + 512, n_left)
            near = x4[a:z] @ x4[base:].T >= np.float32(cosine - 1e-4)
            i, j = np.nonzero(near)
            i, j = i + a, j + base
            if alone:
                i, j = i[i < j], j[i < j]
            ok = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
            i, j = i[ok], j[ok]
            if len(i):
                n += np.bincount(i, many[j], len(x)).astype(np.int64) + np.bincount(j, many[i], len(x)).astype(np.int64)
                root = _roots(len(x), np.concatenate([i, np.arange(len(x))]), np.concatenate([j, root]))
        some = np.flatnonzero(n)
        low = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(low, root, gid)
        return pa.table({"gid": pa.array(gid[some]), "n": pa.array(n[some]), "root": pa.array(low[root[some]])})

    dealt = vectors.select("gid", "copies", "embedding").mapInArrow(deal, f"unit long, side boolean, gid long, copies long, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    return dealt.groupBy("unit").applyInArrow(meet, "gid long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **parameters) -> DataFrame:
    """One row a row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and
    are kept, as are rows without a vec_id (component null). Vectors of different lengths do not link.
    A cosine of exactly ``cosine`` links. Repeated rows are vectors of their own, linked as copies. Other columns (labels) are ignored; an
    empty table gives no rows."""
    rows = vectors.select("vec_id", "embedding").withColumn("gid", F.xxhash64("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    valid = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("gid", F.when(valid, F.col("gid")))
    distinct = written(rows.where("gid is not null").groupBy("gid", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low")))
    # A table of links grows by a job for each length that two vectors or more have (one length, as a rule).
    path, schema = scratch(vectors.sparkSession), "gid long, n long, root long"
    vectors.sparkSession.createDataFrame([], schema).write.parquet(path)
    for r in distinct.groupBy(F.size("embedding").alias("n")).count().where("count > 1").collect():
        links(distinct.where(F.size("embedding") == r["n"]), cosine, **parameters).write.mode("append").parquet(path)
    found = vectors.sparkSession.read.schema(schema).parquet(path)
    comps = components(found.select(F.col("gid").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("gid").agg(F.sum("n").alias("n"))
    named = distinct.select("gid", "low", "copies").join(comps.withColumnRenamed("node", "gid"), "gid", "left")
    named = named.withColumn("component", F.coalesce("component", "gid"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "component").join(counts, "gid", "left").select(
        "gid", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("vec_id", "gid").join(classes, "gid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
