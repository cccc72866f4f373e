"""Embedding near-duplicates: spherical k-means cells, blocked cosines inside cells.

Vectors with equal labels are linked when their cosine reaches a threshold. Equal vectors
are compared once, with their number. Centroids are fitted on a bounded sample; every vector
is placed: it owns the cell of its nearest centroid and is a guest in each cell whose
boundary is nearer than ``slack``. A unit vector within the threshold's angle of another lies
within sin(angle) of every boundary between them, so with that slack (the default) each owner
meets all its neighbours in its own cell and no link is lost; a smaller slack keeps fewer
guests and may lose links near boundaries. Cells are cut into blocks; a task compares one
block of owners with one block of members, so a crowded cell becomes many tasks of the same
size. A block returns sums per owner and a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import components, stored

THRESHOLD = 0.98
SAMPLE = 16_384  # vectors the centroids are fitted on, at most twice as many
CELL = 2_048  # vectors per cell that the number of cells aims at
MOST_CELLS = 1_024  # 16 sample vectors each
BLOCK = 1_024
SALTS = 16


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means on the rows of ``x``; at most k of them."""
    if k <= 1 or len(x) <= k:
        return x[:1]
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def placed(centroids: dict, slack: float):
    """Rows (label, dim, cell, uid, of, embedding, owner): owners once, guests where near."""
    def run(batches):
        apart = {d: np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) for d, c in centroids.items()}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for first in range(0, part.num_rows, 2048):
                    some = part.slice(first, 2048)
                    x, c = unit_rows(some.column(4), int(dim)), centroids[int(dim)]
                    dots = x @ c.T
                    own = dots.argmax(axis=1)
                    inside = dots.max(axis=1)[:, None] - dots <= slack * apart[int(dim)][own] + 1e-9
                    inside[np.arange(len(x)), own] = True
                    row, cell = np.nonzero(inside)
                    rows = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell.astype(np.int64)), rows.column(2), rows.column(3), rows.column(4), pa.array(own[row] == cell)],
                                                     ["label", "dim", "cell", "uid", "of", "embedding", "owner"])
    return run


def block_links(threshold: float):
    """Links of one block of owners with one block of members."""
    def run(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        role = group["owner"].to_numpy(zero_copy_only=False)
        x, node, n = unit_rows(group["embedding"], dim), group["node"].to_numpy(), group["n"].to_numpy()
        uid = group["uid"].to_numpy()
        a, b = np.flatnonzero(role), np.flatnonzero(~role)
        near = x[a] @ x[b].T >= threshold
        near &= uid[a][:, None] != uid[b][None, :]
        links = near @ n[b] if len(b) else np.zeros(len(a), dtype=np.int64)
        hit, met = near.any(axis=1), near.any(axis=0)
        low_a, low_b = node[a].copy(), node[b].copy()
        far = np.iinfo(np.int64).max
        while hit.any():  # smallest node over the links of the block
            new_a = np.minimum(low_a, np.where(near, low_b[None, :], far).min(axis=1))
            new_b = np.minimum(low_b, np.where(near, new_a[:, None], far).min(axis=0))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        u = np.concatenate([node[a][hit], node[b][met]])
        v = np.concatenate([low_a[hit], low_b[met]])
        return pa.table({
            "uid": pa.array(np.concatenate([uid[a][hit], np.zeros(len(u), dtype=np.int64)])),
            "links": pa.array(np.concatenate([links[hit].astype(np.int64), np.zeros(len(u), dtype=np.int64)])),
            "u": pa.array(np.concatenate([np.zeros(int(hit.sum()), dtype=np.int64), u]), mask=np.arange(int(hit.sum()) + len(u)) < hit.sum()),
            "v": pa.array(np.concatenate([np.zeros(int(hit.sum()), dtype=np.int64), v]), mask=np.arange(int(hit.sum()) + len(u)) < hit.sum())})
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                 threshold: float = THRESHOLD, slack: float | None = None, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id and kept.

    n_links counts the other rows linked directly, component_id is the smallest id reachable
    and kept marks the rows whose id that is. Vectors that are null, empty or zero, or hold
    null or non-finite numbers, and rows with a null label or id, have no links and are kept;
    their component is their own id. Vectors of different lengths are never compared. Rows
    that repeat an id are vectors of their own that share a component. An empty table gives
    no rows. Ids are whole numbers.
    """
    slack = math.sin(math.acos(threshold)) if slack is None else slack
    e = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{label_col}`").cast("string") if label_col else F.lit("")).alias("label"), e.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    valid = valid.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = valid.groupBy("label", "embedding", "salt").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    whole = part.groupBy("label", "embedding").agg(F.min("node").alias("node"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    whole = stored(whole.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    back = whole.select("label", "embedding", "node", "n", "uid", F.explode("salts").alias("salt"))
    named = stored(valid.join(back, ["label", "embedding", "salt"]).select("id", "node", "n", "uid"), "named")

    centroids = {}
    for r in whole.groupBy("dim").agg(F.count("*").alias("k")).collect():
        share = min(1.0, sample / r["k"])
        some = whole.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("uid"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1)).select("embedding").limit(2 * sample)
        x = unit_rows(some.toArrow()["embedding"], r["dim"])
        centroids[r["dim"]] = fit_cells(x, min(MOST_CELLS, max(1, r["k"] // cell), max(1, len(x) // 16)))
    cells = whole.select("label", F.col("dim").cast("long").alias("dim"), "node", "n", "embedding", "uid")
    spots = cells.select("label", "dim", "uid", F.struct("node", "n").alias("of"), "embedding").mapInArrow(
        placed(centroids, slack), "label string, dim long, cell long, uid long, of struct<node:long,n:long>, embedding array<double>, owner boolean")
    spots = stored(spots.select("label", "dim", "cell", "uid", "of.node", "of.n", "embedding", "owner"), "cells")
    sizes = spots.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("owner") / block).alias("ka"), F.ceil(F.count("*") / block).alias("kb"))
    dealt = spots.join(stored(sizes, "sizes").hint("merge"), ["label", "dim", "cell"]).where("ka > 0")
    spot = F.pmod(F.xxhash64("uid"), F.lit(1 << 30))
    mine = dealt.where("owner").withColumn("a", spot % F.col("ka")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kb") - 1)))
    theirs = dealt.withColumn("owner", F.lit(False)).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ka") - 1))).withColumn("b", spot % F.col("kb"))
    blocks = mine.unionByName(theirs).drop("ka", "kb")
    found = stored(blocks.groupBy("label", "dim", "cell", "a", "b").applyInArrow(block_links(threshold), "uid long, links long, u long, v long"), "links")
    sums = found.where("u IS NULL").groupBy("uid").agg(F.sum("links").alias("links"))
    groups = components(found.where("u IS NOT NULL").select("u", "v")).select("node", "component")
    links = named.join(stored(sums, "sums").hint("merge"), "uid", "left").join(stored(groups, "groups").hint("merge"), "node", "left")
    links = links.select("id", "uid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    own = rows.withColumn("valid", F.col("id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rest = own.where(~F.col("valid")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = links.select("id", "n_links", "component").unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
