"""Embedding near-duplicates: an exact range join in a metric space, by pivots.

Cosine >= c between vectors is distance <= r = sqrt(2 - 2 c) between their unit vectors. A bounded sample gives the
pivots; a vector's home is the cell of its nearest pivot. If x (home i) and y (home j) are within r, the triangle
inequality gives d(x, p_j) <= d(x, p_i) + 2 r, and the plane between the pivots, which a link between the cells must
cross, d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j). A vector is copied to a later cell only if both hold. So every
pair meets in the cell of the later home, and cells join independently. Cells of vectors without any clusters copy
nearly all; the sample shows that, and few pivots are taken then. Crowded cells are dealt in blocks, so a task
holds two blocks at most. Equal vectors of a label are one point with a weight. Cells return the number of links of
each point and a spanning set of its links, never all pairs."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs
from ._common import arrow_map, cut, dealt_anew, ship, shuffle_parts

#: Rows that pivots are chosen from, those with the smallest hashes, and the most pivots: both are fixed bounds.
#: There are as many pivots, two at least, as make the fewest comparisons over the sample: more cells copy more.
SAMPLE, PIVOTS, BLOCK = 4096, 256, 4096
SLACK = 1e-9


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, key, unit vector); key and vector are null where nothing can be linked."""
    for batch in batches:
        keys, units = [], []
        labels = batch.column(2)
        flat, at = batch.column(1), batch.column(1).offsets.to_numpy()
        values = flat.values.cast(pa.float64())
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values.to_numpy(zero_copy_only=False)))))
        values = np.nan_to_num(values.to_numpy(zero_copy_only=False))
        for k, fine in enumerate((flat.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)).tolist()):
            v = values[at[k] : at[k + 1]]
            top = np.abs(v).max(initial=0.0)
            if not fine or not top or bad[at[k + 1]] > bad[at[k]]:
                keys.append(None), units.append(None)
                continue
            v = v / top + 0.0
            units.append(v / np.sqrt(v @ v))
            keys.append(xxhash.xxh3_128_digest((values[at[k] : at[k + 1]] + 0.0).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "key", "unit"])


def copies(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and the later cells that need a copy of it."""
    d2 = np.maximum(2 - 2 * x @ p.T, 0)
    own = d2.argmin(axis=1)
    least = np.sqrt(d2.min(axis=1))[:, None]
    between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
    near = (np.sqrt(d2) <= least + 2 * radius + SLACK) & (d2 - least**2 <= 2 * radius * between[own] + SLACK)
    return own, near & (np.arange(len(p)) > own[:, None])


def choose_pivots(sample: np.ndarray, radius: float) -> np.ndarray:
    """Farthest first, so that the cells follow the data."""
    if not len(sample):
        return sample
    chosen = [0]
    near = np.full(len(sample), np.inf)
    while len(chosen) < min(PIVOTS, len(sample)):
        near = np.minimum(near, 2 - 2 * sample @ sample[chosen[-1]])
        k = int(near.argmax())
        if near[k] <= 1e-12:
            break
        chosen.append(k)
    best, least = chosen, np.inf
    while len(chosen) > 1:
        own, near = copies(sample, sample[chosen], radius)
        cost = float(((np.bincount(own, minlength=len(chosen)) + near.sum(axis=0)).astype(float) ** 2).sum())
        if cost < least:
            best, least = chosen, cost
        chosen = chosen[: len(chosen) // 2]
    return sample[best]


def _deal(pivots: dict[int, np.ndarray], radius: float):
    """(label, cell, pid, weight, home, unit), the home row and its copies in later cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).offsets.to_numpy()
            size = np.diff(at)
            values = batch.column(2).values.to_numpy()
            src, cell, home = [], [], []
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                x = values[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                p = pivots.get(dim)
                if p is None or not len(p):
                    src.append(rows), cell.append(np.zeros(len(rows), int)), home.append(np.ones(len(rows), bool))
                    continue
                own, near = copies(x, p, radius)
                k, j = np.nonzero(near)
                src += [rows, rows[k]]
                cell += [own, j]
                home += [np.ones(len(rows), bool), np.zeros(len(k), bool)]
            src, cell, home = np.concatenate(src or [[]]).astype(np.int64), np.concatenate(cell or [[]]), np.concatenate(home or [[]])
            pick = pa.array(src)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), pa.array(cell.astype(np.int32)), batch.column(1).take(pick), batch.column(3).take(pick), pa.array(home.astype(bool)), batch.column(2).take(pick)], names=["label", "cell", "pid", "weight", "home", "unit"])

    return run


def _join(least: float):
    """One pair of blocks of a cell: for each point its links here, and one earlier point of its group of links."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(key[2]), int(key[3])
        out = []
        for dim, part in pdf.groupby(pdf.unit.map(len)):
            unit, pid, weight, home, block = (np.stack(part.unit.to_numpy()), part.pid.to_numpy(), part.weight.to_numpy(), part.home.to_numpy(), part.block.to_numpy())
            links = np.zeros(len(pid), np.int64)
            group = np.arange(len(pid))
            x, y = np.flatnonzero(block == bx), np.flatnonzero(block == by)
            for lo in range(0, len(x), 256):
                rows = x[lo : lo + 256]
                a = unit[rows]
                near = a @ unit[y].T >= least
                near &= home[rows][:, None] | home[y][None, :]
                near &= rows[:, None] < y[None, :] if bx == by else True
                links[rows] += near @ weight[y]
                links[y] += weight[rows] @ near
                for r, hit in zip(rows.tolist(), near):
                    if hit.any():
                        old = np.unique(np.append(group[y[hit]], group[r]))
                        if len(old) > 1:
                            group[np.isin(group, old)] = old[0]
            some = (links > 0) | (group != np.arange(len(pid)))
            out.append(pd.DataFrame({"pid": pid[some], "links": links[some], "to": pid[group[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "links": [], "to": []})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, the id under its own name.

    Rows link if their labels are equal and not null, their vectors are of one length and their cosine, in double
    precision, is at least `least`. Null or zero vectors and those with null or non-finite components link with
    nothing, as do rows without an id; such a row is its own component and kept. Repeated rows are linked copies; rows
    with one id and different vectors have their own links. Further columns are ignored."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    slim = slim.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    rows = cut(arrow_map(slim, _points, "vec_id long, label string, key binary, unit array<double>"))
    fine = rows.where("key is not null")
    points = fine.groupBy("label", "key").agg(F.min(F.struct("vec_id", "unit")).alias("p"), F.count("*").alias("weight"))
    points = points.select("label", "key", F.col("p.vec_id").alias("least_id"), F.col("p.unit").alias("unit"), "weight")
    points = cut(points.withColumn("pid", F.monotonically_increasing_id()))
    sample = points.select("unit", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE).collect()
    radius = float(np.sqrt(2 - 2 * least))
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.unit), []).append(r.unit)
    pivots = {k: choose_pivots(np.array(v), radius) for k, v in by_dim.items()}
    dealt = cut(arrow_map(points.select("label", "pid", "unit", "weight"), _deal(pivots, radius), "label string, cell int, pid long, weight long, home boolean, unit array<double>"))
    sizes = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("bx"), F.greatest(b, "block").alias("by"))))
    dealt = dealt.withColumn("u", unit).select("label", "cell", "u.bx", "u.by", "pid", "weight", "home", "block", "unit")
    ship(spark)
    dealt = dealt.repartition(shuffle_parts(spark), "label", "cell", "bx", "by")
    found = cut(dealt.groupBy("label", "cell", "bx", "by").applyInPandas(_join(least), "pid long, links long, to long"))
    counts = found.groupBy("pid").agg(F.sum("links").alias("links"))
    comps = graphs.components(found.select(F.col("pid").alias("u"), F.col("to").alias("v")))
    points = points.select("label", "key", "least_id", "pid", "weight").join(counts, "pid", "left").join(comps.withColumnRenamed("node", "pid"), "pid", "left")
    points = points.select("label", "key", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "pid").alias("root"))
    points = cut(points)
    names = points.groupBy("root").agg(F.min("least_id").alias("component_id"))
    points = points.join(dealt_anew(names, "root"), "root").select("label", "key", "n_links", "component_id")
    linked = fine.join(points, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
