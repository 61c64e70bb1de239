"""Average linkage of any number of vectors, the same as in one matrix of distances.

The distance of two clusters is 1 minus the product of their means, so a cluster is a mean and a
size. Equal vectors are one row. Rows that no chain of distances below the threshold joins never
meet: each connected part is linked in a task of its own. Parts of more than `limit` rows go
through rounds first: clusters that are each other's nearest are merged, since for this linkage
nothing else can come between them, and those with nothing below the threshold are done. Pairs
are compared in chunks by matrix products in different tasks; what leaves a task is a spanning
forest, or each row's nearest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import blocks, graph

#: Rows of a side that one task holds, and rows of those that are compared at once.
SIDE, STRIP = 8192, 256
#: Clusters of which one task holds all distances.
HELD = 2048
#: Added to the threshold where parts are sought: rounding must not part them.
SLACK = 1e-9


def average_linkage(x: np.ndarray, threshold: float, size: np.ndarray | None = None) -> np.ndarray:
    """Labels of average-linkage clusters by cosine distance, merged while it is below the threshold.

    Follows chains of nearest neighbours: for this linkage, two clusters that are each other's
    nearest may be merged at once, whatever else is left to merge. Rows may be means of `size` vectors.
    Distances come from the clusters' means; only of up to HELD clusters all are held, so memory grows with the rows.
    More are first merged many pairs at a time, while that takes a tenth of them off."""
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    mean, size = np.array(x, np.float64), np.ones(n) if size is None else size.astype(np.float64)
    names, up = np.arange(n), np.arange(n)
    before = np.inf
    while HELD < len(mean) < 0.9 * before:
        before = len(mean)
        to, near = nearest(mean)[:2]
        a = np.flatnonzero((to[to] == np.arange(before)) & (np.arange(before) < to) & (near < threshold))
        b = to[a]
        mean[a] = (size[a, None] * mean[a] + size[b, None] * mean[b]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        up[names[b]] = names[a]
        on = near < threshold
        on[b] = False
        mean, size, names = mean[on], size[on], names[on]
    left, alive = len(mean), np.ones(len(mean), bool)
    d = None
    chain: list[int] = []
    far: list[float] = []  # from each of the chain to the one before, as it was found: it falls, so chains end whatever the rounding
    while left > 1:
        if d is None and (left <= HELD or 2 * left < len(mean)):
            chain = (np.cumsum(alive) - 1)[chain].tolist()
            mean, size, names, alive = mean[alive], size[alive], names[alive], np.ones(left, bool)
            if left <= HELD:
                d = mean @ mean.T
                np.subtract(1, d, out=d)
        if not chain:
            chain.append(int(np.argmax(alive)))
            far.append(np.inf)
        a = chain[-1]
        row = np.where(alive, 1 - mean @ mean[a] if d is None else d[a], np.inf)
        row[a] = np.inf
        b = int(np.argmin(row))
        near = row[b]
        if len(chain) > 1 and far[-1] <= near:
            b, near = chain[-2], far[-1]
        if not near < threshold:  # nothing closer: the whole chain is as good as done
            alive[a] = False
            left -= 1
            chain.pop()
            far.pop()
            continue
        if len(chain) > 1 and b == chain[-2]:
            del chain[-2:], far[-2:]
            keep, gone = min(a, b), max(a, b)
            if d is None:
                mean[keep] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            else:
                d[keep, :] = d[:, keep] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            size[keep] += size[gone]
            alive[gone] = False
            up[names[gone]] = names[keep]
            left -= 1
        else:
            chain.append(b)
            far.append(near)
    for k in range(n):
        while up[k] != up[up[k]]:
            up[k] = up[up[k]]
    return np.unique(up, return_inverse=True)[1]


def forest(x: np.ndarray, y: np.ndarray, below: float) -> tuple[list[int], list[int]]:
    """Links of x's rows with y's, as two lists of row numbers: as many as join all that pairs below a distance join."""
    part = np.arange(len(x) + len(y))
    a: list[int] = []
    b: list[int] = []
    for at in range(0, len(x), STRIP):
        near = x[at : at + STRIP] @ y.T > 1 - below
        for i, row in enumerate(near, at):
            cols = np.flatnonzero(row)
            cols = cols[part[len(x) + cols] != part[i]]
            if len(cols):
                names, first = np.unique(part[len(x) + cols], return_index=True)
                a += [i] * len(first)
                b += cols[first].tolist()
                part[np.isin(part, names)] = part[i]
    return a, b


def nearest(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest row of the other side and its distance, for x and for y; without y, within x.

    Every distance is computed once and counts for both of its rows; of equal ones the first row wins."""
    same = y is None
    y = x if same else y
    to_y, dx = np.zeros(len(x), int), np.full(len(x), np.inf)
    to_x, dy = (to_y, dx) if same else (np.zeros(len(y), int), np.full(len(y), np.inf))

    def better(to, best, rows, found, d):
        now = (d < best[rows]) | (d == best[rows]) & (found < to[rows])
        to[rows[now]], best[rows[now]] = found[now], d[now]

    for at in range(0, len(x), STRIP):
        low = at if same else 0
        d = x[at : at + STRIP] @ y[low:].T
        np.subtract(1, d, out=d)
        if same:
            k = len(d)
            d[:, :k] = np.minimum(d[:, :k], d[:, :k].T)
            np.fill_diagonal(d, np.inf)
        for side, to, best, rows, start in ((1, to_y, dx, at + np.arange(d.shape[0]), low), (0, to_x, dy, low + np.arange(d.shape[1]), at)):
            found = np.argmin(d, axis=side)
            better(to, best, rows, found + start, np.take_along_axis(d, np.expand_dims(found, side), side).ravel())
    return to_y, dx, to_x, dy


def _parts(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (event, id, x, n) with `part`: the smallest id reachable over distances below the threshold."""

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = forest(blocks.matrix(left.column("x")), blocks.matrix(right.column("x")), threshold + SLACK)
        event = left.column("event").combine_chunks()
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        return pa.table({"event": event.take(a), "a": left.column("id").take(a), "b": right.column("id").take(b)})

    links = blocks.within(rows.select("event", "id", "x"), ["event"], "id", run, "event string, a string, b string", size=SIDE)
    node = lambda c: F.concat(F.col("event"), F.lit("|"), F.col(c)).alias(c)
    found = graph.components(links.select(node("a"), node("b")))
    named = rows.withColumn("node", F.concat("event", F.lit("|"), "id")).join(found, "node", "left")
    return named.select("event", F.coalesce(F.expr("substring(component, length(event) + 2)"), "id").alias("part"), "id", "x", "n")


def _round(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Clusters that are left of rows (event, part, id, x, n), and (event, gone, kept) of those merged."""

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        left, right = (t.sort_by("id") for t in (left, right))
        x = blocks.matrix(left.column("x"))
        to_y, dx, to_x, dy = nearest(x) if same else nearest(x, blocks.matrix(right.column("x")))
        told = []
        for one, other, to, d in ((left, right, to_y, dx), (right, left, to_x, dy))[: 1 if same else 2]:
            low = pa.array(d < threshold)
            told.append(pa.table({"event": one.column("event"), "id": one.column("id"), "other": other.column("id").take(pa.array(to)), "d": pa.array(d)}).filter(low))
        return pa.concat_tables(told)

    found = blocks.within(rows.select("event", "part", "id", "x"), ["event", "part"], "id", run, "event string, id string, other string, d double", size=SIDE)
    best = cut(found.groupBy("event", "id").agg(F.min(F.struct("d", "other")).alias("b")).select("event", "id", "b.other"))
    back = best.select("event", F.col("other").alias("id"), F.col("id").alias("other"))
    pairs = cut(best.join(back, ["event", "id", "other"]).where("id < other").select("event", F.col("other").alias("gone"), F.col("id").alias("kept")))
    left = rows.join(best.select("event", "id"), ["event", "id"], "left_semi").join(pairs.select("event", F.col("gone").alias("id")), ["event", "id"], "left_anti")
    added = pairs.join(rows.select("event", F.col("id").alias("gone"), F.col("x").alias("y"), F.col("n").alias("k")), ["event", "gone"]).select("event", F.col("kept").alias("id"), "y", "k")
    mean = F.zip_with("x", "y", lambda x, y: (x * F.col("n") + y * F.col("k")) / (F.col("n") + F.col("k")))
    merged = left.join(added, ["event", "id"], "left").select("event", "part", "id", F.when(F.col("k").isNull(), F.col("x")).otherwise(mean).alias("x"), (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"))
    return cut(merged), pairs


def linked(faces: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(event, face_id, label) of faces (event, face_id, x), both names strings: a cluster's label is its smallest face_id."""
    vectors = faces.select("event", "face_id", F.col("x").cast("array<double>").alias("x"))
    rows = cut(vectors.groupBy("event", "x").agg(F.min("face_id").alias("id"), F.count("*").alias("n")))
    names = vectors.join(rows.select("event", "x", "id"), ["event", "x"]).select("event", "face_id", "id")
    rows = cut(_parts(rows, threshold))
    while True:
        sizes = rows.groupBy("event", "part").agg(F.count("*").alias("rows"))
        large = cut(sizes.where(F.col("rows") > limit).select("event", "part"))
        if large.isEmpty():
            break
        left, pairs = _round(rows.join(large, ["event", "part"], "left_semi"), threshold)
        names = cut(names.join(pairs.withColumnRenamed("gone", "id"), ["event", "id"], "left").select("event", "face_id", F.coalesce("kept", "id").alias("id")))
        rows = cut(rows.join(large, ["event", "part"], "left_anti").select(*left.columns).unionByName(left))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        labels = average_linkage(blocks.matrix(table.column("x")), threshold, table.column("n").to_numpy())
        first, at = np.unique(labels, return_index=True)
        return pa.table({"event": table.column("event"), "id": table.column("id"), "label": table.column("id").take(pa.array(at[np.searchsorted(first, labels)]))})

    several = rows.join(sizes.where("rows > 1").select("event", "part"), ["event", "part"], "left_semi")
    labels = several.groupBy("event", "part").applyInArrow(run, "event string, id string, label string")
    return names.join(labels, ["event", "id"], "left").select("event", "face_id", F.coalesce("label", "id").alias("label"))
