"""Searching faces and persons, and near-equal picture hashes.

Vectors are compared chunk by chunk with matrix products; each chunk leaves the best few of each
query, so what is merged in the end is bounded by chunks, not by faces or persons."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import across, matrix


def _best(queries: DataFrame, targets: DataFrame, key: str, n: int, extra: str | None = None) -> DataFrame:
    """(q, d, key): the n nearest targets (key, x) of each query (q, qx) in every chunk of targets; ties by key.

    With `extra`, a target column, a query's own target (extra = q) is left out."""
    kind, q_kind = targets.schema[key].dataType.simpleString(), queries.schema["q"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "d": [], key: []}
        if left.num_rows and right.num_rows:
            order = right.column(key).combine_chunks()
            names = order.to_pylist()
            by_name = np.array(sorted(range(len(names)), key=lambda k: names[k]))
            x = matrix(right.column("x"))[by_name]
            own = np.array(right.column(extra).to_pylist(), object)[by_name] if extra else None
            d = 1 - matrix(left.column("qx")) @ x.T
            for k, q in enumerate(left.column("q").to_pylist()):
                row = np.round(d[k], 6) if extra else d[k]
                if extra:
                    row = np.where(own == q, np.inf, row)
                few = np.flatnonzero(row <= np.partition(row, min(n, len(row)) - 1)[min(n, len(row)) - 1])
                few = few[np.argsort(row[few], kind="stable")][:n]
                few = few[np.isfinite(row[few])]
                out["q"] += [q] * len(few)
                out["d"] += row[few].tolist()
                out[key] += [names[j] for j in by_name[few]]
        return pa.table({"q": pa.array(out["q"], left.schema.field("q").type), "d": pa.array(out["d"], pa.float64()), key: pa.array(out[key], right.schema.field(key).type)})

    return across(queries.select("q", "qx"), "q", targets.select(key, "x", *([extra] if extra else [])), key, run, f"q {q_kind}, d double, {key} {kind}")


def nearest_persons(queries: DataFrame, persons: DataFrame, line: float, margin: float) -> DataFrame:
    """First tier: the nearest person of each query (q, qx), given only if near enough and clearly nearer than the next."""
    found = _best(queries, persons.select("person", F.col("centroid").alias("x")), "person", 2)
    two = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "person"))), 1, 2).alias("n"))
    best, second = F.element_at("n", 1), F.try_element_at("n", F.lit(2))
    gap = second["d"] - best["d"]
    return two.select("q", F.when((best["d"] < line) & (F.coalesce(gap, F.lit(1.0)) >= margin), best["person"]).alias("person"), F.round(best["d"], 6).alias("d"), F.round(gap, 6).alias("margin"))


def nearest_faces(queries: DataFrame, faces: DataFrame, n: int) -> DataFrame:
    """Second tier: the n nearest faces (face_id, vec_id, x) of each query (q a vec_id, qx), leftovers included."""
    own = _best(queries, faces, "face_id", n, "vec_id")
    best = own.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("d", "face_id"))).where(F.col("k") <= n)
    return best.select("q", "face_id", F.round("d", 6).alias("d"))


def hamming_pairs(hashes: DataFrame, hash_col: str, below: int, bits: int = 64) -> DataFrame:
    """Pairs (a, b, bits) of different hashes, a < b, that differ in fewer than `below` bits.

    Hashes are cut into below + 1 blocks: pairs agree in two of them at least, so they meet in a bucket."""
    cuts = [round(bits * i / (below + 1)) for i in range(below + 2)]
    h = F.col(hash_col)
    parts = [F.shiftright(h, a).bitwiseAND(F.lit((1 << (z - a)) - 1)) for a, z in zip(cuts, cuts[1:])]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(parts[i], parts[j]).alias("k")) for t, (i, j) in enumerate(itertools.combinations(range(below + 1), 2))])
    keyed = hashes.select(h.alias("h")).distinct().select("h", F.explode(keys).alias("key"))
    a, b = keyed.select(F.col("h").alias("a"), "key"), keyed.select(F.col("h").alias("b"), "key")
    n = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return a.join(b, "key").where("a < b").where(n < below).select("a", "b", n.cast("int").alias("bits")).distinct()


def hash_classes(rows: DataFrame, id_col: str, hash_col: str, below: int, bits: int = 64) -> DataFrame:
    """(id, class, links) for every row: class is the least id with the same hash, links the number of other rows whose hash differs in fewer than `below` bits.

    Equal hashes count once in the search, however many rows share one; a null hash links with nothing."""
    classes = rows.groupBy(F.col(hash_col).alias("h")).agg(F.count("*").alias("n"), F.min(id_col).alias("class"))
    pairs = hamming_pairs(classes.where("h is not null"), "h", below, bits)
    both = pairs.select(F.col("a").alias("h"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    others = both.join(classes.select(F.col("h").alias("other"), "n"), "other").groupBy("h").agg(F.sum("n").alias("near"))
    told = classes.join(others, "h", "left").select("h", "class", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    out = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).join(told, "h", "left")
    known = F.col("h").isNotNull()
    return out.select("id", F.when(known, F.col("class")).otherwise(F.col("id")).alias("class"), F.when(known, F.col("links")).otherwise(0).cast("long").alias("links"))
