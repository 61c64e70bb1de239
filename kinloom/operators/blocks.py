"""Plans that need every row's place, or every row against every other, without one task for all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a side that one task holds against the other's, about.
CHUNK = 4096


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in the order, from 0, as a long.

    Rows are sorted by ranges and counted by partition; only those counts come together."""
    at, low = F.col("_at"), (1 << 33) - 1
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), F.shiftright(at, 33) == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + at.bitwiseAND(F.lit(low))).drop("_at", "_part", "_before")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length."""
    x = column.combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), -1)


def _dealt(rows: DataFrame, by: list[str], key: str, size: int) -> DataFrame:
    """rows with `own`, their chunk within `by`, and `chunks`, how many there are; few and small, so counted first."""
    n = cut(rows.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("chunks"))) if by else None
    if n is None:
        found = rows.withColumn("chunks", F.lit(max(1, -(-rows.count() // size))))
    else:
        found = rows.join(n, by)
    return found.withColumn("own", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))


def within(rows: DataFrame, by: list[str], key: str, run: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, size: int = CHUNK) -> DataFrame:
    """`run(left, right, same)` for every two chunks of each group of `by`; same tells that both are one chunk."""
    columns = rows.columns
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = _dealt(rows, by, key, size).withColumn("other", other).withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    def both(table: pa.Table) -> pa.Table:
        own, a, b = (table.column(c).to_numpy() for c in ("own", "a", "b"))
        same = bool(a[0] == b[0])
        left = table.filter(pa.array(own == a)).select(columns)
        return run(left, left if same else table.filter(pa.array(own == b)).select(columns), same)

    dealt = spread.select(*columns, "own", "a", "b").repartition(*by, "a", "b")  # else all chunks of a group stay in the task that joined them
    return dealt.groupBy(*by, "a", "b").applyInArrow(both, schema)


def across(left: DataFrame, left_key: str, right: DataFrame, right_key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int = CHUNK) -> DataFrame:
    """`run(left, right)` for every chunk of one side and every chunk of the other."""
    a, b = _dealt(left, [], left_key, size), _dealt(right, [], right_key, size)
    na, nb = (x.select("chunks").first() for x in (a, b))
    na, nb = (na[0] if na else 1), (nb[0] if nb else 1)
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.drop("chunks").withColumn("a", F.col("own")).withColumn("b", many(nb)).drop("own")
    b = b.drop("chunks").withColumn("b", F.col("own")).withColumn("a", many(na)).drop("own")
    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(run, schema)


def quantile(rows: DataFrame, by: list[str], value: str, q: float, low: float = 0.0, high: float = 2.0, bins: int = 20_000) -> DataFrame:
    """(by, quantile): exact, interpolated between neighbours as usual; null values don't count.

    The bins that hold the two ranks are found from counts, and only their values are gathered;
    values outside low and high fall into the outer bins."""
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    held = held.withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / (high - low) * bins))).cast("int"))
    counts = held.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    at = (F.col("all") - 1) * F.lit(q)
    lower, upper = F.floor(at), F.ceil(at)  # ranks from 0
    wanted = placed.where((F.col("upto") > lower) & (F.col("upto") - F.col("n") <= upper))
    wanted = cut(wanted.select(*by, "bin", (F.col("upto") - F.col("n")).alias("before"), (lower - F.col("upto") + F.col("n")).alias("i"), at.alias("at")))
    values = held.join(wanted, [*by, "bin"]).groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("vs"), F.min("before").alias("before"), F.first("at").alias("at"))
    first, share = F.floor("at") - F.col("before"), F.col("at") - F.floor("at")
    a = F.get("vs", first.cast("int"))
    b = F.coalesce(F.get("vs", (first + 1).cast("int")), a)
    return values.select(*by, (a + (b - a) * share).alias("quantile"))
