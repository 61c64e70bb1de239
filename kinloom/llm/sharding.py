"""Sharding by proportional stratified interleaving (operator 10).

Rows are ranked in a seeded random order within their source. A row's fractional rank is
(rank - 1 + u) / size of the source, with u in [0, 1) from the row's hash, so that it lies in the
row's own part of the unit interval, and sources of one row, however many, lie all over it.
Sorting all rows by that fraction mixes every source evenly, and cutting the order into equal
runs gives shards whose row counts differ by one at most and whose mixture is that of the
whole (law `rows`).

No source is ranked in one task, however large: rows are dealt to (source, hash range)
buckets, ranked there, and the sizes of earlier buckets are added. Rows that are alike in every
column have one hash: they are counted before they are dealt, ranked as one, and told apart again
afterwards, in runs of COPIES. The global order works with ranges of the fraction, in which rows
lie evenly by construction, whatever the sources. Counts by range are bounded by the number of
ranges, not by rows.

Defined cases: a null source is a stratum of its own; a null text has no bytes (size 1,
checksum 0); repeated rows are rows like others; rows that tie in every key are alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, pick, read

SHARDS = 16
SEED = "kinloom-7"
#: Rows of a range, about; there are 16**2 to 16**4 ranges. The result is the same whatever their number.
RANGE_ROWS = 50_000
#: So many rows that are alike in every column are written out by one task at most.
COPIES = 50_000


def _digits(rows: int, range_rows: int) -> int:
    """Hex digits that name a range."""
    return max(2, min(4, math.ceil(math.log(max(1, rows) / range_rows, 16))))


def _hex(h, start: int, digits: int):
    return F.conv(F.substring(h, start, digits), 16, 10).cast("long")


def interleave(
    rows: DataFrame, source_col: str = "source", id_col: str = "doc_id", tie_cols: tuple[str, ...] = (), shards: int = SHARDS, seed: str = SEED, range_rows: int = RANGE_ROWS, copies: int = COPIES
) -> DataFrame:
    """rows' columns by position (c0, c1, ...) with `shard` and `slot`.

    The rows should be narrow (ids and what the caller needs beside them): they are shuffled."""
    names = rows.columns
    col = {n: f"c{i}" for i, n in enumerate(names)}
    plain = rows.toDF(*col.values())
    src, key, ties = col[source_col], col[id_col], [col[c] for c in tie_cols]
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(src).cast("string")), F.lit("n"))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), stratum, *[F.col(c).cast("string") for c in ties]))
    alike = cut(plain.withColumn("stratum", stratum).withColumn("h", h).groupBy(*plain.columns, "stratum", "h").agg(F.count("*").alias("n")))
    total = alike.agg(F.sum("n")).first()[0] or 0
    digits = _digits(total, range_rows)
    ranges = 16**digits
    dealt = alike.withColumn("bucket", _hex("h", 1, digits))
    order = ["h", key, *ties]

    counts = dealt.groupBy("stratum", "bucket").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("stratum").orderBy("bucket")
    offsets = cut(counts.select("stratum", "bucket", (F.sum("n").over(ahead) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("size")))
    running = Window.partitionBy("stratum", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.withColumn("r", F.sum("n").over(running) - F.col("n"))
    ranked = join_counted(within, offsets, ["stratum", "bucket"], "inner").withColumn("first", F.col("before") + F.col("r"))

    if alike.where(F.col("n") > copies).isEmpty():
        parts = ranked.withColumn("at", F.lit(0).cast("long"))
    else:
        many = ranked.where(F.col("n") > copies).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(copies).cast("long")))).repartition("h", "at")
        parts = ranked.where(F.col("n") <= copies).withColumn("at", F.lit(0).cast("long")).unionByName(many)
    each = parts.withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + copies, F.col("n")) - 1)))
    within_part = _hex("h", 17, 13).cast("double") / F.lit(float(1 << 52))
    fraction = ((F.col("first") + F.col("k")).cast("double") + within_part) / F.col("size").cast("double")
    spread = cut(each.select(*plain.columns, "h", "stratum", fraction.alias("fraction")).withColumn("range", F.least(F.lit(ranges - 1), F.floor(F.col("fraction") * ranges)).cast("int")))

    found = spread.groupBy("range").agg(F.count("*").alias("n"))  # at most `ranges` rows: one task adds them up
    before = cut(found.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead")))
    placed = spread.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("fraction", "stratum", *order)))
    placed = placed.join(F.broadcast(before), "range").withColumn("p", F.col("ahead") + F.col("r") - 1)
    # The first total % shards shards have one row more.
    size, more = divmod(total, shards)
    big = more * (size + 1)
    shard = F.when(F.col("p") < big, F.floor(F.col("p") / (size + 1))).otherwise(more + F.floor((F.col("p") - big) / max(1, size))).cast("int")
    start = F.when(F.col("shard") < more, F.col("shard") * (size + 1)).otherwise(big + (F.col("shard") - more) * size)
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("p") - start).cast("long")).select(*plain.columns, "shard", "slot")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = interleave(narrow, tie_cols=("size", "text_crc32"))
    return out.select(F.col("c0").alias("doc_id"), F.col("c2").alias("size"), F.col("c3").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum goes by half bytes, the lower half first, with the CRC-32 values (fixed) of the sixteen halves.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT r, doc_id, source, octet_length(b)::BIGINT + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(b), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: CASE WHEN x = '' THEN -1 ELSE strpos('0123456789ABCDEF', x)::BIGINT - 1 END)),
    lambda c, h: CASE WHEN h < 0 THEN c ELSE xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, h) & 15) + 1]) END)) AS text_crc32 FROM d),
h AS (SELECT *, coalesce('s' || source, 'n') AS stratum, md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce('s' || source, 'n'), size, text_crc32)) AS h FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, size, text_crc32) AS k, count(*) OVER (PARTITION BY stratum) AS total FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY ((k - 1)::DOUBLE + ('0x' || h[17:29])::BIGINT::DOUBLE / 4503599627370496) / total::DOUBLE, stratum, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS p, count(*) OVER () // {SHARDS} AS few, count(*) OVER () % {SHARDS} AS more FROM k),
s AS (SELECT *, CASE WHEN p < more * (few + 1) THEN p // (few + 1) ELSE more + (p - more * (few + 1)) // greatest(1, few) END AS shard FROM p)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY p) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
