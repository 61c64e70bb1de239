"""SimHash near-duplicates by pivot distance tables (operator 7).

Every distinct fingerprint gets a table of Hamming distances to reference fingerprints
(pivots). Two fingerprints at most `radius` bits apart differ by at most `radius` in every
coordinate (triangle inequality), so a larger maximum coordinate difference discards a pair
and only survivors are compared bit by bit.

To find pairs without looking at all of them, the fingerprint is cut into `radius + 2`
blocks with pivots of their own. `radius` differing bits leave at least two blocks without a
difference, and there all block coordinates are equal; so pairs are sought among those that
agree in all coordinates of two blocks. A bucket of more than `bucket` fingerprints is cut
into chunks that are compared two by two, in different tasks. Tasks give a spanning forest
of the links they find, never the links themselves, and components are joined by alternating
star contraction.

Defined cases: a null or wordless text has fingerprint zero, linked like any other. Repeated
rows each get a row. A null doc_id never names a component unless all its rows are null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded, cut, join_counted, pick, position, read, utf8

SEED = 42
RADIUS = 3
SHINGLE = 3
PIVOTS = 12
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, as an unsigned number."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    step = 1 << 14
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, step):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[k : k + step], stops[k : k + step])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    base = pick(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in bounded(batches):
            fps = [signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fp long")


def references(count: int, salt: int = 0) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {salt} {i}".encode(), SEED) for i in range(count)], np.uint64)


def distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for every fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1).astype(np.int8)


def block_masks(blocks: int) -> list[np.uint64]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:])]


def bucket_keys(fps: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """For every pair of blocks a key that is equal if all coordinates of both blocks are."""
    per_block = []
    for i, mask in enumerate(block_masks(radius + 2)):
        key = np.full(len(fps), 1469598103934665603, np.uint64)
        for p in references(PIVOTS, i + 1):  # distances within the block, mixed into one key
            key = (key ^ np.bitwise_count((fps ^ p) & mask).astype(np.uint64)) * np.uint64(1099511628211)
        per_block.append(key ^ (key >> np.uint64(29)))
    mix = np.uint64(0x9E3779B97F4A7C15)
    return [((per_block[a] * mix) ^ per_block[b]) * mix + np.uint64(t) for t, (a, b) in enumerate(itertools.combinations(range(radius + 2), 2))]


def forest(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links within each run of equal groups: (index, index) edges."""
    n = len(fps)
    edges: list[tuple[int, int]] = []
    if n < 2:
        return edges
    table = distances(fps, references(PIVOTS))
    cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    sizes = stops - starts
    # Small groups: all of one distance in the sorted order at a time, over all groups.
    small = np.repeat(sizes <= 48, sizes)
    left = np.repeat(stops, sizes) - np.arange(n)  # rows from here to the group's end
    at = np.flatnonzero(small & (left > 1))
    shift = 1
    while len(at):
        near = at[(np.abs(table[at] - table[at + shift]) <= radius).all(axis=1)]
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= radius]
        edges.extend(zip(near.tolist(), (near + shift).tolist()))
        shift += 1
        at = at[left[at] > shift]
    # Large groups: grow components, so that links inside a dense one are not listed.
    for g in np.flatnonzero(sizes > 48):
        rest = np.arange(starts[g], stops[g])
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = rest
                for k in range(PIVOTS):
                    near = near[np.abs(table[near, k] - table[x, k]) <= radius]
                near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
                if len(near):
                    edges.extend((x, y) for y in near.tolist())
                    queue.extend(near.tolist())
                    rest = rest[~np.isin(rest, near, assume_unique=True)]
    return edges


def rooted(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest reachable value for every value in the pairs."""
    up: dict[int, int] = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges with u > v that connect exactly the fingerprints that are linked, directly or over others."""

    def keyed(batches):
        for b in bounded(batches):
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for key in bucket_keys(fps, radius):
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(key.view(np.int64))], names=["fp", "key"])

    keys = distinct.select("fp").mapInArrow(keyed, "fp long, key long")
    crowded = cut(keys.groupBy("key").count().filter(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks")))
    if crowded.isEmpty():
        split = keys.select("fp", "key", F.lit(0).alias("a"), F.lit(0).alias("b"))
    else:
        few = crowded.limit(100_001).count() <= 100_000
        g = F.coalesce("chunks", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), g).cast("int")
        split = (
            keys.join(F.broadcast(crowded) if few else crowded, "key", "left")
            .select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), g - 1)).alias("other"))
            .select("fp", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        )

    def joined(batches):
        held_fp, held_g = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def out(fps, groups):
            edges = forest(fps, groups, radius)
            roots = rooted([(int(x), int(y)) for x, y in zip(fps[[a for a, _ in edges]].view(np.int64), fps[[b for _, b in edges]].view(np.int64))]) if edges else {}
            found = [(u, v) for u, v in roots.items() if u != v]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for b in batches:
            fps = np.concatenate([held_fp, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            groups = np.concatenate([held_g, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(fps):
                continue
            last = int(np.searchsorted(np.cumsum(groups[::-1] != groups[-1]) > 0, True))  # rows of the last, perhaps unfinished group
            cutoff = len(fps) - last
            if cutoff < 20_000 and last < 20_000:
                held_fp, held_g = fps, groups
                continue
            yield out(fps[:cutoff], groups[:cutoff])
            held_fp, held_g = fps[cutoff:], groups[cutoff:]
        if len(held_fp):
            yield out(held_fp, held_g)

    grouped = split.select("fp", F.xxhash64("key", "a", "b").alias("g"))
    placed = grouped.repartition(F.col("g")).sortWithinPartitions("g", "fp")
    return placed.mapInArrow(joined, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(links(distinct, radius, bucket), "u", "v").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = distinct.join(linked, "fp", "left")
    lowest = cut(named.where("root is not null").groupBy("root").agg(F.min("low").alias("least")))  # of components with links
    of_fp = cut(join_counted(named, lowest, "root").select("fp", F.coalesce("least", "low").alias("component_id")))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one whose id names it (of rows that repeat that id, one).

    Rows without an id can't be named, and all stay."""
    found = near_duplicates(docs, id_col, text_col)
    keep = cut(found.filter("doc_id = component_id").select("doc_id").distinct())
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{position(docs, id_col)}"
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    kept = join_counted(plain, keep.select(F.col("doc_id").alias(key)), key, "left_semi").select(*plain.columns)
    if not again.isEmpty():  # only rows whose id is repeated are dealt by id
        once = join_counted(kept, again, key, "left_semi").dropDuplicates([key]).select(*plain.columns)
        kept = join_counted(kept, again, key, "left_anti").select(*plain.columns).unionAll(once)
    return kept.unionAll(plain.filter(F.col(key).isNull())).toDF(*names)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
