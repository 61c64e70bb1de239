"""Near copies by exact set similarity: word shingles with a Jaccard similarity of 4/5 or more.

Fingerprints a few bits apart are only some of the near copies, so the pipeline looks for the
rest here. The search loses no pair. A text's shingles are put in one order for all texts; two
sets that are similar enough share a shingle among the first n - ceil(4n/5) + 1 of each (of n),
and at the first one they share the rest is long enough. Pairs sought there are first compared by
sketches, counts of shingles by bin, which bound what two texts share from above; the pairs that
are left are compared word by word. Shingles that a sample of texts shows to be common come last in the order: that decides
how many pairs are looked at, never which are found.

A crowded shingle (more than CROWD texts) first gives pairs of neighbours by length; then only
its pairs that these have not linked, so a large group of copies is not paired with itself. No
shingle's texts meet in one task: those of a shingle that the sample shows to have more than
`chunk` texts are dealt over as many parts as it takes, by text and shingle, so that other
shingles deal the same texts otherwise and link the parts. Crowded shingles whose texts are all
linked by then are done; the texts of the others are counted and cut into chunks, which are
compared two by two in different tasks.

Defined cases: words are lower-cased (ASCII) and split at ASCII white space; a text of fewer
words than a shingle is one shingle; a wordless text has no near copies; rows without an id
can't be named, and all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded, cut, join_counted, pick, position, stored, utf8

SHINGLE = 5
CROWD = 8
#: Texts of one shingle that meet in one task, about.
CHUNK = 4_096
PER_BIN, _FULL = 4, 0xFFFF
#: Texts of the sample that shows common shingles, in how many of them one is common, and how many are kept.
SAMPLE, COMMON, MOST_COMMON = 4_000, 4, 200_000
_LOW = np.uint64((1 << 63) - 1)
_TOP = np.uint64(1 << 63)


def shingles(text: str | None) -> set[bytes]:
    words = utf8(text).lower().split()
    return {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def similar(a: str | None, b: str | None) -> bool:
    x, y = shingles(a), shingles(b)
    return bool(x) and 9 * len(x & y) >= 4 * (len(x) + len(y))


def hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; one shingle's bytes are held at a time."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b]) for a, b in zip(starts, ends[-n:].tolist())), np.uint64, n) & _LOW)


def first(text: str | None, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles in which a near copy must share one, in order (common ones with the top bit), and the number of all."""
    h = hashes(text)
    n = len(h)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = np.sort(np.where(common[at] == h, h | _TOP, h))
    return h[: n - (4 * n + 4) // 5 + 1] if n else h, n


def sketch(text: str | None) -> bytes:
    """How many of a text's shingles fall into each bin by hash; about PER_BIN to a bin, in a power of two of bins."""
    h = hashes(text)
    bins = 1 << max(3, (len(h) // PER_BIN).bit_length())
    return np.minimum(np.bincount((h % np.uint64(bins)).astype(np.int64), minlength=bins), _FULL).astype("<u2").tobytes()


def perhaps(a: bytes, b: bytes) -> bool:
    """Whether texts with these sketches can be similar: what they share is at most what their bins share."""
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    if x.max() == _FULL or y.max() == _FULL:
        return True
    bins = min(len(x), len(y))  # the finer one is folded
    x, y = x.reshape(-1, bins).sum(axis=0), y.reshape(-1, bins).sum(axis=0)
    return 9 * int(np.minimum(x, y).sum()) >= 4 * int(x.sum() + y.sum())


def common_shingles(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in the sample, sorted, and of how many texts each is likely to be one."""
    every = max(1, base.count() // SAMPLE)

    def run(batches):
        for b in bounded(batches):
            h = [hashes(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*h, np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    drawn = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    found = drawn.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.col("count").desc(), "h").limit(MOST_COMMON)
    rows = sorted((r["h"], r["count"]) for r in found.collect())  # not negative: the top bit is clear
    return np.array([h for h, _ in rows], np.int64).view(np.uint64), every * np.array([c for _, c in rows], np.int64)


def _possible(n, at, i, j):
    """Whether sets of these sizes, sharing what stands at these places first, can be similar enough."""
    a, b = n[i], n[j]
    room = 1 + np.minimum(a - at[i] - 1, b - at[j] - 1)
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * room >= 4 * (a + b))


def _by_shingle(batches, keys, each):
    """Runs of rows that are equal in the first `keys` columns (sorted by them), over batch borders, given to `each` as tables of whole runs, with their borders."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        borders = _borders(t, keys)
        if len(borders) > 2:
            yield from each(t.slice(0, borders[-2]), borders[:-1])
        held = t.slice(borders[-2])
    if held is not None and held.num_rows:
        yield from each(held, _borders(held, keys))


def _borders(t, keys):
    new = np.zeros(t.num_rows - 1, bool)
    for k in range(keys):
        x = t.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(node, component): the least id reachable, for every id that has a near copy."""
    spark = docs.sparkSession
    base = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null")
    kind = base.schema["doc_id"].dataType.simpleString()
    common = spark.sparkContext.broadcast(common_shingles(base))  # at most MOST_COMMON

    def prefixes(batches):
        for b in bounded(batches):
            known, texts = common.value
            ids, hs, ns, at = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                h, n = first(t, known)
                hs.append(h)
                ids.append(np.full(len(h), k))
                ns.append(np.full(len(h), n, np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
            if hs:
                h = np.concatenate(hs)
                parts = np.ones(len(h), np.int32)
                top = h >= _TOP
                parts[top] = -(-texts[np.searchsorted(known, h[top] & _LOW)] // chunk)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(np.concatenate(ids).astype(np.int64))), pa.array(np.concatenate(ns)), pa.array(np.concatenate(at)), pa.array(parts)], names=["h", "id", "n", "p", "parts"])

    rows = base.mapInArrow(prefixes, f"h long, id {kind}, n int, p int, parts int")
    rows = rows.select("h", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "h"), "parts")).otherwise(-1).cast("int").alias("part"), "n", "p", "id")

    def sought(batches):
        """Pairs (a, b) of few texts and of neighbours; rows of crowded shingles as they are, with b null."""

        def each(t, borders):
            h, part, n, p, ids = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy().astype(np.int64), t.column(3).to_numpy(), t.column(4).combine_chunks()
            left, right, crowd = [], [], []
            looked = (np.diff(borders) > 1) | (part[borders[:-1]] >= 0)
            for s, e in zip(borders[:-1][looked].tolist(), borders[1:][looked].tolist()):
                if e - s > CROWD or part[s] >= 0:
                    crowd.append(np.arange(s, e))
                reach = e - s if e - s <= CROWD else 2
                for step in range(1, reach):
                    i = np.arange(s, e - step)
                    i = i[_possible(n, p, i, i + step)]
                    left.append(i)
                    right.append(i + step)
            none = np.empty(0, np.int64)
            a, b, c = (np.concatenate([none, *x]) for x in (left, right, crowd))
            if len(a) + len(c):
                both = np.concatenate([a, c])
                other = pa.array(np.concatenate([b, c]), mask=np.concatenate([np.zeros(len(a), bool), np.ones(len(c), bool)]))
                yield pa.RecordBatch.from_arrays([pa.array(h[both]), ids.take(pa.array(both)), ids.take(other), pa.array(n[both].astype(np.int32)), pa.array(p[both])], names=["h", "a", "b", "n", "p"])

        yield from _by_shingle(batches, 2, each)

    found = cut(rows.repartition("h", "part").sortWithinPartitions("h", "part", "n", "id").mapInArrow(sought, f"h long, a {kind}, b {kind}, n int, p int"))

    def sketches(batches):
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(t) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "s"])

    def compared(pairs):
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        named = cut(pairs.select("a").union(pairs.select("b")).distinct())
        drawn = join_counted(base, named.select(F.col("a").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sketches, f"doc_id {kind}, s binary")
        told = cut(drawn)
        by = lambda c: told.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}"))

        def near(batches):
            for b in batches:
                ok = [perhaps(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        pairs = cut(pairs.join(by("a"), "a").join(by("b"), "b").select("a", "b", "sa", "sb").mapInArrow(near, f"a {kind}, b {kind}"))
        named = cut(pairs.select("a").union(pairs.select("b")).distinct())
        texts = stored(join_counted(base, named.select(F.col("a").alias("doc_id")), "doc_id", "left_semi"))
        of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))

        def check(batches):
            for b in bounded(batches):
                ok = [similar(x, y) for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return cut(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(check, f"a {kind}, b {kind}").distinct())

    links = compared(found.where("b is not null"))
    linked = cut(components(links))
    crowded = found.where("b is null").select("h", F.col("a").alias("id"), "n", "p")
    if crowded.isEmpty():
        return linked

    placed = cut(join_counted(crowded, linked.select(F.col("node").alias("id"), "component"), "id").select("h", "id", "n", "p", F.xxhash64(F.coalesce("component", "id")).alias("c")))
    open_ = cut(placed.groupBy("h").agg(F.count("*").alias("count"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    if open_.isEmpty():
        return linked
    split = (
        join_counted(placed, open_, "h", "inner")
        .select("h", "id", "n", "p", "c", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "n", "p", "c", "id")
    )

    def apart(batches):
        """Pairs of crowded shingles that are not in one component yet: of two chunks those between them."""

        def each(t, borders):
            x, y, own, n, p, c = (t.column(k).to_numpy().astype(np.int64) for k in range(1, 7))
            ids = t.column(7).combine_chunks()
            for s, e in zip(borders.tolist(), borders[1:].tolist()):
                for i in range(s, e - 1):
                    j = np.arange(i + 1, e)
                    j = j[(c[j] != c[i]) & ((x[i] == y[i]) | (own[j] != own[i])) & _possible(n, p, np.full(len(j), i), j)]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(j), i))), ids.take(pa.array(j))], names=["a", "b"])

        yield from _by_shingle(batches, 3, each)

    more = compared(split.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "n", "id").mapInArrow(apart, f"a {kind}, b {kind}"))
    return linked if more.isEmpty() else cut(components(links.union(more)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are linked to a near copy with a smaller id."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{position(docs, id_col)}"
    gone = cut(near_copies(docs, id_col, text_col).where("node <> component").select(F.col("node").alias(key)))
    return join_counted(plain, gone, key, "left_anti").select(*plain.columns).toDF(*names)
