"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 3).

Benchmark items become windows of `size` words (an item of fewer words is one window). The
set of window hashes is broadcast; every document is scanned once with a rolling hash over
its word numbers, hits are verified word by word, and the words inside a verified window are
marked. The broadcast is bounded: a benchmark of more than `block_words` words is cut into
blocks of items and the documents are scanned for each block.

Defined cases: null and wordless texts have no words and are never hit; repeated documents
each get a row; items that repeat an id count once; the windows of items without an id hit
like others, but such items are neither listed nor counted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pick, position, read, utf8

SIZE = 10
BLOCK_WORDS = 2_000_000
_FOLD = bytes((c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32) for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCAN_WORDS = 400_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return utf8(text).translate(_FOLD).split()


class Grams:
    """Windows of benchmark items, looked up by hash and verified."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = SIZE):
        self.number: dict[bytes, int] = {}
        self.size = size
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            w = words(text)
            ids = tuple(self.number.setdefault(x, len(self.number) + 1) for x in w)
            n = min(size, len(ids))
            for k in range(len(ids) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(ids[k : k + n], set()).add(item)
        self.lengths = {}
        for n, grams in by_length.items():
            keys = np.array(list(grams), np.uint64).reshape(-1, n)
            h = self._hash(keys.T)
            order = np.argsort(h, kind="stable")
            found: dict[int, list] = {}
            for gram, x in zip(grams, h.tolist()):
                found.setdefault(x, []).append((gram, tuple(sorted(grams[gram] - {None}))))
            self.lengths[n] = (h[order], found)

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * _MIX
            h ^= h >> np.uint64(31)
        return h

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, tuple]]:
        """(start, length, items) of every verified window; ids has 0 for words no item has."""
        out = []
        for n, (keys, found) in self.lengths.items():
            if len(ids) < n:
                continue
            known = np.concatenate([[0], np.cumsum(ids != 0)])
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = self._hash([ids[at + k] for k in range(n)])
            spot = np.searchsorted(keys, h)
            hit = keys[np.minimum(spot, len(keys) - 1)] == h
            for a, x in zip(at[hit].tolist(), h[hit].tolist()):
                got = tuple(ids[a : a + n].tolist())
                out.extend((a, n, items) for gram, items in found[x] if gram == got)
        return out


def blocks(bench: DataFrame, item_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of bounded size, dealt by item."""
    base = pick(bench, item=item_col, text=text_col).select(F.col("item").cast("string").alias("item"), "text")
    total = base.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // (2 * limit)) or 1
    return [base.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i) for i in range(parts)]


def _hits(texts: list[str | None], grams: Grams):
    """Per text: number of words, spans of word numbers (start, length), items."""
    out = []
    get = grams.number.get
    pending, sizes, total = [], [], 0

    def flush():
        flat = np.array(pending, np.uint64)
        starts = np.cumsum([0, *[s + 1 for s in sizes]])
        marks: list[list] = [[] for _ in sizes]
        for a, n, items in grams.scan(flat):
            k = int(np.searchsorted(starts, a, "right")) - 1
            marks[k].append((a - int(starts[k]), n, items))
        out.extend((s, [(a, n) for a, n, _ in m], sorted({i for *_, items in m for i in items})) for s, m in zip(sizes, marks))

    for t in texts:
        w = words(t)
        pending.extend([get(x, 0) for x in w])
        pending.append(0)  # no window spans two texts
        sizes.append(len(w))
        total += len(w)
        if total > _SCAN_WORDS:
            flush()
            pending, sizes, total = [], [], 0
    if sizes:
        flush()
    return out


def hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """docs' columns by position (c0, c1, ...) with `n_words`, `spans` (array of word start, count) and `items`."""
    spark = docs.sparkSession
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{position(docs, text_col)}"
    added = ["n_words", "spans", "items"]
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("count", pa.int64())])), pa.list_(pa.string())]

    def scan(frame: DataFrame, part: DataFrame, keep: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most block_words words
        at, kept = frame.columns.index(text), [frame.columns.index(c) for c in keep]

        def run(batches):
            grams = Grams(sent.value, size)
            for b in bounded(batches):
                got = _hits(b.column(at).to_pylist(), grams)
                cols = [[n for n, _, _ in got], [[{"start": a, "count": c} for a, c in s] for _, s, _ in got], [i for *_, i in got]]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*keep, *added])

        held = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep)
        return frame.mapInArrow(run, held + ", n_words long, spans array<struct<start:long,count:long>>, items array<string>")

    parts = blocks(bench, item_col, bench_text_col, block_words)
    final = [c for c in plain.columns if keep_text or c != text]
    out = scan(plain, parts[0], plain.columns if parts[1:] else final)
    for i, part in enumerate(parts[1:], 2):  # each further block adds to what the rows have
        have = out.withColumnsRenamed({"spans": "s0", "items": "i0"}).drop("n_words")
        columns = plain.columns if i < len(parts) else final
        both = scan(have, part, [*columns, "s0", "i0"])
        out = both.select(*columns, "n_words", F.concat("s0", "spans").alias("spans"), F.array_sort(F.array_distinct(F.concat("i0", "items"))).alias("items"))
    return out


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans."""
    total, end = 0, 0
    for a, n in sorted(spans):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


def _n_hit(spans):
    """`covered` as a column."""
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["start"] + x["count"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["start"] + x["count"]).alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs without hit documents (mode "documents") or with the hit words cut out (mode "spans")."""
    found = hits(docs, bench, text_col, **options)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    if mode == "documents":
        return found.where(F.size("spans") == 0).select(*plain).toDF(*docs.columns)
    at = plain[position(docs, text_col)]

    @F.udf("string", useArrow=True)
    def without(text, spans):
        if not spans:
            return text
        b = utf8(text)
        drop = {k for s in spans for k in range(s["start"], s["start"] + s["count"])}
        return b"".join(b[a:z] for a, z in _gaps(b, drop)).decode("utf-8", "surrogatepass")

    return found.withColumn(at, without(at, "spans")).select(*plain).toDF(*docs.columns)


def _gaps(b: bytes, drop: set[int]):
    end = 0
    for k, m in enumerate(_WORD.finditer(b)):
        if k in drop:
            yield end, m.start()
            end = m.end()
    yield end, len(b)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = hits(docs, read(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = _n_hit(F.col("spans"))
    return found.select(
        F.col("c0").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM bk),
dk AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM dk),
hit AS (SELECT r, k, n, item FROM dw JOIN bw USING (n, gram)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
