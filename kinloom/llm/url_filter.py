"""URL filter by the ratio of two character language models (operator 8).

Hand-written rules decide the URLs they fit. Their decisions are also what the models learn
from: one variable-order Markov model of accepted URLs and one of rejected URLs. The order goes
as far as a context has been seen, up to ORDER symbols: each order is interpolated with the one
below, by how many different symbols followed the context, and unseen contexts leave the lower
order as it is. Any other URL is judged by the difference of the two log-likelihoods per symbol.

The ruled URLs are dealt by a hash of the URL: of FOLDS parts one is held out from learning,
and the threshold is calibrated on it.

Symbols are the 26 letters (lower-cased), one for any digit, ten marks and one for anything
else, so that grams of ORDER + 1 symbols have a proven bound (39**4, 2.3 million a model)
whatever the number of URLs: counts are arrays of that size, and workers get one array of
differences (18 MB). Lower orders are sums over the higher ones, since every position has its
ORDER symbols before it (symbol 0 before the first). Calibration uses a histogram of BINS bins.

Defined cases: a null url or one without :// has empty host and path; a null or empty url's
ratio is 0; without ruled URLs of both kinds to learn from the ratio is 0, and without both
kinds held out the threshold is 0; a ratio at the threshold is allowed. Repeated rows each get
a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pick, read

#: (verdict, host, path prefix): the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 3
FOLDS = 5
BINS = 2001
SPAN = 10.0
_MARKS = "/.-_?=&#%:"
_CODE = bytes(
    1 + (c | 32) - 97 if 97 <= (c | 32) <= 122 and c < 128 else 27 if 48 <= c <= 57 else 28 + _MARKS.index(chr(c)) if c < 128 and chr(c) in _MARKS else 38 for c in range(256)
)
_BASE = 39  # symbol 0 stands before the first one


def parts(url):
    """(host, path) of a url column."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, url, host, path, rule, ruling): rule and ruling are null where no rule fits."""
    base = pick(urls, id=id_col, url=url_col)
    host, path = parts(F.col("url"))
    base = base.withColumn("host", host).withColumn("path", path)
    rule = ruling = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        ruling = F.when(fits, verdict) if ruling is None else ruling.when(fits, verdict)
    return base.withColumn("rule", rule).withColumn("ruling", ruling)


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every URL the code of (ORDER symbols before, symbol), and the URL's place in the list."""
    coded = [(u or "").encode("utf-8", "surrogatepass").translate(_CODE) for u in urls]
    gap = bytes(ORDER)
    s = np.frombuffer(gap + gap.join(coded) + gap, np.uint8).astype(np.int32)
    code = s.copy()
    for k in range(1, ORDER + 1):
        code[k:] += s[:-k] * _BASE**k
    at = np.flatnonzero(s)
    return code[at], np.repeat(np.arange(len(coded)), [len(c) for c in coded])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of every gram, from the counts of all; the first axes are the context, oldest symbol first."""
    p = np.full(_BASE, 1 / _BASE)
    for k in range(ORDER + 1):
        c = counts.reshape((_BASE,) * (ORDER + 1)).sum(axis=tuple(range(ORDER - k)))
        n, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = np.where(n > 0, (c + kinds * p) / np.maximum(1, n + kinds), p)
    return np.log(p).ravel()


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Gram counts of each ruling, summed over all rows of (url, ruling)."""

    def count(batches):
        seen = {}
        for b in bounded(batches):
            urls, rulings = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object)
            for ruling in set(rulings.tolist()):
                held = seen.setdefault(ruling, np.zeros(_BASE ** (ORDER + 1), np.int64))
                codes, n = np.unique(grams(urls[rulings == ruling].tolist())[0], return_counts=True)
                held[codes] += n
        for ruling, held in seen.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([ruling] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["ruling", "code", "n"])

    summed = labelled.mapInArrow(count, "ruling string, code int, n long").groupBy("ruling", "code").agg(F.sum("n").alias("n"))
    allow = summed.select((F.col("ruling") == "allow").alias("allow"), "code", "n").toArrow()  # bounded by the number of grams
    kind, code, n = (allow.column(c).to_numpy() for c in ("allow", "code", "n"))
    out = {}
    for ruling, mine in (("allow", kind.astype(bool)), ("block", ~kind.astype(bool))):
        out[ruling] = np.zeros(_BASE ** (ORDER + 1), np.int64)
        out[ruling][code[mine]] = n[mine]
    return out


def ratios(urls: list[str | None], difference: np.ndarray) -> np.ndarray:
    """Log-likelihood difference per symbol of every URL."""
    codes, owner = grams(urls)
    size = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, difference[codes], len(urls)) / np.maximum(1, size)


def calibrate(histogram: dict[tuple[str, int], int]) -> float:
    """The threshold with the best mean of the shares of accepted and rejected URLs told rightly; of equals the middle one."""
    allow, block = (np.array([histogram.get((x, b), 0) for b in range(BINS)], float) for x in ("allow", "block"))
    if not allow.sum() or not block.sum():
        return 0.0
    below_allow, below_block = (np.concatenate([[0], np.cumsum(x)]) / x.sum() for x in (allow, block))
    score = (1 - below_allow) + below_block  # of the threshold at each bin's lower edge
    best = np.flatnonzero(score >= score.max() - 1e-12)
    return (float(best[len(best) // 2]) / BINS * 2 - 1) * SPAN


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, ratio, verdict) for every row of urls."""
    spark = urls.sparkSession
    base = ruled(urls, id_col, url_col, rules)
    held_out = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    labelled = base.where("ruling is not null").select("url", "ruling")
    counts = learn(labelled.where(~held_out))
    both = all(c.any() for c in counts.values())
    difference = log_probabilities(counts["allow"]) - log_probabilities(counts["block"]) if both else np.zeros(_BASE ** (ORDER + 1))
    sent = spark.sparkContext.broadcast(difference)  # bounded by the number of grams

    def scored(batches):
        for b in bounded(batches):
            r = ratios(b.column("url").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.float64())], names=[*b.schema.names, "ratio"])

    hist = labelled.where(held_out).mapInArrow(scored, "url string, ruling string, ratio double")
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("ratio") / SPAN + 1) / 2 * BINS))).cast("int")
    found = {(r["ruling"], r["bin"]): r["n"] for r in hist.groupBy("ruling", at.alias("bin")).agg(F.count("*").alias("n")).collect()}  # 2 * BINS rows at most
    threshold = calibrate(found)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema) + ", ratio double"
    verdict = F.coalesce("ruling", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return base.mapInArrow(scored, kind).withColumn("verdict", verdict).drop("url", "ruling")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").select("page_id", "host", "path", "rule", "verdict", "ratio")
