"""Quality rules as weak supervision (operator 6).

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation
over the counts of all vote patterns of the corpus estimates, for each rule, how often its
vote is right and how often it speaks for good and for bad documents; the posterior
probability that a document is good decides, instead of every rule having to pass.

There are at most 3**len(RULES) patterns, so their counts are a bounded table whatever the
corpus; every document is counted. Where the text itself isn't kept it is measured once: the
measures are written to the shared folder, counted from there, and joined with the patterns'
posterior probabilities. Where it is kept (the pipeline), texts are measured again rather than
written, which would take as much disk as the corpus. Documents the base rules fail are rejected in any case.

Defined cases: a null, empty or wordless text has no words and is rejected; repeated rows each
get a row; on an empty table nothing is estimated.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pick, position, read, stored, utf8

THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 50
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]  # numbers again, so that products stay small
    _, inverse, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + n] |= often
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, tuple[float, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what further rules look at."""
    text = text or ""
    b = utf8(text)
    words = b.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _WHITE))
    symbols = len(_SYMBOLS.findall(text))
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    repeats = repeated_words(words)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = max(1, sum(map(str.isalpha, text)))
    enders = sum(w.endswith((b".", b"?", b"!", b":", b";", b",")) and not w.endswith(b"!!") for w in words)
    return n, word_chars, symbols, dup, repeats, (upper / letters, text.count("!!") / max(1, n), enders / max(1, n), len(seen), sum(len(w) == 1 and not w.isalnum() for w in words) / max(1, n))


def _if(bad: bool, good: bool = False) -> int:
    return -1 if bad else 1 if good else 0


#: (name, vote) over the tuple of `measure`; a rule abstains where it can't tell.
RULES = [
    ("length", lambda m: _if(m[0] < MIN_WORDS)),
    ("repeats", lambda m: _if(m[4] > 0.5 * m[0])),
    ("symbols", lambda m: _if(m[2] >= 0.25 * max(1, m[0]), m[2] <= 0.02 * m[0])),
    ("lone_symbols", lambda m: _if(m[5][4] >= 0.2)),
    ("dup_lines", lambda m: _if(m[3] > 0.5 * (m[3] + m[5][3]))),
    ("capitals", lambda m: _if(m[5][0] >= 0.5)),
    ("shouting", lambda m: _if(m[5][1] >= 0.3)),
    ("word_length", lambda m: _if(not 2 <= m[1] / max(1, m[0]) <= 20)),
    ("sentences", lambda m: _if(m[0] >= MIN_WORDS and m[5][2] < 0.02, 0.04 <= m[5][2] <= 0.5)),
]


def votes(m) -> str:
    return "".join("-0+"[rule(m) + 1] for _, rule in RULES)


def base_failed(n_words: int, repeats: int) -> bool:
    return n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior probability of good for every vote pattern.

    EM for a two-class model with rules independent given the class. It starts from rules
    that are right four times in five, and a rule may never come to be wrong more often than
    right, so that the classes keep their meaning."""
    if not counts:
        return {}
    patterns = sorted(counts)
    v = np.array([["-0+".index(c) - 1 for c in p] for p in patterns])
    w = np.array([counts[p] for p in patterns], float)
    prior, right = 0.7, np.full((v.shape[1], 2), 0.8)  # of class bad and good: the chance that a vote, if given, is right
    spoken = np.full((v.shape[1], 2), 0.5)
    good = np.zeros(len(w))
    for _ in range(rounds):
        score = np.zeros((len(w), 2))
        for c, sign in ((0, -1), (1, 1)):
            for j in range(v.shape[1]):
                vote = v[:, j]
                score[:, c] += np.where(vote == 0, np.log(1 - spoken[j, c]), np.log(spoken[j, c]) + np.where(vote == sign, math.log(right[j, c]), math.log(1 - right[j, c])))
        odds = np.log(prior / (1 - prior)) + score[:, 1] - score[:, 0]
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        mass = np.stack([w * (1 - good), w * good])
        prior = min(0.99, max(0.01, mass[1].sum() / w.sum()))
        for c, sign in ((0, -1), (1, 1)):
            given = mass[c] @ (v != 0)
            right[:, c] = np.clip((mass[c] @ (v == sign) + 8) / (given + 10), 0.51, 0.999)
            spoken[:, c] = np.clip((given + 1) / (mass[c].sum() + 2), 0.001, 0.999)
    return dict(zip(patterns, good.tolist()))


def tallied(batches):
    """Vote patterns of a column of texts, counted."""
    seen: dict[str, int] = {}
    for b in bounded(batches):
        for t in b.column(0).to_pylist():
            p = votes(measure(t))
            seen[p] = seen.get(p, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])


def judge(docs: DataFrame, text_col: str = "text", keep_text: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns by position (c0, c1, ...) with the measures, base_failed, votes, quality and kept."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = position(docs, text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]

    def run(batches):
        for b in bounded(batches):
            rows = []
            for t in b.column(at).to_pylist():
                m = measure(t)
                rows.append((*m[:5], base_failed(m[0], m[4]), votes(m)))
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*[f"c{i}" for i in kept], *names])

    held = ", ".join(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in kept)
    measured = plain.mapInArrow(run, held + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string")
    if keep_text:
        votes_ = plain.select(F.col(f"c{at}").alias("text")).mapInArrow(tallied, "votes string, n long")
    else:
        measured = stored(measured)
        votes_ = measured.select("votes", F.lit(1).cast("long").alias("n"))
    tally = votes_.groupBy("votes").agg(F.sum("n").alias("n"))
    posterior = estimate({r["votes"]: r["n"] for r in tally.collect()})  # at most 3**len(RULES) rows
    told = docs.sparkSession.createDataFrame(list(posterior.items()), "votes string, quality double")
    good = measured.join(F.broadcast(told), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return good.select(*[f"c{i}" for i in kept], *names, "quality", "kept")


def drop_low_quality(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept."""
    return judge(docs, text_col, threshold=threshold).where("kept").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return judge(docs, keep_text=False).withColumnRenamed("c0", "doc_id")
