"""Language identification with segmentation-marginalised unigrams (operator 4).

Every language has a unigram model over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by a forward
algorithm; a text's is the product over its words (runs of letters, lower-cased, marked at
their start as in the vocabulary).

The models are learnt in one expectation step over all training rows: under a rank-based prior
over pieces, a forward-backward pass gives each word's expected piece counts, which are summed
by language (a table of pieces times languages, whatever the corpus). Counts are smoothed
towards the prior. Learning and scoring work on word types, many at once, in logarithms, so
words may be of any length; workers remember a bounded number of types. The score is the best
language's share of the texts' probabilities per word (their geometric mean), so that it does
not come to 1 only because a text is long.

Defined cases: texts that are null or have no letter are `und` with score 0; without any
training row all are. Rows without a language or an id don't train. Ties go to the language
that sorts first; repeated rows each get a row (and each count in training).
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pick, read

#: Word types a worker remembers, characters handled at once, weight of the prior in pieces' counts.
TYPES = 500_000
CHARACTERS = 150_000
PRIOR_COUNT = 2000.0
#: Log-probability of a character that no piece has: the same in every language.
UNKNOWN = -20.0
_WORD = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)) and not any(map(str.isalpha, text)):
        return []
    return found


class Pieces:
    """The vocabulary: an automaton over its pieces and their prior."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        seen: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if not (len(model.id_to_piece(i)) > 255 or model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).lower()
                seen.setdefault(piece, len(seen))
        self.count = len(seen) + 1  # the last stands for unknown characters
        self.automaton = ahocorasick.Automaton()
        for piece, k in seen.items():
            self.automaton.add_word(piece, len(piece) << 24 | k)
        self.automaton.make_automaton()
        self.single = np.zeros(0x110000, bool)  # characters that are pieces, and the separator
        self.single[[ord(p) for p in seen if len(p) == 1] + [10]] = True
        rank = 1 / (np.arange(len(seen)) + 50.0)
        self.prior = np.concatenate([np.log(rank / rank.sum()), [UNKNOWN]])

    def lattice(self, types: list[str]):
        """(word, start, end, piece) of every piece in every marked type, by end and word; and the lengths."""
        text = "\n" + "\n".join(["▁" + t for t in types])  # no piece has the separator
        lengths = np.array([len(t) + 1 for t in types])
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) + 1
        owner = np.repeat(np.arange(len(types)), lengths + 1)
        found = np.array([e << 32 | c for e, c in self.automaton.iter(text)], np.int64)
        at, size, piece = found >> 32, found >> 24 & 0xFF, found & 0xFFFFFF
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = np.flatnonzero(~self.single[points])
        at = np.concatenate([at, odd])
        size, piece = np.concatenate([size, np.ones(len(odd), np.int64)]), np.concatenate([piece, np.full(len(odd), self.count - 1)])
        word = owner[at]
        end = at - first[word] + 1
        order = np.argsort(end * len(types) + word, kind="stable")
        word, end, size, piece = word[order], end[order], size[order], piece[order]
        return word, end - size, end, piece, lengths


def _steps(key: np.ndarray):
    """Slices of equal values in a sorted array."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]) if len(key) else ()


def forward(word, start, end, piece, lengths, log_p: np.ndarray) -> np.ndarray:
    """Log-sums over the segmentations of every prefix: (word, position, language)."""
    alpha = np.full((len(lengths), int(lengths.max()) + 1, log_p.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for a, b in _steps(end):
        w = word[a:b]
        runs = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
        alpha[w[runs], end[a]] = np.logaddexp.reduceat(alpha[w, start[a:b]] + log_p[piece[a:b]], runs, axis=0)
    return alpha


def expected(types: list[str], weights: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected counts (piece, language) of the types, weighted by their counts in each language."""
    word, start, end, piece, lengths = pieces.lattice(types)
    log_p = pieces.prior[:, None]
    alpha = forward(word, start, end, piece, lengths, log_p)[:, :, 0]
    beta = np.full_like(alpha, -np.inf)
    beta[np.arange(len(types)), lengths] = 0
    order = np.lexsort((word, -start))
    w2, s2, e2, p2 = word[order], start[order], end[order], piece[order]
    for a, b in _steps(s2):
        w = w2[a:b]
        runs = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
        beta[w[runs], s2[a]] = np.logaddexp.reduceat(beta[w, e2[a:b]] + pieces.prior[p2[a:b]], runs)
    total = alpha[np.arange(len(types)), lengths]
    post = np.exp(alpha[word, start] + pieces.prior[piece] + beta[word, end] - total[word])
    return np.stack([np.bincount(piece, post * weights[word, k], pieces.count) for k in range(weights.shape[1])], axis=1)


def by_size(types: list[str]):
    """Types in groups of like length and bounded size."""
    held, size = [], 0
    for t in sorted(types, key=len):
        if held and (len(held) + 1) * (len(t) + 1) > CHARACTERS:
            yield held
            held = []
        held.append(t)
    if held:
        yield held


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    return Pieces(path)


def learn(rows: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (piece, language) and log-priors, from all rows of (text, lang)."""

    def count(batches):
        pieces = load(path)
        seen: dict[str, dict[str, int]] = {}
        documents: dict[str, int] = {}
        held = 0

        def flush():
            langs = sorted(seen)
            totals = np.zeros((pieces.count, len(langs)))
            for group in by_size(list({t for x in seen.values() for t in x})):
                totals += expected(group, np.array([[seen[x].get(t, 0) for x in langs] for t in group], float), pieces)
            for k, x in enumerate(langs):
                at = np.flatnonzero(totals[:, k])
                yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array([*at.tolist(), -1], pa.int32()), pa.array([*totals[at, k].tolist(), float(documents[x])])], names=["lang", "piece", "n"])

        for b in bounded(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = seen.setdefault(lang, {})
                documents[lang] = documents.get(lang, 0) + 1
                before = len(at)
                for w in words(text):
                    at[w] = at.get(w, 0) + 1
                held += len(at) - before
            if held > TYPES:
                yield from flush()
                seen, documents, held = {}, {}, 0
        if seen:
            yield from flush()

    summed = rows.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()  # pieces times languages at most
    found = summed.to_pydict()
    langs = sorted(set(found["lang"]))
    pieces = load(path)
    counts, documents = np.zeros((pieces.count, len(langs))), np.zeros(len(langs))
    for x, p, n in zip(found["lang"], found["piece"], found["n"]):
        if p < 0:
            documents[langs.index(x)] = n
        else:
            counts[p, langs.index(x)] = n
    counts[-1] = 0
    smooth = counts + PRIOR_COUNT * np.exp(pieces.prior)[:, None]
    log_p = np.log(smooth / smooth.sum(axis=0)) if langs else smooth
    log_p[-1] = UNKNOWN
    return langs, log_p, np.log(documents / documents.sum()) if langs else documents


class Scorer:
    """Text scores by language; remembers word types."""

    def __init__(self, log_p: np.ndarray, pieces: Pieces):
        self.log_p, self.pieces = log_p, pieces
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, log_p.shape[1]))

    def texts(self, split: list[list[str]]) -> np.ndarray:
        number = self.number
        fresh = {w for ws in split for w in ws if w not in number}
        if len(number) + len(fresh) > TYPES:
            number.clear()
            fresh, self.rows = {w for ws in split for w in ws}, self.rows[:0]
        new = [self.rows]
        for group in by_size(list(fresh)):
            word, start, end, piece, lengths = self.pieces.lattice(group)
            new.append(forward(word, start, end, piece, lengths, self.log_p)[np.arange(len(group)), lengths])
            for w in group:
                number[w] = len(number)
        self.rows = np.concatenate(new) if len(new) > 1 else self.rows
        out = np.zeros((len(split), self.log_p.shape[1]))
        for k, ws in enumerate(split):
            if ws:
                out[k] = self.rows[[number[w] for w in ws]].sum(axis=0)
        return out


_KEPT: dict[str, Scorer] = {}


def kept_scorer(name: str, log_p: np.ndarray, pieces: Pieces) -> Scorer:
    """The worker's scorer of one call of `identify`, with the types that earlier tasks met."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Scorer(log_p, pieces)
    return _KEPT[name]


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_text_col: str = "text", train_lang_col: str = "lang", path: str | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """(id, further columns of `more`, lang_pred, score) for every row of docs, by models learnt from all of train with a language."""
    spark = docs.sparkSession
    path = path or default_vocabulary()
    rows = pick(train, text=train_text_col, lang=train_lang_col).where("lang is not null")
    langs, log_p, prior = learn(rows, path)
    sent = spark.sparkContext.broadcast(log_p)  # pieces times languages
    base = pick(docs, id=id_col, text=text_col, **(more or {}))
    kept = [i for i, c in enumerate(base.columns) if c != "text"]
    names = [base.columns[i] for i in kept] + ["lang_pred", "score"]
    call = uuid.uuid4().hex

    def run(batches):
        scorer = kept_scorer(call, sent.value, load(path))
        for b in bounded(batches):
            split = [words(t) for t in b.column(1).to_pylist()]
            best, score = ["und"] * len(split), [0.0] * len(split)
            if langs:
                total = scorer.texts(split) + prior
                top = total.argmax(axis=1)
                per_word = (total - total.max(axis=1, keepdims=True)) / np.maximum(1, [len(ws) for ws in split])[:, None]
                share = 1 / np.exp(per_word).sum(axis=1)
                for k, ws in enumerate(split):
                    if ws:
                        best[k], score[k] = langs[int(top[k])], float(share[k])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=names)

    held = ", ".join(f"{base.columns[i]} {base.schema[i].dataType.simpleString()}" for i in kept)
    return base.mapInArrow(run, held + ", lang_pred string, score double")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    train = docs.where((fold != 1) & F.col("lang").isNotNull()).select("text", "lang")
    out = identify(docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), train, more={"held_out": "held_out"})
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")
