"""BPE encoding and decoding by per-prefix dynamic programming (operator 5).

For every prefix of a word exactly one vocabulary token can be the last token of its
encoding. Matching the word against an automaton of all tokens gives, at each position, the
tokens that end there; the one whose predecessor (the last token of the prefix before it)
forms a compatible pair with it is stored, and the stored tokens are followed back from the
word's end. A pair is compatible if merging the symbols of both gives the pair again; the
answer is remembered for each pair.

Text handling follows the vocabulary file: special tokens are cut out of the raw text, text
is NFC-normalised and lower-cased, white space is dropped, words are split by the file's
pattern and mapped to printable bytes. Words never span white space, so results are
remembered by white-space separated chunk (a bounded memory, refilled when it is full). Only
NFC and lower-casing of text beyond ASCII are the tokenizers library's own.

Defined cases: null counts as empty; an empty text has no ids; repeated rows each get a row.
"""

from __future__ import annotations

import gc
import hashlib
import json
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import tokenizers.normalizers as normalizers
from pyspark.sql import DataFrame

from .common import bounded, pick, position, read

#: What a worker remembers before it starts anew: chunks with their ids and tokens (large), words' ids, and pairs (small, and dear to find again).
CHUNKS, WORDS, PAIRS = 250_000, 83_333, 250_000
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPACES = regex.compile(r"[\x1c-\x1f]")
_END = "\ue000"
#: Letters and numbers of the regex module's newer Unicode tables that the tokenizers library (Unicode 16) doesn't count as such.
_NOT_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a "
    "11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_NOT_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _ranges(spec: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in spec.split())


class Remembered(dict):
    """A bounded memory: when the newer half is full it becomes the older one, whose entries return on use."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def printable_bytes() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str, chunks: int = CHUNKS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        letters, numbers = rf"[\p{{L}}--[{_ranges(_NOT_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(_NOT_NUMBERS)}]]"
        self.wide_words = regex.compile("(?V1)" + split["pattern"]["Regex"].replace(r"\p{L}", letters).replace(r"\p{N}", numbers))
        self.bytes = printable_bytes()
        self.fold = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])  # its Unicode tables differ from Python's
        ids = model["vocab"]
        self.rank = {(ids[a], ids[b]): (k, ids[a.removesuffix(self.suffix) + b] if not a.endswith(self.suffix) else ids[a + b]) for k, (a, b) in enumerate(model["merges"])}
        spelled = {i: (t[: -len(self.suffix)] + _END if t.endswith(self.suffix) and t != self.suffix else t) for t, i in ids.items()}
        self.symbol = {s: i for i, s in spelled.items() if len(s.removesuffix(_END)) == 1}
        self.spelled = spelled
        self.automaton = ahocorasick.Automaton()
        for i, s in spelled.items():
            if self._merge(self._symbols(s)) == [i]:  # else no text ever gives this token
                self.automaton.add_word(s, (len(s.removesuffix(_END)), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known_words = Remembered(WORDS)
        self.known = Remembered(chunks)

    def _symbols(self, s: str) -> list[int]:
        end = s.endswith(_END)
        s = s.removesuffix(_END)
        return [self.symbol[c + _END if end and k == len(s) - 1 else c] for k, c in enumerate(s)]

    def _merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: the lowest-ranked adjacent pair first, leftmost of equals."""
        ids = list(ids)
        while len(ids) > 1:
            found = [(self.rank[p][0], k) for k in range(len(ids) - 1) if (p := (ids[k], ids[k + 1])) in self.rank]
            if not found:
                break
            _, k = min(found)
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b stays as it is."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._merge(self._symbols(self.spelled[a]) + self._symbols(self.spelled[b])) == [a, b]
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (printable bytes, without the end mark)."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        known = self.pairs.get
        for end, (size, token) in self.automaton.iter(word + _END):
            if end == n:
                to = n  # the last byte and the end mark are one symbol
            elif (to := end + 1) == n:
                continue
            if last[to] >= 0:
                continue
            start = to - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = known(before << 20 | token)
                if good is None:
                    good = self.compatible(before, token)
                if not good:
                    continue
            last[to], back[to] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids and decoded tokens of one white-space separated chunk."""
        if not chunk.isascii():
            low, words = self.fold.normalize_str(chunk), self.wide_words
        else:
            low, words = chunk.lower(), self.words
        ids: list[int] = []
        for m in (low,) if low.isalpha() and low.isascii() else words.findall(low):
            got = self.known_words[m]
            if got is None:
                word = m if m.isascii() and m.isprintable() else "".join([self.bytes[b] for b in m.encode("utf-8", "surrogatepass")])
                got = self.encode_word(word)
                if len(m) < 100:
                    self.known_words.put(m, got)
            ids += got
        return len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def _chunks(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        known = self.known
        got = [known[c] for c in chunks]
        if None in got:
            for k, c in enumerate(chunks):
                if got[k] is None:
                    found = known[c]
                    if found is None:
                        found = self._chunk(c)
                        if len(c) < 100:
                            known.put(c, found)
                    got[k] = found
        return got

    def _parts(self, text: str) -> list[tuple[int, str, str]]:
        """Number of ids, ids and tokens of the text's chunks and special tokens."""
        if (not self.specials or "<|" not in text) and not _ODD_SPACES.search(text):
            return self._chunks(text.split())
        out = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            out += [(1, str(self.special[part]), part)] if k % 2 else self._chunks([c for c in _SPACES.split(part) if c])
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, ids, _ in self._parts(text) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by a space; unknown ids give nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by a space, SHA-256 of the decoded text."""
        n, ids, tokens = zip(*parts) if (parts := self._parts(text or "")) else ((), (), ())
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
        return sum(n), sha(ids), sha(tokens)


@lru_cache(maxsize=1)
def load(path: str, chunks: int = CHUNKS) -> WordBpe:
    return WordBpe(path, chunks)


def _mapped(docs: DataFrame, text_col: str, path: str, names: list[str], kinds: list[pa.DataType], sql: str, make, keep_text: bool, chunks: int = CHUNKS) -> DataFrame:
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = position(docs, text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def run(batches):
        coder = load(path, chunks)
        gc.freeze()  # the memory of chunks has no cycles; walking it again and again takes a third of the time
        gc.set_threshold(200_000, 50, 1000)
        for b in bounded(batches):
            cols = list(zip(*[make(coder, t) for t in b.column(at).to_pylist()])) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*[f"c{i}" for i in kept], *names])

    held = "".join(f"c{i} {plain.schema[i].dataType.simpleString()}, " for i in kept)
    out = plain.mapInArrow(run, held + sql)
    return out.toDF(*[docs.columns[i] for i in kept], *names)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with `ids` and `decoded`; existing columns of these names come first, under the same names."""
    make = lambda coder, t: ((ids := coder.encode(t or "")), coder.decode(ids))
    return _mapped(docs, text_col, path or default_vocabulary(), ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()], "ids array<int>, decoded string", make, True)


def digests(docs: DataFrame, text_col: str = "text", path: str | None = None, chunks: int = CHUNKS) -> DataFrame:
    """docs without the text, with `n_tokens`, `ids_sha256` and `decoded_sha256`; workers remember up to `chunks` chunks twice, which changes time and memory only."""
    return _mapped(docs, text_col, path or default_vocabulary(), ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda coder, t: coder.digest(t), False, chunks)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
