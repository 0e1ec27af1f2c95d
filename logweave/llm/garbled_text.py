"""Text decoded with the wrong character encoding, found and restored by a hidden Markov model.

One state is clean text, every other state an encoding pair.  Clean text emits a character by a bigram model; an encoding
pair emits the garbled form (one to eight characters) of a character that the same model rates.  ASCII characters look
alike in every state, so that only the runs of other characters are decoded, with the path carried from run to run.  The
most likely path labels each character; labelled spans get the inverse transform of their state.  The bigram model is
estimated from the data themselves in two rounds over all rows: first without the texts that hold valid multi-byte
sequences of some pair, then from the texts as the first round restores them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
#: Encoding pairs (encoding that wrote, encoding that read, times) of the garbled states.
PAIRS = (
    ("utf-8", "cp1252", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "cp850", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "mac_roman", 1),
    ("utf-8", "cp1251", 1),
    ("cp850", "cp1252", 1),
    ("cp1252", "cp850", 1),
)
CLEAN = 0
#: Log probabilities: into a multi-byte state, into a single-byte state, back to clean, between pairs.
ENTER_MULTI, ENTER_SINGLE, LEAVE, ACROSS = math.log(2e-3), math.log(3e-4), math.log(2e-2), math.log(1e-6)
#: Weight of an unseen bigram, and the share of it that a code point of another block gets.
SMOOTH = 0.02
_RUN = regex.compile(r"[^\x00-\x7f]+")
#: Up to so many results of distinct run sequences are kept by each Python worker.
CACHE = 200_000


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character above ASCII in a single-byte encoding; undefined bytes stand for themselves."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
        if codec == "cp1252":
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=500_000)
def _multi(text: str, codec: str) -> tuple[str, int] | None:
    """(character, length) of the UTF-8 sequence that a text starts with, read by codec."""
    table = _bytes_of(codec)
    lead = table.get(text[:1], 0)
    n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    if not n or len(text) < n:
        return None
    try:
        return bytes(table.get(c, 0) for c in text[:n]).decode("utf-8"), n
    except UnicodeDecodeError:
        return None


def arc(text: str, at: int, state: int) -> tuple[str, int] | None:
    """(restored character, characters consumed) if a state can have written what stands at a position."""
    wrote, read, times = PAIRS[state - 1]
    if wrote != "utf-8":
        b = _bytes_of(read).get(text[at])
        try:
            return None if b is None else (bytes([b]).decode(wrote), 1)
        except UnicodeDecodeError:
            return None
    if times == 1:
        return _multi(text[at : at + 4], read)
    inner, end = "", at
    while len(inner) < 4 and (got := _multi(text[end : end + 4], read)):
        inner, end = inner + got[0], end + got[1]
        if done := _multi(inner, read):
            return done[0], end - at
    return None


def symbol(c: str) -> str:
    """The model's alphabet: digits are alike, and so are the code points of a block beyond U+2FFF."""
    return "0" if c.isascii() and c.isdigit() else c if c < "　" else chr(ord(c) & ~0xFFF | 0xFFF)


class Bigrams:
    """P(next symbol | symbol) from counts of pairs with at least one symbol above ASCII, and of each first symbol."""

    def __init__(self, pairs: dict[tuple[str, str], int], firsts: dict[str, int]):
        self.pairs, self.firsts = pairs, firsts
        self.cache: dict[tuple[str, str], float] = {}

    def log(self, a: str, b: str) -> float:
        key = (a, b)
        if (v := self.cache.get(key)) is None:
            x, y = symbol(a) if a else "", symbol(b) if b else ""
            v = math.log((self.pairs.get((x, y), 0) + SMOOTH) / (self.firsts.get(x, 0) + SMOOTH * 500))
            if len(self.cache) < CACHE:
                self.cache[key] = v
        return v


def count_pairs(texts: list[str], pairs: Counter, firsts: Counter) -> None:
    for t in texts:
        s = "".join(map(symbol, t))
        firsts.update(s)
        firsts[""] += 1
        for m in _RUN.finditer(s):
            a, b = m.span()
            w = s[max(a - 1, 0) : b + 1]
            if a == 0:
                pairs["", w[0]] += 1
            if b == len(s):
                pairs[w[-1], ""] += 1
            pairs.update(zip(w, w[1:]))


def decode_runs(runs: tuple[tuple[str, str, str], ...], model: Bigrams) -> list[list[tuple[int, str]]]:
    """Most likely path of runs (character before, run, character after): for each run (state, restored text) of each arc."""
    states = range(len(PAIRS) + 1)
    enter = [0.0] + [ENTER_MULTI if p[0] == "utf-8" else ENTER_SINGLE for p in PAIRS]

    def move(a: int, b: int) -> float:
        return 0.0 if a == b else enter[b] if a == CLEAN else LEAVE if b == CLEAN else ACROSS

    now: dict[int, tuple[float, str, tuple | None]] = {CLEAN: (0.0, "", None)}  # score, last character, path
    for number, (before, run, after) in enumerate(runs):
        cells: list[dict[int, tuple[float, str, tuple | None]]] = [{} for _ in range(len(run) + 1)]
        cells[0] = {k: (v, before, path) for k, (v, _, path) in now.items()}
        for at in range(len(run)):
            if not cells[at]:
                continue
            for k in states:
                got = (run[at], 1) if k == CLEAN else arc(run, at, k)
                if got is None:
                    continue
                made, n = got
                best = None
                for j, (v, last, path) in cells[at].items():
                    w = v + move(j, k)
                    for a, b in zip((last, *made), made):
                        w += model.log(a, b)
                    if best is None or w > best[0]:
                        best = (w, made[-1], (path, number, k, made))
                old = cells[at + n].get(k)
                if best is not None and (old is None or best[0] > old[0]):
                    cells[at + n][k] = best
        now = {k: (v + model.log(last, after), last, path) for k, (v, last, path) in cells[-1].items()}
    _, _, path = max(now.values(), key=lambda x: x[0])
    out: list[list[tuple[int, str]]] = [[] for _ in runs]
    while path is not None:
        path, number, k, made = path
        out[number].append((k, made))
    return [x[::-1] for x in out]


class Restorer:
    def __init__(self, model: Bigrams):
        self.model = model
        self.cache: dict = {}

    def restore(self, text: str) -> str | None:
        """The restored text, '' where characters are lost, None for clean text."""
        if text.isascii():
            return None
        if LOST in text:
            return ""
        found = list(_RUN.finditer(text))
        key = tuple((symbol(text[m.start() - 1]) if m.start() else "", m[0], symbol(text[m.end()]) if m.end() < len(text) else "") for m in found)
        if key not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            labels = decode_runs(key, self.model)
            self.cache[key] = ["".join(c for _, c in x) for x in labels] if any(k for x in labels for k, _ in x) else None
        if (made := self.cache[key]) is None:
            return None
        out, at = [], 0
        for m, c in zip(found, made):
            out += [text[at : m.start()], c]
            at = m.end()
        out = "".join(out) + text[at:]
        deeper = self.restore(out) if out != text and len(out) < len(text) else None
        return deeper or out


def _suspect(text: str) -> bool:
    return LOST in text or any(arc(m[0], i, k) for m in _RUN.finditer(text) for i in range(len(m[0])) for k, p in enumerate(PAIRS, 1) if p[0] == "utf-8")


def _counted(texts: DataFrame, model: Bigrams | None) -> Bigrams:
    """Counts over all texts: without suspect ones, or, given a model, as it restores them.

    What comes to the driver is bounded by the model's alphabet (symbols below U+3000 and one a block), not by the rows.
    """

    sent = texts.sparkSession.sparkContext.broadcast((model.pairs, model.firsts)) if model else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, firsts = Counter(), Counter()
        restorer = Restorer(Bigrams(*sent.value)) if sent else None
        for b in batches:
            texts = b["text"].tolist()
            if restorer:
                texts = [t if (r := restorer.restore(t)) is None else r for t in texts]
            else:
                texts = [t for t in texts if t.isascii() or not _suspect(t)]
            count_pairs(texts, pairs, firsts)
        made = [(a, b, n) for (a, b), n in pairs.items()] + [(a, None, n) for a, n in firsts.items()]
        yield pd.DataFrame(made, columns=["a", "b", "n"])

    got = texts.mapInPandas(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Bigrams({(r["a"], r["b"]): r["n"] for r in got if r["b"] is not None}, {r["a"]: r["n"] for r in got if r["b"] is None})


def fit(texts: DataFrame, text: str) -> Bigrams:
    """The bigram model of all texts."""
    texts = texts.select(F.col(text).alias("text")).where("text is not null")
    return _counted(texts, _counted(texts, None))


def restored(rows: DataFrame, text: str, model: Bigrams) -> DataFrame:
    """``rows`` with a column ``restored``: the text as it was, '' where characters were lost for good, null for clean text.

    Null and empty texts are clean; texts of any length are read whole; repeated rows are judged alike.
    """
    sent = rows.sparkSession.sparkContext.broadcast((model.pairs, model.firsts))  # once an executor; bounded by the model's alphabet

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(Bigrams(*sent.value))
        for s in batches:
            yield pd.Series([restorer.restore(t) if t else None for t in s.tolist()], dtype=object)

    touched = F.col(text).rlike(r"[^\x00-\x7f]")
    some = rows.where(touched).withColumn("restored", F.pandas_udf(run, "string").asNondeterministic()(F.col(text)))
    return some.unionByName(rows.where(~F.coalesce(touched, F.lit(False))).withColumn("restored", F.lit(None).cast("string")))
