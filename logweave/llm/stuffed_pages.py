"""Keyword-stuffed pages and link lists, found by a hidden Markov model over the lines of a page.

A unit is a line; lines of prose are told apart into their sentences, and very long units into pieces.  Each unit is described by a
few categorical features that come from classes of characters and from repetition, not from lists of words: shares of links, hash tags,
codes, list marks and log-like tokens, the share of words that stood shortly before, and the shape of a sentence.  A hidden Markov
model with the states prose, link list, tag list, menu (of repeated words) and log excerpt labels the units, and a page is flagged by the share
of its words in units that are neither prose nor an excerpt, which reports about logs hold.

The model starts from stated expectations and is re-estimated by Baum-Welch over all pages: the features are found once and
written, every round sums the expected counts in the tasks, and only counts by feature code reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import cut

PROSE, LINKS, TAGS, MENU, EXCERPT = range(5)
STATES = 5
#: Words of a unit at most; longer ones are cut into even pieces.
LONGEST = 24
#: A word counts as repeated if it stood at most so many words before on its page.
NEAR = 24
ROUNDS = 3
#: The stated expectations count like this share of all units, whatever their number.
PRIOR = 0.5
#: Units that are stepped together, about.
CELLS = 60_000

# Token classes by their characters; the first that fits holds.
WORD, LINK, TAG, CODE, MARK, LOG = range(6)
_LINK = regex.compile(r"://|^www\.|\]\(|^<a$|^href=|^\p{L}[\p{L}\d]*(?:-[\p{L}\d]+)+(?:\.[\p{L}\d-]+)*\.\p{Ll}{2,}(?:[/?:].*)?$|^[\p{Ll}\d-]+(?:\.[\p{Ll}\d-]+)*\.\p{Ll}{2,}/\S*$|^[\p{Ll}\d-]{2,}\.\p{Ll}{2,5}$")
_TAG = regex.compile(r"^#(?!\d+$)[\w-]{2,}[.,;]?$")
_CODE = regex.compile(r"^[\[(]?\p{L}{1,6}-?\d{1,6}[\])]?[,;|]?$")
_MARK = regex.compile(r"^[^\p{L}\p{N}\s]+$")
_LOG = regex.compile(
    r"^[\[<\"'(]?\d{4}[-/]\d\d[-/]\d\d|^\[?\d\d:\d\d:\d\d|^\[?\p{Lu}{4,}[\]:]?$|^[\w.@]+=|^\"[@\w.]+\":|^[{}\[\]]+$|^<\d+>|^[\p{L}\d_$]+(?:[.:/]{1,2}[\p{L}\d_$]+){2,}$|^\w+\[\d+\]:?$|\w\([\w.:$]*\)$|^\d+#\d+:$"
)
_EDGE = regex.compile(r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}]+$")
_FENCE = "```"
#: Number of values of each feature: links, hash tags, codes, marks, repetition, sentence shape, log-like tokens.
SIZES = (3, 3, 3, 3, 4, 3, 3)
CODES = int(np.prod(SIZES))


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(token, line and page of each token; distinct tokens), lines numbered over all texts, fence lines left out; and which lines are fenced."""
    lines = pc.split_pattern(texts, "\n")
    page = pc.list_parent_indices(lines).to_numpy()
    flat = pc.utf8_trim_whitespace(pc.list_flatten(lines))
    fence = pc.starts_with(flat, _FENCE).to_numpy(zero_copy_only=False)
    total = np.cumsum(fence)
    first = np.searchsorted(page, np.arange(len(texts)))
    before = np.concatenate([[0], total])[first]
    fenced = (total - before[page]) % 2 == 1
    words = pc.utf8_split_whitespace(flat)
    line = pc.list_parent_indices(words).to_numpy()
    tokens = pc.list_flatten(words)
    keep = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False) & ~fence[line]
    coded = tokens.filter(pa.array(keep)).dictionary_encode()
    return coded.indices.to_numpy(), line[keep], page, fenced, coded.dictionary.to_pylist()


def _classes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, number of the bare word or -1, flags) of distinct tokens; flags: 1 starts in lower case, 2 ends a sentence, 4 starts with a capital, 8 ends with a list mark."""
    kind, bare, flags = np.zeros(len(words), np.int8), np.full(len(words), -1, np.int64), np.zeros(len(words), np.int8)
    seen: dict[str, int] = {}
    for k, w in enumerate(words):
        flags[k] = w[0].islower() | (w[-1] in ".!?…") << 1 | w[0].isupper() << 2 | (w[-1] in ",;|") << 3
        if w.isalpha():
            if len(w) > 3 and w.isupper():
                kind[k] = LOG
            elif len(w) > 2:
                bare[k] = seen.setdefault(w.lower(), len(seen))
            continue
        low = _EDGE.sub("", w).lower()
        if _LINK.search(w):
            kind[k] = LINK
        elif _TAG.search(w):
            kind[k], bare[k] = TAG, seen.setdefault(low.rstrip("0123456789"), len(seen))
        elif _MARK.search(w):
            kind[k] = MARK
        elif _CODE.search(w):
            kind[k] = CODE
        elif _LOG.search(w):
            kind[k] = LOG
        elif len(low) > 2 and not low.isdigit():
            bare[k] = seen.setdefault(low, len(seen))
    return kind, bare, flags


def _level(share: np.ndarray, *bounds: float) -> np.ndarray:
    return np.searchsorted(np.array(bounds), share, "left")


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature code, words, page) of each unit of the texts, in order."""
    token, line, page_of, fenced, words = _split(texts)
    if not len(token):
        return (np.zeros(0, np.int64),) * 3
    kinds, bares, flags = _classes(words)
    kind, bare, flag, page = kinds[token], bares[token], flags[token], page_of[line]
    n = len(token)
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | ((flag[:-1] & 2 > 0) & (flag[1:] & 4 > 0))
    unit = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    pieces = -(-size // LONGEST)
    piece = (np.arange(n) - start[unit]) * pieces[unit] // size[unit]
    new[1:] |= piece[1:] != piece[:-1]
    unit, start = np.cumsum(new) - 1, np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    share = [np.bincount(unit[kind == c], minlength=len(start)) / size for c in range(6)]
    listed = np.bincount(unit[(kind != MARK) & (flag & 8 > 0)], minlength=len(start)) / size
    # words that stood shortly before on their page
    told = np.flatnonzero(bare >= 0)
    order = told[np.lexsort((told, bare[told], page[told]))]
    near = np.zeros(n, bool)
    same = (bare[order[1:]] == bare[order[:-1]]) & (page[order[1:]] == page[order[:-1]]) & (order[1:] - order[:-1] <= NEAR)
    near[order[1:][same]] = True
    plain = np.bincount(unit[told], minlength=len(start))
    again = np.bincount(unit[near], minlength=len(start)) / np.maximum(plain, 1)
    lower = np.bincount(unit[flag & 1 > 0], minlength=len(start)) / size
    last = np.append(start[1:], n) - 1
    ended = np.maximum.reduceat(flag & 2, start) > 0
    closed = (flag[last] & 2 > 0) | (flag[np.maximum(last - 1, start)] & 2 > 0)  # a sign may stand behind
    opened = (flag[start] | flag[np.minimum(start + 1, last)] | flag[np.minimum(start + 2, last)]) & 4 > 0  # or a mark and a label before
    shape = np.where(opened & closed & (lower >= 0.5) & (size >= 4), 2, ended.astype(np.int64))
    log = np.maximum(_level(share[LOG], 0.1, 0.25), fenced[line[start]].astype(np.int64))
    parts = (_level(share[LINK], 0.0, 0.2), _level(share[TAG], 0.0, 0.2), _level(share[CODE], 0.0, 0.12), _level(share[MARK] + listed, 0.12, 0.28), _level(again, 0.25, 0.45, 0.7), shape, log)
    return np.ravel_multi_index(parts, SIZES), size, page[start]


#: Expected emissions of each state before fitting, feature by feature.
START = (
    ((0.93, 0.05, 0.02), (0.97, 0.02, 0.01), (0.90, 0.08, 0.02), (0.88, 0.10, 0.02), (0.58, 0.32, 0.08, 0.02), (0.10, 0.20, 0.70), (0.93, 0.06, 0.01)),
    ((0.05, 0.10, 0.85), (0.90, 0.05, 0.05), (0.94, 0.04, 0.02), (0.50, 0.20, 0.30), (0.35, 0.15, 0.20, 0.30), (0.93, 0.06, 0.01), (0.96, 0.03, 0.01)),
    ((0.90, 0.06, 0.04), (0.50, 0.05, 0.45), (0.40, 0.05, 0.55), (0.55, 0.20, 0.25), (0.20, 0.20, 0.25, 0.35), (0.92, 0.07, 0.01), (0.96, 0.03, 0.01)),
    ((0.92, 0.05, 0.03), (0.92, 0.05, 0.03), (0.95, 0.04, 0.01), (0.55, 0.25, 0.20), (0.02, 0.06, 0.17, 0.75), (0.80, 0.19, 0.01), (0.97, 0.02, 0.01)),
    ((0.94, 0.04, 0.02), (0.97, 0.02, 0.01), (0.92, 0.06, 0.02), (0.60, 0.28, 0.12), (0.50, 0.24, 0.16, 0.10), (0.70, 0.27, 0.03), (0.03, 0.32, 0.65)),
)
FIRST = (0.66, 0.1, 0.1, 0.1, 0.04)
MOVE = (
    (0.93, 0.02, 0.02, 0.02, 0.01),
    (0.04, 0.90, 0.03, 0.02, 0.01),
    (0.04, 0.03, 0.90, 0.02, 0.01),
    (0.04, 0.02, 0.02, 0.91, 0.01),
    (0.06, 0.01, 0.01, 0.01, 0.91),
)
#: Values of the features of each code.
_PARTS = np.array(np.unravel_index(np.arange(CODES), SIZES))


class Model:
    def __init__(self, first=FIRST, move=MOVE, emit=START):
        self.first, self.move = np.array(first), np.array(move)
        self.emit = [np.array([emit[s][f] for s in range(STATES)]) for f in range(len(SIZES))]
        table = np.ones((CODES, STATES))
        for e, x in zip(self.emit, _PARTS):
            table *= e[:, x].T
        self.table = np.vstack([table, np.ones(STATES)])  # the last row fills up short pages

    def posteriors(self, pages: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of pages of like length, stepped together: (numbers, lengths, codes, probability of each state in each unit, expected moves)."""
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            some = order[-max(1, CELLS // longest) :]
            del order[-len(some) :]
            sizes = np.array([len(pages[k]) for k in some])
            codes = np.full((len(some), longest), CODES)
            for r, k in enumerate(some):
                codes[r, : sizes[r]] = pages[k]
            b = self.table[codes]
            a, p = np.empty_like(b), np.empty_like(b)
            a[:, 0] = self.first * b[:, 0]
            for t in range(longest):
                if t:
                    a[:, t] = (a[:, t - 1] @ self.move) * b[:, t]
                a[:, t] /= a[:, t].sum(1, keepdims=True)
            c, moves = np.ones((len(some), STATES)), np.zeros((STATES, STATES))
            for t in range(longest - 1, -1, -1):
                p[:, t] = a[:, t] * c
                p[:, t] /= p[:, t].sum(1, keepdims=True)
                bc = b[:, t] * c
                if t:
                    joint = a[:, t - 1, :, None] * self.move * bc[:, None, :]
                    joint /= joint.sum((1, 2), keepdims=True)
                    moves += joint[t < sizes].sum(0)
                c = bc @ self.move.T
                c /= c.sum(1, keepdims=True)
                c[t >= sizes] = 1.0
            yield some, sizes, codes, p, moves

    def counts(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected (first states, moves, states of each code)."""
        first, move, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CODES + 1, STATES))
        for _, _, codes, p, moves in self.posteriors(pages):
            first += p[:, 0].sum(0)
            move += moves
            for s in range(STATES):
                seen[:, s] += np.bincount(codes.ravel(), p[:, :, s].ravel(), CODES + 1)
        return first, move, seen[:CODES]

    def refit(self, first: np.ndarray, move: np.ndarray, seen: np.ndarray, prior: float = PRIOR) -> "Model":
        """The model of expected counts, in which the stated expectations count like a share of all units, parted evenly among the states."""
        weight = prior * seen.sum() / STATES
        first = first + prior * first.sum() * np.array(FIRST)
        move = move + weight * np.array(MOVE)
        emit = []
        for f, size in enumerate(SIZES):
            e = weight * np.array([START[s][f] for s in range(STATES)])
            for v in range(size):
                e[:, v] += seen[_PARTS[f] == v].sum(0)
            emit.append(e / e.sum(1, keepdims=True))
        # rounded, so that the order in which tasks are summed doesn't show
        return Model(np.round(first / first.sum(), 9), np.round(move / move.sum(1, keepdims=True), 9), [[np.round(emit[f][s], 9) for f in range(len(SIZES))] for s in range(STATES)])

    def shares(self, pages: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Share of each page's words in units that are neither prose nor an excerpt; 0 for pages without words."""
        out = np.zeros(len(pages))
        for some, lengths, _, p, _ in self.posteriors(pages):
            label = p.argmax(2)
            odd = (label != PROSE) & (label != EXCERPT)
            for r, k in enumerate(some):
                w = sizes[k]
                out[k] = w[odd[r, : lengths[r]]].sum() / w.sum()
        return out


def with_units(pages: DataFrame, text: str) -> DataFrame:
    """``pages`` with the struct column ``units``: feature codes and words of the units of each text, whole; null for a null text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            codes, sizes, page = units(pa.array(s.fillna(""), pa.string()))
            bounds = np.searchsorted(page, np.arange(1, len(s)))
            yield pd.DataFrame({"codes": np.split(codes.astype(np.int16), bounds), "sizes": np.split(sizes.astype(np.int16), bounds)})

    made = F.pandas_udf(run, "codes array<short>, sizes array<short>").asNondeterministic()(F.col(text))
    return pages.withColumn("units", made)


def fit(coded: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model fitted, without labels, on all pages of ``with_units``."""
    model = Model()

    def run(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
        first, move, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CODES, STATES))
        for b in batches:
            one = model.counts([np.asarray(c) for c in b["codes"] if c is not None])
            first, move, seen = first + one[0], move + one[1], seen + one[2]
        rows = np.vstack([first, move, seen])
        used = np.flatnonzero(rows.sum(1))
        yield pd.DataFrame({"key": used} | {f"s{k}": rows[used, k] for k in range(STATES)})

    schema = "key int, " + ", ".join(f"s{k} double" for k in range(STATES))
    for _ in range(rounds):
        now = model
        counts = coded.select("units.codes").mapInPandas(lambda it, m=now: run(it, m), schema).groupBy("key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)])
        rows = np.zeros((1 + STATES + CODES, STATES))
        for r in counts.collect():  # at most as many rows as there are feature codes
            rows[r["key"]] = r[1:]
        if not rows[1 + STATES :].any():
            return model
        model = model.refit(rows[0], rows[1 : 1 + STATES], rows[1 + STATES :])
    return model


def with_share(pages: DataFrame, text: str, rounds: int = ROUNDS, out: str = "non_prose") -> DataFrame:
    """``pages`` with the share of words that aren't in prose or log excerpts, by a model fitted on all of them.

    Texts are read whole and once; equal texts get equal shares; null, empty and blank texts get 0; an empty table gives no rows.  Further
    columns are kept; a column ``units`` is replaced.
    """
    names = [c for c in pages.columns if c not in (text, "units")]
    coded = cut(with_units(pages, text).select(*names, "units"))
    model = fit(coded, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            none = np.zeros(0, np.int64)
            yield pd.Series(model.shares([none if c is None else np.asarray(c) for c in b["codes"]], [none if c is None else np.asarray(c) for c in b["sizes"]]))

    return coded.withColumn(out, F.pandas_udf(run, "double").asNondeterministic()(F.col("units"))).drop("units")
