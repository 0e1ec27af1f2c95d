"""Token ids of a public byte-level BPE vocabulary by proposing and verifying.

A text is cut at spaces and line breaks into pieces, and each distinct piece into words by the tokenizer's pattern.  For each
distinct word, greedy longest match proposes tokens.  A
sequence of tokens is the one that merging gives if and only if every pair of neighbours is compatible, that is, merging
the two tokens' joined bytes gives back just these two; all pairs of a batch are tested together against a sorted table of
known pairs.  Only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts texts into words before byte_bpe_50k merges them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to so many distinct pieces of texts are kept by each Python worker.
CACHE = 400_000
#: Texts with other white space than single spaces and line breaks between characters, which are cut only before such spaces.
_ODD = r"^[ ]|[ \n]$|  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A word of the pattern never crosses the place before a space that a character follows, nor, in other texts, the border
# between a line break and a character.
_BEFORE = re.compile(r"(?= \S)")


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.piece = {v: k for k, v in ranks.items()}
        self.words = regex.compile(pattern)
        #: Tokens of the pieces of plain texts, and of those with other white space.
        self.known: dict[str, tuple[int, ...]] = {}
        self.odd: dict[str, tuple[int, ...]] = {}
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def propose(self, word: bytes) -> list[int]:
        """Tokens by greedy longest match."""
        out, at, ranks = [], 0, self.ranks
        while at < len(word):
            end = min(len(word), at + self.longest)
            while (t := ranks.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Tokens by merging the neighbours of lowest rank, the exact way."""
        ranks = self.ranks
        if (t := ranks.get(word)) is not None and len(word) == 1:
            return [t]
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for long words, with a heap of the mergeable neighbours."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], alive[j], after[i] = joined, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [ranks[p] for p, live in zip(parts, alive) if live]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair (left * size + right) whether merging gives back just the two."""
        if len(pairs) == 0:
            return np.zeros(0, bool)
        asked, back = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, asked), max(len(self.pairs) - 1, 0))
        fresh = asked[self.pairs[at] != asked] if len(self.pairs) else asked
        if len(fresh):
            made = np.array([self.merge(self.piece[int(p) // self.size] + self.piece[int(p) % self.size]) == [int(p) // self.size, int(p) % self.size] for p in fresh], bool)
            if len(self.pairs) > 4 * CACHE:
                self.pairs, self.fits = self.pairs[:0], self.fits[:0]
                return self.compatible(pairs) if len(fresh) < len(asked) else made[back]
            order = np.argsort(both := np.concatenate([self.pairs, fresh]))
            self.pairs, self.fits = both[order], np.concatenate([self.fits, made])[order]
            at = np.searchsorted(self.pairs, asked)
        return self.fits[at][back]

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of distinct words."""
        if not words:
            return {}
        raw = [w.encode() for w in words]
        made = [[t] if (t := self.ranks.get(b)) is not None else self.propose(b) for b in raw]
        sizes = np.array([len(m) for m in made])
        flat = np.fromiter((t for m in made for t in m), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(made)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self.compatible(flat[inner] * self.size + flat[inner + 1])
        for k in np.unique(owner[inner[~fits]]):
            made[k] = self.merge(raw[k])
        return {w: tuple(m) for w, m in zip(words, made)}

    def _know(self, pieces: list[str], known: dict[str, tuple[int, ...]], runs: bool = False) -> list[tuple[int, ...]]:
        """Tokens of distinct pieces; ``runs``: a piece that starts with a line break is a run of them before a character."""
        fresh = [x for x in pieces if x not in known]
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = pieces
        # of several line breaks before a character the last is a word of its own
        cut = [[w for w in (x[1:], "\n") if w] if runs and x[:1] == "\n" else self.words.findall(x) for x in fresh]
        words = self.learn(list({w for ws in cut for w in ws}))
        known.update((x, tuple(t for w in ws for t in words[w])) for x, ws in zip(fresh, cut))
        return [known[x] for x in pieces]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, number of tokens of each text), cut column-wise at spaces and line breaks."""
        marked = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\x1f "), "\n+", "\x1f\\0\x1f")
        pieces = pc.split_pattern(marked, "\x1f")
        row = pc.list_parent_indices(pieces).to_numpy()
        coded = pc.list_flatten(pieces).dictionary_encode()
        code, tokens = coded.indices.to_numpy(), self._know(coded.dictionary.to_pylist(), self.known, True)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int32, int(size.sum()))
        start, many = (np.cumsum(size) - size)[code], size[code]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(start - (ends - many), many)
        return flat[at], np.bincount(row, many, len(texts)).astype(np.int64)

    def encode_batch(self, texts: list[str | None] | pa.Array) -> pa.ListArray:
        """Token ids of each text; null texts count as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        ids, counts = self._plain(texts.filter(pc.invert(odd)))
        if not pc.any(odd).as_py():
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids))
        some = [self._know(_BEFORE.split(t), self.odd) for t in texts.filter(odd).to_pylist()]
        rare = [np.fromiter(chain.from_iterable(x), np.int32) for x in some]
        odd = odd.to_numpy(zero_copy_only=False)
        number, order = np.empty(len(texts), np.int64), np.argsort(np.append(np.flatnonzero(~odd), np.flatnonzero(odd)))
        number[~odd], number[odd] = counts, [len(x) for x in rare]
        both = np.append(counts, number[odd])
        joined = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(both)), pa.int32()), pa.array(np.concatenate([ids, *rare])))
        return joined.take(pa.array(order))

    def count_batch(self, texts: list[str | None] | pa.Array) -> pa.Array:
        return pc.list_value_length(self.encode_batch(texts))


def _slices(texts: pa.Array, characters: int = 4_000_000) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + characters)))
        yield texts[at:upto]
        at = upto


def _by_batches(rows: DataFrame, text: str, name: str, folder: str, out: str, kind: str, read) -> DataFrame:
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(ranks.value)
        for s in batches:
            yield pa.concat_arrays([read(encoder, part) for part in _slices(s)] or [read(encoder, s)])

    return rows.withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(F.col(text)))


def with_token_ids(rows: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, out: str = "ids") -> DataFrame:
    """``rows`` with a column of token ids, without special tokens: their strings are ordinary text.

    An empty text has no ids, and a null text counts as empty: both give an empty list.  Texts of any length are
    encoded whole.  The vocabulary file is read on the driver and sent once to each executor; its size is fixed.
    """
    return _by_batches(rows, text, name, folder, out, "array<int>", Encoder.encode_batch)


def with_token_count(rows: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, out: str = "tokens") -> DataFrame:
    """``rows`` with the number of tokens of each text; 0 for empty and null texts."""
    return _by_batches(rows, text, name, folder, out, "int", Encoder.count_batch)
