"""Delimited records into typed rows, and the records that fail with reason and offset.

A quote-aware finite-state machine reads raw records.  The text of a batch, or of a file, is cut into chunks.  The machine's
transition maps form a small monoid: a chunk's effect is one of its elements, found for all chunks together, one
character column at a time, without knowing the state before the chunk.  Composing the elements gives the state at the start
of every chunk, and each chunk is then tokenised from it.  ``load_delimited`` does so for records that stand in rows,
``file_records`` for files, whose blocks are read by different tasks and whose records may cross blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States: at a field's start, in a bare field, in a quoted field, after a quote mark within a quoted field, failed.
START, BARE, QUOTED, AFTER, FAILED = range(5)
# Character classes: other, delimiter, quote mark, line break, end of a record that stands in a row of its own.
OTHER, DELIMITER, QUOTE, BREAK, END = range(5)
#: The machine: NEXT[state, class].  The end of a record closes its last field and starts the next record.
NEXT = np.array(
    [
        [BARE, START, QUOTED, BARE, START],
        [BARE, START, FAILED, BARE, START],
        [QUOTED, QUOTED, AFTER, QUOTED, START],
        [FAILED, START, QUOTED, FAILED, START],
        [FAILED, FAILED, FAILED, FAILED, START],
    ],
    np.int8,
)
#: The same machine over a file of records: a bare line break ends a record, and a failed record ends with its line.
FILE_NEXT = NEXT.copy()
FILE_NEXT[[START, BARE, AFTER, FAILED], BREAK] = START
#: Characters of a chunk within a batch, and characters that are stepped together at most (one record may be longer).
CHUNK, TOGETHER = 512, 4_000_000


class Machine:
    """A state machine with the monoid of its transition maps: element 0 changes nothing."""

    def __init__(self, following: np.ndarray):
        self.following = following
        states, kinds = following.shape
        maps = [tuple(range(states))]
        index = {maps[0]: 0}
        step: list[list[int]] = []
        for m in maps:  # grows while it is read: every element by every class
            step.append([])
            for c in range(kinds):
                made = tuple(int(following[s, c]) for s in m)
                if made not in index:
                    index[made] = len(maps)
                    maps.append(made)
                step[-1].append(index[made])
        self.maps = np.array(maps, np.int8)
        self.step = np.array(step, np.int16)
        self.product = np.array([[index[tuple(int(self.maps[b][s]) for s in self.maps[a])] for b in range(len(maps))] for a in range(len(maps))], np.int16)

    def _columns(self, kinds: np.ndarray, chunk: int) -> np.ndarray:
        """Classes as (place in the chunk, chunk); the last chunk is filled up at its end by class -1."""
        count = max(1, -(-len(kinds) // chunk))
        full = np.full(count * chunk, -1, np.int8)
        full[: len(kinds)] = kinds
        return np.ascontiguousarray(full.reshape(count, chunk).T)

    def elements(self, kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The element of each chunk of a text."""
        columns = self._columns(kinds, chunk)
        now = np.zeros(columns.shape[1], np.int16)
        open_ = columns[-1, -1] == -1
        for column in columns:
            now[: len(now) - open_] = self.step[now[: len(now) - open_], column[: len(now) - open_]]
            if open_ and column[-1] >= 0:
                now[-1] = self.step[now[-1], column[-1]]
        return now

    def compose(self, elements) -> int:
        """The element of chunks that follow one another."""
        out = 0
        for e in elements:
            out = int(self.product[out, e])
        return out

    def starts(self, elements: np.ndarray, state: int = START) -> np.ndarray:
        """The state at the start of each chunk, if the first starts in ``state``: exclusive products, in as many rounds as their number has bits."""
        before = np.concatenate([np.zeros(1, np.int16), elements[:-1]])
        reach = 1
        while reach < len(before):
            before[reach:] = self.product[before[:-reach], before[reach:]]
            reach *= 2
        return self.maps[before, state]

    def element(self, kinds: np.ndarray) -> int:
        return self.compose(self.elements(kinds).tolist())

    def states(self, kinds: np.ndarray, state: int = START, chunk: int = CHUNK) -> np.ndarray:
        """The state after each character: every chunk is stepped from the state that the composed elements give."""
        columns = self._columns(kinds, chunk)
        now = self.starts(self.elements(kinds, chunk), state)
        out = np.empty(columns.shape, np.int8)
        for j, column in enumerate(columns):
            now = self.following[now, column]  # class -1 only fills up the end
            out[j] = now
        return out.T.ravel()[: len(kinds)]


RECORDS, FILE = Machine(NEXT), Machine(FILE_NEXT)


def classes(text: str, delimiter: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(codes), np.int8)
    out[codes == 10] = BREAK
    out[codes == 34] = QUOTE
    out[codes == ord(delimiter)] = DELIMITER
    return out


def _cells(text: str, borders: list[int]) -> list[str]:
    out, a = [], 0
    for b in [*borders, len(text)]:
        out.append(text[a + 1 : b - 1].replace('""', '"') if text[a : a + 1] == '"' else text[a:b])
        a = b + 1
    return out


def tokenize(texts: list[str], delimiter: str, chunk: int = CHUNK) -> tuple[list[list[str] | None], np.ndarray]:
    """(fields of each record, or None; character offset of the quoting error, or -1)."""
    fields: list[list[str] | None] = []
    wrong: list[int] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < TOGETHER):
            size += len(texts[upto]) + 1
            upto += 1
        some = texts[at:upto]
        ends = np.cumsum([len(t) + 1 for t in some]) - 1
        kinds = classes("\0".join(some) + "\0", delimiter)
        kinds[ends] = END
        after = RECORDS.states(kinds, START, chunk)
        before = np.concatenate([np.array([START], np.int8), after[:-1]])
        first = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        bad = np.full(len(some), -1, np.int64)
        failed = np.flatnonzero(((after == FAILED) & (before != FAILED)) | ((kinds == END) & (before == QUOTED)))
        who, where = np.unique(np.searchsorted(ends, failed), return_index=True)
        bad[who] = failed[where] - first[who]
        borders = np.flatnonzero((kinds == DELIMITER) & (after == START))
        bounds = np.searchsorted(borders, np.append(first, ends[-1] + 1)).tolist()
        for k, t in enumerate(some):
            fields.append(None if bad[k] >= 0 else _cells(t, (borders[bounds[k] : bounds[k + 1]] - first[k]).tolist()))
        wrong += bad.tolist()
        at = upto
    return fields, np.array(wrong, np.int64)


def _real_date(text: str, day_first) -> bool:
    iso = day_first is None or day_first != day_first
    mark = "-" if iso else "/"
    parts = text.split(mark)
    if len(parts) != 3 or not all(p.isascii() and p.isdigit() for p in parts):
        return False
    y, m, d = (parts[0], parts[1], parts[2]) if iso else (parts[2], parts[1], parts[0]) if day_first else (parts[2], parts[0], parts[1])
    if (len(y), len(m), len(d)) != (4, 2, 2):
        return False
    try:
        pd.Timestamp(year=int(y), month=int(m), day=int(d))
    except ValueError:
        return False
    return y != "0000"


def _real_time(text: str) -> bool:
    return len(text) == 8 and text[2] == text[5] == ":" and all(p.isascii() and p.isdigit() for p in text.split(":")) and len(text.split(":")) == 3 and text < "24" and text[3] < "6" and text[6] < "6"


#: The driver's feed: a column's number, from the end if negative, and what its values must be.
FEED = {0: "date", 1: "time", 2: "level", -1: "digits"}


def judge(fields: list[str], columns: int, day_first, levels: frozenset, dates: dict, schema: Mapping[int, str] = FEED) -> tuple[str | None, int | None]:
    """(first reason that holds, number of the field) of a record without quoting errors."""
    if len(fields) != columns:
        return "columns", min(len(fields), columns)
    for k, kind in schema.items():
        if not -len(fields) <= k < len(fields):
            continue
        text = fields[k]
        if kind == "date":
            key = (text, None if day_first != day_first else day_first)
            if key not in dates:
                if len(dates) > 100_000:
                    dates.clear()
                dates[key] = _real_date(*key)
            good = dates[key]
        elif kind == "time":
            good = _real_time(text)
        elif kind == "level":
            good = text.lower() in levels
        elif kind == "digits":
            good = not text or text.isascii() and text.isdigit()
        else:
            raise ValueError(f"unknown kind of value {kind!r}")
        if not good:
            return "value", k % len(fields)
    return None, None


_SCHEMA = "reason string, error_at long, error_field int, fields array<string>"


def load_delimited(rows: DataFrame, origin: DataFrame, levels: dict[str, str], raw: str = "raw", part: str = "part_file", keep_fields: bool = True,
                   schema: Mapping[int, str] = FEED) -> DataFrame:
    """``rows`` with a struct column ``load``: reason, error_at, error_field and fields of each raw record.

    reason is null for a valid record, else the first that holds of ``quoting`` (error_at: character offset), ``columns`` and
    ``value`` (error_field: number of the field, from 0); fields holds the unquoted values unless quoting fails.  Header,
    delimiter and date order come from ``origin`` (a fixed table, one row a file), the kinds of values from ``schema`` (date,
    time, level or digits by the column's number; other columns take any text).  A null record counts as empty; a record
    of a file without header or delimiter gets the reason ``origin``; repeated rows are judged alike, each for itself.
    """
    known = {r["part_file"]: (r["delimiter"], r["header"], r["day_first"]) for r in origin.collect() if r["delimiter"] and r["header"]}
    spelled, schema = frozenset(levels), dict(schema)

    def load(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        dates: dict = {}
        width = {p: len(tokenize([h], d)[0][0] or []) for p, (d, h, _) in known.items()}
        for text, files in batches:
            texts, files = text.fillna("").tolist(), files.tolist()
            out: list = [("origin", None, None, None)] * len(texts)
            for delimiter in {known[f][0] for f in set(files) if f in known}:
                at = [i for i, f in enumerate(files) if f in known and known[f][0] == delimiter]
                fields, bad = tokenize([texts[i] for i in at], delimiter)
                for i, f, b in zip(at, fields, bad.tolist()):
                    if f is None:
                        out[i] = ("quoting", b, None, None)
                    else:
                        reason, where = judge(f, width[files[i]], known[files[i]][2], spelled, dates, schema)
                        out[i] = (reason, None, where, f if keep_fields else None)
            made = pd.DataFrame(out, columns=["reason", "error_at", "error_field", "fields"])
            yield made.astype({"error_at": "Int64", "error_field": "Int32"})

    return rows.withColumn("load", F.pandas_udf(load, _SCHEMA).asNondeterministic()(F.col(raw), F.col(part)))


_BLOCK = "part_path string, block long, element int"
_RECORD = "part_path string, block long, line_no long, place int, raw string, error_at long, cells array<string>"


def _block_elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a block of a file: the element of its lines that hold a quote mark; the others leave the state at a line's start as it is."""
    now = element = None
    for b in batches:
        out = []
        for key, some in b.groupby(["part_path", "block", "delimiter"], sort=False, dropna=False):
            if key != now:
                if now is not None:
                    out.append((*now[:2], element))
                now, element = key, 0
            element = FILE.compose([element, FILE.element(classes("\n".join(some["line"].tolist()) + "\n", key[2]))])
        yield pd.DataFrame(out, columns=["part_path", "block", "element"])
    if now is not None:
        yield pd.DataFrame([(*now[:2], element)], columns=["part_path", "block", "element"])


def _block_starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file that start within a quoted field: one narrow row a block is read."""
    blocks = blocks.sort_values("block")
    starts = FILE.starts(blocks["element"].to_numpy(np.int16))
    return blocks[starts == QUOTED][["part_path", "block"]]


# A record's place in its block: whole, or the piece that a block starts with, ends with, or consists of.
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def _block_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    now, held, held_no, low, state, head, delimiter = None, [], None, 0, START, False, ","

    def close() -> list[tuple]:
        if now is None or not held:
            return []
        return [(now[0], now[1], held_no, MIDDLE if head else TAIL, "\n".join(held), None, None)]

    for b in batches:
        out: list[tuple] = []
        for key, some in b.groupby(["part_path", "block"], sort=False, dropna=False):
            if key != now:
                out += close()
                now, held, held_no, low = key, [], None, int(some["line_no"].iloc[0]) - int(key[1])
                head = bool(some["inside"].iloc[0])
                state, delimiter = QUOTED if head else START, some["delimiter"].iloc[0]
            lines, numbers = some["line"].tolist(), (some["line_no"] - low).tolist()
            kinds = classes("\n".join(lines) + "\n", delimiter)
            after = FILE.states(kinds, state)
            state = int(after[-1])
            ends = np.cumsum([len(x) + 1 for x in lines]) - 1
            closed = after[ends] == START
            whole: list[tuple[int, str]] = []
            for line, no, end in zip(lines, numbers, closed.tolist()):
                if not held:
                    held_no = no
                held.append(line)
                if end:
                    if head:
                        out.append((*now, held_no, HEAD, "\n".join(held), None, None))
                        head = False
                    else:
                        whole.append((held_no, "\n".join(held)))
                    held = []
            fields, bad = tokenize([t for _, t in whole], delimiter)
            out += [(*now, no, WHOLE, t, None if w < 0 else w, f) for (no, t), f, w in zip(whole, fields, bad.tolist())]
        yield pd.DataFrame(out, columns=names).astype({"error_at": "Int64"})
    yield pd.DataFrame(close(), columns=names).astype({"error_at": "Int64"})


def _join_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
    """Records of one file that cross blocks; one that never closes ends with the file."""
    out, held, first = [], [], None

    def close() -> None:
        fields, bad = tokenize(["\n".join(held)], first["delimiter"])
        out.append((first["part_path"], first["block"], first["line_no"], WHOLE, "\n".join(held), None if bad[0] < 0 else int(bad[0]), fields[0]))

    for r in pieces.sort_values(["block", "line_no"]).to_dict("records"):
        if r["place"] == TAIL and held:
            close()
            held = []
        if not held:
            first = r
        held.append(r["raw"])
        if r["place"] == HEAD:
            close()
            held = []
    if held:
        close()
    return pd.DataFrame(out, columns=[x.split()[0] for x in _RECORD.split(", ")]).astype({"error_at": "Int64"})


def file_records(lines: DataFrame) -> DataFrame:
    """Records of delimited files: part_path, block, line_no (the block's start plus the place of the record's first line in it), raw, error_at, cells (null where quoting fails).

    lines: part_path, block (start of the file's block that a line was read in), line_no, line and delimiter, in the order of the
    file within each partition, as a text scan gives them.  Blocks are read by different tasks: each gives one element of the
    machine's monoid, composed by file to the state in which every block starts.  Line breaks within quotes belong to their
    field; a quote that never closes ends with its file.  Null delimiters count as commas; empty tables give no rows.
    """
    from logweave.operators.joins import sized
    from logweave.session import cut

    lines = lines.select("part_path", "block", "line_no", F.coalesce("line", F.lit("")).alias("line"), F.coalesce("delimiter", F.lit(",")).alias("delimiter"))
    marked = lines.where(F.contains("line", F.lit('"'))).select("part_path", "block", "delimiter", "line")
    blocks = lines.groupBy("part_path", "block").agg(F.lit(0).alias("element")).unionByName(marked.mapInPandas(_block_elements, _BLOCK))
    blocks = blocks.groupBy("part_path", "block").agg(F.max("element").cast("int").alias("element"))
    inside = cut(blocks.groupBy("part_path").applyInPandas(_block_starts, "part_path string, block long").withColumn("inside", F.lit(True)))
    few = sized(inside)
    told = lines.join(few, ["part_path", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    if few is inside:  # joined by shuffle: the order of the file is made again
        told = told.repartition("part_path", "block").sortWithinPartitions("part_path", "block", "line_no")
    told = told.select("part_path", "block", "line_no", "line", "delimiter", "inside")
    read = cut(told.mapInPandas(_block_records, _RECORD))
    pieces = read.where(F.col("place") != WHOLE)
    if pieces.isEmpty():
        return read.drop("place")
    pieces = pieces.join(lines.groupBy("part_path").agg(F.first("delimiter").alias("delimiter")), "part_path")
    crossing = pieces.groupBy("part_path").applyInPandas(_join_pieces, _RECORD)
    return read.where(F.col("place") == WHOLE).unionByName(crossing).drop("place")
