"""Log lines into entries with timestamp, level, component and message.

``frame_entries`` joins physical lines to entries: lines are range-partitioned by (file, line number), so that one huge
file spreads over many tasks; each task streams through its sorted lines once.  The entry that is open at a task's end and
the lines that stand before a task's first header are kept apart: two narrow rows a task tell which open entry such lines go on
with, and they are added to it by its key.  ``parse_texts`` does the same for entries that already stand in one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.joins import sized
from logweave.operators.layouts import Parsed, Router
from logweave.session import cut

FIELDS = "layout string, stamp string, level string, component string, message string"
# A piece is a whole entry, the entry that is open at its task's end, or a line before its task's first header.
WHOLE, OPEN, LOOSE = range(3)
_PIECE = f"place int, part string, first_line long, first_id long, last_id long, lines long, head long, wanted boolean, body string, {FIELDS}"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
ENTRY_COLUMNS = ("part", "first_line", "first_id", "last_id", "lines", "layout", "stamp", "level", "component", "message")


class _Entry:
    """An entry that may go on.  Its lines are held only as long as its fields need them, or all for the message."""

    def __init__(self, router: Router, part, line_no, ident, line: str, found: Parsed, keep: bool):
        self.router, self.part, self.first_line, self.first_id, self.last_id = router, part, line_no, ident, ident
        self.found, self.keep, self.body, self.lines = found, keep, [line], 1
        self.closed, self.again = not found.need, 2

    def add(self, ident, line: str) -> None:
        self.last_id = ident
        self.lines += 1
        if self.keep or not self.closed:
            self.body.append(line)
        if self.closed:
            return
        if self.found.need != "json":
            self.found, self.closed = self.router.complete(self.found, "\n".join(self.body)), True
        elif line.rstrip() == "}" and len(self.body) >= self.again:
            text = "\n".join(self.body)
            done = self.router.complete(self.found, text)
            if done.layout == "json" and done.message == text and done.stamp is None and done.level is None:
                self.again = 2 * len(self.body)  # not whole yet; looked at again when twice as long, or at its end
            else:
                self.found, self.closed = done, True

    def row(self, place: int = WHOLE) -> tuple:
        f, text = self.found, None
        if place == OPEN:
            wanted = self.keep or not self.closed
            return (OPEN, self.part, self.first_line, self.first_id, self.last_id, self.lines, None, wanted, "\n".join(self.body) if wanted else None, f.layout, f.stamp, f.level, f.component, None)
        if self.keep or f.need:
            text = "\n".join(self.body)
        if f.need:
            f = self.router.complete(f, text)
        elif self.keep and self.lines > 1:
            f.message = (self.router.entry(text) or f).message
        return (WHOLE, self.part, self.first_line, self.first_id, self.last_id, self.lines, None, None, None, f.layout, f.stamp, f.level, f.component, f.message if self.keep else None)


def _loose(place: int, part, no, ident, head, line: str | None, message: str | None) -> tuple:
    return (place, part, no, ident, ident, 1, head, None, line, "none", None, None, "", message)


def _frame(batches: Iterator[pd.DataFrame], levels: tuple[str, ...], keep: bool, generic: bool) -> Iterator[pd.DataFrame]:
    router, now, last = Router(levels, generic), None, None
    first = head = head_part = None
    body = True  # of the lines before the first header: what an open record of the task before may still lack
    for b in batches:
        out = []
        for part, no, ident, line in zip(b["part"].tolist(), b["line_no"].tolist(), b["id"].tolist(), b["line"].tolist()):
            if (part, no, ident) == last:
                continue
            line = line or ""
            if last is None:
                first, head, head_part = True, no, part
            elif part != last[0]:
                first = False
            last = (part, no, ident)
            if found := router.header(line):
                if now is not None:
                    out.append(now.row())
                now, first = _Entry(router, part, no, ident, line, found, keep), False
            elif now is not None and part == now.part:
                now.add(ident, line)
            elif first:
                out.append(_loose(LOOSE, part, no, ident, head, line if keep or body else None, None))
                body = body and line.rstrip() != "}"
            else:  # a file's lines before its first header
                out.append(_loose(WHOLE, part, no, ident, None, None, line if keep else None))
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype({"head": "Int64"})
    if now is not None:
        yield pd.DataFrame([now.row(OPEN)], columns=_NAMES).astype({"head": "Int64"})


def _finish(batches: Iterator[pd.DataFrame], levels: tuple[str, ...], keep: bool, generic: bool) -> Iterator[pd.DataFrame]:
    """Open entries with the lines that go on with them."""
    router = Router(levels, generic)
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            f = Parsed(r.layout, r.stamp, r.level, r.component)
            if r.wanted:
                text = "\n".join([r.body, *([] if r.more is None else r.more)])
                f = router.entry(text) or Parsed("none", message=text)
            out.append((r.part, r.first_line, r.first_id, r.end_id, r.all_lines, f.layout, f.stamp, f.level, f.component, f.message if keep else None))
        yield pd.DataFrame(out, columns=list(ENTRY_COLUMNS))


def frame_entries(lines: DataFrame, levels: dict[str, str], part: str = "part_file", line_no: str = "line_no", ident: str = "record_id",
                  line: str = "line", keep_message: bool = True, generic: bool = False) -> DataFrame:
    """Entries of physical lines: part, first_line, first_id, last_id, lines, layout, stamp, level, component, message.

    An entry runs to the line before the next header of its file; lines before a file's first header are entries of
    layout ``none``, one a line, so that a file without any header needs no more memory than one with many.  ``level`` is as
    written (``sevN`` for a syslog priority); it is null where none is stated.  Repeated rows (same file, line number and id) count once; a null
    line counts as empty; a null file is a file of its own; an empty input gives no rows; further columns are ignored.  Without
    ``keep_message`` the text of an entry is not held beyond the lines that its fields need.  ``generic`` also takes the
    layouts of ``FAMILIES``, among them any line that starts with a stamp.
    """
    spelled = tuple(levels)
    lines = lines.select(F.col(part).cast("string").alias("part"), F.col(line_no).cast("long").alias("line_no"),
                         F.col(ident).cast("long").alias("id"), F.col(line).cast("string").alias("line"))
    lines = lines.where(F.col("line_no").isNotNull() & F.col("id").isNotNull())
    ordered = lines.repartitionByRange("part", "line_no", "id").sortWithinPartitions("part", "line_no", "id")
    pieces = cut(ordered.mapInPandas(lambda it: _frame(it, spelled, keep_message, generic), _PIECE))
    # each task's first lines without header go on with the entry that was open last before them in their file, if there is one
    loose = pieces.where(F.col("place") == LOOSE)
    heads = loose.groupBy("part", "head").agg(F.lit(None).cast("long").alias("own"), F.lit(None).cast("boolean").alias("own_wanted"))
    ends = pieces.where(F.col("place") == OPEN).select("part", F.col("first_line").alias("head"), F.col("first_line").alias("own"), F.col("wanted").alias("own_wanted"))
    before = Window.partitionBy("part").orderBy("head", F.desc_nulls_last("own")).rowsBetween(Window.unboundedPreceding, 0)
    owners = heads.unionByName(ends).withColumns({"owner": F.last("own", True).over(before), "owner_wanted": F.last("own_wanted", True).over(before)})
    owners = owners.where("own is null").select(F.col("part").alias("__p"), F.col("head").alias("__h"), "owner", "owner_wanted")
    loose = loose.join(sized(owners), F.col("part").eqNullSafe(F.col("__p")) & (F.col("head") == F.col("__h")))
    wanted = F.when(F.col("owner_wanted"), F.struct("first_line", "first_id", F.coalesce("body", F.lit("")).alias("body")))
    more = loose.where("owner is not null").groupBy(F.col("part").alias("__p"), F.col("owner").alias("__o")).agg(
        F.sum("lines").alias("__lines"), F.max(F.struct("first_line", "first_id"))["first_id"].alias("__end"), F.transform(F.array_sort(F.collect_list(wanted)), lambda x: x["body"]).alias("more"))
    open_ = pieces.where(F.col("place") == OPEN).join(more, F.col("part").eqNullSafe(F.col("__p")) & (F.col("first_line") == F.col("__o")), "left")
    open_ = open_.withColumns({"end_id": F.coalesce("__end", "last_id"), "all_lines": F.col("lines") + F.coalesce("__lines", F.lit(0))})
    open_ = open_.select("part", "first_line", "first_id", "end_id", "all_lines", "layout", "stamp", "level", "component", "wanted", "body", "more")
    schema = f"part string, first_line long, first_id long, last_id long, lines long, {FIELDS}"
    closed = open_.mapInPandas(lambda it: _finish(it, spelled, keep_message, generic), schema)
    alone = loose.where("owner is null").withColumn("message", F.col("body") if keep_message else F.lit(None).cast("string")).select(*ENTRY_COLUMNS)
    return pieces.where(F.col("place") == WHOLE).select(*ENTRY_COLUMNS).unionByName(closed).unionByName(alone)


def parse_texts(rows: DataFrame, levels: dict[str, str], text: str = "text", keep_message: bool = True) -> DataFrame:
    """``rows`` with a struct column ``entry`` (layout, stamp, level, component, message) of each text.

    Null and unknown texts give layout ``none`` with the text as message.
    """
    spelled = tuple(levels)

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        router = Router(spelled)
        for s in batches:
            out = []
            for t in s.tolist():
                f = (router.entry(t) if t else None) or Parsed("none", message=t)
                out.append((f.layout, f.stamp, f.level, f.component, f.message if keep_message else None))
            yield pd.DataFrame(out, columns=["layout", "stamp", "level", "component", "message"])

    # marked nondeterministic, so that the optimizer doesn't copy the call into filters and run it twice
    return rows.withColumn("entry", F.pandas_udf(parse, FIELDS).asNondeterministic()(F.col(text)))


def with_standard_level(entries: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Entries whose level is known, in its standard spelling; the others state none."""
    pairs = [x for k, v in levels.items() for x in (F.lit(k), F.lit(v))]
    if not pairs:
        return entries.withColumn("level", F.lit(None).cast("string")).where("level is not null")
    return entries.withColumn("level", F.element_at(F.create_map(*pairs), F.lower("level"))).where("level is not null")
