"""Files into canonical events.

Every reader gives the event schema.  ``id`` orders the records of a file by their place and is unique within it; event_ref
is the file's path and that place.  ``read`` looks at the head of every file, groups the files by format, and reads each group
by one plan: encoding, delimiter and header are each file's own.  Formats of lines are read split, compressed files and archives
are unpacked file by file into lines and take the same readers; spreadsheets and whole JSON documents are read file by file.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import lzma
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.events import EVENT_SCHEMA
from logweave.functions import formats
from logweave.functions.transforms import key_values, lower_keys
from logweave.operators.entries import frame_entries
from logweave.operators.joins import sized
from logweave.operators.layouts import COMPONENT_KEYS, LEVEL_KEYS, STAMP_KEYS, TEXT_KEYS
from logweave.operators.rejects import file_records
from logweave.operators.stamps import to_epoch_ms
from logweave.session import cut
from logweave.sources.detect import CP850, decode, detect

# Names of the roles of columns in English, Portuguese and Spanish.
CODE_KEYS = ("code", "event_id", "eventid", "event.code", "codigo", "código", "id_evento")
SOURCE_KEYS = ("source", "origem", "origen", "service", "host", "hostname", "logger", "component", "app")
MESSAGE_KEYS = (*TEXT_KEYS, "mensagem", "mensaje", "descricao", "descrição")
DATE_KEYS, CLOCK_KEYS = ("data", "date", "dia", "fecha"), ("hora", "time", "hour")
STAMPS = (*STAMP_KEYS, "datahora", "data_hora", "eventtime", "timecreated", "_time")
LEVELS = (*LEVEL_KEYS, "nivel", "nível", "gravidade", "criticidade")
ENVELOPES = ("Records", "value", "events", "data", "logs", "items", "entries", "results")
DEFAULT_LEVELS = {
    "critical": "Crítico", "crit": "Crítico", "fatal": "Crítico", "emerg": "Crítico", "alert": "Crítico", "error": "Erro", "err": "Erro", "severe": "Erro", "fail": "Erro", "e": "Erro", "f": "Crítico",
    "warning": "Aviso", "warn": "Aviso", "w": "Aviso", "info": "Informação", "information": "Informação", "notice": "Informação", "i": "Informação", "debug": "Depuração", "fine": "Depuração", "dbug": "Depuração", "d": "Depuração",
    "trace": "Rastreio", "trce": "Rastreio", "finest": "Rastreio", "crítico": "Crítico", "erro": "Erro", "aviso": "Aviso", "informação": "Informação", "depuração": "Depuração", "rastreio": "Rastreio",
    **{f"sev{k}": v for k, v in enumerate(("Crítico", "Crítico", "Crítico", "Erro", "Aviso", "Informação", "Informação", "Depuração"))},
}


def _page(name: str) -> tuple[str, str]:
    """Characters of the upper half of ISO 8859-1, and those of a code page at the same bytes."""
    pairs = [(chr(b), bytes([b]).decode(name, "replace")) for b in range(128, 256)]
    pairs = [(a, b) for a, b in pairs if b != "\ufffd" and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _line_text(raw: Column) -> Column:
    """Text of a line's bytes: UTF-8, else CP850 where a byte between letters is a letter there and a sign in cp1252, else cp1252."""
    data = raw.cast("binary")
    plain = F.decode(data, "ISO-8859-1")
    return F.when(F.is_valid_utf8(raw), raw).when(plain.rlike(CP850), F.translate(plain, *_page("cp850"))).otherwise(F.translate(plain, *_page("cp1252")))


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "auto") -> DataFrame:
    """part_file, part_path, block, line_no (ordered and unique within the file) and line of text files, read split.

    line_no is the start of the file's block plus the place among the lines of the task.  Within a file it rises: a block that isn't its
    file's last has the full size, so it is the first of its task and has at least as many bytes as lines; a last block starts beyond all those.
    ``auto`` takes each line by itself as UTF-8, CP850 or cp1252; other names are encodings of whole files.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if encoding.lower().replace("-", "").startswith(("utf16", "utf32")):
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    rows = reader.text(path)
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    line = _line_text(F.col("value")) if encoding == "auto" else F.decode(F.col("value").cast("binary"), encoding)
    line = F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), "\r$", "")
    return rows.select(F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.file_path").alias("part_path"), F.col("_metadata.file_block_start").alias("block"), place.alias("line_no"), line.alias("line"))


def text_page(spark: SparkSession, path: str, start: int = 0, size: int = 200, needle: str = "", encoding: str = "auto") -> DataFrame:
    """Lines of one file from a place on, in order, or of them those that hold ``needle``: paging and search without reading the file into events."""
    rows = read_lines(spark, path, encoding).where(F.col("line_no") >= start)
    if needle:
        rows = rows.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    return rows.orderBy("line_no").limit(size)


def _any(fields: Column, names) -> Column:
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])


def to_events(rows: DataFrame, zone: str = "UTC", year: int | None = None, day_first: bool = True, levels: dict[str, str] | None = None) -> DataFrame:
    """Events of rows with part_file, line_no, raw and fields (a map of texts): roles are found by the fields' names."""
    levels = levels or DEFAULT_LEVELS
    rows = rows.withColumn("__f", F.col("fields")).withColumn("__l", lower_keys(F.col("fields")))
    f = F.col("__l")
    stamp = F.coalesce(_any(f, [k.lower() for k in STAMPS if k not in ("time", "date")]), F.concat_ws(" ", _any(f, DATE_KEYS), _any(f, CLOCK_KEYS)))
    rows = rows.withColumn("__s", stamp).withColumn("__z", F.lit(zone)).withColumn("__y", F.lit(year).cast("int")).withColumn("__d", F.lit(None).cast("string")).withColumn("__df", F.lit(day_first))
    words = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
    level = _any(f, [k.lower() for k in LEVELS])
    return rows.select(
        F.col("line_no").alias("id"), F.concat_ws(":", F.coalesce("part_path", "part_file"), "line_no").alias("event_ref"), "part_file", F.coalesce("parse_status", F.lit("parsed")).alias("parse_status") if "parse_status" in rows.columns else F.lit("parsed").alias("parse_status"),
        to_epoch_ms("__s", "__z", "__y", "__d", "__df").alias("ts"), _any(f, SOURCE_KEYS).alias("source"), F.coalesce(F.try_element_at(words, F.lower(F.trim(level))), level).alias("level"), _any(f, CODE_KEYS).alias("code"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.coalesce(_any(f, MESSAGE_KEYS), F.col("raw")).alias("message"), "raw", F.col("__f").alias("fields"),
    )


def flatten(value, depth: int = 12) -> dict[str, str]:
    """Dotted names of a nested JSON value down to a depth; a name that is written dotted wins over a nested one."""
    out: dict[str, str] = {}
    plain: dict[str, str] = {}

    def walk(v, name: str, left: int) -> None:
        if isinstance(v, dict) and v and left:
            for k, x in v.items():
                walk(x, f"{name}.{k}" if name else str(k), left - 1)
        elif v is not None:
            (plain if "." in name and name in value else out)[name] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    if isinstance(value, dict):
        walk(value, "", depth)
    return out | plain


def _flat(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s.tolist():
            try:
                v = json.loads(t) if t else None
            except ValueError:
                v = None
            flat = flatten(v) if isinstance(v, dict) else None
            out.append(flat | known_product(flat) if flat is not None else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "map<string,string>")(c)


# Products of JSON records by the names that tell them, with the names of time, source, code and text in them.
PRODUCTS = {
    "cloudtrail": (("eventSource", "eventName", "eventTime"), ("eventTime", "eventSource", "eventName", "eventName")), "suricata": (("event_type", "flow_id"), ("timestamp", "in_iface", "event_type", "alert.signature")),
    "okta": (("eventType", "published"), ("published", "client.ipAddress", "eventType", "displayMessage")), "gcp": (("logName", "insertId"), ("timestamp", "logName", "protoPayload.methodName", "textPayload")),
    "kubernetes": (("auditID", "verb"), ("requestReceivedTimestamp", "user.username", "verb", "requestURI")), "wazuh": (("rule.id", "manager.name"), ("timestamp", "agent.name", "rule.id", "rule.description")),
}


def known_product(record: dict[str, str]) -> dict[str, str]:
    """Names that a known product's record adds: product, and timestamp, source, code and message where they aren't written."""
    for product, (marks, names) in PRODUCTS.items():
        if all(m in record for m in marks):
            told = {role: record[n] for role, n in zip(("timestamp", "source", "code", "message"), names) if n in record and role not in record}
            return {"product": product} | told
    return {}


_SINGLE = "part_file", "part_path", "line_no"


def _none() -> Column:
    return F.expr("map()").cast("map<string,string>")


def jsonl_events(lines: DataFrame, **how) -> DataFrame:
    """One JSON object a line; lines that aren't one keep their text and are marked unparsed."""
    rows = lines.where(F.trim("line") != "").withColumn("f", _flat(F.col("line")))
    rows = rows.select(*_SINGLE, F.col("line").alias("raw"), F.coalesce("f", _none()).alias("fields"), F.when(F.col("f").isNull(), "unparsed").otherwise("parsed").alias("parse_status"))
    return to_events(rows, **how)


def records_of(document) -> list:
    """The records of a JSON document: a list, or the list in an envelope, batches within batches included."""
    if isinstance(document, list):
        return [r for d in document for r in (records_of(d) if isinstance(d, list) else [d])]
    if isinstance(document, dict):
        hits = document.get("hits")
        if isinstance(hits, dict) and isinstance(hits.get("hits"), list):
            return [h.get("_source", h) for h in hits["hits"]]
        for k in ENVELOPES:
            if isinstance(document.get(k), list) and document[k] and all(isinstance(x, dict) for x in document[k]):
                return [r for x in document[k] for r in records_of(x)]
        for k, v in document.items():
            if k in ENVELOPES and isinstance(v, dict):
                return records_of(v)
    return [document]


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """part_path and content of files, a row a file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("part_path"), "content")


_ROWS = "part_path string, line_no long, raw string, fields map<string,string>"
_NAMES = ["part_path", "line_no", "raw", "fields"]


def _by_file(files: DataFrame, parse, how: dict) -> DataFrame:
    """Events of ``parse(content)``, which gives (raw, fields) of each record of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["part_path"], b["content"]):
                yield pd.DataFrame([(name, k, raw, f) for k, (raw, f) in enumerate(parse(bytes(data)))], columns=_NAMES)

    return to_events(files.mapInPandas(run, _ROWS).withColumn("part_file", F.element_at(F.split("part_path", "/"), -1)), **how)


def json_events(files: DataFrame, **how) -> DataFrame:
    """Whole JSON documents: arrays and envelopes, read file by file."""

    def parse(data: bytes) -> Iterator[tuple[str, dict]]:
        for r in records_of(json.loads(decode(data))):
            flat = flatten(r)
            yield json.dumps(r, ensure_ascii=False), flat | known_product(flat)

    return _by_file(files, parse, how)


MARKS = {"csv": ",", "csv-semicolon": ";", "tsv": "\t", "csv-pipe": "|"}


def unique_names(cells: list[str]) -> list[str]:
    """Names of columns: blank ones are ``coluna N``, of equal ones the later get their number."""
    out: list[str] = []
    for k, c in enumerate(cells, 1):
        name = c.strip().lstrip("\ufeff") or f"coluna {k}"
        out.append(f"{name} {k}" if name in out else name)
    return out


def table_head(lines: list[str], mark: str) -> tuple[int, list[str]]:
    """(number of the header line, -1 for none; names) of a table's first lines: the first line of the usual width, if it holds no data."""
    cells = [next(csv.reader([x], delimiter=mark), []) for x in lines]
    widths = [len(c) for c in cells if len(c) > 1] or [1]
    usual = max(set(widths), key=lambda w: (widths.count(w), w))
    for k, c in enumerate(cells):
        if len(c) == usual:
            data = any(re.fullmatch(r"[\s\d.,:/+-]*\d[\s\d.,:/TZ+-]*", x) for x in c)
            return (-1, [f"coluna {j}" for j in range(1, usual + 1)]) if data else (k, unique_names(c))
    return -1, ["coluna 1"]


_HEAD = "part_path string, kind string, encoding string, delimiter string, header_no long, names array<string>"


def sniff(lines: DataFrame, kind: str = "auto", mark: str = "", most: int = 50) -> DataFrame:
    """Format, encoding, delimiter, the header's line (from 0, -1 for none) and names of each file, from its first lines: one row a file.

    lines: part_path, block, line_no and raw (the line's bytes).  Only the first lines of the first block leave the scan.
    """
    first = lines.where("block = 0")
    low = first.groupBy("part_path").agg(F.min("line_no").alias("__low"))
    heads = first.join(F.broadcast(low) if low.limit(100_001).count() <= 100_000 else low, "part_path").where(F.col("line_no") < F.col("__low") + most)

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        data = b"\n".join(bytes(x)[:65536] for x in rows["raw"])
        got = kind if kind != "auto" else detect(data)
        encoding = next((e for m, e in ((b"\xff\xfe\0\0", "UTF-32LE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")) if data.startswith(m)), "auto")
        m, at, names = mark or MARKS.get(got, ""), -1, []
        if m:
            text = [decode(bytes(x)).rstrip("\r") for x in rows["raw"]] if encoding == "auto" else decode(data).splitlines()
            at, names = table_head([t for t in text], m)
        return pd.DataFrame([(rows["part_path"].iloc[0], got, encoding, m or None, at, names)], columns=["part_path", "kind", "encoding", "delimiter", "header_no", "names"])

    return heads.select("part_path", "line_no", F.substring("raw", 1, 65536).alias("raw")).groupBy("part_path").applyInPandas(look, _HEAD)


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their bytes, for ``sniff``."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return rows.select(F.col("_metadata.file_path").alias("part_path"), F.col("_metadata.file_block_start").alias("block"), place.alias("line_no"), F.col("value").cast("binary").alias("raw"))


def delimited_events(lines: DataFrame, heads: DataFrame, **how) -> DataFrame:
    """Delimited text by each file's own delimiter and header (heads: part_path, delimiter, header_no, names); line breaks within quotes are kept.

    Records whose quoting fails or that have too few or too many fields are kept with their text and the reason as parse_status.
    """
    heads = sized(heads.select("part_path", "delimiter", "header_no", "names"))
    told = lines.join(heads.select("part_path", "delimiter"), "part_path")
    records = file_records(told).join(heads.select("part_path", "header_no", "names"), "part_path")
    records = records.where((F.col("line_no") > F.col("header_no")) & (F.trim("raw") != ""))
    cells, names = F.coalesce("cells", F.expr("array()").cast("array<string>")), F.col("names")
    extra = F.transform(F.sequence(F.size(names) + 1, F.greatest(F.size(cells), F.size(names) + 1)), lambda k: F.concat(F.lit("coluna "), k.cast("string")))
    keys = F.slice(F.concat(names, extra), F.lit(1), F.size(cells))
    fields = F.map_filter(F.map_from_arrays(keys, cells), lambda _, v: v != "")
    status = F.when(F.col("cells").isNull(), "quoting").when(F.size(cells) != F.size(names), "columns").otherwise("parsed")
    rows = records.withColumn("part_file", F.element_at(F.split("part_path", "/"), -1))
    return to_events(rows.select(*_SINGLE, "raw", F.coalesce(fields, _none()).alias("fields"), status.alias("parse_status")), **how)


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str = ",", header: str | None = None, **how) -> DataFrame:
    """Delimited files, each with its own header line; ``header`` names the columns of files without one."""
    heads = sniff(raw_lines(spark, path), "csv", delimiter)
    if header is not None:
        names = F.array(*[F.lit(n) for n in unique_names(next(csv.reader([header], delimiter=delimiter), []))])
        heads = heads.withColumn("names", names).withColumn("header_no", F.lit(-1).cast("long"))
    return delimited_events(read_lines(spark, path), cut(heads), **how)


def _headed(lines: DataFrame, prefix: str, split: str) -> DataFrame:
    """Rows of logs whose comment lines name the fields: each row meets the last header line before it in its file."""
    from logweave.operators.joins import as_of_join

    heads = lines.where(F.col("line").startswith(prefix)).select("part_path", F.col("line_no").alias("h"), F.split(F.trim(F.substring("line", len(prefix) + 1, 1 << 20)), split).alias("names"))
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select(*_SINGLE, "line")
    rows = as_of_join(rows, heads, ["part_path"], "line_no", "h", ["names"], 1 << 26).where("names is not null")
    cells = F.split("line", split)
    n = F.least(F.size("names"), F.size(cells))
    fields = F.map_filter(F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice(cells, F.lit(1), n)), lambda _, v: v != "-")
    return rows.select(*_SINGLE, F.col("line").alias("raw"), fields.alias("fields"))


def w3c_events(lines: DataFrame, **how) -> DataFrame:
    return to_events(_headed(lines, "#Fields:", " "), **how)


def zeek_events(lines: DataFrame, **how) -> DataFrame:
    return to_events(_headed(lines, "#fields\t", "\t"), **how)


def _by_line(parse) -> "callable":
    def events(lines: DataFrame, **how) -> DataFrame:
        rows = lines.where(F.trim("line") != "")
        return to_events(rows.select(*_SINGLE, F.col("line").alias("raw"), F.coalesce(parse(F.col("line")), _none()).alias("fields")), **how)

    return events


def _as_map(parts: dict[str, Column], extra: str = "") -> Column:
    flat = F.map_filter(F.create_map(*[x for k, v in parts.items() if k != extra for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    if not extra:
        return flat
    more = F.coalesce(parts[extra], F.expr("map()").cast("map<string,string>"))
    return F.map_concat(F.map_filter(flat, lambda k, _: ~F.map_contains_key(more, k)), more)


cef_events = _by_line(lambda c: _as_map(formats.cef(c), "extension"))
leef_events = _by_line(lambda c: _as_map(formats.leef(c), "attributes"))
firewall_events = _by_line(formats.firewall)
auditd_events = _by_line(lambda c: _as_map({("timestamp" if k == "epoch" else k): v for k, v in formats.auditd(c).items()}, "fields"))
logfmt_events = _by_line(key_values)
labeled_events = _by_line(formats.labeled)


def read_pattern(spark: SparkSession, path: str | list[str], pattern: str, **how) -> DataFrame:
    """A format given by an expression with named groups."""
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    index = re.findall(r"(?<!\\)\((?:(?!\?)|\?<(\w+)>)", java)
    names = [n for n in index if n]
    parse = _by_line(lambda c: F.when(c.rlike(java), F.create_map(*[x for n in names for x in (F.lit(n), F.regexp_extract(c, java, index.index(n) + 1))])))
    return parse(read_lines(spark, path), **how)


def log_events(lines: DataFrame, levels: dict[str, str] | None = None, zone: str = "UTC", year: int | None = None, day_first: bool = True) -> DataFrame:
    """Program logs of any known layout, mixed, multi-line entries included; other lines that start with a stamp are entries too."""
    levels = levels or DEFAULT_LEVELS
    e = frame_entries(lines, levels, part="part_path", ident="line_no", generic=True)
    words = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
    e = e.withColumn("__z", F.lit(zone)).withColumn("__y", F.lit(year).cast("int")).withColumn("__d", F.lit(None).cast("string")).withColumn("__df", F.lit(day_first))
    fields = F.map_filter(F.create_map(F.lit("parser.format"), F.col("layout"), F.lit("component"), F.col("component")), lambda _, v: v != "")
    return e.select(F.col("first_line").alias("id"), F.concat_ws(":", "part", "first_line").alias("event_ref"), F.element_at(F.split("part", "/"), -1).alias("part_file"), F.when(F.col("layout") == "none", "text").otherwise("parsed").alias("parse_status"),
        to_epoch_ms("stamp", "__z", "__y", "__d", "__df").alias("ts"), F.nullif("component", F.lit("")).alias("source"), F.coalesce(F.try_element_at(words, F.lower("level")), F.col("level")).alias("level"), F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), "message", F.col("message").alias("raw"), fields.alias("fields"))


def text_events(lines: DataFrame, **how) -> DataFrame:
    rows = lines.where(F.trim("line") != "")
    return to_events(rows.select(*_SINGLE, F.col("line").alias("raw"), F.create_map(F.lit("message"), F.col("line")).alias("fields"), F.lit("text").alias("parse_status")), **how)


# Names of XML records' elements and attributes, and the roles that they play.
XML_ROLES = {
    "System.EventID": "code", "EventID": "code", "System.TimeCreated.SystemTime": "timestamp", "TimeCreated.SystemTime": "timestamp", "System.Computer": "host", "Computer": "host",
    "millis": "timestamp", "date": "timestamp", "logger": "source", "class": "source",
}


def xml_fields(text: str) -> dict[str, str]:
    """Dotted names of one record's elements and attributes; a Data element is named by its Name attribute."""
    out: dict[str, str] = {}
    try:
        node = ET.fromstring(re.sub(r"(</?)[\w.-]+:(?=[\w.-]+[\s/>])", r"\1", text))  # the names' prefixes are declared outside of the record
    except ET.ParseError:
        return out

    def walk(e: ET.Element, name: str) -> None:
        tag = e.tag.rsplit("}", 1)[-1]
        name = e.attrib["Name"] if tag == "Data" and "Name" in e.attrib else f"{name}.{tag}" if name else tag
        for k, v in e.attrib.items():
            if not (tag == "Data" and k == "Name"):
                out[f"{name}.{k}"] = v
        if e.text and e.text.strip():
            out[name] = e.text.strip()
        for x in e:
            walk(x, name)

    for k, v in node.attrib.items():
        out[k.rsplit("}", 1)[-1]] = v
    for x in node:
        walk(x, "")
    if node.text and node.text.strip() and not len(node):
        out["message"] = node.text.strip()
    return out | {XML_ROLES[k]: v for k, v in out.items() if k in XML_ROLES and XML_ROLES[k] not in out}


def read_xml(spark: SparkSession, path: str | list[str], row_tag: str = "Event", **how) -> DataFrame:
    """XML records by their repeated element, read split at its closing tag."""
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", f"</{row_tag}>").text(path)
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    text = F.concat(F.regexp_extract(_line_text(F.col("value")), rf"(?s)(<{re.escape(row_tag)}[\s>].*)$", 1), F.lit(f"</{row_tag}>"))
    rows = rows.select(F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.file_path").alias("part_path"), place.alias("line_no"), text.alias("raw")).where(F.col("raw") != f"</{row_tag}>")
    parse = F.pandas_udf(lambda s: pd.Series([xml_fields(t) for t in s], dtype=object), "map<string,string>")
    return to_events(rows.withColumn("fields", parse("raw")), **how)


def xml_events(files: DataFrame, row_tag: str = "Event", **how) -> DataFrame:
    """XML records of files that are read whole, as archives' members."""
    return _by_file(files, lambda data: ((m[0], xml_fields(m[0])) for m in re.finditer(rf"(?s)<{re.escape(row_tag)}[\s>].*?</{re.escape(row_tag)}>", decode(data))), how)


def sheet_rows(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """(sheet, cells) of each row of an xlsx workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        for name in sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)):
            for row in ET.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
                cells: list[str] = []
                for c in row.findall("m:c", ns):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                        at = at * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells += [""] * (max(at, len(cells) + 1) - len(cells))
                    cells[(at or len(cells)) - 1] = text
                yield name.rsplit("/", 1)[-1][:-4], cells


def xlsx_events(files: DataFrame, **how) -> DataFrame:
    """Rows of every sheet as events; a sheet's first row of texts is its header."""

    def parse(data: bytes) -> Iterator[tuple[str, dict]]:
        heads: dict[str, list[str]] = {}
        for sheet, cells in sheet_rows(data):
            if sheet not in heads:
                heads[sheet] = unique_names(cells)
            elif any(cells):
                names = heads[sheet] + [f"coluna {j}" for j in range(len(heads[sheet]) + 1, len(cells) + 1)]
                yield "\t".join(cells), {n: c for n, c in zip(names, cells) if c} | {"sheet": sheet}

    return _by_file(files, parse, how)


#: Archives within archives, at most; deeper ones are refused.
DEPTH = 32


def members(name: str, data: bytes, depth: int = DEPTH) -> Iterator[tuple[str, bytes]]:
    """(member, content) of an archive or compressed file, by content: zip, tar, gzip, bzip2, xz, zstd; others are themselves."""
    kind = detect(data[:65536])
    if kind in PACKED and not depth:
        raise ValueError(f"{name}: archives are nested too deeply")
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if "xl/workbook.xml" in z.namelist():
                yield name, data
                return
            for m in z.namelist():
                if not m.endswith("/"):
                    yield from members(f"{name}!/{m}", z.read(m), depth - 1)
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t.getmembers():
                if m.isfile():
                    yield from members(f"{name}!/{m.name}", t.extractfile(m).read(), depth - 1)
    elif kind == "zstd":
        import zstandard

        yield from members(name, zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read(), depth - 1)
    elif kind in PACKED:
        yield from members(name, {"gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress}[kind](data), depth - 1)
    else:
        yield name, data


PACKED = ("zip", "tar", "gzip", "bzip2", "xz", "zstd")


def unpacked(files: DataFrame) -> DataFrame:
    """part_path (``archive!/member``) and content of archives' members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["part_path"], b["content"]):
                for m, inner in members(name, bytes(data)):
                    yield pd.DataFrame({"part_path": [m], "content": [inner]})

    return files.mapInPandas(run, "part_path string, content binary")


def content_lines(files: DataFrame) -> DataFrame:
    """Lines, with their bytes in UTF-8, of files that are held whole: one block a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["part_path"], b["content"]):
                lines = re.split("\r\n|\n|\r", decode(bytes(data)))
                lines = lines[:-1] if lines[-1] == "" else lines
                for at in range(0, len(lines), 50_000):
                    yield pd.DataFrame({"part_path": name, "line_no": range(at, at + len(lines[at : at + 50_000])), "line": lines[at : at + 50_000]})

    rows = files.mapInPandas(run, "part_path string, line_no long, line string")
    return rows.select(F.element_at(F.split("part_path", "/"), -1).alias("part_file"), "part_path", F.lit(0).cast("long").alias("block"), "line_no", "line")


def read_archive_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """part_file, part_path (``archive!/member``), line_no and line of the text members of archives."""
    return content_lines(unpacked(_files(spark, path)))


#: Readers of lines, and of files held whole.
LINE_READERS = {
    "jsonl": jsonl_events, "w3c": w3c_events, "zeek": zeek_events, "cef": cef_events, "leef": leef_events, "firewall": firewall_events, "auditd": auditd_events, "mixed": log_events, "text": text_events,
    "logfmt": logfmt_events, "labeled": labeled_events,
}
FILE_READERS = {"json": json_events, "xlsx": xlsx_events, "xml": xml_events}
KINDS = (*LINE_READERS, *FILE_READERS, *MARKS, *PACKED)


def _read_contents(files: DataFrame, how: dict) -> DataFrame | None:
    """Events of files that are held whole, each by its own format."""
    files = cut(files)
    heads = sniff(content_lines(files).withColumn("raw", F.encode("line", "UTF-8")))
    binary = F.when(F.substring("content", 1, 2).cast("string") == "PK", "xlsx")
    heads = cut(heads.join(files.select("part_path", binary.alias("__b")), "part_path").withColumn("kind", F.coalesce("__b", "kind")).drop("__b"))
    out = None
    for kind in sorted(r["kind"] for r in heads.select("kind").distinct().collect()):
        mine = heads.where(F.col("kind") == kind)
        some = files.join(sized(mine.select("part_path")), "part_path", "left_semi")
        got = FILE_READERS[kind](some, **how) if kind in FILE_READERS else delimited_events(content_lines(some), mine, **how) if kind in MARKS else LINE_READERS.get(kind, text_events)(content_lines(some), **how)
        out = got if out is None else out.unionByName(got)
    return out


def read(spark: SparkSession, path: str | list[str], kind: str = "auto", **how) -> DataFrame:
    """Events of files or folders; ``auto`` takes every file by its own format, encoding and header, compressed files and archives included.

    The paths and formats of the files come to the driver, which lists the files anyway; each format is one plan over its files.
    """
    if kind != "auto":
        if kind not in KINDS:
            raise ValueError(f"unknown format {kind!r}")
        out = (read_delimited(spark, path, MARKS[kind], **how) if kind in MARKS else read_xml(spark, path, **how) if kind == "xml" else FILE_READERS[kind](_files(spark, path), **how) if kind in FILE_READERS
               else _read_contents(unpacked(_files(spark, path)), how) if kind in PACKED else LINE_READERS[kind](read_lines(spark, path), **how))
    else:
        heads = cut(sniff(raw_lines(spark, path)))
        groups: dict[tuple[str, str], list[str]] = {}
        for r in heads.select("part_path", "kind", "encoding").collect():
            packed = r["kind"] in PACKED
            group = "delimited" if r["kind"] in MARKS else "packed" if packed else r["kind"]
            groups.setdefault((group, "auto" if packed else r["encoding"]), []).append(unquote(r["part_path"]))
        out = None
        for (group, encoding), paths in sorted(groups.items()):
            paths = sorted(paths)
            if group == "packed" or encoding.startswith("UTF-32"):
                got = _read_contents(unpacked(_files(spark, paths)), how)
            elif group == "delimited":
                got = delimited_events(read_lines(spark, paths, encoding), heads, **how)
            elif group in FILE_READERS:
                got = read_xml(spark, paths, **how) if group == "xml" and encoding == "auto" else FILE_READERS[group](_files(spark, paths), **how)
            else:
                got = LINE_READERS[group](read_lines(spark, paths, encoding), **how)
            if got is not None:
                out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return out.select(*[F.col(x.name).cast(x.dataType).alias(x.name) for x in EVENT_SCHEMA.fields])


def read_many(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """Several sources as one, ids offset so that they are unique over all: source number times 2^48 plus the place; event_ref tells files apart."""
    out = None
    for k, p in enumerate(paths):
        got = read(spark, p, **how).withColumn("id", F.col("id") + (k << 48))
        out = got if out is None else out.unionByName(got)
    return out
