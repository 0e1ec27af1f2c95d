"""Format of a file from its first bytes."""

from __future__ import annotations

import csv
import json
import re

from logweave.operators.layouts import Router

FORMATS = ("auto", "jsonl", "json", "csv", "csv-semicolon", "tsv", "csv-pipe", "w3c", "zeek", "cef", "leef", "firewall", "auditd", "xml", "xlsx", "zip", "tar", "gzip", "bzip2", "xz", "zstd", "logfmt", "labeled", "mixed", "text")
_COMPRESSED = ((b"\x1f\x8b", "gzip"), (b"PK\x03\x04", "zip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"))
#: A byte between letters, written as in ISO 8859-1, that is a letter in CP850 and hardly stands there in cp1252.
CP850 = "[A-Za-z][\u0081-\u0084\u0087-\u008d\u00a1-\u00a4][a-z\u0080-\u00a5\u00c6\u00e4]"


def decode(data: bytes) -> str:
    """Text of bytes: by byte-order mark, else UTF-8, else cp1252."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and len(data) >= 4096:  # a character cut off at the end of the sample
            return data[: e.start].decode("utf-8")
        pass
    text = data.decode("latin-1")
    return data.decode("cp850" if re.search(CP850, text) else "cp1252", "replace")


def detect(data: bytes, levels=("error", "warn", "info", "debug")) -> str:
    for mark, name in _COMPRESSED:
        if data.startswith(mark):
            return "xlsx" if name == "zip" and b"xl/" in data else name
    if data[257:262] == b"ustar":
        return "tar"
    text = decode(data)
    lines = [x for x in text.splitlines() if x.strip()][:50]
    if not lines:
        return "text"
    if lines[0].lstrip().startswith("<") and re.match(r"\s*<[?\w!]", lines[0]) and not re.match(r"<\d{1,3}>", lines[0]):
        return "xml"
    if any(x.startswith("#Fields:") for x in lines):
        return "w3c"
    if any(x.startswith("#fields\t") for x in lines):
        return "zeek"
    for mark, name in (("CEF:", "cef"), ("LEEF:", "leef"), ("msg=audit(", "auditd")):
        if sum(mark in x for x in lines) > len(lines) / 2:
            return name
    if sum("SRC=" in x and "DST=" in x for x in lines) > len(lines) / 2:
        return "firewall"
    whole = 0
    for x in lines:
        try:
            whole += isinstance(json.loads(x), dict)
        except ValueError:
            pass
    if whole > len(lines) / 2:
        return "json" if len(lines) == 1 and re.match(r'\s*\{\s*"(?:Records|value|events|data|hits|logs|items)"\s*:\s*[\[{]', text) else "jsonl"
    if text.lstrip()[:1] in "[{" and re.match(r'\s*[\[{]\s*(?:["{]|$)', text):
        router = Router(levels)
        if router.header(lines[0]) is None or text.lstrip()[0] == "[" or re.match(r'\s*\{\s*"(?:Records|value|events|data|hits|logs|items)"\s*:', text):
            return "json"
    router = Router(levels, generic=True)
    found = [router.header(x) for x in lines]
    if sum(f is not None for f in found) >= max(1, len(lines) / 4):
        return "logfmt" if all(f is not None and f.layout == "pairs" for f in found) else "mixed"
    labels = sum(len(re.findall(r"(?:^|\t|; )\s*[^\W\d_][\w .-]{0,40}:(?=\s)", x)) > 1 for x in lines)
    if labels > len(lines) / 2:
        return "labeled"
    for mark, name in ((";", "csv-semicolon"), ("\t", "tsv"), ("|", "csv-pipe"), (",", "csv")):
        widths = [len(r) for r in csv.reader(lines, delimiter=mark)]
        usual = max(set(widths), key=lambda w: (widths.count(w), w))
        before = widths.index(usual)  # lines of a preamble
        if usual > 1 and (before == 0 or before <= 5 and usual > 2) and widths.count(usual) > 0.8 * (len(widths) - before):
            return name
    return "text"
