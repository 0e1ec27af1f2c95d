"""Routing of log entries to layout parsers by literals.

Every layout names groups of literals; its header line holds at least one of each group.  One Aho-Corasick automaton over all
literals finds, in a single pass over the line, which of them it holds, and so the layouts that may apply; only their anchored
expressions are then tried, in priority order, to verify the header and to extract its fields.  A line that no layout accepts is no header: it
belongs to the entry before it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick

# Field names under which structured entries give their level, component, time and text.
LEVEL_KEYS = ("level", "severity", "log.level", "lvl", "loglevel", "levelname")
COMPONENT_KEYS = ("component", "logger", "module", "log.logger", "logger_name", "program", "class")
STAMP_KEYS = ("ts", "timestamp", "@timestamp", "time", "at", "time_iso8601", "time_local", "datetime", "date")
TEXT_KEYS = ("msg", "message", "text", "request")
WRAPPER_KEYS = ("log", "MESSAGE")
# The severity letters of glog-style headers.
GLOG_LETTERS = "IWEFD"
# Level words of console loggers with an event number.
CONSOLE_LEVELS = ("trce", "dbug", "info", "warn", "fail", "crit")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass
class Parsed:
    """Fields of one entry.  need: lines that must follow before the entry is complete ('', 'text' or 'json')."""

    layout: str
    stamp: str | None = None
    level: str | None = None
    component: str = ""
    message: str | None = None
    need: str = ""


_DAY = r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d"
_PAIR = re.compile(r'([@\w][\w.@-]*)=("(?:[^"\\]|\\.)*"|\S*)')
_HEADERS: dict[str, re.Pattern] = {
    "access": re.compile(r'\S+ \S+ (?:\S+|"[^"]*") \[(?P<t>\d{1,2}/\w{3}/\d{4}:\d\d:\d\d:\d\d(?: [+-]\d{4})?)\] (?P<m>.*)', re.S),
    "syslog5424": re.compile(r"<(?P<p>\d{1,3})>1 (?P<t>\S+) \S+ (?P<c>\S+) \S+ \S+ (?:-|(?:\[[^\]]*\])+)(?: (?P<m>.*))?$", re.S),
    "syslog3164": re.compile(r"(?:<(?P<p>\d{1,3})>)?(?P<t>[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ (?P<c>[^\s:\[]+)(?:\[\d+\])?: (?P<m>.*)", re.S),
    "web-error": re.compile(r"(?P<t>\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(?P<l>\w+)\] \d+#\d+: (?P<m>.*)", re.S),
    "module-error": re.compile(r"\[(?P<t>\w{3} \w{3} [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)? \d{4})\] \[(?:(?P<c>[\w.-]*):)?(?P<l>\w+)\] (?:\[pid [^\]]*\] ?)?(?:\[client [^\]]*\] ?)?(?P<m>.*)", re.S),
    "dashed": re.compile(rf"(?P<t>{_DAY}(?:[.,]\d+)?) (?P<x>[-|]) (?P<c>\S+) (?P=x) (?P<l>[^\W\d_]+) (?P=x) (?P<m>.*)", re.S),
    "threaded": re.compile(rf"(?P<t>{_DAY}(?:[.,]\d+)?) +(?P<l>[^\W\d_]+) +\[[^\]]*\] (?P<c>\S+) - (?P<m>.*)", re.S),
    "two-line": re.compile(r"(?P<t>[A-Z][a-z]{2} \d{1,2}, \d{4} \d{1,2}:\d\d:\d\d [AP]M) (?P<c>\S+)(?: (?P<f>\S+))?\s*$"),
    "glog": re.compile(r"(?P<l>[A-Z])(?P<t>\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ (?P<c>[^\s:\]]+):\d+\] (?P<m>.*)", re.S),
    "console": re.compile(r"(?P<l>[a-z]{4}): (?P<c>[\w.`+<>]+)\[\d+\]\s*$"),
    "pairs": re.compile(r'(?:[@\w][\w.@-]*=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)(?:\s+|$)){2,}$'),
    "json": re.compile(r"\{\s*(?:\"|$|\})"),
}
#: The literals of each layout: a header holds at least one of every group.
ANCHORS: dict[str, tuple[tuple[str, ...], ...]] = {
    "json": (("{",),),
    "syslog5424": ((">1 ",),),
    "syslog3164": (tuple(f"{m} " for m in MONTHS), (": ",)),
    "two-line": ((" AM ", " PM "), (", ",)),
    "module-error": (("] [",), (":",)),
    "web-error": (("] ",), ("#",), ("/",), (": ",)),
    "access": (tuple(f"/{m}/" for m in MONTHS), ("] ",)),
    "threaded": (("] ",), (" - ",), (":",)),
    "dashed": ((" - ", " | "), (":",)),
    "glog": (("] ",), (".",), (":",)),
    "console": (tuple(f"{w}: " for w in CONSOLE_LEVELS), ("[",)),
    "pairs": (("=",),),
}
ORDER = tuple(ANCHORS)
# Layouts that are tried only where files of any program are read: mobile system logs, proxy logs, load balancer logs, and any line
# that starts with a stamp.
FAMILIES: dict[str, tuple[tuple[str, ...], ...]] = {"logcat": ((": ",), (".",)), "squid": (("/",), (".",)), "balancer": (("Z ",), (":",)), "stamped": ((":",),)}
_STAMP = (
    r"\d{4}[-/.]\d\d[-/.]\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?|\d\d[-/.]\d\d[-/.]\d{4},?[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?"
    r"|\d{1,2}[ -/]\w{3}[ -/]\d{4}[: ]\d\d:\d\d:\d\d(?:[.,]\d+)?|(?:[A-Z][a-z]{2},? )?[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d(?: \d{4})?"
)
_HEADERS |= {
    "logcat": re.compile(r"(?P<mo>\d\d)-(?P<d>\d\d) (?P<t>\d\d:\d\d:\d\d\.\d{3})\s+\d+\s+\d+ (?P<l>[VDIWEFA]) (?P<c>[^:]*?)\s*: (?P<m>.*)", re.S),
    "squid": re.compile(r"(?P<t>\d{9,10}\.\d{3})\s+\d+ \S+ (?P<m>[A-Z_]+/\d{3} \d+ [A-Z]+ \S+ .*)", re.S),
    "balancer": re.compile(r"(?:https?|h2|wss?|grpcs?) (?P<t>\d{4}-\d\d-\d\dT[\d:.]+Z) (?P<c>\S+) (?P<m>.*)", re.S),
    "stamped": re.compile(rf"[\[(<]?(?P<t>{_STAMP})[\])>]?[\s:|,;-]*(?P<m>.*)", re.S),
}
_LEVEL_HEAD = re.compile(r"\[(?P<a>[^\W\d_]+)\][ :]|(?P<b>[^\W\d_]+)(?:: | - )")
_SECOND = re.compile(r"\s*(?P<l>[^\W\d_]+): (?P<m>.*)", re.S)


@lru_cache(maxsize=2)
def automaton(generic: bool = False) -> tuple[ahocorasick.Automaton, dict[str, int]]:
    """(automaton whose values are the literals' bits, bit of each literal)."""
    groups = [g for groups in (ANCHORS | (FAMILIES if generic else {})).values() for g in groups]
    bits = {literal: 1 << k for k, literal in enumerate(dict.fromkeys(x for g in groups for x in g))}
    a = ahocorasick.Automaton()
    for literal, bit in bits.items():
        a.add_word(literal, bit)
    a.make_automaton()
    return a, bits


def _text(v) -> str | None:
    if v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _pick(record: dict, keys: tuple[str, ...]) -> str | None:
    for k in keys:
        if k in record and not isinstance(record[k], (dict, list)):
            return _text(record[k])
        head, _, tail = k.partition(".")
        if tail and isinstance(record.get(head), dict) and tail in record[head]:
            return _text(record[head][tail])
    return None


_JSON = json.JSONDecoder(strict=False, parse_float=str, parse_int=str)


class Router:
    """Parses entries.  levels: lower-case spellings that count as a level."""

    def __init__(self, levels, generic: bool = False):
        self.levels = frozenset(levels)
        self.automaton, bits = automaton(generic)
        layouts = ANCHORS | (FAMILIES if generic else {})
        #: For each layout the bits of its groups of literals; for each set of literals the layouts that it allows.
        self.needs = [(name, [sum(bits[x] for x in g) for g in groups], getattr(self, "_" + name.replace("-", "_"))) for name, groups in layouts.items()]
        self.routes: dict[int, tuple] = {}

    def header(self, line: str) -> Parsed | None:
        """The fields of a header line, or None for a line that continues an entry."""
        seen = 0
        for _, bit in self.automaton.iter(line):
            seen |= bit
        if (route := self.routes.get(seen)) is None:
            route = self.routes[seen] = tuple((_HEADERS[name].match, read) for name, groups, read in self.needs if all(seen & g for g in groups))
        for match, read in route:
            if (m := match(line)) and (found := read(m, line)):
                return found
        return None

    def entry(self, text: str) -> Parsed | None:
        """The fields of an entry that stands in one text, its lines included."""
        first, _, rest = text.partition("\n")
        found = self.header(first.rstrip("\r"))
        if found is None:
            return None
        if found.need:
            found = self.complete(found, text)
        elif rest:
            found.message = (found.message or "") + "\n" + rest
        return found

    def complete(self, found: Parsed, text: str) -> Parsed:
        """Fields that stand on the lines after the header; text: the whole entry."""
        if found.need == "json":
            return self._record(text) or Parsed("json", message=text)
        _, _, rest = text.partition("\n")
        found.need = ""
        if found.layout == "two-line":
            if m := _SECOND.match(rest):
                found.level, found.message = m["l"], m["m"]
        else:
            found.message = rest.strip()
        return found

    def _access(self, m, _):
        return Parsed("access", m["t"], message=m["m"])

    def _syslog5424(self, m, _):
        return Parsed("syslog5424", m["t"], f"sev{int(m['p']) % 8}", "" if m["c"] == "-" else m["c"], m["m"])

    def _syslog3164(self, m, _):
        message, level = m["m"], None
        if (h := _LEVEL_HEAD.match(message)) and (word := (h["a"] or h["b"])).lower() in self.levels:
            level, message = word, message[h.end() :].lstrip()
        elif m["p"]:
            level = f"sev{int(m['p']) % 8}"
        return Parsed("syslog3164", m["t"], level, m["c"], message)

    def _web_error(self, m, _):
        return Parsed("web-error", m["t"], m["l"], "", m["m"])

    def _module_error(self, m, _):
        c = m["c"] or ""
        return Parsed("module-error", m["t"], m["l"], "" if c == "-" else c, m["m"])

    def _dashed(self, m, _):
        return Parsed("dashed", m["t"], m["l"], m["c"], m["m"])

    def _threaded(self, m, _):
        return Parsed("threaded", m["t"], m["l"], m["c"], m["m"])

    def _two_line(self, m, _):
        return Parsed("two-line", m["t"], None, m["c"], None, "text")

    def _glog(self, m, _):
        return Parsed("glog", m["t"], m["l"], m["c"], m["m"]) if m["l"] in GLOG_LETTERS else None

    def _console(self, m, _):
        return Parsed("console", None, m["l"], m["c"], None, "text") if m["l"] in CONSOLE_LEVELS else None

    def _pairs(self, m, line):
        record = {k: v[1:-1].replace('\\"', '"').replace("\\\\", "\\") if v[:1] == '"' else v for k, v in _PAIR.findall(line)}
        if not any(k in record for k in STAMP_KEYS + LEVEL_KEYS):
            return None
        return Parsed("pairs", _pick(record, STAMP_KEYS), _pick(record, LEVEL_KEYS), _pick(record, COMPONENT_KEYS) or "", _pick(record, TEXT_KEYS))

    def _json(self, m, line):
        found = self._record(line)
        if found is None and not line.rstrip().endswith("}"):
            return Parsed("json", need="json")
        return found

    def _logcat(self, m, _):
        return Parsed("logcat", f"{m['mo']}{m['d']} {m['t']}", {"V": "trace", "A": "fatal", "F": "fatal"}.get(m["l"], m["l"]), m["c"], m["m"])

    def _squid(self, m, _):
        return Parsed("squid", m["t"], None, "", m["m"])

    def _balancer(self, m, _):
        return Parsed("balancer", m["t"], None, m["c"], m["m"])

    def _stamped(self, m, _):
        """Any line that starts with a stamp: the first level among its first words, the name before the first colon."""
        words = m["m"].split(None, 6)[:6]
        level = next((w for w in (x.strip("[]<>():|,;-") for x in words) if len(w) > 1 and w.lower() in self.levels), None)
        named = re.search(r"(?:^|\s)([A-Za-z][\w.$/-]+)(?:\[\d+\])?: ", m["m"][:120])
        component = named[1] if named and named[1].lower() not in self.levels else ""
        return Parsed("stamped", m["t"], level, component, m["m"])

    def _record(self, text: str) -> Parsed | None:
        try:
            record, end = _JSON.raw_decode(text.lstrip())
        except ValueError:
            return None
        if not isinstance(record, dict):
            return None
        for k in WRAPPER_KEYS:
            if isinstance(record.get(k), str) and "stream" in record:
                return self.entry(record[k].rstrip("\n"))
        return Parsed("json", _pick(record, STAMP_KEYS), _pick(record, LEVEL_KEYS), _pick(record, COMPONENT_KEYS) or "", _pick(record, TEXT_KEYS))
