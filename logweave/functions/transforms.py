"""Field transforms, extraction by grok, dissect and key-value, and derived fields."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.plans.filters import Filter, compile_filters

# The common patterns that grok expressions name.
GROK = {
    "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*", "INT": r"[+-]?[0-9]+", "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "POSINT": r"\b[1-9][0-9]*\b", "BASE16NUM": r"(?:0[xX])?[0-9A-Fa-f]+", "UUID": r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}", "IPV4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "IPV6": r"[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+", "IP": r"(?:%{IPV6}|%{IPV4})", "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?", "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "USERNAME": r"[a-zA-Z0-9._-]+", "USER": r"%{USERNAME}", "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"', "QS": r"%{QUOTEDSTRING}", "PATH": r"(?:/[^\s?]*)+", "URIPATH": r"(?:/[^\s?#]*)+",
    "LOGLEVEL": r"(?:[Tt]race|TRACE|[Dd]ebug|DEBUG|[Ii]nfo|INFO|[Nn]otice|NOTICE|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL)",
    "YEAR": r"[0-9]{4}", "MONTHNUM": r"(?:0[1-9]|1[0-2])", "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])", "TIME": r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?",
    "NONNEGINT": r"\b[0-9]+\b", "BASE10NUM": r"%{NUMBER}", "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b",
    "DAY": r"\b(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)\b", "HOUR": r"(?:2[0-3]|[01]?[0-9])", "MINUTE": r"[0-5][0-9]", "SECOND": r"(?:[0-5]?[0-9]|60)(?:[.,][0-9]+)?",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}", "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}", "DATE": r"(?:%{DATE_US}|%{DATE_EU})", "DATESTAMP": r"%{DATE}[- ]%{TIME}", "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))", "TZ": r"[A-Z]{3,4}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}", "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}", "PROG": r"[^\s\[\]:]+", "SYSLOGPROG": r"%{PROG}(?:\[%{POSINT}\])?", "SYSLOGHOST": r"%{IPORHOST}", "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "EMAILLOCALPART": r"[a-zA-Z0-9_.+=:-]+", "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}", "HTTPDUSER": r"(?:%{EMAILADDRESS}|%{USER})", "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}|(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4}", "COMMONMAC": r"(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2}",
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+.-]+", "URIHOST": r"%{IPORHOST}(?::%{POSINT})?", "URIPARAM": r"\?[^\s#]*", "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?", "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@\s]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "UNIXPATH": r"(?:/[\w.,+@%-]*)+", "WINPATH": r"(?:[A-Za-z]:|\\)(?:\\[^\\?*\s]*)+", "TTY": r"/dev/(?:pts|tty[pq]?)(?:\w+)?/?\d*", "URN": r"urn:[0-9A-Za-z][0-9A-Za-z-]{0,31}:\S+", "BASE16FLOAT": r"[+-]?(?:0x)?[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]*)?",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{TIME}(?:Z|[+-][0-9]{2}:?[0-9]{2})?",
}


def compile_grok(expression: str, custom: dict[str, str] | None = None, depth: int = 24) -> tuple[str, list[str]]:
    """(Java expression with plain groups, field names) of a grok expression."""
    library, names = GROK | (custom or {}), []

    def expand(text: str, left: int) -> str:
        if left == 0:
            raise ValueError("patterns are nested too deeply")
        out, at = [], 0
        for m in re.finditer(r"%\{(\w+)(?::([\w.@-]+))?(?::\w+)?\}", text):
            out.append(text[at : m.start()])
            if m[1] not in library:
                raise ValueError(f"unknown pattern {m[1]}")
            if m[2]:
                if len(names) >= 64:
                    raise ValueError("more than 64 fields")
                names.append(m[2])
                out.append("(" + expand(library[m[1]], left - 1) + ")")
            else:
                out.append("(?:" + expand(library[m[1]], left - 1) + ")")
            at = m.end()
        return "".join(out) + text[at:]

    return expand(expression, depth), names


def grok(c: Column, expression: str, custom: dict[str, str] | None = None) -> dict[str, Column]:
    """Field columns of a grok expression; null where it doesn't match."""
    pattern, names = compile_grok(expression, custom)
    return {n: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k)) for k, n in enumerate(names, 1)}


def dissect(c: Column, layout: str) -> dict[str, Column]:
    """Field columns of a layout such as ``%{a} - %{b}``; null where it doesn't fit."""
    parts = re.split(r"%\{([\w.?]*)\}", layout)
    pattern = "(?s)^" + re.escape(parts[0])
    names = []
    for k in range(1, len(parts), 2):
        last = k + 2 >= len(parts) and not parts[k + 1]
        pattern += ("(.*)" if last else "(.*?)") + re.escape(parts[k + 1])
        names.append(parts[k])
    pattern += "$"
    return {n: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k)) for k, n in enumerate(names, 1) if n and not n.startswith("?")}


def key_values(c: Column, pair: str = r'([\w.@-]+)=("[^"]*"|\S*)') -> Column:
    """A map of the key=value pairs of a text; of a key that stands twice the last holds."""
    keys, values = F.regexp_extract_all(c, F.lit(pair), F.lit(1)), F.regexp_extract_all(c, F.lit(pair), F.lit(2))
    entries = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(e["k"].alias("k"), F.regexp_replace(e["v"], '^"|"$', "").alias("v")))
    return F.aggregate(entries, F.expr("map()").cast("map<string,string>"),
                       lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


def lower_keys(fields: Column) -> Column:
    """A map with its names in lower case; of names that are then equal the last holds."""
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.transform(entries, lambda e: e["k"])
    plain = F.size(F.array_distinct(names)) == F.size(names)  # the common case needs no fold
    folded = F.aggregate(entries, F.expr("map()").cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    return F.when(plain, F.map_from_entries(entries)).otherwise(folded)


def decode_base64(c: Column) -> Column:
    """Text of base64 or base64url, padded or not; null where it is neither."""
    text = F.translate(F.regexp_replace(c, r"[\s=]+", ""), "-_", "+/")
    padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int")))
    good = text.rlike(r"^[A-Za-z0-9+/]+$") & (F.pmod(F.length(text), F.lit(4)) != 1)
    return F.when(good, F.decode(F.when(good, F.try_to_binary(padded, F.lit("base64"))), "UTF-8"))


def encode_base64(c: Column) -> Column:
    """base64 in one line."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", "")


def step(c: Column, name: str) -> Column:
    """One transform; texts it can't read give null."""
    match name:
        case "base64_decode" | "base64url_decode":
            return decode_base64(c)
        case "base64_encode":
            return encode_base64(c)
        case "base64url_encode":
            return F.rtrim(F.translate(encode_base64(c), "+/", "-_"), F.lit("="))
        case "url_decode":
            return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
        case "form_decode":
            return F.try_url_decode(c)
        case "url_encode":
            return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        case "hex_encode":
            return F.lower(F.hex(F.encode(c, "UTF-8")))
        case "hex_decode":
            return F.when(c.rlike(r"^(?:[0-9A-Fa-f]{2})*$"), F.decode(F.unhex(c), "UTF-8"))
        case "parse_json":
            return F.to_json(F.try_parse_json(c))
        case "parse_xml":
            return parse_xml(c)
        case "jwt_header":
            return F.to_json(F.try_parse_json(decode_base64(F.get(F.split(c, r"\."), F.lit(0)))))
        case "basic":
            return decode_base64(F.nullif(F.regexp_extract(c, r"(?i)^\s*basic\s+(\S+)\s*$", 1), F.lit("")))
        case "utf16_decode":
            return F.when(c.rlike(r"^[A-Za-z0-9+/\s]+=*$"), F.decode(F.try_to_binary(F.regexp_replace(c, r"\s", ""), F.lit("base64")), "UTF-16LE"))
        case "jwt_payload":
            return F.to_json(F.try_parse_json(decode_base64(F.get(F.split(c, r"\."), F.lit(1)))))
        case "parse_query":
            return F.to_json(query_map(c))
        case "trim":
            return F.trim(c)
        case "lower":
            return F.lower(c)
        case "upper":
            return F.upper(c)
        case "basename":
            return F.regexp_extract(c, r"([^/\\]*)$", 1)
        case "hex_to_int":
            return F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10)
    raise ValueError(f"unknown transform {name!r}")


#: Bounds of what a transform reads: characters of a text, nodes and depth of a document; texts beyond them give null.
MOST_TEXT, MOST_NODES, MOST_DEPTH = 262_144, 4096, 16


def _xml_value(e: ET.Element, depth: int, left: list[int]):
    left[0] -= 1
    if depth > MOST_DEPTH or left[0] < 0:
        raise ValueError("the document is too large")
    out: dict = {f"@{k.rsplit('}', 1)[-1]}": v for k, v in e.attrib.items()}
    for x in e:
        name, value = x.tag.rsplit("}", 1)[-1], _xml_value(x, depth + 1, left)
        if name not in out:
            out[name] = value
        elif isinstance(out[name], list):
            out[name].append(value)
        else:
            out[name] = [out[name], value]
    text = " ".join(x.strip() for x in [e.text, *(y.tail for y in e)] if x and x.strip())
    if not out:
        return text
    return out | {"#text": text} if text else out


def parse_xml(c: Column) -> Column:
    """JSON of an XML text: attributes as ``@name``, repeated elements as lists; null for texts that aren't XML, declare entities or are too large."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s.tolist():
            made = None
            if t and len(t) <= MOST_TEXT and "<!" not in t:
                try:
                    root = ET.fromstring(t)
                    made = json.dumps({root.tag.rsplit("}", 1)[-1]: _xml_value(root, 1, [MOST_NODES])}, ensure_ascii=False)
                except (ET.ParseError, ValueError):
                    pass
            out.append(made)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(c)


def children(c: Column, name: str) -> Column:
    """Map ``name.child`` of the values of a JSON text, nested ones by dotted names, lists by their numbers; null for other texts."""

    def run(s: pd.Series) -> pd.Series:
        def walk(v, at: str, out: dict, depth: int) -> None:
            parts = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
            if parts and depth <= MOST_DEPTH and len(out) < MOST_NODES:
                for k, x in parts:
                    walk(x, f"{at}.{k}", out, depth + 1)
            elif v is not None:
                out[at] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

        made = []
        for t in s.tolist():
            try:
                value = json.loads(t) if t and len(t) <= 2 * MOST_TEXT else None
            except ValueError:
                value = None
            out: dict[str, str] = {}
            walk(value, name, out, 0)
            made.append(out if isinstance(value, (dict, list)) else None)
        return pd.Series(made, dtype=object)

    return F.pandas_udf(run, "map<string,string>")(c)


def exploded(df: DataFrame, column: str, steps: Sequence[str]) -> DataFrame:
    """``df`` with the children of a transform's output added to its fields as ``column.child``; fields that are there already stay."""
    made = F.coalesce(children(transform(F.col(f"`{column}`") if column in df.columns else column_of(df, column), steps), column), F.expr("map()").cast("map<string,string>"))
    rows = df.withColumn("__made", made)
    own = F.coalesce("fields", F.expr("map()").cast("map<string,string>")) if "fields" in df.columns else F.expr("map()").cast("map<string,string>")
    rows = rows.withColumn("fields", F.map_concat(F.map_filter("__made", lambda k, _: ~F.map_contains_key(own, k)), own))
    return rows.drop("__made")


def delimited_fields(c: Column, names: Sequence[str], mark: str = ",") -> Column:
    """Map of a delimited text's values by names; quoted values may hold the mark, values without a name are ``column N``."""
    cells = F.from_csv(c, ", ".join(f"c{k} string" for k in range(len(names))), {"sep": mark})
    return F.when(c.isNotNull(), F.map_filter(F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), cells[f"c{k}"])]), lambda _, v: v.isNotNull()))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of an expression's group in a text, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def transform(c: Column, steps: Sequence[str]) -> Column:
    if len(steps) > 8:
        raise ValueError("more than 8 steps")
    for s in steps:
        c = step(c, s)
    return c


def query_map(url: Column) -> Column:
    """Parameters of a URL or query string; of a name that stands twice the last holds."""
    text = F.regexp_replace(F.regexp_extract(url, r"(?s)(?:^[^?]*\?|^)([^#?]*=[^#]*)", 1), r"^\?", "")
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    decoded = F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.lit("")).alias("k"),
                                                    F.try_url_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    return F.aggregate(decoded, F.expr("map()").cast("map<string,string>"),
                       lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


@dataclass(frozen=True)
class Rule:
    """A derived field's rule: pattern over a column, a template with $1, and filters that must hold."""

    column: str
    pattern: str
    template: str = "$1"
    filters: tuple[Filter, ...] = ()


def derived_field(df: DataFrame, name: str, rules: Sequence[Rule]) -> DataFrame:
    """The first rule whose result isn't empty gives the field."""
    options = []
    for r in rules:
        c = column_of(df, r.column).cast("string")
        parts = re.split(r"\$(\d)", r.template)
        made = [F.regexp_extract(c, r.pattern, int(p)) if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p]
        value = F.concat(*made) if made else F.lit("")
        hit = c.rlike(r.pattern) & compile_filters(df, list(r.filters))
        options.append(F.when(hit & (F.trim(value) != ""), value))
    return df.withColumn(name, F.coalesce(*options, F.lit(None).cast("string")))


def mask_personal(c: Column) -> Column:
    """Addresses of mail, cards, tokens and IPs masked for export."""
    out = F.regexp_replace(c, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "‹mail›")
    out = F.regexp_replace(out, r"(?i)\b(bearer|token|password|senha|secret|api[_-]?key)(\s*[:=]\s*|\s+)\S+", "$1$2‹secret›")
    out = F.regexp_replace(out, r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", "‹card›")
    return F.regexp_replace(out, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "‹ip›")
