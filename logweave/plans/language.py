"""The search language: text to syntax tree to Column.

    expression := or ; or := and (OR and)* ; and := not ([AND] not)* ; not := [NOT | - | !] atom
    atom := ( expression ) | field operator value | value
    value := word | "phrase" | /regex/ | a..b | [a TO b] | ( value OR value, ... ) | word with * and ?

Logic is two-valued: a missing value makes a condition false before NOT is applied.  Conditions that aren't negated are left null on
missing values, which counts as no: plain comparisons so stay in a form that reaches the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.events import LEVELS, column_of
from logweave.functions.net import in_nets, is_net
from logweave.functions.units import num_unit, parse_number

# Columns whose values are searched by substring, aliases of columns, and words of the operators.
TEXT_COLUMNS = ("message", "description", "name", "raw")
ALIASES = {"origem": "source", "nivel": "level", "nível": "level", "codigo": "code", "código": "code", "mensagem": "message", "usuario": "user",
           "usuário": "user", "nome": "name", "descricao": "description", "tempo": "ts", "timestamp": "ts", "arquivo": "part_file", "caminho": "part_path"}
AND_WORDS, OR_WORDS, NOT_WORDS = ("AND", "E", "&&"), ("OR", "OU", "||"), ("NOT", "NÃO", "NAO", "!")
MEMBERSHIPS = {"regra": "threat", "deteccao": "rule", "detecção": "rule"}
LEVEL_WORDS = {"critico": 0, "crítico": 0, "critical": 0, "fatal": 0, "erro": 1, "error": 1, "err": 1, "aviso": 2, "warn": 2, "warning": 2,
               "informacao": 3, "informação": 3, "info": 3, "depuracao": 4, "depuração": 4, "debug": 4, "rastreio": 5, "trace": 5}

_TOKEN = re.compile(
    r"""\s*(?:(?P<regex>/(?:[^/\\]|\\.)+/)|(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<range>\[[^\]]*?\s+TO\s+[^\]]*\])|(?P<sign>[()]|&&|\|\|)"""
    r"""|(?P<field>[\w@][\w.@-]*)(?P<op>!=|>=|<=|:|=|>|<)|(?P<minus>[-!](?=\S))|(?P<word>[^\s()"]+))""",
    re.X,
)


class QueryError(ValueError):
    """A text that isn't an expression of the language."""


@dataclass
class Node:
    kind: str  # and, or, not, text, field
    children: list["Node"] = field(default_factory=list)
    name: str = ""
    op: str = ""
    value: tuple = ()


def tokenize(text: str) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:at + 10]!r}")
        if m["field"]:
            out.append(("field", m["field"], m["op"]))
        else:
            out.append((m.lastgroup, m[m.lastgroup], ""))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self) -> tuple[str, str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", "")

    def take(self) -> tuple[str, str, str]:
        t = self.peek()
        self.at += 1
        return t

    def parse(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek()[1] in OR_WORDS and self.peek()[0] in ("word", "sign"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both(self) -> Node:
        parts = [self.negation()]
        while True:
            kind, text, _ = self.peek()
            if kind in ("word", "sign") and text in AND_WORDS:
                self.take()
            elif kind == "end" or kind in ("word", "sign") and text in (*OR_WORDS, ")"):
                break
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def negation(self) -> Node:
        kind, text, _ = self.peek()
        if kind == "minus" or kind == "word" and text in NOT_WORDS:
            self.take()
            return Node("not", [self.negation()])
        return self.atom()

    def atom(self) -> Node:
        kind, text, op = self.take()
        if (kind, text) == ("sign", "("):
            node = self.either()
            if self.take()[1] != ")":
                raise QueryError("missing )")
            return node
        if kind == "field":
            return Node("field", name=text, op=op, value=self.values())
        if kind in ("word", "phrase", "regex"):
            return Node("text", value=(self.literal(kind, text),))
        raise QueryError("an expression is missing" if kind == "end" else f"unexpected {text!r}")

    def literal(self, kind: str, text: str) -> tuple[str, str]:
        if kind == "phrase":
            return "phrase", re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "regex":
            return "regex", text[1:-1].replace("\\/", "/")
        if kind == "range":
            lo, hi = re.split(r"\s+TO\s+", text[1:-1].strip())
            return "range", f"{lo}\0{hi}"
        if m := re.fullmatch(r"(.+?)\.\.(.+)", text):
            return "range", f"{m[1]}\0{m[2]}"
        return ("wild" if re.search(r"[*?]", text) else "word"), text

    def values(self) -> tuple:
        kind, text, op = self.take()
        if (kind, text) != ("sign", "("):
            if kind == "field":  # a value with a colon of its own, as in an address
                kind, text = "word", text + op + (self.take()[1] if self.peek()[0] in ("word", "field") else "")
            if kind not in ("word", "phrase", "regex", "range"):
                raise QueryError("a value is missing")
            return (self.literal(kind, text),)
        out = []
        while True:
            kind, text, _ = self.take()
            if kind == "end":
                raise QueryError("missing )")
            if text == ")" and kind == "sign":
                break
            if text in OR_WORDS:
                continue
            for part in text.split(",") if kind == "word" else [text]:
                if part:
                    out.append(self.literal(kind, part))
        return tuple(out)


def wildcard(text: str) -> str:
    return "(?isu)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text) + "$"


class Compiler:
    def __init__(self, df: DataFrame):
        self.df = df
        self.skip = {"arquivo", "caminho", "part_file", "part_path", "raw", "event_ref", "level", "parse_status"}

    def free(self, kind: str, text: str) -> Column:
        """Free text: a phrase in any text of the event, values apart so that it can't span two of them."""
        names = [c for c, t in self.df.dtypes if t == "string" and c not in self.skip]
        parts = [F.col(f"`{c}`") for c in names]
        if "fields" in self.df.columns:
            parts.append(F.array_join(F.map_values("fields"), "\x1f"))
        whole = F.concat_ws("\x1f", *parts)
        if kind == "regex":
            return F.exists(F.split(whole, "\x1f"), lambda v: v.rlike("(?iuU)" + text))
        if kind == "wild":
            text = text.strip("*")
            if re.search(r"[*?]", text):
                return F.exists(F.split(whole, "\x1f"), lambda v: v.rlike(wildcard(text).replace("^", "", 1)[:-1]))
        return F.contains(F.lower(whole), F.lit(text.lower()))

    def number(self, c: Column, text: str) -> tuple[Column, Column]:
        if re.match(r"^\d{4}-\d\d-\d\d", text):
            return c.cast("long"), F.unix_millis(F.to_timestamp(F.lit(text.strip('"'))))
        got = parse_number(text)
        if got is None:
            raise QueryError(f"no number: {text!r}")
        return num_unit(c.cast("string")), F.lit(got[0])

    def one(self, name: str, op: str, kind: str, text: str) -> Column:
        key = ALIASES.get(name.lower(), name)
        c = column_of(self.df, key)
        t = c.cast("string")
        if op in (">", ">=", "<", "<="):
            a, b = self.number(c, text)
            return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        if op in ("=", "!="):
            return t == text
        if kind == "range":
            lo, hi = text.split("\0")
            (a, x), (_, y) = self.number(c, lo), self.number(c, hi)
            if parse_number(lo) and parse_number(hi) and parse_number(lo)[0] > parse_number(hi)[0]:
                raise QueryError("the range's bounds are in the wrong order")
            return (a >= x) & (a <= y)
        if kind == "regex":
            return t.rlike("(?iuU)" + text)
        if text == "*":
            return F.length(F.trim(t)) > 0
        if kind == "wild":
            return t.rlike(wildcard(text))
        if key == "level" and text.lower() in LEVEL_WORDS:
            return t == LEVELS[LEVEL_WORDS[text.lower()]]
        if kind == "word" and is_net(text):
            return in_nets(t, [text])
        if key in TEXT_COLUMNS:
            return F.contains(F.lower(t), F.lit(text.lower()))
        return F.lower(F.trim(t)) == text.strip().lower()

    def compile(self, node: Node) -> Column:
        match node.kind:
            case "and" | "or":
                out = self.compile(node.children[0])
                for x in node.children[1:]:
                    out = out & self.compile(x) if node.kind == "and" else out | self.compile(x)
                return out
            case "not":
                return ~F.coalesce(self.compile(node.children[0]), F.lit(False))
            case "text":
                return self.free(*node.value[0])
        if node.name.lower() in MEMBERSHIPS and node.op == ":":
            from logweave.operators.rules import selects, threat_condition

            of = threat_condition if MEMBERSHIPS[node.name.lower()] == "threat" else selects
            out = F.lit(False)
            for _, text in node.value:
                out = out | F.coalesce(of(self.df, text), F.lit(False))
            return out
        out = F.lit(False)
        plain = [v for k, v in node.value if k in ("word", "phrase") and not is_net(v)]
        key = ALIASES.get(node.name.lower(), node.name)
        if node.op == ":" and len(plain) == len(node.value) > 1 and key not in (*TEXT_COLUMNS, "level"):
            return F.lower(F.trim(column_of(self.df, key).cast("string"))).isin([v.strip().lower() for v in plain])
        for kind, text in node.value:
            out = out | self.one(node.name, node.op, kind, text)
        return ~F.coalesce(out, F.lit(False)) if node.op == "!=" else out


def compile_query(df: DataFrame, text: str) -> Column:
    """The predicate of a query over the events ``df``, where null counts as no; an empty query holds for every event."""
    return Compiler(df).compile(Parser(text).parse()) if text.strip() else F.lit(True)


def search(df: DataFrame, text: str) -> DataFrame:
    return df.where(compile_query(df, text))


def required_words(node: Node) -> list[str]:
    """ASCII words that every text that fits holds somewhere, in lower case: what can be told from the lines before they are parsed."""
    if node.kind == "and":
        return [w for x in node.children for w in required_words(x)]
    plain = node.kind == "text" or node.kind == "field" and node.op in (":", "=") and len(node.value) == 1 and node.name.lower() not in (*MEMBERSHIPS, "level", "nivel", "nível")
    if plain and node.value[0][0] in ("word", "phrase") and re.fullmatch(r"[A-Za-z_]{2,}", node.value[0][1]):
        return [node.value[0][1].lower()]
    return []


def prefiltered(lines: DataFrame, text: str, line: str = "line") -> DataFrame:
    """Lines that may hold events of a query: those without one of its required words can't; what may be written otherwise stays."""
    out = lines
    for w in required_words(Parser(text).parse()) if text.strip() else []:
        out = out.where(F.contains(F.lower(F.col(line)), F.lit(w)) | F.col(line).contains("\\u") | F.col(line).contains("%"))
    return out
