"""Search language to the JSON query DSL of search servers, for filters pushed to a remote source."""

from __future__ import annotations

import re

from logweave.functions.units import parse_number
from logweave.plans.language import ALIASES, LEVEL_WORDS, TEXT_COLUMNS, Node, Parser
from logweave.events import LEVELS


def _number(text: str):
    got = parse_number(text)
    return text if got is None else int(got[0]) if got[0].is_integer() else got[0]


def _leaf(name: str, op: str, kind: str, text: str) -> dict:
    key = ALIASES.get(name.lower(), name)
    if op in (">", ">=", "<", "<="):
        return {"range": {key: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]: _number(text)}}}
    if kind == "range":
        lo, hi = text.split("\0")
        return {"range": {key: {"gte": _number(lo), "lte": _number(hi)}}}
    if kind == "regex":
        return {"regexp": {key: {"value": text, "case_insensitive": True}}}
    if text == "*":
        return {"exists": {"field": key}}
    if kind == "wild":
        return {"wildcard": {key: {"value": text, "case_insensitive": True}}}
    if key == "level" and text.lower() in LEVEL_WORDS:
        return {"term": {key: LEVELS[LEVEL_WORDS[text.lower()]]}}
    if op == ":" and key in TEXT_COLUMNS:
        return {"match_phrase": {key: text}}
    return {"term": {key: text if op in ("=", "!=") else {"value": text, "case_insensitive": True}}}


def to_dsl(node: Node) -> dict:
    match node.kind:
        case "and":
            return {"bool": {"filter": [to_dsl(x) for x in node.children]}}
        case "or":
            return {"bool": {"should": [to_dsl(x) for x in node.children], "minimum_should_match": 1}}
        case "not":
            return {"bool": {"must_not": [to_dsl(node.children[0])]}}
        case "text":
            kind, text = node.value[0]
            if kind == "regex":
                return {"query_string": {"query": f"/{text}/"}}
            return {"multi_match": {"query": re.sub(r"\*$", "", text), "type": "phrase_prefix" if kind == "wild" else "phrase", "fields": ["*"], "lenient": True}}
    leaves = [_leaf(node.name, node.op, k, t) for k, t in node.value]
    out = leaves[0] if len(leaves) == 1 else {"bool": {"should": leaves, "minimum_should_match": 1}}
    return {"bool": {"must_not": [out]}} if node.op == "!=" else out


def compile_remote(text: str, since: int | None = None, until: int | None = None, time_field: str = "@timestamp") -> dict:
    """The query of a text and a period in epoch milliseconds."""
    parts = [to_dsl(Parser(text).parse())] if text.strip() else []
    if since is not None or until is not None:
        parts.append({"range": {time_field: {k: v for k, v in (("gte", since), ("lt", until)) if v is not None} | {"format": "epoch_millis"}}})
    return {"bool": {"filter": parts}} if parts else {"match_all": {}}
