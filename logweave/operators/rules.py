"""Detection rules as data: compiled by kind, with evidence, suppression, threat texts and tactics.

A rule is a dictionary: id, kind, where (search language), any (a condition on the elements of a JSON list), by, window, count, steps,
severity, evidence, tactic, and what its kind needs.  A step is a condition, or a condition with a count.  ``field`` names one
field or several, of which the first that holds a value counts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators import detect as D
from logweave.plans.language import compile_query
from logweave.plans.sigma import span_ms

SEVERITIES = ("info", "low", "medium", "high", "critical")
# Tactics of ATT&CK techniques, by the number that a rule's id starts with.
TACTICS = {
    "T1003": "credential-access", "T1053": "persistence", "T1059": "execution", "T1070": "defense-evasion", "T1078": "initial-access", "T1098": "persistence", "T1110": "credential-access",
    "T1136": "persistence", "T1190": "initial-access", "T1505": "persistence", "T1543": "persistence", "T1562": "defense-evasion",
}
_RUN = "action:(process_start OR script_execution)"
_FAILED, _ENTERED = "action:logon outcome:failure", "action:logon outcome:success"
#: Rules of the package's own, one or more for a technique.
BASE = (
    {"id": "T1003-registry-secrets", "kind": "single", "severity": "high", "evidence": 3, "where": f"{_RUN} command:*hklm* command:(*save* OR *export*)"},
    {"id": "T1053-task", "kind": "single", "severity": "low", "evidence": 2, "where": "action:task_create"},
    {"id": "T1059-shell-handed-out", "kind": "single", "severity": "critical", "evidence": 4, "where": "reverse_shell:true"},
    {"id": "T1070-log-cleared", "kind": "single", "severity": "high", "evidence": 4, "where": "action:log_clear"},
    {"id": "T1098-group-member", "kind": "single", "severity": "medium", "evidence": 2, "where": "action:group_member_add"},
    {"id": "T1136-account", "kind": "single", "severity": "medium", "evidence": 2, "where": "action:account_create"},
    {"id": "T1190-answered-probe", "kind": "single", "severity": "high", "evidence": 3, "where": "web.attack:true http.status_class:2xx"},
    {"id": "T1505-script-sent", "kind": "single", "severity": "high", "evidence": 3, "where": "web.script:true web.upload_dir:true http.method:(POST OR PUT)"},
    {"id": "T1543-service", "kind": "single", "severity": "medium", "evidence": 2, "where": "action:service_install"},
    {"id": "T1562-audit-policy", "kind": "single", "severity": "medium", "evidence": 3, "where": "action:audit_policy_change"},
    {"id": "T1110-guessing", "kind": "threshold", "severity": "medium", "evidence": 2, "by": ["identity"], "window": "10m", "count": 5, "where": _FAILED},
    {"id": "T1110-spraying", "kind": "distinct", "severity": "high", "evidence": 3, "by": ["source_address"], "window": "30m", "count": 6, "field": ["identity", "host"], "where": _FAILED},
    {"id": "T1110-guessed", "kind": "sequence", "severity": "high", "evidence": 4, "by": ["identity"], "window": "1h", "steps": [{"where": _FAILED, "count": 3}, _ENTERED]},
    {"id": "T1136-made-powerful", "kind": "sequence", "severity": "high", "evidence": 4, "by": ["host"], "window": "1h", "steps": ["action:account_create", "action:group_member_add"]},
    {"id": "T1078-new-source", "kind": "new_value", "severity": "low", "evidence": 2, "by": ["identity"], "field": "source_address", "where": _ENTERED},
)


FACTS = ("action", "outcome", "host", "identity", "source_address", "process", "command", "resource", "url.path", "http.status", "http.status_class", "http.method", "web.attack", "web.script", "web.upload_dir", "reverse_shell", "source_public")


def flat(events: DataFrame) -> DataFrame:
    """Events with the security facts as columns for the rules' conditions.

    The facts are written once to the shared folder: all rules read them from there instead of deriving them each.
    """
    from logweave.operators.roles import with_security
    from logweave.session import cut

    rows = events if "_sec" in events.columns else with_security(events)
    rows = cut(rows.select("id", "ts", "source", "code", "level", "message", "_sec"))
    return rows.select(*[c for c in rows.columns if c != "_sec"], *[F.try_element_at("_sec", F.lit(n)).alias(n) for n in FACTS])


def load_rules(text: str) -> list[dict]:
    """Rules written as a JSON list, or as an object with ``rules``; a rule without id or kind is refused."""
    got = json.loads(text)
    rules = got.get("rules", []) if isinstance(got, dict) else got
    for r in rules:
        if not r.get("id") or not r.get("kind"):
            raise ValueError(f"a rule needs id and kind: {r!r}")
    return rules


def any_element(text: Column, tests: Sequence[tuple[str, str, str]]) -> Column:
    """Whether one element of a JSON list (of objects, or one object) passes all tests (key, equals | contains | regex, value); a dotted key goes down."""
    elements = F.from_json(F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<string>")

    def one(e: Column) -> Column:
        out = F.lit(True)
        for key, op, value in tests:
            v = F.get_json_object(e, "$" + "".join(f"['{k}']" for k in key.split(".")))
            out = out & {"equals": F.lower(v) == value.lower(), "contains": F.contains(F.lower(v), F.lit(value.lower())), "regex": v.rlike(value)}[op]
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.exists(elements, one), F.lit(False))


def _steps(df: DataFrame, rule: dict) -> list[Column]:
    out = []
    for s in rule["steps"]:
        where, count = (s, 1) if isinstance(s, str) else (s["where"], int(s.get("count", 1)))
        out += [compile_query(df, where)] * count
    return out


def _where(df: DataFrame, rule: dict) -> Column:
    where = compile_query(df, rule.get("where", ""))
    for path, tests in rule.get("any", {}).items():
        where = where & any_element(F.col(f"`{path}`") if path in df.columns else F.try_element_at("fields", F.lit(path)), tests)
    if rule.get("unless"):
        where = where & ~F.coalesce(compile_query(df, rule["unless"]), F.lit(False))
    return where


def _value(rule: dict) -> Column:
    names = [rule["field"]] if isinstance(rule["field"], str) else rule["field"]
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names])


def _entity(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.concat_ws(" / ", *keys) if keys else F.coalesce(F.col("host"), F.col("source")) if "host" in df.columns else F.col("source")


def run(df: DataFrame, rule: dict) -> DataFrame:
    """Findings of one rule: rule, severity, evidence, entity, first, last, n."""
    by = rule.get("by", [])
    where = _where(df, rule)
    width = span_ms(rule.get("window", "1h"))
    keyed = df.withColumns({f"__k{i}": F.col(f"`{b}`") for i, b in enumerate(by)})
    keys = [f"__k{i}" for i in range(len(by))]
    for k in keys:
        where = where & F.col(k).isNotNull()
    entity = _entity(df, keys)
    ts, one, none = F.col("ts"), F.lit(1).cast("long"), F.lit(None).cast("long")
    match rule["kind"]:
        case "single":
            found = keyed.where(where).select(entity.alias("entity"), ts.alias("first"), ts.alias("last"), one.alias("n"))
        case "threshold":
            found = D.threshold(keyed, where, keys, rule["count"], width).select(entity.alias("entity"), "first", "last", F.col("hits").alias("n"))
        case "distinct":
            found = D.distinct(keyed.withColumn("__v", _value(rule)), where, keys, "__v", rule["count"], width).select(entity.alias("entity"), "first", "last", F.col("hits").alias("n"))
        case "sequence" | "temporal" as kind:
            known = keyed
            for k in keys:
                known = known.where(F.col(k).isNotNull())
            found = D.sequence(known, _steps(df, rule), keys, width, kind == "sequence").select(entity.alias("entity"), "first", "last", F.size("events").cast("long").alias("n"))
        case "absence":
            until = rule.get("until") or df.agg(F.max("ts").alias("m")).first()["m"] or 0
            hit = D.absence(keyed, where, compile_query(df, rule["expected"]), keys, width, until)
            found = hit.select(entity.alias("entity"), ts.alias("first"), ts.alias("last"), one.alias("n"))
        case "ratio":
            hit = D.ratio(keyed, compile_query(df, rule["numerator"]), where, keys, rule["gte"], width)
            found = hit.select(entity.alias("entity"), ts.alias("first"), ts.alias("last"), F.col("win_n").alias("n"))
        case "beacon":
            found = D.beacon(keyed.where(where), keys, rule.get("count", 6)).select(entity.alias("entity"), none.alias("first"), none.alias("last"), F.col("hits").alias("n"))
        case "new_value":
            found = D.new_value(keyed.where(where).withColumn("__v", _value(rule)), keys, "__v", rule.get("history", 5)).select(entity.alias("entity"), ts.alias("first"), ts.alias("last"), one.alias("n"))
        case "appeared":
            found = D.appeared(keyed.where(where).withColumn("__status", F.col("`http.status`").try_cast("int")), keys[0], "__status", rule.get("count", 3)).select(entity.alias("entity"), F.col("appeared").alias("first"), F.col("appeared").alias("last"), F.col("misses").alias("n"))
        case "size_outlier":
            hit = D.size_outlier(keyed.where(where).withColumn("__size", _value(rule).try_cast("double")), keys[0], "__size")
            found = hit.select(entity.alias("entity"), ts.alias("first"), ts.alias("last"), one.alias("n"))
        case other:
            raise ValueError(f"unknown kind {other!r}")
    return found.select(*_named(rule), "entity", "first", "last", "n")


def _named(rule: dict) -> list[Column]:
    return [F.lit(rule["id"]).alias("rule"), F.lit(rule.get("severity", "medium")).alias("severity"), F.lit(int(rule.get("evidence", 1))).alias("evidence")]


def run_singles(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Findings of all rules of kind ``single`` in one pass over the events."""
    hits = []
    for rule in rules:
        keys = [F.col(f"`{b}`") for b in rule.get("by", [])]
        where = _where(df, rule)
        for k in keys:
            where = where & k.isNotNull()
        hits.append(F.when(where, F.struct(*_named(rule), _entity(df, keys).alias("entity"))))
    found = df.select("ts", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    return found.select("h.*", F.col("ts").alias("first"), F.col("ts").alias("last"), F.lit(1).cast("long").alias("n"))


def run_all(df: DataFrame, rules: Sequence[dict] = BASE, suppressed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Findings of all rules without the suppressed (rule, entity) pairs; ``*`` stands for any entity."""
    single = [r for r in rules if r["kind"] == "single"]
    parts = ([run_singles(df, single)] if single else []) + [run(df, r) for r in rules if r["kind"] != "single"]
    out = parts[0]
    for found in parts[1:]:
        out = out.unionByName(found)
    for name, entity in suppressed:
        out = out.where((F.col("rule") != name) | (F.lit(False) if entity == "*" else ~F.col("entity").eqNullSafe(F.lit(entity))))
    return out


def chain(findings: DataFrame, first: str, second: str, width: int) -> DataFrame:
    """Findings of a rule that follow ones of another on the same entity within a span."""
    from logweave.operators.joins import band_join

    a = findings.where(F.col("rule") == first).select("entity", F.col("last").alias("a_ts"))
    b = findings.where(F.col("rule") == second).select("entity", F.col("first").alias("b_ts"))
    return band_join(a, b, ["entity"], "a_ts", "b_ts", width, False)


def evidence(findings: DataFrame) -> DataFrame:
    """Evidence level 1 to 5 with a cap for single undated findings, and its label."""
    level = F.least(F.greatest("evidence", F.lit(1)), F.when(F.col("first").isNull(), F.lit(2)).otherwise(F.lit(5)))
    return findings.withColumn("level", level).withColumn("label", F.element_at(F.array(*map(F.lit, ("hint", "weak", "plausible", "strong", "confirmed"))), level))


def tactics(findings: DataFrame) -> DataFrame:
    """Findings, entities and the highest severity by tactic."""
    table = F.create_map(*[x for k, v in TACTICS.items() for x in (F.lit(k), F.lit(v))])
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = findings.withColumn("tactic", F.coalesce(F.try_element_at(table, F.substring_index("rule", "-", 1)), F.lit("other"))).withColumn("__r", rank)
    return rows.groupBy("tactic").agg(F.count("*").alias("findings"), F.count_distinct("entity").alias("entities"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max("__r").cast("int")).alias("severity"))


#: Threat texts: id, category, severity, expression over the normalised text.
THREATS = (
    ("traversal", "web", "medium", r"(?:\.\./){2,}|/etc/(?:passwd|shadow)"), ("sqli", "web", "high", r"union(?:\s|\+)+(?:all(?:\s|\+)+)?select|\bor\b\s+['\"]?1['\"]?\s*=\s*['\"]?1|sleep\(\d+\)"), ("xss", "web", "medium", r"<script|onerror\s*=|javascript:"),
    ("log4shell", "web", "critical", r"\$\{(?:jndi|lower:j|::-j)"), ("reverse-shell", "command", "high", r"/dev/(?:tcp|udp)/|\bn(?:c|cat)\b.*\s-[ec]\s"), ("powershell-encoded", "command", "high", r"powershell.*\s-e(?:nc|ncodedcommand)?\s+[a-z0-9+/=]{20,}"),
    ("download-run", "command", "high", r"(?:curl|wget)\s+\S+.*\|\s*(?:ba)?sh\b"), ("credential-dump", "command", "high", r"mimikatz|lsass\.dmp|sekurlsa|ntds\.dit"), ("ransom-note", "impact", "critical", r"your files (?:have been|are) encrypted"),
)


def load_threats(text: str) -> tuple[tuple[str, str, str, str], ...]:
    """A catalog of threat texts written as JSON objects with id, category, severity and pattern (an expression over lower-case text)."""
    got = json.loads(text)
    return tuple((t["id"], t.get("category", "other"), t.get("severity", "medium"), t["pattern"]) for t in (got.get("threats", []) if isinstance(got, dict) else got))


def threat_scan(events: DataFrame, text: Column, threats: Sequence[tuple[str, str, str, str]] = THREATS) -> DataFrame:
    """Events with the threat texts that they hold, in the text itself or with its escapes undone: threat, category, severity."""
    from logweave.operators.roles import deobfuscate

    both = F.concat_ws("\n", F.lower(text), deobfuscate(text))
    hits = F.filter(F.array(*[F.when(both.rlike(p), F.struct(F.lit(i).alias("threat"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for i, c, s, p in threats]), lambda x: x.isNotNull())
    return events.withColumn("t", F.explode(hits)).select("*", "t.*").drop("t")


def threat_condition(events: DataFrame, threat: str, threats: Sequence[tuple[str, str, str, str]] = THREATS) -> Column:
    """Whether an event's message or raw text holds a threat text."""
    from logweave.events import column_of
    from logweave.operators.roles import deobfuscate

    patterns = [p for i, _, _, p in threats if i == threat]
    if not patterns:
        raise ValueError(f"unknown threat {threat!r}")
    text = F.concat_ws("\n", column_of(events, "message").cast("string"), column_of(events, "raw").cast("string"))
    return F.concat_ws("\n", F.lower(text), deobfuscate(text)).rlike(patterns[0])


def selects(events: DataFrame, name: str, rules: Sequence[dict] = BASE) -> Column:
    """Whether some step or condition of a rule selects an event; the rule's facts are columns (``flat``) or fields."""
    rule = next((r for r in rules if r["id"] == name), None)
    if rule is None:
        raise ValueError(f"unknown rule {name!r}")
    out = F.lit(False)
    for where in _steps(events, rule) if "steps" in rule else [_where(events, rule)]:
        out = out | F.coalesce(where, F.lit(False))
    return out


def themes(findings: DataFrame, buckets: int = 24) -> DataFrame:
    """Findings by technique (the part of the rule's id before the first dash) and by one of ``buckets`` equal spans of the time they cover: theme, start, n."""
    span = findings.agg(F.min("first").alias("a"), F.max("first").alias("b")).first()
    low = span["a"] or 0
    width = max(1, -(-((span["b"] or 0) - low + 1) // buckets))
    start = low + F.floor((F.col("first") - low) / width) * width
    return findings.groupBy(F.substring_index("rule", "-", 1).alias("theme"), start.alias("start")).agg(F.count("*").alias("n"))
