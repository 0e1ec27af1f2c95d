"""Roles of fields (user, addresses, host, process …), actions and outcomes, and the normalised security overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import formats
from logweave.functions.net import ip_scope, ipv4_number
from logweave.functions.transforms import lower_keys

# Field names of each role, the most trusted first.
ALIASES = {
    "user": "user.name user username usuario usuário TargetUserName SubjectUserName AccountName userName actor login uid suser duser principal",
    "src_ip": "source.ip src_ip src srcip client_ip clientip c-ip remote_addr sourceIPAddress IpAddress SRC src_addr remote id.orig_h",
    "dst_ip": "destination.ip dst_ip dst dstip server_ip s-ip DestinationIp DST dst_addr id.resp_h",
    "host": "host.name host hostname computer Computer WorkstationName dvchost server",
    "process": "process.executable process.name process Image NewProcessName exe comm app program",
    "parent_process": "process.parent.executable process.parent.name ParentImage ParentProcessName parent",
    "cmdline": "process.command_line CommandLine cmdline command COMMAND ProcessCommandLine proctitle",
    "url": "url.full url uri request path cs-uri-stem requestURL",
    "domain": "dns.question.name domain query QueryName fqdn",
    "hash": "file.hash.sha256 hash sha256 sha1 md5 Hashes fileHash",
    "dst_port": "destination.port dst_port dpt dport DPT DestinationPort id.resp_p",
    "user_agent": "user_agent.original user_agent agent cs(user-agent) http_user_agent requestClientApplication",
    "file": "file.path file filename TargetFilename fname filePath ObjectName",
    "status": "http.response.status_code status sc-status status_code code_http",
    "action": "event.action action act eventName Operation EventAction",
    "outcome": "event.outcome outcome result success res Status",
}
# Actions told from Windows event numbers, and from words of messages; the first that matches wins.
CODE_ACTIONS = {
    "4624": "logon", "4625": "logon", "4634": "logoff", "4648": "logon_explicit", "4672": "privileged_logon", "4688": "process_start", "1": "process_start", "4689": "process_end", "5": "process_end", "4697": "service_install", "7045": "service_install",
    "4698": "task_create", "4699": "task_delete", "4702": "task_update", "4719": "audit_policy_change", "4720": "account_create", "4722": "account_enable", "4725": "account_disable", "4726": "account_delete", "4738": "account_change", "4740": "account_lockout",
    "4723": "password_change", "4724": "password_change", "4728": "group_member_add", "4732": "group_member_add", "4729": "group_member_remove", "4733": "group_member_remove", "4768": "kerberos_tgt", "4769": "kerberos_service_ticket", "4657": "registry_change",
    "4663": "object_access", "5140": "share_access", "5156": "network_connection", "3": "network_connection", "1102": "log_clear", "4616": "time_change", "4104": "script_execution", "22": "dns_query", "7": "image_load", "8": "remote_thread", "10": "process_access", "11": "file_create", "23": "file_delete",
}
WORD_ACTIONS = (
    ("logon", r"accepted (?:password|publickey)|failed password|invalid user|authentication fail|logged in|login|logon|session opened|sign-?in"),
    ("logoff", r"logged out|logoff|logout|session closed|disconnected from user"), ("privilege_use", r"\bsudo\b|\bsu:|privilege"), ("account_create", r"new user|useradd|account created"),
    ("password_change", r"password changed|passwd"), ("log_clear", r"log (?:was )?cleared"), ("malware_detected", r"malware|virus|trojan|quarantin"), ("network_connection", r"connection (?:from|to|accepted|refused)|conex[ãa]o"),
    ("http_request", r"\b(?:GET|POST|PUT|DELETE|HEAD|PATCH) /"),
)
FAILURES = r"(?i)fail|denied|refused|invalid|unauthori[sz]ed|forbidden|blocked|error|recusad|negad|falha|inv[áa]lid"
SUCCESSES = r"(?i)success|accepted|allowed|granted|opened|\bok\b|concedid|sucesso|aceit"


def with_roles(events: DataFrame) -> DataFrame:
    """Events with a struct column ``roles``: a literal field ``@role`` wins, then the role's names in order of trust, then what the message shows."""
    rows = events.withColumn("__low", lower_keys(F.coalesce("fields", F.expr("map()").cast("map<string,string>"))))
    get = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("__low", F.lit(n.lower()))), F.lit("")) for n in names])
    m = F.coalesce("message", F.lit(""))
    found = lambda pattern: F.nullif(F.regexp_extract(m, pattern, 1), F.lit(""))
    shown = {
        "user": found(r"(?i)\b(?:user|usu[áa]rio|for(?: invalid user)?|usuario)[ =:]+'?([\w.@\\-]+)"), "src_ip": found(r"(?i)\b(?:from|rhost=|src=|client:?) ?((?:\d{1,3}\.){3}\d{1,3})"), "url": found(r"(https?://[^\s\"'<>]+)"),
        "hash": found(r"\b([0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"),
    }
    roles = {}
    for role, names in ALIASES.items():
        own = F.nullif(F.try_element_at("__low", F.lit(f"@{role}")), F.lit(""))
        roles[role] = F.coalesce(own, get(names.split()), *([shown[role]] if role in shown else []))
    code = F.create_map(*[x for k, v in CODE_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    words = F.lit(None).cast("string")
    for name, pattern in reversed(WORD_ACTIONS):
        words = F.when(m.rlike("(?iu)" + pattern), name).otherwise(words)
    roles["action"] = F.coalesce(F.nullif(F.try_element_at("__low", F.lit("@action")), F.lit("")), F.try_element_at(code, F.col("code")), F.lower(roles["action"]), words, F.lit("activity"))
    status = roles["status"].try_cast("int")
    told = F.coalesce(roles["outcome"], F.lit(""))
    roles["outcome"] = F.when(F.col("code") == "4625", "failure").when(F.col("code") == "4624", "success").when(told.rlike(r"(?i)^(?:failure|fail|failed|no|false|error|denied|blocked)$"), "failure").when(told.rlike(r"(?i)^(?:success|succeeded|yes|true|ok|allowed|0x0)$"), "success")
    roles["outcome"] = roles["outcome"].when(status.between(400, 599), "failure").when(status.between(100, 399), "success").when(m.rlike(FAILURES), "failure").when(m.rlike(SUCCESSES), "success")
    roles["src_scope"], roles["dst_scope"] = ip_scope(roles["src_ip"]), ip_scope(roles["dst_ip"])
    roles["tool"] = F.coalesce(formats.user_agent(roles["user_agent"])["family"], F.nullif(F.regexp_extract(roles["process"], r"([^/\\]+?)(?:\.exe)?$", 1), F.lit("")))
    return rows.withColumn("roles", F.struct(*[c.cast("string").alias(k) for k, c in roles.items()])).drop("__low")


# What marks attacks in requests.
WEB_ATTACK = r"(?i)(?:\.\./){2}|%2e%2e%2f|union(?:\s|\+|%20)+select|<script|%3cscript|/etc/passwd|\bor\b\s*['\"]?1['\"]?\s*=\s*['\"]?1|\$\{jndi:|;\s*(?:cat|wget|curl)\b|cmd\.exe|xp_cmdshell"
#: Words that stand together in commands that hand a shell to a remote machine: a socket of the shell itself, a pipe to a network tool,
#: or an interpreter that opens a socket and gives it to a process.
SHELL_WORDS = (("/dev/tcp/", ">&"), ("/dev/udp/", ">&"), ("mkfifo", "nc "), ("socket", "dup2"), ("socket", "subprocess"), ("pty.spawn(",), ("fsockopen(", "exec"), ("tcpsocket", "popen"))
#: Folders into which web applications let users write.
WRITABLE = ("upload", "uploads", "userfiles", "usercontent", "wp-content", "incoming", "tmp")


def hands_out_shell(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for words in SHELL_WORDS:
        both = F.lit(True)
        for w in words:
            both = both & F.contains(low, F.lit(w))
        out = out | both
    return out


def with_security(events: DataFrame) -> DataFrame:
    """Events with ``_sec``, a map of normalised security facts, each from the roles or the request."""
    rows = events if "roles" in events.columns else with_roles(events)
    r = lambda n: F.col(f"roles.{n}")
    url = F.coalesce(r("url"), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Z]+ )?(?:https?://[^/]+)?", ""), r"[?#\s].*$", "")
    status = r("status").try_cast("int")
    parts = {
        "action": r("action"), "outcome": r("outcome"), "host": r("host"), "identity": F.lower(r("user")), "source_address": r("src_ip"), "process": r("process"), "command": r("cmdline"), "resource": F.coalesce(r("file"), F.nullif(path, F.lit(""))),
        "url.path": F.nullif(path, F.lit("")), "http.status": status.cast("string"), "http.status_class": F.when(status.isNotNull(), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))), "http.method": F.nullif(F.regexp_extract(F.coalesce(r("url"), F.col("message")), r"\b(GET|POST|PUT|DELETE|HEAD|PATCH|OPTIONS)\b", 1), F.lit("")),
        "web.attack": F.when(url.rlike(WEB_ATTACK) | F.coalesce(F.try_url_decode(url), F.lit("")).rlike(WEB_ATTACK), "true"), "web.script": F.when(path.rlike(r"(?i)\.(?:php\d?|phtml|aspx?|jspx?|cgi|cfm)$"), "true"),
        "web.upload_dir": F.when(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, WRITABLE))), "true"), "reverse_shell": F.when(hands_out_shell(F.coalesce(r("cmdline"), F.col("message"))), "true"), "source_public": F.when(ipv4_number(r("src_ip")).isNotNull() & (r("src_scope") == "público"), "true"),
    }
    return rows.withColumn("_sec", F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()))


def day_first(dates: Column) -> Column:
    """Aggregate: whether numeric dates of a file start with the day; null where none tells."""
    a, b = F.regexp_extract(dates, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", 1).try_cast("int"), F.regexp_extract(dates, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", 2).try_cast("int")
    first, second = F.count_if(a.between(13, 31) & b.between(1, 12)), F.count_if(b.between(13, 31) & a.between(1, 12))
    return F.when(first > second, True).when(second > first, False)


def looks_like_version(c: Column) -> Column:
    """Texts such as 1.2.3 or v10.4.1-rc2, which aren't dates."""
    return c.rlike(r"(?i)^v?\d{1,3}(?:\.\d{1,3}){1,3}(?:[-+][\w.]+)?$")


def reconstruct(events: DataFrame, key: str, ident: str = "id") -> DataFrame:
    """Records that a producer wrote in several parts, joined by its id in order: key, first_id, parts, raw, fields (the first value of a name holds)."""
    rows = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(F.col(ident).alias("i"), "raw", "fields")).alias("p"))
    rows = rows.withColumn("p", F.array_sort("p", lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))
    merged = F.aggregate(F.transform("p", lambda x: x["fields"]), F.expr("map()").cast("map<string,string>"), lambda m, f: F.map_concat(m, F.map_filter(f, lambda k, _: ~F.map_contains_key(m, k))))
    return rows.select(key, F.col("p")[0]["i"].alias("first_id"), F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["raw"]), "\n").alias("raw"), merged.alias("fields"))


def client_inventory(events: DataFrame, agent: Column) -> DataFrame:
    """Events by class, family and system of user agents."""
    parts = formats.user_agent(agent)
    return events.where(agent.isNotNull()).groupBy(*[parts[k].alias(k) for k in ("class", "family", "os")]).agg(F.count("*").alias("n"), F.count_if(parts["anomaly"].isNotNull()).alias("anomalies"))


def deobfuscate(c: Column) -> Column:
    """A command with percent, hexadecimal and character escapes undone, carets and joined quotes dropped."""
    out = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    out = F.regexp_replace(out, r"\^|`|\"\"|''|'\s*\+\s*'|\"\s*\+\s*\"", "")
    return F.regexp_replace(F.lower(out), r"\s+", " ")


def participants(events: DataFrame) -> DataFrame:
    """Events with their security facts as columns and a struct column ``participants``: attacker, target, and why they are taken for it; null where nothing tells.

    A failed logon is an attempt of its source on the account's host; a request with the marks of an attack one of its client on the server;
    a file or account that is changed is the target of the one who changes it.
    """
    from logweave.operators.rules import flat

    rows = flat(events)  # written once: the facts stand in many of the conditions
    sec = lambda n: F.col(f"`{n}`")
    made = lambda a, t, why: F.struct(a.alias("attacker"), t.alias("target"), F.lit(why).alias("why"))
    told = F.when((sec("action") == "logon") & (sec("outcome") == "failure") & sec("source_address").isNotNull(), made(sec("source_address"), F.coalesce(sec("host"), sec("identity")), "failed logon"))
    told = told.when((sec("web.attack") == "true") & sec("source_address").isNotNull(), made(sec("source_address"), F.coalesce(sec("host"), sec("url.path")), "request with an attack"))
    told = told.when(sec("reverse_shell") == "true", made(F.coalesce(sec("identity"), sec("host")), sec("host"), "shell handed out"))
    told = told.when(sec("action").isin("account_change", "account_delete", "password_change", "group_member_add", "log_clear"), made(sec("identity"), F.coalesce(sec("resource"), sec("host")), "change"))
    return rows.withColumn("participants", told)


def retimestamp(events: DataFrame, rules: list[dict], zone: str = "UTC") -> DataFrame:
    """Events with ``ts`` derived anew by a user's rules: file (an expression over part_file), pattern (its first group is the stamp in raw), zone, year, day_first.

    The first rule whose file and pattern fit holds; other events keep their time.
    """
    from logweave.operators.stamps import to_epoch_ms

    raw = F.coalesce("raw", "message")
    picked = F.lit(None).cast("struct<s:string,z:string,y:int,f:boolean>")
    for r in reversed(rules):
        hit = F.coalesce(F.col("part_file"), F.lit("")).rlike(r.get("file", "")) & raw.rlike(r["pattern"])
        one = F.struct(F.regexp_extract(raw, r["pattern"], 1).alias("s"), F.lit(r.get("zone", zone)).alias("z"), F.lit(r.get("year")).cast("int").alias("y"), F.lit(r.get("day_first", True)).alias("f"))
        picked = F.when(hit, one).otherwise(picked)
    rows = events.withColumn("__p", picked).withColumns({"__s": F.col("__p.s"), "__z": F.col("__p.z"), "__y": F.col("__p.y"), "__d": F.lit(None).cast("string"), "__f": F.col("__p.f")})
    rows = rows.withColumn("__ts", to_epoch_ms("__s", "__z", "__y", "__d", "__f"))
    return rows.withColumn("ts", F.coalesce("__ts", "ts")).drop("__p", "__s", "__z", "__y", "__d", "__f", "__ts")


def map_sources(events: DataFrame, mapping: list[dict]) -> DataFrame:
    """Events with fields named and scaled as a user declares by source: source (an expression), fields {name: {from, factor}}; the first mapping that fits holds."""
    own = F.coalesce("fields", F.expr("map()").cast("map<string,string>"))
    made = own

    def over(new: Column) -> Column:
        return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k)), new)

    for m in reversed(mapping):
        entries = []
        for name, how in m["fields"].items():
            value = F.try_element_at(own, F.lit(how["from"]))
            if "factor" in how:
                value = F.coalesce((value.try_cast("double") * how["factor"]).cast("string"), value)
            entries += [F.lit(name), value]
        new = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
        made = F.when(F.coalesce(F.col("source"), F.lit("")).rlike(m["source"]), over(new)).otherwise(made)
    return events.withColumn("fields", made)
