"""Fields of single-line formats as Column expressions; texts of another format give null fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.transforms import key_values

_ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?(?: (.*))?$'
_S5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]]*\])+)(?: (.*))?$"
_S3164 = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: (.*)$"
_CEF = r"(?:^|\s)CEF:(\d+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"
_LEEF = r"LEEF:([\d.]+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


def _fields(c: Column, pattern: str, names: list[str]) -> dict[str, Column]:
    hit = c.rlike(pattern)
    return {n: F.when(hit, F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))) for k, n in enumerate(names, 1) if n}


def access_log(c: Column) -> dict[str, Column]:
    """Common and combined access logs; request is split into method, path and protocol where it can be."""
    out = _fields(c, _ACCESS, ["client_ip", "", "user", "time_local", "request", "status", "size", "referer", "agent", "rest"])
    shape = r"^([A-Z]+) (\S+)(?: (HTTP/\S+))?$"
    for k, n in enumerate(("method", "path", "protocol"), 1):
        out[n] = F.nullif(F.regexp_extract(out["request"], shape, k), F.lit(""))
    return {k: F.nullif(v, F.lit("-")) for k, v in out.items()}


def syslog5424(c: Column) -> dict[str, Column]:
    out = _fields(c, _S5424, ["priority", "timestamp", "host", "app", "pid", "msgid", "data", "message"])
    p = out["priority"].try_cast("int")
    return out | {"facility": F.floor(p / 8).cast("int"), "severity": p % 8}


def structured_data(data: Column) -> Column:
    """Map ``sd.<id>.<param>`` of RFC 5424 structured data."""
    blocks = F.regexp_extract_all(data, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    pairs = F.flatten(F.transform(blocks, lambda b: F.transform(F.map_entries(key_values(b)), lambda e: F.struct(F.concat(F.lit("sd."), F.substring_index(b, " ", 1), F.lit("."), e["key"]).alias("k"), e["value"].alias("v")))))
    return F.map_from_entries(pairs)


def syslog3164(c: Column) -> dict[str, Column]:
    return _fields(c, _S3164, ["priority", "timestamp", "host", "app", "pid", "message"])


def cef(c: Column) -> dict[str, Column]:
    """Header fields and the extension as a map."""
    out = _fields(c, _CEF, ["version", "vendor", "product", "product_version", "signature", "name", "severity", ""])
    text = F.regexp_extract(c, _CEF, 8)
    # a value runs to the next key: break before each key
    broken = F.regexp_replace(text, r"(?:^|\s+)([\w.\[\]-]+)=", "\n$1=")
    lines = F.filter(F.split(broken, "\n"), lambda x: x.contains("="))
    entries = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^[^=]*=", ""), r"\\([=\\])", "$1").alias("v")))
    return out | {"extension": F.when(c.rlike(_CEF), last_wins(entries))}


def leef(c: Column) -> dict[str, Column]:
    out = _fields(c, _LEEF, ["version", "vendor", "product", "product_version", "event_id", ""])
    text = F.regexp_extract(c, _LEEF, 6)
    own = text.rlike(r"^(?:x[0-9A-Fa-f]{2}|0x[0-9A-Fa-f]{2}|[^\w\s])\|")
    mark = F.when(own, F.regexp_extract(text, r"^([^|]+)\|", 1))
    mark = F.when(mark.rlike(r"^0?x"), F.chr(F.conv(F.regexp_replace(mark, "^0?x", ""), 16, 10).cast("int"))).when(mark.isNotNull(), mark).otherwise("\t")
    lines = F.filter(F.split(F.replace(F.regexp_replace(text, r"^(?:0?x[0-9A-Fa-f]{2}|[^\w\s])\|", ""), mark, F.lit("\x1f")), "\x1f"), lambda x: x.contains("="))
    entries = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v")))
    return out | {"attributes": F.when(c.rlike(_LEEF), last_wins(entries))}


def last_wins(entries: Column) -> Column:
    return F.aggregate(entries, F.expr("map()").cast("map<string,string>"),
                       lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


def firewall(c: Column) -> Column:
    """Map of an iptables or UFW line, lower-case names."""
    return F.when(c.contains("SRC=") & c.contains("DST="), F.transform_keys(key_values(c, r"\b([A-Z]+)=(\S*)"), lambda k, _: F.lower(k)))


def auditd(c: Column) -> dict[str, Column]:
    """type, epoch, serial and fields of an audit record; hexadecimal proctitles are decoded."""
    shape = r"^type=(\S+) msg=audit\((\d+(?:\.\d+)?):(\d+)\): ?(.*)$"
    out = _fields(c, shape, ["type", "epoch", "audit_serial", ""])
    m = key_values(F.regexp_extract(c, shape, 4))
    title = F.try_element_at(m, F.lit("proctitle"))
    decoded = F.when(title.rlike(r"^(?:[0-9A-F]{2})+$"), F.translate(F.decode(F.unhex(title), "UTF-8"), "\0", " ")).otherwise(title)
    return out | {"fields": F.when(c.rlike(shape), m), "proctitle": decoded}


def labeled(c: Column) -> Column:
    """Map of a line of ``Label: value`` pairs parted by tabs or ``; ``: names ``label.<name>``, a host also as ``host``."""
    pairs = F.filter(F.split(c, r"\t+|; +"), lambda x: x.rlike(r"^\s*\p{L}[\p{L}\d _.-]{0,40}:(?:\s|$)"))
    named = F.transform(pairs, lambda x: F.struct(F.concat(F.lit("label."), F.translate(F.lower(F.trim(F.substring_index(x, ":", 1))), " -", "__")).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    fields = last_wins(named)
    host = F.try_element_at(fields, F.lit("label.host"))
    more = F.when(host.isNotNull(), F.map_from_arrays(F.array(F.lit("host")), F.array(F.regexp_extract(host, r"^(\S*)", 1)))).otherwise(F.expr("map()").cast("map<string,string>"))
    return F.when(F.size(pairs) > 0, F.map_concat(fields, more))


def windows_event(c: Column) -> dict[str, Column]:
    """System fields and named data of an exported Windows event."""
    x = lambda path: F.xpath_string(c, F.lit(path))
    good = c.contains("<Event") & c.contains("</Event>")
    names = F.xpath(c, F.lit("//*[local-name()='Data']/@Name"))
    values = F.xpath(c, F.lit("//*[local-name()='Data']/text()"))
    return {
        "code": F.when(good, x("//*[local-name()='EventID']")), "provider": F.when(good, x("//*[local-name()='Provider']/@Name")),
        "time": F.when(good, x("//*[local-name()='TimeCreated']/@SystemTime")), "computer": F.when(good, x("//*[local-name()='Computer']")),
        "channel": F.when(good, x("//*[local-name()='Channel']")), "level": F.when(good, x("//*[local-name()='System']/*[local-name()='Level']")),
        "data": F.when(good & (F.size(names) == F.size(values)), F.map_from_arrays(names, values)),
    }


# Browsers, tools and systems told from user agents; the first pattern that matches wins.
AGENT_FAMILIES = (
    ("ferramenta ofensiva", "sqlmap|nikto|nmap|masscan|gobuster|dirbuster|wpscan|hydra|nuclei|ffuf|acunetix|zgrab"),
    ("robô", r"bot\b|spider|crawl|slurp"),
    ("biblioteca", r"curl|wget|python-requests|python-urllib|go-http-client|okhttp|java/|libwww|axios|node-fetch|powershell|^[\w.-]+/[\d.]+$"),
    ("navegador", r"mozilla/|opera"),
)
BROWSERS = (("Edge", "edg(?:e|a|ios)?/"), ("Opera", "opr/|opera"), ("Samsung", "samsungbrowser/"), ("Firefox", "firefox/|fxios/"), ("Chrome", "chrome/|crios/"), ("Safari", "version/[0-9.]+.*safari/"), ("IE", "msie |trident/"))
SYSTEMS = (("Windows", "windows"), ("Android", "android"), ("iOS", "iphone|ipad|ipod"), ("macOS", "mac os x|macintosh"), ("ChromeOS", "cros "), ("Linux", "linux|x11"))


def _first(c: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(table):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def user_agent(c: Column) -> dict[str, Column]:
    """Class, family, version and system of a user agent, and whether it claims what can't be."""
    family = F.coalesce(_first(c, BROWSERS), F.nullif(F.regexp_extract(c, r"^([\w.-]+)/", 1), F.lit("")))
    version = F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)(?:edg(?:e|a|ios)?|opr|samsungbrowser|firefox|fxios|chrome|crios|version)/([0-9.]+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"^[\w.-]+/([0-9.]+)", 1), F.lit("")))
    low = F.lower(c)
    anomaly = F.when(low.contains("windows nt") & low.contains("iphone"), "two systems").when(low.contains("firefox/") & low.contains("chrome/"), "two engines").when(version.try_cast("double") > 400, "version")
    return {"class": _first(c, AGENT_FAMILIES), "family": family, "version": version, "os": _first(c, SYSTEMS), "anomaly": anomaly}


def stack_trace(c: Column) -> dict[str, Column]:
    """Exception class, message, root cause and a fingerprint of the frames of a Java stack trace in a text."""
    head = r"(?m)^(?:Exception in thread \"[^\"]*\" )?((?:[\w$]+\.)+[\w$]*(?:Exception|Error|Throwable)[\w$]*)(?:: (.*))?$"
    causes = F.regexp_extract_all(c, F.lit(r"(?m)^Caused by: ((?:[\w$]+\.)*[\w$]+)"), F.lit(1))
    frames = F.regexp_extract_all(c, F.lit(r"(?m)^\s+at ([\w$.<>]+)\("), F.lit(1))
    has = F.size(frames) > 0
    return {
        "class": F.when(has, F.nullif(F.regexp_extract(c, head, 1), F.lit(""))), "message": F.when(has, F.nullif(F.regexp_extract(c, head, 2), F.lit(""))),
        "root_cause": F.when(has, F.coalesce(F.element_at(F.when(F.size(causes) > 0, causes), -1), F.nullif(F.regexp_extract(c, head, 1), F.lit("")))),
        "frames": F.size(frames), "fingerprint": F.when(has, F.sha2(F.array_join(frames, "\n"), 256)),
    }
