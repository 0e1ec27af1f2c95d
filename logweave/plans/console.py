"""The guarded SQL console: one SELECT over the view ``events`` and its own CTEs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

MAX_BYTES, MAX_COLUMNS, MAX_PAGE = 128 * 1024, 256, 200
# Functions that a console query may call.
FUNCTIONS = frozenset(
    """count sum avg mean min max first last any_value median mode percentile percentile_disc percentile_cont stddev stddev_pop stddev_samp variance var_pop var_samp approx_count_distinct
    listagg string_agg collect_list array_agg bool_and bool_or count_if min_by max_by row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value
    abs ceil ceiling floor round trunc power pow sqrt ln log log10 exp sign greatest least coalesce if ifnull nullif nullifzero zeroifnull cast try_cast lower upper length char_length
    octet_length bit_length trim ltrim rtrim substring substr left right replace concat concat_ws startswith endswith contains position instr split_part split levenshtein rlike regexp_like
    regexp_extract regexp_extract_all regexp_replace explode md5 sha2 xxhash64 typeof get_json_object json_array_length json_object_keys to_json try_parse_json variant_get timestamp_millis
    timestamp_seconds unix_millis unix_micros unix_timestamp make_timestamp date_trunc date_part datediff date_format to_timestamp try_to_timestamp day month year hour minute second
    grouping grouping_id filter transform size array map element_at try_element_at not and or in between like ilike case when exists over partition interval extract using on as from join
    within group order values""".split()
)


class Refused(ValueError):
    """A query that the console doesn't run."""


def check(df: DataFrame, sql: str) -> None:
    """Refuses anything but one SELECT or WITH over ``events`` and its CTEs with known functions, by the parsed plan."""
    if len(sql.encode()) > MAX_BYTES:
        raise Refused("the query is too long")
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "''", sql), flags=re.S)
    if not re.match(r"\s*(?:select|with)\b", bare, re.I) or ";" in bare.rstrip().rstrip(";") or "/*+" in sql:
        raise Refused("only one SELECT is allowed")
    spark = df.sparkSession
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.rstrip().rstrip(";"))
    except Exception as e:
        raise Refused(str(e).split("\n")[0]) from None
    text = plan.toString()
    ctes = {x.lower() for x in re.findall(r"(?:\bwith(?:\s+recursive)?|,)\s*([A-Za-z_]\w*)\s*(?:\([^)]*\)\s*)?as\s*\(", bare, re.I)}
    if "events" in ctes:
        raise Refused("events is a reserved name")
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", text):
        if name.lower() not in ctes | {"events"}:
            raise Refused(f"unknown relation {name}")
    if "UnresolvedTableValuedFunction" in text or "InsertInto" in text or "CreateTable" in text:
        raise Refused("table functions and writes aren't allowed")
    for name in re.findall(r"\b([A-Za-z_]\w*)\s*\(", bare):
        if name.lower() not in FUNCTIONS | ctes | {"select"}:
            raise Refused(f"function {name} isn't allowed")


def execute(events: DataFrame, sql: str) -> DataFrame:
    """The result of a checked query over ``events``, in a session of its own, so that views of others aren't seen."""
    check(events, sql)
    # a new session of the same context: its view is seen by no other, and a caller's view of that name stays
    own = events.sparkSession.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(name, events.sparkSession.conf.get(name))
    plan = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, events._jdf.queryExecution().logical())
    DataFrame(plan, own).createOrReplaceTempView("events")
    out = own.sql(sql.rstrip().rstrip(";"))
    if len(out.columns) > MAX_COLUMNS:
        raise Refused("too many columns")
    return out


def page(result: DataFrame, offset: int = 0, limit: int = MAX_PAGE) -> DataFrame:
    return result.offset(offset).limit(min(limit, MAX_PAGE))


def export(result: DataFrame, path: str, kind: str = "jsonl") -> None:
    """The complete result as JSON lines or CSV files in a folder."""
    if kind == "jsonl":
        result.write.mode("error").json(path)
    elif kind == "csv":
        result.write.mode("error").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")
