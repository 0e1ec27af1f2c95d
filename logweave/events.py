"""The canonical event and the view of the driver's tables as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.tables import table

# The six standard levels, from the most to the least severe.
LEVELS = ("Crítico", "Erro", "Aviso", "Informação", "Depuração", "Rastreio")
EMPTY_LABEL = "(vazio)"
STANDARD_COLUMNS = ("timestamp", "level", "source", "code", "name", "description", "message")

EVENT_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("event_ref", T.StringType()), T.StructField("part_file", T.StringType()),
     T.StructField("parse_status", T.StringType()), T.StructField("ts", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "level", "code", "name", "description", "message", "raw")]
    + [T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
)

#: The same view in SQL for the oracle.
EV_SQL = """
ev as (
  select event_id as id, epoch_us(ts) // 1000 as ts, 'source-' || (user_id % 12) as source,
    case event_type when 'error' then 'Erro' when 'purchase' then 'Aviso' else 'Informação' end as level, event_type as code,
    event_type || ' item ' || (event_id % 7) || ' took ' || cast(floor(value) as bigint) || ' ms from 10.0.' || (user_id // 16) || '.' || (user_id % 256) as message,
    'user-' || user_id as user, '10.0.' || (user_id // 16) || '.' || (user_id % 256) as ip,
    case when event_id % 11 = 0 then null when event_id % 5 = 0 then cast(floor(value) as bigint) || ' MB'
         when event_id % 5 = 1 then (event_id % 13) || ',5 kb' else cast(floor(value) as bigint) || ' KB' end as size,
    cast(json_extract(props, '$.k') as bigint) as k, cast(floor(value) as bigint) as latency, value
  from events)
"""


def events_view(spark: SparkSession, folder: str) -> DataFrame:
    """events.parquet as canonical events with a few fields as columns."""
    e = table(spark, folder, "events")
    u, i = F.col("user_id"), F.col("event_id")
    whole = F.floor("value").cast("long")
    ip = F.concat(F.lit("10.0."), (u / 16).cast("long").cast("string"), F.lit("."), (u % 256).cast("string"))
    return e.select(
        i.alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("source-"), u % 12).alias("source"),
        F.when(F.col("event_type") == "error", "Erro").when(F.col("event_type") == "purchase", "Aviso").otherwise("Informação").alias("level"),
        F.col("event_type").alias("code"),
        F.concat(F.col("event_type"), F.lit(" item "), i % 7, F.lit(" took "), whole, F.lit(" ms from "), ip).alias("message"),
        F.concat(F.lit("user-"), u).alias("user"), ip.alias("ip"),
        F.when(i % 11 == 0, None).when(i % 5 == 0, F.concat(whole, F.lit(" MB"))).when(i % 5 == 1, F.concat(i % 13, F.lit(",5 kb")))
        .otherwise(F.concat(whole, F.lit(" KB"))).alias("size"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), whole.alias("latency"), "value",
    )


def column_of(df: DataFrame, name: str) -> Column:
    """A column by name, else the field of that name in ``fields`` (letter case last), else a path into JSON, else the role of that name, else null."""
    if name in df.columns:
        return F.col(f"`{name}`")
    lower = {c.lower(): c for c in df.columns}
    if name.lower() in lower:
        return F.col(f"`{lower[name.lower()]}`")
    found = []
    if "fields" in df.columns:
        from logweave.functions.transforms import lower_keys

        found = [F.try_element_at("fields", F.lit(name)), F.try_element_at(lower_keys(F.col("fields")), F.lit(name.lower()))]
    # a dotted name goes down into a column or field that holds JSON; the longest name that exists counts first
    parts = name.split(".")
    for k in range(len(parts) - 1, 0, -1):
        head, path = ".".join(parts[:k]), "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts[k:])
        if head.lower() in lower:
            found.append(F.get_json_object(F.col(f"`{lower[head.lower()]}`").cast("string"), path))
        elif "fields" in df.columns:
            found.append(F.get_json_object(F.try_element_at("fields", F.lit(head)), path))
    if "roles" in df.columns and name in df.schema["roles"].dataType.fieldNames():
        found.append(F.col(f"roles.`{name}`"))
    return F.coalesce(*found) if found else F.lit(None).cast("string")
