"""Process lifetimes and parents by GUID, or by PID within a boot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.joins import ancestors, as_of_join

FOREVER = (1 << 62)


def instances(starts: DataFrame, ends: DataFrame, boots: DataFrame) -> DataFrame:
    """Process instances with boot and end.

    starts: id, host, ts, pid, ppid, guid, parent_guid; ends: host, ts, pid; boots: host, ts.  A process ends at its first
    termination after its start or when its PID starts anew on the same host and boot, whichever is earlier.
    """
    booted = as_of_join(starts, boots.select("host", F.col("ts").alias("boot")), ["host"], "ts", "boot", ["boot"])
    again = F.lead("ts").over(Window.partitionBy("host", "boot", "pid").orderBy("ts", "id"))
    booted = booted.withColumn("__next", again)
    stops = ends.select("host", "pid", (-F.col("ts")).alias("__neg"), F.col("ts").alias("stop"))
    flipped = booted.withColumn("__at", -F.col("ts"))
    out = as_of_join(flipped, stops, ["host", "pid"], "__at", "__neg", ["stop"])  # the first stop at or after the start
    return out.withColumn("end", F.least(F.coalesce("stop", F.lit(FOREVER)), F.coalesce("__next", F.lit(FOREVER)))).drop("__next", "__at", "stop")


def parents(processes: DataFrame) -> DataFrame:
    """id, parent, how: explicit_guid, ambiguous_guid, missing_guid_parent, inferred_pid_lifetime, ambiguous_pid, missing_pid_parent, unknown_boot or root."""
    p = processes
    by_guid = p.where("parent_guid is not null").alias("c").join(
        p.where("guid is not null").alias("p"), (F.col("c.host") == F.col("p.host")) & (F.col("c.parent_guid") == F.col("p.guid")), "left"
    ).where("p.id is null or (p.ts <= c.ts and c.ts < p.end and p.boot <=> c.boot)")
    by_guid = p.where("parent_guid is not null").select("id").join(
        by_guid.groupBy(F.col("c.id").alias("id")).agg(F.count("p.id").alias("n"), F.min("p.id").alias("parent")), "id", "left")
    guid = by_guid.select("id", F.when(F.col("n") == 1, F.col("parent")).alias("parent"),
        F.when(F.col("n") == 1, "explicit_guid").when(F.col("n") > 1, "ambiguous_guid").otherwise("missing_guid_parent").alias("how"))
    rest = p.where("parent_guid is null")
    plain = rest.where("ppid is not null and ppid <> 0 and boot is not null")
    found = plain.alias("c").join(p.alias("p"), (F.col("c.host") == F.col("p.host")) & (F.col("c.boot") == F.col("p.boot")) & (F.col("c.ppid") == F.col("p.pid"))
                                  & (F.col("p.ts") < F.col("c.ts")) & (F.col("c.ts") < F.col("p.end")))
    found = found.groupBy(F.col("c.id").alias("id")).agg(F.count("p.id").alias("n"), F.min("p.id").alias("parent"))
    pid = plain.select("id").join(found, "id", "left").select("id", F.when(F.col("n") == 1, F.col("parent")).alias("parent"),
        F.when(F.col("n") == 1, "inferred_pid_lifetime").when(F.col("n") > 1, "ambiguous_pid").otherwise("missing_pid_parent").alias("how"))
    other = rest.where("ppid is null or ppid = 0 or boot is null").select("id", F.lit(None).cast("long").alias("parent"),
        F.when(F.col("ppid").isNull() | (F.col("ppid") == 0), "root").otherwise("unknown_boot").alias("how"))
    return guid.unionByName(pid).unionByName(other)


def tree(processes: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of the process forest."""
    return ancestors(parents(processes).select("id", "parent"), "id", "parent")
