"""Named queries of the core and, where SQL can express them, their equivalents for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.operators import training
from logweave.queries import analysis, filtering, normalise, parity, relational, summaries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_entries": training.p2_entries,
    "p2_found": training.p2_found,
    "p3_found": training.p3_found,
    "p6_found": training.p6_found,
    "p6_loaded": training.p6_loaded,
}
ORACLE: dict[str, str] = {}
for module in (filtering, summaries, relational, analysis, normalise, parity):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE


#: Sums and conditional counts that DuckDB widens to 128 bits; the queries give 64-bit integers (and here a double).
WIDENED = {
    "agg_group_rich": {"total": "double"}, "timeline_range": {"errors": "bigint", "warnings": "bigint"}, "lanes": {"errors": "bigint"}, "overview_totals": {"errors": "bigint", "warnings": "bigint"}, "overview_patterns": {"errors": "bigint"},
    "compare_periods": {"before": "bigint", "after": "bigint"}, "entity_summary": {"failures": "bigint"}, "field_profile": {"numeric": "bigint"}, "win_range_ms": {"win_sum": "bigint"}, "detect_aggregate": {"win_sum": "bigint"},
    "journey_index": {"errors": "bigint", "warnings": "bigint"}, "operational_rare": {"all": "bigint"}, "operational_mixture": {"n": "bigint"}, "behavior_volume": {"bytes": "bigint", "median": "bigint", "mad": "bigint"}, "behavior_rarity": {"all": "bigint"},
    "behavior_velocity": {"total": "bigint"}, "behavior_quality": {"unparsed": "bigint", "undated": "bigint"}, "learn_failure_change": {"n0": "bigint", "b0": "bigint", "n1": "bigint", "b1": "bigint"},
}
for name, columns in WIDENED.items():
    changed = ", ".join(f'cast("{c}" as {t}) as "{c}"' for c, t in columns.items())
    ORACLE[name] = f"select * replace ({changed}) from ({ORACLE[name]})"


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return training.p2_found(spark, folder)
