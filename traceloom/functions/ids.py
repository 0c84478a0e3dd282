"""Stable hash ids.  The joined text must not change, so that ids stay equal between builds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLUE = "||"


def global_node_id(run_id: Column, raw_node_id: Column) -> Column:
    return F.concat(F.lit("node_"), F.sha1(F.concat_ws(_GLUE, run_id, raw_node_id)))


def timestamp_text(wall: Column, precision: Column, model: Column, unit: Column, order: Column, raw: Column) -> Column:
    """One text per timestamp: wall|precision|model|unit|order|raw."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (wall, precision, model, unit, order, raw)]
    return F.concat_ws("|", *parts)


def global_edge_id(
    run_id: Column, raw_edge_id: Column, src: Column, dst: Column, timestamp: Column, line_number: Column
) -> Column:
    raw = F.coalesce(raw_edge_id.cast("string"), F.lit("None"))
    payload = F.concat_ws(_GLUE, run_id, raw, src, dst, timestamp, line_number.cast("string"))
    return F.concat(F.lit("edge_"), F.sha1(payload))
