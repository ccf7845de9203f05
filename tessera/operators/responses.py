"""JSON of services and of status updates as VARIANT: guarded paths, nested lists, and merges in which a null that is given counts.

A field of another type than expected is as if it were absent, at every step of a path; what is no JSON has no fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(value: Column, path: str) -> Column:
    """The elements of the list at a path; none if there is no list."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _string(value: Column, path: str) -> Column:
    """The string at a path; null for numbers and others, which a plain cast would turn into strings."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def response_text(response: Column) -> Column:
    """The texts of all parts of all candidates of a generation response (JSON), joined."""
    parts = F.flatten(F.transform(_list(F.try_parse_json(response), "$.candidates"), lambda c: _list(c, "$.content.parts")))
    return F.array_join(F.array_compact(F.transform(parts, lambda p: _string(p, "$.text"))), "")


def stream_text(frames: Column) -> Column:
    """The text of a streamed generation: that of every data frame of its lines, in order; frames without text and others are left out."""
    data = F.filter(F.split(frames, "\r?\n", -1), lambda line: line.startswith("data: "))
    return F.array_join(F.transform(data, lambda line: response_text(F.substr(line, F.lit(7)))), "")


def records_by_path(records: Column) -> Column:
    """A map from path to record (JSON) of a JSON list of records; of equal paths the last counts, and records without one are left out."""
    kept = F.filter(_list(F.try_parse_json(records), "$"), lambda r: F.coalesce(_string(r, "$.path") != "", F.lit(False)))
    paths = F.transform(kept, lambda r: _string(r, "$.path"))
    last = F.filter(kept, lambda r, i: F.array_position(F.reverse(paths), _string(r, "$.path")) == F.size(paths) - i)
    return F.map_from_arrays(F.transform(last, lambda r: _string(r, "$.path")), F.transform(last, lambda r: F.to_json(r)))


def merged_fields(updates: DataFrame, key: str) -> DataFrame:
    """key, field, value (JSON) and updated_at of the shallow merge of each key's updates (body: a JSON object) in order of (ts, event_id).

    The last update that gives a field decides, also if it gives null; updated_at is the time of the key's last update. Bodies that are no objects change nothing else.
    """
    fields = F.try_variant_get(F.try_parse_json("body"), "$", "map<string,variant>")
    rows = updates.select(key, F.struct("ts", "event_id").alias("_order"), fields.alias("_fields"))
    # No window: fields are reduced before the shuffle, and the time of the last update comes from a second aggregate of a row a key.
    last = rows.groupBy(key).agg(F.max("_order.ts").alias("updated_at"))
    given = rows.select(key, "_order", F.explode("_fields").alias("field", "_value")).select(key, "field", "_order", F.to_json("_value").alias("value"))
    merged = given.groupBy(key, "field").agg(F.max_by("value", "_order").alias("value"))
    return merged.join(last, key)
