"""Relations, features, types and labels of nodes and edges.

``attributes`` columns are MAP<STRING,STRING>: a key may be present with a null value, which some rules
tell apart from an absent key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<missing>"
UNKNOWN = "<unknown>"

# Relation keys and feature source keys in order of preference.
RELATION_KEYS = ("relation_type", "relation", "cf:relation", "prov:relation")
FEATURE_KEYS = {
    "path": ("path", "pathname", "filename"),
    "process_name": ("comm", "processName"),
    "command_line": ("cmdLine", "cmd_line", "cmd"),
    "working_directory": ("cwd",),
    "network_address": ("address", "remote_ip", "local_ip", "src_addr", "dst_addr", "sender", "receiver"),
    "port": ("port", "remote_port", "local_port", "src_port", "dst_port"),
    "network_family": ("family",),
}
# Node type vocabulary by family.
PROCESS_TYPES = ("process", "task")
NETWORK_TYPES = ("address", "netflow", "network", "packet", "socket")
FILE_TYPES = (
    "block", "char", "device", "directory", "file", "iattr", "inode_unknown", "link", "path",
    "regular file", "super block", "symlink", "xattr",
)
OTHER_TYPES = ("argv", "machine", "named pipe", "pipe", "process_memory", "unknown")
NODE_TYPES = PROCESS_TYPES + NETWORK_TYPES + FILE_TYPES + OTHER_TYPES

# White space as Python sees it.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _joined_words(value: Column, glue: str) -> Column:
    words = F.regexp_replace(F.lower(value), _SPACE, " ")
    return F.replace(F.trim(words), F.lit(" "), F.lit(glue)) if glue != " " else F.trim(words)


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def relation_field(attributes: Column) -> Column:
    """The first relation key that is present, even if its value is null."""
    picked = F.lit(MISSING)
    for key in reversed(RELATION_KEYS):
        picked = F.when(F.map_contains_key(attributes, key), key).otherwise(picked)
    return picked


def raw_relation(attributes: Column) -> Column:
    picked = F.lit(None).cast("string")
    for key in reversed(RELATION_KEYS):
        picked = F.when(F.map_contains_key(attributes, key), attributes[key]).otherwise(picked)
    return picked


def normalize_relation(value: Column) -> Column:
    return F.coalesce(_blank_to_null(_joined_words(value, "_")), F.lit(MISSING))


def normalize_prov_type(value: Column) -> Column:
    return F.coalesce(_blank_to_null(_strip(value)), F.lit(MISSING))


def edge_label(prov_type: Column, relation: Column) -> Column:
    return F.concat_ws(":", normalize_prov_type(prov_type), relation)


def annotate_edges(edges):
    """Relation field, raw and normalised relation, time source and edge label as columns and attributes."""
    attributes = F.col("attributes")
    raw = raw_relation(attributes)
    annotated = edges.withColumns(
        {
            "relation_field": relation_field(attributes),
            "relation_value": normalize_relation(raw),
            "raw_relation_value": F.coalesce(raw, F.lit(MISSING)),
            "timestamp_source": F.when(F.map_contains_key(attributes, "cf:date"), "cf:date").when(
                F.map_contains_key(attributes, "ts"), "ts"
            ),
        }
    )
    return annotated.withColumns(
        {
            "edge_label": edge_label(F.col("prov_type"), F.col("relation_value")),
            "features": F.struct(
                F.col("prov_type").alias("prov_type"), usable_text(F.col("relation_value")).alias("relation")
            ),
        }
    )


def usable_text(value: Column) -> Column:
    """Trimmed text; empty and sentinel values are null."""
    text = _strip(value)
    return F.when(~text.isin("", MISSING, UNKNOWN), text)


def plain_text(value: Column) -> Column:
    """Trimmed text; only empty is null, sentinels stay."""
    return _blank_to_null(_strip(value))


def first_usable(attributes: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[usable_text(attributes[key]) for key in keys])


def node_features(attributes: Column) -> Column:
    found = {name: first_usable(attributes, keys) for name, keys in FEATURE_KEYS.items()}
    address = F.when(
        found["network_address"].isNotNull(),
        F.concat_ws(":", found["network_address"], found["port"]),
    )
    display = F.coalesce(found["process_name"], found["path"], address)
    return F.struct(*[c.alias(n) for n, c in found.items()], display.alias("display_name"))


def type_token(value: Column) -> Column:
    token = _joined_words(value, " ")
    return F.when(~token.isin("", MISSING, UNKNOWN), token)


def type_hint(value: Column) -> Column:
    return _blank_to_null(_joined_words(value, " "))


def node_type(attributes: Column) -> Column:
    """Object type, else the type hint; a token outside the vocabulary is ``unknown``."""
    token = F.coalesce(type_token(attributes["object_type"]), type_token(attributes["_raw_type_hint"]))
    return F.when(token.isin(*NODE_TYPES), token).otherwise("unknown")


def node_label(kind: Column, attributes: Column, features: Column, is_placeholder: Column) -> Column:
    hint = plain_text(attributes["_raw_type_hint"])
    parts = {
        "process": (kind, features["process_name"], features["command_line"], features["working_directory"]),
        "network": (kind, hint, features["network_address"], features["port"], features["network_family"]),
        "other": (kind, hint, features["path"], features["display_name"], features["command_line"]),
    }
    label = F.when(is_placeholder, F.concat_ws(" ", F.lit("missing_endpoint"), hint))
    label = label.when(kind.isin(*PROCESS_TYPES), F.concat_ws(" ", *parts["process"]))
    label = label.when(kind.isin(*NETWORK_TYPES), F.concat_ws(" ", *parts["network"]))
    return label.otherwise(F.concat_ws(" ", *parts["other"]))


def node_path(kind: Column, features: Column) -> Column:
    """Path entry of a node; only process types carry a command."""
    return F.struct(
        F.coalesce(features["display_name"], F.lit("missing_endpoint")).alias("path"),
        kind.alias("type"),
        F.when(kind.isin(*PROCESS_TYPES), features["command_line"]).alias("cmd"),
    )


def short_json(text: Column, limit: int = 700) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
