"""Raw captures: JSON lines, read tolerantly, numbered and projected to node and edge records."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.names import file_stem, plain_path, run_name
from traceloom.functions.times import event_timestamp
from traceloom.operators.ordered import lookup_join, scan
from traceloom.session import materialize

_BLANKS = " \t\r\n\x0b\x0c"
# Numbers that a parser gives back in another form: with a point or an exponent, of many digits, or negative zero.
_ODD_NUMBER = r"[:\[,]\s*-?(?:[0-9]+[.eE]|[0-9]{16}|(?<=-)0)"
# From the last match on whatever is no number, strings as a whole, and the number behind it.  Possessive, so that it neither goes back nor nests.
_NUMBER = r'\G((?:[^"0-9-]++|"(?:[^"\\]++|\\.)*+")*+)(-?[0-9][0-9.eE+-]*+)'


def text_lines(
    spark: SparkSession, path: str | list[str], glob: str = "*.jsonl", ends: str | None = "\n", since: datetime | None = None
) -> DataFrame:
    """Lines of all files with what is needed to number them.

    Only ``ends`` ends a line, or with None any of ``\\r``, ``\\n`` and ``\\r\\n``.  Blank lines stay, since they count.  With ``since``
    only files changed at or after that time are opened.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    lines = (reader.option("lineSep", ends) if ends else reader).text(path)
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
    return lines.select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def number_lines(staged: DataFrame) -> DataFrame:
    """Replace block_start and row by the 1-based line number.

    ``staged`` must be a written table, so that ``row`` is settled.  Inside a block rows are consecutive; the
    lines of earlier blocks of the file are added from a table of one row per block.  No line is shuffled
    while that table is small.
    """
    block = ["file_path", "block_start"]
    sizes = staged.groupBy(*block).agg(F.count(F.lit(1)).alias("lines"), F.min("row").alias("first_row"))
    sizes = materialize(sizes, "blocks")
    offsets = scan(sizes, ["file_path"], ["block_start"], {"upto": ("sum", "lines")})
    offsets = offsets.select(*block, "first_row", (F.col("upto") - F.col("lines")).alias("before"), *run_columns())
    numbered = lookup_join(staged, offsets, block, ["row"], "inner")
    number = (F.col("before") + F.col("row") - F.col("first_row") + 1).alias("line_number")
    return numbered.select(*[c for c in staged.columns if c not in ("block_start", "row")], number, *RUN_COLUMNS)


RUN_COLUMNS = ("run_id", "tool", "scenario", "kind")


def run_columns() -> list:
    """Run columns of a file; worked out per file or block, not per line."""
    stem = file_stem(F.col("file_path"))
    name = run_name(stem)
    return [stem.alias("run_id"), *[name[c].alias(c) for c in RUN_COLUMNS[1:]]]


def name_runs(lines: DataFrame) -> DataFrame:
    """Add the run columns to lines that were not numbered here."""
    names = materialize(lines.select("file_path").distinct().select("file_path", *run_columns()), "names")
    return lookup_join(lines, names, ["file_path"], ["line_number"], "inner")


def with_tier(lines: DataFrame) -> DataFrame:
    """Decode each line: strict UTF-8 JSON, then latin-1; ``tier`` is null when neither reads it.

    Adds tier, record (VARIANT), exact (``exact_record``), non_ascii, and the decoded text of lines that are not plainly fine.
    """
    line = F.btrim("value", F.lit(_BLANKS))
    valid = F.is_valid_utf8(line)
    text = F.when(valid, line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1"))
    parsed = lines.withColumn("_valid", valid).withColumn("_text", text).withColumn("_v", F.try_parse_json("_text"))
    is_object = F.startswith("_text", F.lit("{")) & F.col("_v").isNotNull()
    tier = (
        F.when(F.col("value") == "", "blank")
        .when(F.col("_text") == "", "whitespace")
        .when(is_object & F.col("_valid"), "strict_ok")
        .when(is_object, "repairable_latin1")
        .when(F.col("_v").isNotNull(), "unrepaired")
    )
    wide = F.octet_length("_text") > F.length("_text")
    return (
        parsed.withColumn("tier", tier)
        .withColumn("record", F.when(is_object, F.col("_v")))
        .withColumn("exact", F.when(is_object, exact_record(F.col("_text"))))
        .withColumn("non_ascii", wide)
        .withColumn("text", F.when(F.coalesce("tier", F.lit("")) != "strict_ok", F.col("_text")))
        .withColumnRenamed("_valid", "valid_utf8")
        .drop("value", "_text", "_v")
    )


def exact_record(text: Column) -> Column:
    """The record of a JSON text with every number as the text it was written as; null where the usual record says the same."""
    return F.when(F.rlike(text, F.lit(_ODD_NUMBER)), F.try_parse_json(F.regexp_replace(text, _NUMBER, '$1"$2"')))


_MENDED = T.StructType(
    [
        T.StructField("readable", T.BooleanType()),
        T.StructField("mended", T.StringType()),
        T.StructField("positions", T.ArrayType(T.LongType())),
    ]
)


def json_mender():
    """A pandas UDF from line to (readable, mended, positions).

    ``readable`` lines are those a lenient parser takes as they are (NaN and the like, read as null).  In the
    others, wherever a delimiter must follow and does not, the nearest bare quote before is escaped.  ``mended`` is
    the object as it was written but for those quotes and constants, null when there is none.  ``positions`` are the places of the
    escapes in the text as it stood when each was put in.

    The line is read once.  Outside strings the only bare quotes are those that end strings, so the quote to escape is the end of the
    last string, unless a backslash stands before it; then the quote that opened the string is nearest, and escaping that one
    leaves no line to read.  Reading goes on inside the string, in the container it stood in, from the quote onwards.  All that workers need is
    inside, so that they need not have this package.
    """
    blanks = re.compile(r"[ \t\n\r]*")
    rest_of_string = re.compile(r'[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"')
    number = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
    word = re.compile(r"(true|false|null)|NaN|-?Infinity")
    longest_int, deepest = 4300, 1000  # fixed values: what the usual parsers read
    value, value_or_end, key, key_or_end, colon, after = range(6)

    def mend(text: str) -> tuple[bool, str | None, list[int]]:
        marks: list[tuple[int, int, str]] = []  # (from, to, instead) in order of place
        quotes: list[int] = []  # places in the text as given
        container, depth, state = None, 0, value  # container: (is an object, what holds it)
        last = None  # end of the last string, and container, depth and state behind it
        at = opened = blanks.match(text).end()
        while True:
            at = blanks.match(text, at).end()
            c = text[at : at + 1]
            if state == after and container is None:
                break
            if state == after and c == ",":
                state, at = key if container[0] else value, at + 1
                continue
            if c and c == ("}" if container and container[0] else "]") and state in (after, key_or_end, value_or_end):
                container, depth, state, at = container[1], depth - 1, after, at + 1
                continue
            if state == colon and c == ":":
                state, at = value, at + 1
                continue
            if state in (after, colon):
                if last is None or text[last[0] - 1] == "\\":
                    return False, None, []
                quote, container, depth, state = last
                while marks and marks[-1][0] > quote:  # a constant that is inside the string now
                    marks.pop()
                marks.append((quote, quote, "\\"))
                quotes.append(quote)
                at = quote
            elif c == '"':
                state = colon if state in (key, key_or_end) else after
            elif state in (key, key_or_end):
                return False, None, []
            elif c in ("{", "["):
                container, depth, state, at = (c == "{", container), depth + 1, key_or_end if c == "{" else value_or_end, at + 1
                if depth > deepest:
                    return False, None, []
                continue
            else:
                found = number.match(text, at)
                if found is None:
                    found = word.match(text, at)
                    if found is None:
                        return False, None, []
                    if not found[1]:
                        marks.append((at, found.end(), "null"))
                elif not found[1] and not found[2] and found.end() - at > longest_int:
                    return False, None, []
                state, at = after, found.end()
                continue
            ended = rest_of_string.match(text, at + 1)  # behind the quote that opens the string or was escaped
            if ended is None:
                return False, None, []
            at = ended.end()
            last = at - 1, container, depth, state
        if at != len(text):
            return False, None, []
        if text[opened] != "{":
            return not quotes, None, []
        out, done = [], 0
        for start, end, instead in marks:
            out += [text[done:start], instead]
            done = end
        return not quotes, "".join([*out, text[done:]]), [q + n for n, q in enumerate(quotes)]

    def mend_all(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mend(t) for t in texts], columns=["readable", "mended", "positions"])

    return F.pandas_udf(mend_all, _MENDED)


def repair_undecided(decoded: DataFrame) -> DataFrame:
    """Mend the lines no decoder could read; only those pass through Python.  ``decoded`` is a written table."""
    fine = decoded.filter("tier is not null")
    return fine.unionByName(mend_lines(decoded.filter("tier is null")).select(*fine.columns))


def mend_lines(undecided: DataFrame) -> DataFrame:
    """Tier and record of lines without a tier."""
    mended = undecided.withColumn("m", json_mender()("text"))
    record = F.try_parse_json("m.mended")
    tier = (
        F.when(F.col("m.mended").isNull(), "unrepaired")
        .when(~F.col("m.readable"), "repairable_escape_quotes")
        .when(F.col("valid_utf8"), "strict_ok")
        .otherwise("repairable_latin1")
    )
    return mended.withColumn("tier", tier).withColumn("record", record).withColumn("exact", exact_record(F.col("m.mended"))).drop("m")


def _present(path: str):
    return F.variant_get("record", f"$.{path}", "variant").isNotNull()


def _as_written(usual: Column, exact: Column) -> Column:
    """Scalars with numbers as written; lists and objects as the usual JSON text."""
    return F.when(F.rlike(usual, F.lit(r"^[\[{]")), usual).otherwise(F.coalesce(exact, usual))


def _string(path: str):
    """A value as text."""
    usual = F.try_variant_get("record", path, "string")
    return F.when(F.col("exact").isNull(), usual).otherwise(_as_written(usual, F.try_variant_get("exact", path, "string")))


def _annotations():
    usual, exact = (F.try_variant_get(c, "$.annotations", "map<string,string>") for c in ("record", "exact"))
    written = F.transform_values(usual, lambda k, v: _as_written(v, F.element_at(exact, k)))
    return F.coalesce(F.when(F.col("exact").isNull(), usual).otherwise(written), F.expr("map()").cast("map<string,string>"))


def _only_text(path: str):
    kind = F.schema_of_variant(F.variant_get("record", path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get("record", path, "string"))


def project_records(lines: DataFrame) -> DataFrame:
    """Envelope of every record in place of record and exact; other columns are kept.

    A record with from and to is an edge, else one with an id is a node.

    Presence of a key counts, even with a null value.  Annotations that are no object are an empty map.
    ``raw`` is the record as JSON text with sorted keys.
    """
    edge = _present("from") & _present("to")
    node = _present("id") & ~edge
    none = F.lit("None")
    return (
        lines.withColumn("record_class", F.when(edge, "edge").when(node, "node").when(F.col("record").isNotNull(), "other"))
        .select(
            *[c for c in lines.columns if c not in ("record", "exact")],
            "record_class",
            F.when(F.col("record_class") == "node", F.coalesce(_string("$.id"), none)).alias("raw_node_id"),
            F.when(F.col("record_class") == "edge", _string("$.annotations.id")).alias("raw_edge_id"),
            F.when(F.col("record_class") == "edge", F.coalesce(_string("$.from"), none)).alias("src"),
            F.when(F.col("record_class") == "edge", F.coalesce(_string("$.to"), none)).alias("dst"),
            _string("$.type").alias("prov_type"),
            _annotations().alias("attributes"),
            _only_text("$.annotations.from_type").alias("from_type"),
            _only_text("$.annotations.to_type").alias("to_type"),
            _present("from").alias("has_from"),
            _present("to").alias("has_to"),
            F.to_json("record").alias("raw"),
        )
    )


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """Decoded and numbered lines of a folder of captures, without empty ones."""
    decoded = materialize(with_tier(text_lines(spark, path, glob)).drop("record", "exact"), "decoded")
    return repair_undecided(number_lines(decoded).filter("tier is null or tier <> 'blank'"))


_FAILURES = T.StructType([T.StructField(c, T.StringType()) for c in ("strict_error", "latin1_error")])


def decoder_errors():
    """A pandas UDF from (text, valid_utf8) of a line to what a strict and a latin-1 decoder say of it; null where they read it."""

    def tried(read) -> str | None:
        try:
            if isinstance(read(), dict):
                return None
            return "ValueError: JSON line did not decode to an object"
        except (ValueError, RecursionError) as error:
            return f"{type(error).__name__}: {error}"

    def errors(texts: pd.Series, valid: pd.Series) -> pd.DataFrame:
        rows = []
        for text, utf8 in zip(texts, valid, strict=True):
            line = text.encode("utf-8" if utf8 else "latin-1")
            rows.append((tried(lambda: json.loads(line.decode("utf-8"))), tried(lambda: json.loads(line.decode("latin-1")))))  # noqa: B023
        return pd.DataFrame(rows, columns=["strict_error", "latin1_error"])

    return F.pandas_udf(errors, _FAILURES)


def problem_details(lines: DataFrame, width: int = 400) -> DataFrame:
    """Lines that are not strict JSON, with both decoders' errors and the places of repaired quotes.

    Input: run_id, tool, line_number, tier, text, valid_utf8 (``audit_lines``); only problem lines go through Python.
    """
    bad = lines.filter("tier <> 'strict_ok'").withColumn("e", decoder_errors()("text", "valid_utf8")).withColumn("m", json_mender()("text"))
    mended = F.col("tier") == "repairable_escape_quotes"
    return bad.select(
        "run_id", "tool", "line_number", "tier", F.left("text", F.lit(width)).alias("excerpt"), "text",
        "e.strict_error", F.when(F.col("tier") != "repairable_latin1", F.col("e.latin1_error")).alias("latin1_error"),
        F.when(mended, F.col("m.positions")).alias("repaired_positions"),
    )


def audit_lines(lines: DataFrame) -> DataFrame:
    """Lines as the audit sees them: it strips line ends only, so a line of blanks is unrepaired."""
    tier = F.when(F.col("tier") == "whitespace", "unrepaired").otherwise(F.col("tier"))
    tool = F.substring_index("run_id", "_", -1)
    return lines.select("run_id", tool.alias("tool"), "line_number", tier.alias("tier"), "text", "valid_utf8")


def read_capture(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """All records of a folder of captures, blank lines left out."""
    return capture(text_lines(spark, path, glob))


def capture(lines: DataFrame) -> DataFrame:
    """All records of lines (``text_lines``), blank ones left out.

    The lines are read once and written as records; only lines no decoder could read are looked at again.
    """
    lines = with_tier(lines)
    numbered = number_lines(materialize(project_records(lines), "records"))
    kept = [c for c in lines.columns if c not in ("record", "exact", "block_start", "row")]
    undecided = numbered.filter("tier is null").select(*kept, "line_number", *RUN_COLUMNS)
    mended = materialize(project_records(mend_lines(undecided)), "mended")
    return drop_blank(numbered.filter("tier is not null").unionByName(mended))


def chosen(lines: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """``columns`` of the records (``project_records``) of numbered lines with file_path, line_number, tier, non_ascii and the run columns, blank lines left out.

    The lines are decoded once.  Only the columns are written, and the text of lines no decoder could read; just those are looked at again.
    """
    keys = ["file_path", "line_number", "tier", "non_ascii"]
    text = F.when(F.col("tier").isNull(), F.col("text")).alias("_text")
    staged = materialize(project_records(with_tier(lines)).select(*keys, "valid_utf8", text, *columns), "chosen")
    undecided = staged.filter("tier is null").select(*keys, "valid_utf8", F.col("_text").alias("text"))
    mended = project_records(mend_lines(undecided)).select(*keys, *columns)
    read = staged.filter("tier is not null").drop("valid_utf8", "_text").unionByName(mended)
    return drop_blank(name_runs(read))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.filter("tier not in ('blank', 'whitespace')")


def rejects(records: DataFrame) -> DataFrame:
    """Lines that give no node or edge, with the reason."""
    stamp = event_timestamp(F.col("tool"), F.col("attributes"))["wall_time_ns"]
    reason = (
        F.when(F.col("tool").isNull(), "unknown_tool")
        .when(F.col("record_class").isNull(), "unreadable")
        .when(F.col("record_class") == "other", "neither_node_nor_edge")
        .when((F.col("record_class") == "edge") & stamp.isNull(), "edge_without_time")
    )
    return records.withColumn("reason", reason).filter("reason is not null").select(
        "run_id", "line_number", "reason", F.coalesce("text", "raw").alias("text")
    )


def require_clean(records: DataFrame) -> None:
    """The strict policy: any record but an unreadable line that cannot be used stops the build."""
    bad = rejects(records).filter("reason <> 'unreadable'").take(1)
    if bad:
        row = bad[0]
        raise ValueError(f"{row['reason']} at line {row['line_number']} of {row['run_id']}")


def node_records(records: DataFrame) -> DataFrame:
    return records.filter("record_class = 'node' and tool is not null").select(
        "run_id", "tool", "raw_node_id", "prov_type", "line_number", "attributes", "raw"
    )


def edge_records(records: DataFrame) -> DataFrame:
    """Edges with their time; the timestamp struct is kept beside its main columns."""
    edges = records.filter("record_class = 'edge' and tool is not null").select(
        "run_id", "tool", "raw_edge_id", "src", "dst", "prov_type", "line_number", "attributes", "from_type", "to_type", "raw",
        event_timestamp(F.col("tool"), F.col("attributes")).alias("timestamp"),
    )
    return edges.filter("timestamp.wall_time_ns is not null").select(
        "*", "timestamp.wall_time_ns", "timestamp.wall_time_precision_ns", "timestamp.model_time", "timestamp.model_time_unit", "timestamp.order"
    )
