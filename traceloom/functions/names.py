"""Run names, scenario names and other short text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capture tools, splits, scenario aliases of the label file.
TOOLS = ("camflow", "conprov", "provbpf", "recap")
SPLITS = ("train", "val", "test")
SCENARIO_ALIASES = {"opensmtpd": "smtpd"}


def plain_path(path: Column) -> Column:
    """The path as the file system has it; file metadata writes it with percent escapes."""
    escaped = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(path, F.lit("%")), F.url_decode(escaped)).otherwise(path)


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def run_name(stem: Column) -> Column:
    """(scenario, tool, kind) of ``<scenario>_<tool>[_run_<n>]``; all null when the tool is unknown."""
    base = F.regexp_replace(stem, r"_run_[0-9]+$", "")
    pattern = f"(?s)^(.*)_({'|'.join(TOOLS)})$"
    known = base.rlike(pattern)
    scenario = F.regexp_extract(base, pattern, 1)
    return F.struct(
        F.when(known, scenario).alias("scenario"),
        F.when(known, F.regexp_extract(base, pattern, 2)).alias("tool"),
        F.when(known, run_kind(scenario)).alias("kind"),
    )


def run_name_loose(stem: Column) -> Column:
    """The profiling variant: the tool is whatever follows the last underscore."""
    tool = F.substring_index(stem, "_", -1)
    scenario = F.regexp_replace(stem, r"(?s)^(.*?)_?[^_]*$", "$1")
    return F.struct(scenario.alias("scenario"), tool.alias("tool"), run_kind(scenario).alias("kind"))


def run_kind(scenario: Column) -> Column:
    return F.when(F.contains(scenario, F.lit("_benign_")), "benign").otherwise("cve")


def scenario_alias(scenario: Column) -> Column:
    mapped = scenario
    for name, alias in SCENARIO_ALIASES.items():
        mapped = F.when(scenario == name, alias).otherwise(mapped)
    return mapped


def attack_scenario(scenario: Column) -> Column:
    """(name, cve) at the first ``_CVE-``; null for other scenarios."""
    parts = F.split(scenario, "_CVE-", 2)
    return F.when(
        F.size(parts) == 2,
        F.struct(parts[0].alias("name"), F.concat(F.lit("CVE-"), parts[1]).alias("cve")),
    )


def safe_name(text: Column, length: int = 80) -> Column:
    kept = F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_")
    return F.left(F.regexp_replace(kept, r"^[_.\-]+|[_.\-]+$", ""), F.lit(length))


def general_number(value: Column) -> Column:
    """A number as ``%g`` writes it: six significant digits, no zeros behind them, an exponent below -4 and from 6 on."""
    number = value.cast("double")
    short = F.format_string("%.5e", number)
    exponent = F.regexp_extract(short, r"e([-+][0-9]+)$", 1).try_cast("int")
    fixed = F.lit(None).cast("string")
    for power in range(-4, 6):
        fixed = F.when(exponent == power, F.format_string(f"%.{5 - power}f", number)).otherwise(fixed)
    plain = F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1")
    mantissa = F.regexp_replace(F.regexp_extract(short, r"^(.*)e", 1), r"(\.[0-9]*?)0+$", "$1")
    scientific = F.concat(F.regexp_replace(mantissa, r"\.$", ""), F.lit("e"), F.regexp_extract(short, r"e(.*)$", 1))
    odd = F.when(F.isnan(number), "nan").when(number == float("inf"), "inf").when(number == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(exponent.between(-4, 5), F.regexp_replace(plain, r"\.$", "")).otherwise(scientific))


def number_token(value: Column) -> Column:
    """``value_token`` of a number, or of any other value's text."""
    return value_token(general_number(value))


def value_token(text: Column) -> Column:
    """A ``%g``-style number text with ``.`` as p and ``-`` as m."""
    return F.translate(text, ".-", "pm")


def fixed_number(value: Column, digits: int = 3) -> Column:
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", number))


def metric_number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def rung_number(rung: Column) -> Column:
    """Numeric order of a rung name ``r<n>_…``; 999 for other names."""
    digits = F.regexp_extract(rung, r"^r([0-9]+)_", 1)
    return F.when(digits == "", 999).otherwise(digits.try_cast("int"))


def job_label(job: Column, prefix_pattern: str) -> Column:
    """(method, rung token) of a job name ``<method>_<prefix>_<rung token>[_…]``."""
    pattern = f"^([a-z0-9]+)_{prefix_pattern}_(r[0-9]+|final)(_.*)?$"
    known = job.rlike(pattern)
    return F.struct(
        F.when(known, F.regexp_extract(job, pattern, 1)).alias("method"),
        F.when(known, F.regexp_extract(job, pattern, 2)).alias("rung"),
    )


def percentage(part: Column, total: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), total), digits), F.lit(0.0))
