"""Hyper-parameter grids as tables: every combination numbered and named, and its overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.names import value_token

# Axes of the published grids in order, as text, and the default combination.
GRIDS = {
    "magic": {
        "axes": {
            "win": ("1m", "2m", "4m"),
            "lr": ("0.0003", "0.001", "0.003"),
            "wd": ("0.0001", "0.0005", "0.001"),
            "dim": ("32", "64", "128"),
            "mask": ("0.3", "0.5", "0.7"),
        },
        "default": ("1m", "0.001", "0.0005", "64", "0.5"),
    },
    "velox": {
        "axes": {
            "lr": ("0.0001", "0.0003", "0.001"),
            "wd": ("0", "1e-06", "1e-05"),
            "dim": ("64", "128", "256"),
            "emb": ("64", "128", "256"),
            "batch": ("512", "1024", "2048"),
        },
        "default": ("0.0001", "1e-05", "128", "128", "1024"),
    },
    "orthrus": {
        "axes": {
            "lr": ("1e-05", "3e-05", "0.0001"),
            "wd": ("0", "1e-06", "1e-05"),
            "cap": ("default", "medium", "large"),
            "batch": ("512", "1024", "2048"),
            "neigh": ("10", "20", "50"),
        },
        "default": ("1e-05", "1e-05", "default", "1024", "20"),
    },
    "kairos": {
        "axes": {
            "lr": ("2e-05", "5e-05", "0.0001"),
            "wd": ("0.001", "0.01", "0.1"),
            "cap": ("small", "default", "large"),
            "batch": ("512", "1024", "2048"),
            "neigh": ("10", "20", "50"),
        },
        "default": ("5e-05", "0.01", "default", "1024", "20"),
    },
}
# Override keys of an axis, and the values of the named capacities per method.
AXIS_KEYS = {
    "lr": ("training.lr",),
    "wd": ("training.weight_decay",),
    "dim": ("training.node_hid_dim", "training.node_out_dim"),
    "emb": ("featurization.emb_dim",),
    "mask": ("training.decoder.reconstruct_masked_features.mask_rate",),
    "batch": ("batching.intra_graph_batching.edges.intra_graph_batch_size",),
    "neigh": ("batching.intra_graph_batching.tgn_last_neighbor.tgn_neighbor_size",),
}
CAPACITIES = {
    "orthrus": {
        "default": {"training.node_out_dim": "64", "featurization.emb_dim": "128"},
        "medium": {"training.node_out_dim": "128", "featurization.emb_dim": "128"},
        "large": {"training.node_out_dim": "256", "featurization.emb_dim": "256"},
    },
    "kairos": {
        name: {
            key: size
            for key in (
                "training.node_hid_dim",
                "training.node_out_dim",
                "training.encoder.tgn.tgn_memory_dim",
                "training.encoder.tgn.tgn_time_dim",
            )
        }
        for name, size in (("small", "64"), ("default", "100"), ("large", "128"))
    },
}
WINDOW_SECONDS = {"1m": 60, "2m": 120, "4m": 240}
SEED_KEYS = ("training.seed", "featurization.seed")
RUNG_EPOCHS = (1, 2, 4, 9)
FINAL_EPOCHS = 12


def numbered(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Every combination of the array columns ``axes``, the last varying fastest, numbered from 0.

    The combination of the row's ``default`` array comes first.  The number is computed from the positions,
    so nothing is sorted or gathered.
    """
    out = rows
    place = F.lit(0).cast("bigint")
    default_place = F.lit(0).cast("bigint")
    for nth, axis in enumerate(axes):
        size = F.size(axis)
        default_place = default_place * size + F.array_position(axis, F.col("default")[nth]) - 1
    out = out.withColumn("_default_place", default_place)
    for axis in axes:
        out = out.withColumn(f"_n_{axis}", F.size(axis))
    for axis in axes:
        out = out.select(
            *[c for c in out.columns if c != axis], F.posexplode(axis).alias(f"_p_{axis}", axis)
        )
    for axis in axes:
        place = place * F.col(f"_n_{axis}") + F.col(f"_p_{axis}")
    index = F.when(place == F.col("_default_place"), 0).when(place < F.col("_default_place"), place + 1).otherwise(place)
    return out.withColumn("index", index.cast("bigint")).drop(
        "_default_place", "default", *[f"_{k}_{a}" for a in axes for k in ("n", "p")]
    )


def combination_name(index: Column, axes: list[str], suffix: str = "seed0") -> Column:
    number = index.cast("string")
    number = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    parts = [F.concat(F.lit(a), value_token(F.col(a).cast("string"))) for a in axes]
    return F.concat_ws("_", F.concat(F.lit("c"), number), *parts, F.lit(suffix))


def parameter_grid(rows: DataFrame, axes: list[str]) -> DataFrame:
    grid = numbered(rows, axes)
    return grid.withColumn("name", combination_name(F.col("index"), axes))


def published_grid(spark: SparkSession, method: str) -> DataFrame:
    """The grid of a method: index, name and one column per axis."""
    spec = GRIDS[method]
    axes = list(spec["axes"])
    arrays = [F.array(*[F.lit(v) for v in spec["axes"][a]]).alias(a) for a in axes]
    row = spark.range(1).select(*arrays, F.array(*[F.lit(v) for v in spec["default"]]).alias("default"))
    return parameter_grid(row, axes).select("index", "name", *axes)


def override_map(method: str, axes: list[str]) -> Column:
    """Overrides of a combination: every axis adds its keys, named capacities add several."""
    maps = [F.create_map(*[c for k in SEED_KEYS for c in (F.lit(k), F.lit("0"))])]
    for axis in axes:
        value = F.col(axis).cast("string")
        if axis == "cap":
            maps += [
                F.when(value == name, F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])).otherwise(
                    F.expr("map()").cast("map<string,string>")
                )
                for name, keys in CAPACITIES[method].items()
            ]
        elif axis in AXIS_KEYS:
            maps.append(F.create_map(*[c for k in AXIS_KEYS[axis] for c in (F.lit(k), value)]))
    return F.map_concat(*maps)


def window_seconds(axis: Column) -> Column:
    seconds = F.lit(None).cast("int")
    for name, value in WINDOW_SECONDS.items():
        seconds = F.when(axis == name, value).otherwise(seconds)
    return seconds


def planned_runs(grid: DataFrame, method: str, rungs: tuple[int, ...] = RUNG_EPOCHS) -> DataFrame:
    """One row per combination and rung (``r0_e1`` …), with epochs and the rung resumed from."""
    axes = [c for c in grid.columns if c not in ("index", "name")]
    names = [f"r{n}_e{e}" for n, e in enumerate(rungs)]
    table = F.array(
        *[
            F.struct(
                F.lit(names[n]).alias("rung"),
                F.lit(e).alias("epochs"),
                F.lit(names[n - 1] if n else None).cast("string").alias("resume_from"),
            )
            for n, e in enumerate(rungs)
        ]
    )
    return (
        grid.withColumn("overrides", override_map(method, axes))
        .withColumn("r", F.explode(table))
        .select(F.lit(method).alias("method"), "r.*", "index", "name", "overrides")
    )


def expand_templates(templates: DataFrame, seeds: list[int]) -> DataFrame:
    """Run templates × seeds.  Input: name, overrides.

    The seed is appended to the name and set under the seed keys a template does not set itself; without
    seeds the templates are the runs.
    """
    if not seeds:
        return templates.select("name", F.lit(None).cast("int").alias("seed"), "overrides")
    expanded = templates.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    text = F.col("seed").cast("string")
    seeded = F.create_map(*[c for k in SEED_KEYS for c in (F.lit(k), text)])
    unset = F.map_filter(seeded, lambda k, v: ~F.map_contains_key(F.col("overrides"), k))
    return expanded.select(
        F.concat(F.col("name"), F.lit("_seed"), text).alias("name"),
        "seed",
        F.map_concat(F.col("overrides"), unset).alias("overrides"),
    )
