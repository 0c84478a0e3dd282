"""Versioned tables: commits that are built aside, checked, and switched to in one step.

A folder that was set up with ``create`` holds

- ``<table>/commit=<id>/<partitions>/part-*``: the files that a commit wrote.  A commit never touches another one's files;
- ``_manifests/<id>``: a table with one row per part file of the snapshot: table, commit, partition, path, rows, bytes;
- ``_log/<version>.json``: one small file per version, which names the manifest and the schemas.  It is written aside and renamed to a name that
  must not exist, so the switch is one atomic step and two writers cannot both be version n.

A commit replaces the partitions it is told to and adds files; the new manifest is the old one without the replaced partitions plus
the new files, worked out by Spark.  A job that fails before the rename leaves files that no manifest names: every reader goes on seeing the
old snapshot, and ``vacuum`` removes them later.  A ``Snapshot`` is pinned to the version it was opened at; later commits
do not change what it reads while that version is retained.

Other folders (``FlatStore``) hold one plain Parquet table per name.  Their commits are written aside and checked too; only the last
step, replacing partitions in place, is not atomic there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.names import plain_path
from traceloom.session import materialize
from traceloom.sources import sinks

_MANIFEST = "table string, commit string, partition map<string,string>, path string, rows bigint, bytes bigint"


class CommitConflict(RuntimeError):
    """Another commit changed the same partitions in the meantime."""


# Files ------------------------------------------------------------------------------------------------


def _jpath(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _jpath(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_jpath(spark, path))


def _put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file whole or not at all; False when the name is taken."""
    jvm, aside = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    stream = _files(spark, aside).create(_jpath(spark, aside), False)
    try:
        stream.write(content.encode())
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_jpath(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_jpath(spark, aside), _jpath(spark, path), options)
        return True
    except Exception as error:
        _files(spark, aside).delete(_jpath(spark, aside), False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_jpath(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _files(spark, folder).listStatus(_jpath(spark, folder)))


# Versions ---------------------------------------------------------------------------------------------


def _log(root: str, version: int) -> str:
    return f"{root}/_log/{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    names = _names(spark, f"{root.rstrip('/')}/_log")
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]


def create(spark: SparkSession, root: str) -> None:
    """Make ``root`` a versioned folder; does nothing if it is one."""
    entry = {"version": 0, "commit": "", "manifest": None, "tables": {}, "note": {}, "at": time.time()}
    _put_if_absent(spark, _log(root.rstrip("/"), 0), json.dumps(entry))


def is_versioned(spark: SparkSession, root: str) -> bool:
    return bool(versions(spark, root))


@dataclass
class Snapshot:
    """The tables of one version."""

    spark: SparkSession
    root: str
    entry: dict

    @property
    def version(self) -> int:
        return self.entry["version"]

    def has(self, table: str) -> bool:
        return table in self.entry["tables"]

    def manifest(self, table: str | None = None) -> DataFrame:
        if self.entry["manifest"] is None:
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/{self.entry['manifest']}")
        return rows if table is None else rows.filter(F.col("table") == table)

    def read(self, table: str, keys: DataFrame | None = None, **where: list[str]) -> DataFrame:
        """A table; ``where`` names partition columns and the values wanted, ``keys`` is a table of them, and only their files are listed.

        The driver holds the paths of the files that are read, as the file index of any Parquet scan does.
        """
        schema = T.StructType.fromJson(self.entry["tables"][table]["schema"])
        files = self.manifest(table)
        for column, values in where.items():
            files = files.filter(F.col("partition")[column].isin(*values))
        if keys is not None:
            files = files.join(_renamed(keys), _same_partition(keys), "left_semi")
        paths = [f"{self.root}/{r['path']}" for r in files.select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        commit = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        return self.spark.read.schema(commit).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.names)


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest version, or a retained older one."""
    root = root.rstrip("/")
    known = versions(spark, root)
    if not known:
        raise ValueError(f"{root} holds no versioned tables")
    wanted = known[-1] if version is None else version
    if wanted not in known:
        raise ValueError(f"version {wanted} of {root} is not retained")
    return Snapshot(spark, root, json.loads(read_text(spark, _log(root, wanted))))


def history(spark: SparkSession, root: str) -> Iterator[dict]:
    """Log entries, newest first."""
    root = root.rstrip("/")
    for version in reversed(versions(spark, root)):
        yield json.loads(read_text(spark, _log(root, version)))


def _renamed(keys: DataFrame) -> DataFrame:
    return keys.distinct().select(*[F.col(c).cast("string").alias(f"_key_{c}") for c in keys.columns])


def _same_partition(keys: DataFrame):
    """Whether a row of a manifest is of a partition that ``_renamed`` keys name."""
    hit = F.lit(True)
    for column in keys.columns:
        hit = hit & (F.col("partition")[column] == F.col(f"_key_{column}"))
    return hit


# Commits ----------------------------------------------------------------------------------------------


@dataclass
class VersionedCommit:
    """Tables written aside on top of ``base``; nothing is visible before ``publish``."""

    base: Snapshot
    id: str = field(default_factory=lambda: f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}")
    schemas: dict[str, dict] = field(default_factory=dict)
    by: dict[str, list[str]] = field(default_factory=dict)
    gone: list[tuple[str, DataFrame]] = field(default_factory=list)
    whole: set[str] = field(default_factory=set)

    @property
    def spark(self) -> SparkSession:
        return self.base.spark

    def before(self, table: str, keys: DataFrame | None = None) -> DataFrame | None:
        """A table, or its partitions that ``keys`` name, as it was before this commit; None if there was none."""
        return self.base.read(table, keys) if self.base.has(table) else None

    def replace(self, tables: list[str] | tuple[str, ...], keys: DataFrame) -> None:
        """Partitions of ``tables`` whose columns have one of the values of ``keys`` (a written table) are left out of the new version."""
        self.gone += [(table, keys) for table in tables]

    def write(self, table: str, df: DataFrame, by: list[str], overwrite: bool = False) -> DataFrame:
        """Write rows of a table, once per table and commit, and give them back as read from the files.

        With ``overwrite`` the new version holds these rows alone.
        """
        if table in self.schemas:
            raise ValueError(f"{table} is already written in this commit")
        by = list(by)
        shaped = df.select(*[c for c in df.columns if c not in by], *by)
        self.schemas[table], self.by[table] = json.loads(shaped.schema.json()), by
        if overwrite:
            self.whole.add(table)
        balanced = shaped.hint("rebalance", *by) if by else shaped
        writer = balanced.write.partitionBy(*by) if by else balanced.write
        writer.parquet(self._folder(table))
        return self.written(table)

    def written(self, table: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(self.schemas[table])).parquet(self._folder(table))

    def _folder(self, table: str) -> str:
        return f"{self.base.root}/{table}/commit={self.id}"

    def _added(self) -> DataFrame:
        """Manifest rows of the new files.  Only partition values and row counts are read."""
        found = self.spark.createDataFrame([], _MANIFEST)
        for table, by in self.by.items():
            partition = F.create_map(*[x for c in by for x in (F.lit(c), F.col(c).cast("string"))]) if by else F.expr("map()")
            at = f"/commit={self.id}/"
            path = F.concat(F.lit(table + at), F.substring_index(plain_path(F.col("_metadata.file_path")), at, -1))
            files = self.written(table).select(
                F.lit(table).alias("table"), F.lit(self.id).alias("commit"), F.to_json(partition.cast("map<string,string>")).alias("partition"),
                path.alias("path"), F.col("_metadata.file_size").alias("bytes"),
            ).groupBy("table", "commit", "partition", "path", "bytes").agg(F.count(F.lit(1)).alias("rows"))
            found = found.unionByName(files.withColumn("partition", F.from_json("partition", "map<string,string>")))
        return found

    def _kept(self, base: Snapshot) -> DataFrame:
        kept = base.manifest().filter(~F.col("table").isin(*self.whole)) if self.whole else base.manifest()
        for table, keys in self.gone:
            kept = kept.join(_renamed(keys), (F.col("table") == table) & _same_partition(keys), "left_anti")
        return kept

    def _conflicts(self, theirs: Snapshot, added: DataFrame) -> bool:
        """Whether a partition that this commit writes or replaces differs between its base and ``theirs``."""
        def files(s: Snapshot, other: Snapshot) -> DataFrame:
            return s.manifest().join(other.manifest().select("path"), "path", "left_anti")

        changed = files(self.base, theirs).unionByName(files(theirs, self.base)).select("table", "partition", F.to_json("partition").alias("_p"))
        if self.whole and not changed.filter(F.col("table").isin(*self.whole)).isEmpty():
            return True
        own = added.select("table", F.to_json("partition").alias("_p")).distinct()
        if not changed.join(own, ["table", "_p"], "left_semi").isEmpty():
            return True
        for table, keys in self.gone:
            if not changed.filter(F.col("table") == table).join(_renamed(keys), _same_partition(keys), "left_semi").isEmpty():
                return True
        return False

    def publish(self, **note) -> int:
        """Switch to the new version and return its number.

        If other commits came first this one is put on top of them, unless they changed the same partitions.
        """
        added = materialize(self._added(), "added")
        base = self.base
        while True:
            newest = snapshot(self.spark, base.root)
            if newest.version != base.version:
                if self._conflicts(newest, added):
                    raise CommitConflict(f"version {newest.version} of {base.root} changed the same partitions")
                base = newest
            manifest = f"_manifests/{self.id}-{uuid.uuid4().hex[:8]}"
            files = self._kept(base).unionByName(added)
            files.hint("rebalance", "table").write.parquet(f"{base.root}/{manifest}")
            known = base.entry["tables"] | {t: {"schema": s, "by": self.by[t]} for t, s in self.schemas.items()}
            entry = {"version": base.version + 1, "commit": self.id, "manifest": manifest, "tables": known, "note": note, "at": time.time()}
            if _put_if_absent(self.spark, _log(base.root, base.version + 1), json.dumps(entry)):
                return base.version + 1


@dataclass
class FlatCommit:
    """The same steps for a folder of plain tables: tables are written aside, and moved over by ``publish``."""

    spark: SparkSession
    root: str
    staged: dict[str, tuple[DataFrame, list[str], bool]] = field(default_factory=dict)
    gone: list[tuple[str, DataFrame]] = field(default_factory=list)

    def before(self, table: str, keys: DataFrame | None = None) -> DataFrame | None:
        if not path_exists(self.spark, f"{self.root}/{table}"):
            return None
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        return rows if keys is None else rows.join(keys.distinct(), keys.columns, "left_semi")

    def replace(self, tables: list[str] | tuple[str, ...], keys: DataFrame) -> None:
        self.gone += [(table, keys) for table in tables]

    def write(self, table: str, df: DataFrame, by: list[str], overwrite: bool = False) -> DataFrame:
        staged = materialize(df, f"aside-{table}")
        self.staged[table] = staged, list(by), overwrite
        return staged

    def written(self, table: str) -> DataFrame:
        return self.staged[table][0]

    def publish(self, **note) -> None:
        for table, keys in self.gone:
            sinks.drop_partitions(self.spark, f"{self.root}/{table}", (r.asDict() for r in keys.distinct().toLocalIterator()))
        for table, (df, by, overwrite) in self.staged.items():
            if overwrite or not by:
                sinks.write_table(df, f"{self.root}/{table}")
            else:
                sinks.write_partitioned(df, f"{self.root}/{table}", by)


@dataclass
class FlatStore:
    spark: SparkSession
    root: str

    def has(self, table: str) -> bool:
        return path_exists(self.spark, f"{self.root}/{table}")

    def read(self, table: str, **where: list[str]) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{table}")
        for column, values in where.items():
            df = df.filter(F.col(column).isin(*values))
        return df

    def begin(self) -> FlatCommit:
        return FlatCommit(self.spark, self.root)


@dataclass
class VersionedStore:
    """A versioned folder as it was when opened."""

    pinned: Snapshot

    def has(self, table: str) -> bool:
        return self.pinned.has(table)

    def read(self, table: str, keys: DataFrame | None = None, **where: list[str]) -> DataFrame:
        return self.pinned.read(table, keys, **where)

    def begin(self) -> VersionedCommit:
        return VersionedCommit(self.pinned)


def open_store(spark: SparkSession, root: str) -> FlatStore | VersionedStore:
    """The tables of a folder, read consistently from here on if the folder is versioned."""
    root = root.rstrip("/")
    return VersionedStore(snapshot(spark, root)) if is_versioned(spark, root) else FlatStore(spark, root)


# Retention --------------------------------------------------------------------------------------------


def vacuum(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = 86_400) -> int:
    """Forget all but the newest ``keep`` versions and remove the partitions that no kept one names; returns how many.

    Files of commits younger than ``grace_seconds`` that no version names stay: they may be about to be published.  Readers that are pinned
    to a forgotten version lose it.
    """
    root = root.rstrip("/")
    known = versions(spark, root)
    forgotten, kept = known[: max(len(known) - keep, 0)], [snapshot(spark, root, v) for v in known[-keep:]]
    used = kept[0].manifest()
    for other in kept[1:]:
        used = used.unionByName(other.manifest())
    used = materialize(used.select("commit", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct(), "used")
    tables = sorted({t for s in kept for t in s.entry["tables"]} | {t for v in forgotten for t in snapshot(spark, root, v).entry["tables"]} | _unnamed(spark, root))
    # First the log, so that no reader opens a version that is about to lose files.
    for version in forgotten:
        _files(spark, root).delete(_jpath(spark, _log(root, version)), False)
    live = {s.entry["manifest"] for s in kept}
    newest = time.strftime("%Y%m%dT%H%M%S", time.gmtime(time.time() - grace_seconds))
    for name in _names(spark, f"{root}/_manifests"):
        if f"_manifests/{name}" not in live and name[:15] < newest:
            _files(spark, root).delete(_jpath(spark, f"{root}/_manifests/{name}"), True)
    removed = 0
    named = materialize(used.select("commit").distinct(), "commits")
    for table in tables:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root}/{table}")
        rel = F.concat(F.lit(f"{table}/commit="), F.substring_index("path", f"/{table}/commit=", -1))
        folders = listed.select(F.regexp_extract(rel, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(rel, r"/commit=([^/]*)/", 1).alias("commit")).distinct()
        # Parts of a published commit that later ones replaced, and all of those that were never published.
        dead = folders.join(used, "folder", "left_anti").join(named.withColumn("named", F.lit(True)), "commit", "left")
        dead = materialize(dead.filter(F.substring("commit", 1, 15) < newest).select("folder"), "dead")
        for row in dead.toLocalIterator():
            _files(spark, root).delete(_jpath(spark, f"{root}/{row['folder']}"), True)
            removed += 1
    return removed


def _unnamed(spark: SparkSession, root: str) -> set[str]:
    """Folders beside the log: tables that perhaps no version names."""
    return {n for n in _names(spark, root) if not n.startswith(("_", "."))}
