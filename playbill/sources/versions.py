"""Stored tables as a chain of versions.

A store is a folder with ``data`` and ``log``. A commit writes new folders of Parquet files under ``data`` and then one small manifest under ``log``,
which names all folders of all tables of the store. A manifest has the next free number and appears whole or not at all, and only if nobody else has
taken its number. Readers take the newest manifest and change nothing. A table may be divided by a column; a commit then replaces or drops single
parts and takes all others over by name, without reading them. What a writer left behind when it died is named by no manifest and so is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "part_"
#: the part of rows whose dividing column is null
NO_VALUE = "none"
ALL = "*"
LOOK_UP = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


class Conflict(RuntimeError):
    """Another writer has changed what this commit builds on."""


@dataclass(frozen=True)
class State:
    """One version of a store: for each table its schema, dividing column and the folders of each part; notes are small texts or numbers."""

    root: str
    version: int
    tables: dict = field(default_factory=dict)
    notes: dict = field(default_factory=dict)
    touched: dict = field(default_factory=dict)

    def parts(self, name: str) -> list[str]:
        return sorted(self.tables.get(name, {}).get("parts", {}))


@dataclass(frozen=True)
class Change:
    """New rows of a table. ``mode`` is ``replace`` (the whole table), ``parts`` (the named parts) or ``append``."""

    name: str
    rows: DataFrame
    by: str | None = None
    mode: str = "replace"
    parts: tuple[str, ...] = ()


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, log = _path(spark, f"{root}/log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> State:
    fs, file = _path(spark, f"{root}/log/{number:020d}.json")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return State(root=root, version=number, **json.loads(text))


def load(spark: SparkSession, root: str) -> State | None:
    """The newest version of a store, or None if nothing was ever committed."""
    numbers = _numbers(spark, root)
    return _manifest(spark, root, numbers[-1]) if numbers else None


def read(spark: SparkSession, state: State | None, name: str, parts: Iterable[str] | None = None, empty: str | None = None) -> DataFrame:
    """Rows of a table in one version, of all parts or of the given ones alone. ``empty`` is the schema of a table that does not exist."""
    table = state.tables.get(name) if state else None
    if table is None:
        if empty is None:
            raise KeyError(f"there is no table {name}")
        return spark.createDataFrame([], empty)
    schema = T.StructType.fromJson(json.loads(table["schema"]))
    chosen = table["parts"] if parts is None else {p: table["parts"][p] for p in set(parts) & table["parts"].keys()}
    folders = sorted(f"{state.root}/{f}" for each in chosen.values() for f in each)
    if not folders:
        return spark.createDataFrame([], schema)
    # many small folders are looked up by a few tasks instead of one task each
    before = spark.conf.get(LOOK_UP, None)
    spark.conf.set(LOOK_UP, str(max(1, min(len(folders) // 64, 10_000))))
    try:
        return spark.read.schema(schema).parquet(*folders)
    finally:
        spark.conf.unset(LOOK_UP) if before is None else spark.conf.set(LOOK_UP, before)


def part_of(column: str) -> Column:
    """The part that a row's value belongs to."""
    return F.coalesce(F.col(column).cast("string"), F.lit(NO_VALUE))


def _write(spark: SparkSession, root: str, change: Change) -> dict[str, list[str]]:
    """Write the rows of a change; the new folders of each part."""
    folder = f"data/{uuid.uuid4().hex}"
    if change.by is None:
        change.rows.write.parquet(f"{root}/{folder}")
        return {ALL: [folder]}
    # rows of one part come together, and a part that is too large for one task is split
    rows = change.rows.withColumn(PART, part_of(change.by)).hint("rebalance", PART)
    rows.write.partitionBy(PART).parquet(f"{root}/{folder}")
    fs, written = _path(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(written) if s.isDirectory()]
    return {n.removeprefix(f"{PART}="): [f"{folder}/{n}"] for n in names if n.startswith(f"{PART}=")}


def _applied(base: State | None, root: str, changes: list[tuple[Change, dict]], drop: dict[str, list[str]], notes: dict) -> State:
    tables = {n: {**t, "parts": dict(t["parts"])} for n, t in (base.tables if base else {}).items()}
    touched: dict[str, list[str]] = {}
    for change, written in changes:
        table = tables.get(change.name)
        if change.mode == "replace" or table is None:
            table = {"by": change.by, "parts": {}}
            touched[change.name] = [ALL]
        elif table["by"] != change.by:
            raise ValueError(f"table {change.name} is divided by {table['by']}")
        else:
            touched[change.name] = sorted({*change.parts, *written})
        if change.mode == "parts":
            stray = set(written) - set(change.parts)
            if stray:
                raise ValueError(f"rows outside the named parts of {change.name}: {sorted(stray)[:5]}")
            table["parts"] = {p: f for p, f in table["parts"].items() if p not in change.parts}
        for part, folders in written.items():
            table["parts"][part] = [*table["parts"].get(part, []), *folders] if change.mode == "append" else folders
        table["schema"] = change.rows.schema.json()
        tables[change.name] = table
    for name, parts in drop.items():
        tables[name]["parts"] = {p: f for p, f in tables[name]["parts"].items() if p not in parts}
        touched[name] = sorted({*touched.get(name, []), *parts})
    if notes:
        touched["notes"] = sorted(notes)
    return State(root, (base.version if base else 0) + 1, tables, {**(base.notes if base else {}), **notes}, touched)


def _publish(spark: SparkSession, state: State) -> bool:
    """Make a manifest appear under its number; False if the number is taken."""
    jvm = spark._jvm
    final, draft = f"{state.root}/log/{state.version:020d}.json", f"{state.root}/log/.draft-{uuid.uuid4().hex}"
    fs, source = _path(spark, draft)
    target = jvm.org.apache.hadoop.fs.Path(final)
    stream = fs.create(source, False)
    stream.write(bytearray(json.dumps({"tables": state.tables, "notes": state.notes, "touched": state.touched}).encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":  # a rename here would overwrite, a second link cannot
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(source))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, none)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(source, False)
    return True


def _clash(mine: dict, theirs: dict) -> bool:
    """Whether two commits touch the same parts or notes."""
    both = mine.keys() & theirs.keys()
    return any(ALL in mine[n] or ALL in theirs[n] or set(mine[n]) & set(theirs[n]) for n in both)


def commit(
    spark: SparkSession, root: str, base: State | None, changes: Iterable[Change] = (), drop: dict[str, list[str]] | None = None,
    notes: dict | None = None, blind: bool = False,
) -> State:
    """Store changes that were worked out from the version ``base`` (None: from nothing) as the next version.

    Commits of others that came in between are kept if they touch other parts, tables and notes; otherwise ``Conflict`` is raised and nothing has
    changed. ``blind`` says that the changes depend on no version, so they go on top of whatever there is. All changes of a commit become visible
    together. The number of parts and notes is meant to be small, such as days.
    """
    written = [(c, _write(spark, root, c)) for c in changes]
    drop, notes = drop or {}, notes or {}
    known = base.version if base else 0
    while True:
        later = [_manifest(spark, root, n) for n in _numbers(spark, root) if n > known]
        top = later[-1] if later else base
        new = _applied(top, root, written, drop, notes)
        if not blind and any(_clash(new.touched, each.touched) for each in later):
            raise Conflict(f"{root} was changed by version {later[-1].version}")
        fs, log = _path(spark, f"{root}/log")
        fs.mkdirs(log)
        if _publish(spark, new):
            return new


def vacuum(spark: SparkSession, root: str, keep: int = 10, grace_seconds: int = 86_400) -> int:
    """Forget all but the newest ``keep`` versions and delete folders that no kept version names; returns their number.

    Folders younger than ``grace_seconds`` stay, as a writer may not have committed them yet.
    """
    numbers = _numbers(spark, root)
    for number in numbers[:-keep]:
        fs, file = _path(spark, f"{root}/log/{number:020d}.json")
        fs.delete(file, False)
    named = {
        f.split("/")[1] for n in numbers[-keep:] for t in _manifest(spark, root, n).tables.values() for folders in t["parts"].values() for f in folders
    }
    fs, data = _path(spark, f"{root}/data")
    if not fs.exists(data):
        return 0
    now = spark._jvm.java.lang.System.currentTimeMillis()
    old = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named and now - s.getModificationTime() >= 1000 * grace_seconds]
    for path in old:
        fs.delete(path, True)
    return len(old)
