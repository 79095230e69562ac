"""Sinks: named result tables written to a folder, display names restored.

Overwriting is atomic. A table is written to a version folder of its own,
``out_dir/<name>/v-<id>``, that no reader looks at; then a commit, a small numbered file in
``out_dir/_commits``, names the version of every table of the folder. Commits
are created exclusively, one number after the other, so two writers cannot take the
same one, and a commit file that is not whole does not count. Until the
commit, and if a write fails, readers get the old version; several tables
(``write_tables``) change in one commit, or none does. The version before the
current one is kept for readers that have begun, older ones go.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from taskshift.functions.columns import display_names

COMMITS = "_commits"
#: Times that a commit is tried again when another writer took its number.
TRIES = 50


def _folder(name: str) -> str:
    return name.replace(" ", "_")


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path: local disk, HDFS or an object store alike."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, out_dir: str) -> list[tuple[int, dict]]:
    """Whole commits of a folder, newest first."""
    fs, at = _fs(spark, f"{out_dir}/{COMMITS}")
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        number = status.getPath().getName().removesuffix(".json")
        if not number.isdigit():
            continue
        stream = fs.open(status.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found.append((int(number), json.loads(text)))
        except ValueError:          # its writer has not finished, or died
            found.append((int(number), {}))
    return sorted(found, key=lambda c: -c[0])


def _commit(spark: SparkSession, out_dir: str, changes: dict[str, dict]) -> None:
    """Make ``changes`` (table -> version) the current state, on top of whatever is current then."""
    from py4j.protocol import Py4JJavaError
    for _ in range(TRIES):
        done = _commits(spark, out_dir)
        state = next((c["tables"] for _, c in done if c), {}) | changes
        number = (done[0][0] if done else 0) + 1
        fs, at = _fs(spark, f"{out_dir}/{COMMITS}/{number:012d}.json")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                continue            # another writer took this number: start from its state
            raise
        stream.write(bytearray(json.dumps({"tables": state}).encode()))
        stream.close()
        _clean(spark, out_dir, changes)
        return
    raise RuntimeError(f"{out_dir}: no commit after {TRIES} tries")


def _clean(spark: SparkSession, out_dir: str, tables: dict[str, dict]) -> None:
    """Drop the versions of the changed tables that neither the current state nor the one before names, and their commits."""
    whole = [(n, c["tables"]) for n, c in _commits(spark, out_dir) if c]
    for name in tables:
        used = {t[name]["version"] for _, t in whole[:2] if name in t}
        older = {t[name]["version"] for _, t in whole[2:] if name in t} - used
        for version in older:
            fs, at = _fs(spark, f"{out_dir}/{_folder(name)}/{version}")
            fs.delete(at, True)
    for number, _ in whole[2:]:
        fs, at = _fs(spark, f"{out_dir}/{COMMITS}/{number:012d}.json")
        fs.delete(at, False)


def _stage(df: DataFrame, out_dir: str, name: str, fmt: str, display: bool, sep: str) -> dict:
    """Write a new version that no reader sees yet; nothing of it stays if that fails."""
    version = f"v-{uuid.uuid4().hex}"
    path = f"{out_dir}/{_folder(name)}/{version}"
    out = display_names(df) if display and fmt == "csv" else df
    try:
        if fmt == "csv":
            out.write.option("header", True).option("sep", sep).csv(path)
        else:
            out.write.parquet(path)
    except Exception:
        fs, at = _fs(df.sparkSession, path)
        fs.delete(at, True)
        raise
    return {"version": version, "format": fmt, "sep": sep}


def write_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", display: bool = True, sep: str = ",") -> dict[str, str]:
    """Overwrite several named tables of a folder in one commit; returns name -> path of the new version."""
    out_dir = out_dir.rstrip("/")
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    staged: dict[str, dict] = {}
    try:
        for name, df in tables.items():
            staged[name] = _stage(df, out_dir, name, fmt, display, sep)
    except Exception:
        for name, made in staged.items():
            fs, at = _fs(spark, f"{out_dir}/{_folder(name)}/{made['version']}")
            fs.delete(at, True)
        raise
    _commit(spark, out_dir, staged)
    return {name: f"{out_dir}/{_folder(name)}/{made['version']}" for name, made in staged.items()}


def write_table(df: DataFrame, out_dir: str, name: str, fmt: str = "parquet",
                display: bool = True, sep: str = ",") -> str:
    """Overwrite the named table of ``out_dir`` (parquet or csv); returns the path of the new version."""
    return write_tables({name: df}, out_dir, fmt, display, sep)[name]


def read_table(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The current version of a named table: the whole of it, or of the one before if a write is under way."""
    out_dir = out_dir.rstrip("/")
    state = next((c["tables"] for _, c in _commits(spark, out_dir) if c), {})
    if name not in state:
        raise FileNotFoundError(f"{out_dir} has no table {name!r}")
    made = state[name]
    path = f"{out_dir}/{_folder(name)}/{made['version']}"
    return spark.read.option("header", True).option("sep", made["sep"]).csv(path) if made["format"] == "csv" else spark.read.parquet(path)


def table_names(spark: SparkSession, out_dir: str) -> list[str]:
    """The tables of a folder, as of its last commit."""
    return sorted(next((c["tables"] for _, c in _commits(spark, out_dir.rstrip("/")) if c), {}))


def preview(df: DataFrame, order, n: int = 20) -> DataFrame:
    """Sorted preview of a result (a top-n: TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
