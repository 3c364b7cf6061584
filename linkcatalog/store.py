"""Tables that several writers change at once: immutable Parquet files, named by numbered versions.

A version is a small file that lists, for each table, the files of its rows and the changes since. A commit writes
its rows first and then the next version's file, which only one writer can create: the others learn of the
conflict, look again and try anew. All tables of a commit change together or not at all.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Change sets of a table that a read merges, at most; a commit beyond that writes the table anew.
MOST_CHANGES = 12


class Conflict(RuntimeError):
    """Another writer made this version first."""


@dataclass(frozen=True)
class Put:
    """The table made anew; rows are told apart by ``key``, whose columns are never null."""

    rows: DataFrame
    key: Sequence[str] = ()


@dataclass(frozen=True)
class Append:
    """Rows with keys that the table doesn't have."""

    rows: DataFrame


@dataclass(frozen=True)
class Upsert:
    """Rows that take the place of those of the same key. Keys are unique in ``rows``."""

    rows: DataFrame


@dataclass(frozen=True)
class Remove:
    """Keys whose rows go."""

    rows: DataFrame


Change = Put | Append | Upsert | Remove


@dataclass(frozen=True)
class Version:
    """``tables``: name to key, schema, files of rows, change sets; ``epochs``: writer to the last epoch that it
    committed; ``wrote``: the files of each table that this commit itself made."""

    number: int
    tables: dict[str, dict]
    epochs: dict[str, int]
    wrote: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """A folder of such tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    # --- versions ---

    def current(self) -> Version:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.version(max(numbers)) if numbers else Version(0, {}, {})

    def version(self, number: int) -> Version:
        if not number:
            return Version(0, {}, {})
        stream = self._fs.open(self._path(self._name(number)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def _name(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def _announce(self, version: Version) -> None:
        """Creates the version's file; of several writers one succeeds."""
        own = f"{self.root}/versions/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(own))
        out.write(json.dumps({"tables": version.tables, "epochs": version.epochs, "wrote": version.wrote}).encode())
        out.close()
        uri = urlparse(self._fs.makeQualified(self._path(own)).toString())
        if uri.scheme == "file":  # a rename replaces what is there, a link doesn't
            at = unquote(uri.path)
            try:
                os.link(at, os.path.join(os.path.dirname(at), f"{version.number:012d}.json"))
            except FileExistsError as e:
                raise Conflict(version.number) from e
            finally:
                self._fs.delete(self._path(own), False)
            return
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._path(own), self._path(self._name(version.number)), none)
        except Py4JJavaError as e:
            self._fs.delete(self._path(own), False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(version.number) from e
            raise

    # --- rows ---

    def read(self, name: str, at: Version | None = None) -> DataFrame:
        """The rows of a table: its files, less those with a change, and the last change of each key."""
        table = (at or self.current()).tables[name]
        schema = StructType.fromJson(table["schema"])
        rows = self._load(table["files"], schema)
        if not table["changes"]:
            return rows
        last = self.changes(table)
        kept = rows.join(last.select(*table["key"]), table["key"], "left_anti")
        return kept.select(*schema.names).unionByName(last.where("not _gone").select(*schema.names))

    def changes(self, table: dict) -> DataFrame:
        """The last change of each key, with ``_gone`` where it removes the row."""
        schema = StructType.fromJson(table["schema"])
        wide = StructType([*schema.fields]).add("_gone", "boolean")
        parts = [self._load([x], wide).withColumn("_n", F.lit(n)) for n, x in enumerate(table["changes"])]
        both = parts[0]
        for x in parts[1:]:
            both = both.unionByName(x)
        if len(parts) == 1:
            return both.drop("_n")
        last = F.max_by(F.struct(*schema.names, "_gone"), "_n").alias("row")
        return both.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(table["key"])]).agg(last).select("row.*")

    def wrote(self, version: Version, name: str) -> DataFrame:
        """The rows that a version's own commit wrote to a table; of removals the keys."""
        schema = StructType.fromJson(version.tables[name]["schema"]).add("_gone", "boolean")
        return self._load(version.wrote.get(name, []), schema).drop("_gone")

    def _load(self, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{x}" for x in files])

    # --- commits ---

    def commit(self, at: Version, changes: dict[str, Change | Sequence[Change]], writer: str | None = None, epoch: int | None = None) -> Version:
        """The version after ``at``, with the changes of all tables; :class:`Conflict` where ``at`` is no longer the
        last. What a lost commit wrote is deleted."""
        tables = {n: {**t, "files": [*t["files"]], "changes": [*t["changes"]]} for n, t in at.tables.items()}
        wrote: dict[str, list[str]] = {}
        try:
            for name, given in changes.items():
                for change in given if isinstance(given, Sequence) else [given]:
                    self._apply(tables, name, change, wrote)
                if len(tables[name]["changes"]) > MOST_CHANGES:
                    whole = self.read(name, Version(at.number + 1, tables, {}))
                    tables[name] |= {"files": [self._write(name, whole)], "changes": []}
            epochs = at.epochs if writer is None else {**at.epochs, writer: epoch}
            out = Version(at.number + 1, tables, epochs, wrote)
            self._announce(out)
        except BaseException:
            for x in (x for files in wrote.values() for x in files):
                self._fs.delete(self._path(f"{self.root}/data/{x}"), True)
            raise
        return out

    def _apply(self, tables: dict, name: str, change: Change, wrote: dict) -> None:
        rows = change.rows
        if isinstance(change, Put):
            made = self._write(name, rows)
            tables[name] = {"key": [*change.key] or tables.get(name, {}).get("key", []), "schema": rows.schema.jsonValue(), "files": [made], "changes": []}
        else:
            table = tables[name]
            schema = StructType.fromJson(table["schema"])
            if not isinstance(change, Append) and not table["key"]:
                raise ValueError(f"{name} has no key")
            if isinstance(change, Remove):
                rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in table["key"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
            else:
                rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            if isinstance(change, Append) and not table["changes"]:
                made = self._write(name, rows)
                table["files"].append(made)
            else:  # a key that was removed before may come back
                made = self._write(name, rows.withColumn("_gone", F.lit(isinstance(change, Remove))))
                table["changes"].append(made)
        wrote.setdefault(name, []).append(made)

    def _write(self, name: str, rows: DataFrame) -> str:
        made = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/data/{made}")
        return made

    def transact(self, work: Callable[[Version], dict[str, Change]], writer: str | None = None, epoch: int | None = None, tries: int = 40) -> Version | None:
        """Commits what ``work`` makes of the last version, again from the start where another was faster. Once
        ``writer`` has committed ``epoch`` or a later one, nothing happens and the result is None: so a batch
        that comes again changes nothing. No changes: no commit."""
        for _ in range(tries):
            at = self.current()
            if writer is not None and at.epochs.get(writer, -1) >= epoch:
                return None
            changes = work(at)
            if not changes:
                return None
            try:
                return self.commit(at, changes, writer, epoch)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def restore(self, number: int) -> Version:
        """The tables as they were in an earlier version, as a new one. Epochs stay."""
        while True:
            at, old = self.current(), self.version(number)
            try:
                out = Version(at.number + 1, old.tables, at.epochs)
                self._announce(out)
                return out
            except Conflict:
                continue
