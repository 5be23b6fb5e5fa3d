"""A stored table that is changed in place: copy on write by key bucket, versions by manifest.

Rows lie in folders by ``bucket``, a hash of their key.  A change reads and writes only
the buckets that it touches, into a new folder under ``data``; then a manifest is put
beside the older ones that names, for each bucket, the folder that holds it now.  The
manifest is written under another name and renamed, which fails if somebody else has
made that version meanwhile, so a reader sees a whole version or the one before, a
change that dies half-way leaves nothing but an unnamed folder, and of two changes of
one version the second is refused (``Conflict``) and can be tried again.

Keys are unique and present; a batch that repeats a key is an error unless it has an
order, or each of its rows is wanted: then they all stay, under the one key.  Deleting keys that aren't there changes nothing and makes no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store as S

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another change has made the version that this one was about to make."""


class _Files:
    """The few file operations of a table, wherever its folder is."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self._path(folder).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(f.getPath().getName() for f in self.system.listStatus(where)) if self.system.exists(where) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Writes a whole file under a name that nobody has; False if somebody has it."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.system.create(draft, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.makeQualified(self.system.getUri(), self.system.getWorkingDirectory()).toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._path(name), options)
        except Exception as failed:
            self.system.delete(draft, False)
            if "FileAlreadyExists" in str(failed):
                return False
            raise
        return True

    def remove(self, folder: str) -> None:
        self.system.delete(self._path(folder), True)


@dataclass(frozen=True)
class Manifest:
    """version: its number; folders: of each bucket that has rows the folder under the table's; change: what made it."""

    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[int, str]
    change: dict

    @classmethod
    def parse(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(x["version"], x["key"], x["buckets"], x["schema"], {int(b): f for b, f in x["folders"].items()}, x["change"])

    def text(self) -> str:
        return json.dumps(self.__dict__)


class VersionedTable:
    """open() or create() one; every change returns the number of the version that it made, or of the last one if it changed nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = _Files(spark, folder)

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: str, buckets: int = 64) -> VersionedTable:
        """A table of rows in a new folder; buckets: so many that one of them is a task's work."""
        table = cls(rows.sparkSession, folder)
        if table.versions():
            raise Conflict(f"{folder} is a table already")
        empty = Manifest(-1, key, buckets, rows.schema.json(), {}, {})
        once = rows.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(F.col(key)))
        table._commit(empty, set(range(buckets)), S._once(once, key, None), "create")
        return table

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VersionedTable:
        table = cls(spark, folder)
        if not table.versions():
            raise FileNotFoundError(folder)
        return table

    # --- versions ---

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names(f"{self.folder}/manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        version = max(self.versions()) if version is None else version
        return Manifest.parse(self.files.text(f"{self.folder}/manifests/v{version:012d}.json"))

    def history(self) -> DataFrame:
        """(version, change, n_buckets): what made each version, and how many buckets it wrote anew or emptied."""
        rows = [(v, m.change["kind"], m.change["touched"]) for v, m in ((v, self.manifest(v)) for v in self.versions())]
        return self.spark.createDataFrame(rows, "version long, change string, n_buckets long")

    def _rows(self, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.folder}/{f}" for b, f in sorted(m.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._rows(self.manifest(version))

    def point(self, value: object, version: int | None = None) -> DataFrame:
        """The row of a key (or its rows, if it has several); only its bucket is read."""
        m = self.manifest(version)
        kind = T.StructType.fromJson(json.loads(m.schema))[m.key].dataType
        own = self.spark.range(1).select(self._bucket(m, F.lit(value).cast(kind))).first()[0]
        return self._rows(m, {own}).filter(F.col(m.key) == value)

    # --- changes ---

    @staticmethod
    def _bucket(m: Manifest, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(m.buckets)).cast("int")

    def _touched(self, m: Manifest, keys: DataFrame) -> set[int]:
        """The buckets of keys: at most as many numbers as the table has buckets."""
        kind = T.StructType.fromJson(json.loads(m.schema))[m.key].dataType
        return {r[0] for r in keys.select(self._bucket(m, F.col(m.key).cast(kind)).alias("b")).distinct().collect()}

    def _commit(self, m: Manifest, touched: set[int], rows: DataFrame, kind: str) -> int:
        """Writes the touched buckets' rows and names them in the next manifest."""
        name = f"data/{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(m.schema))
        typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        # a bucket is one task's and one file, whatever their number
        typed.withColumn(BUCKET, self._bucket(m, F.col(m.key))).repartition(min(len(touched), m.buckets) or 1, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{name}")
        made = {int(f.partition("=")[2]): f"{name}/{f}" for f in self.files.names(f"{self.folder}/{name}") if f.startswith(f"{BUCKET}=")}
        if not set(made) <= touched:
            raise AssertionError(f"rows of buckets {sorted(set(made) - touched)} that the change doesn't touch")
        folders = {b: f for b, f in m.folders.items() if b not in touched} | made
        after = replace(m, version=m.version + 1, folders=folders, change={"kind": kind, "touched": len(touched) if m.version >= 0 else len(made)})
        if not self.files.put_once(f"{self.folder}/manifests/v{after.version:012d}.json", after.text()):
            self.files.remove(f"{self.folder}/{name}")
            raise Conflict(f"version {after.version} of {self.folder} was made meanwhile")
        return after.version

    def _change(self, keys: DataFrame, kind: str, make: Callable[[DataFrame], DataFrame]) -> int:
        m = self.manifest()
        touched = self._touched(m, keys)
        return self._commit(m, touched, make(self._rows(m, touched)), kind) if touched else m.version

    def upsert(self, batch: DataFrame, updated: Sequence[str], order: str | None = None, each: bool = False) -> int:
        """New keys are added, of known ones the ``updated`` columns change, to nulls too; order and each as in store.upsert()."""
        key = self.manifest().key
        return self._change(batch.select(key), "upsert", lambda old: S.upsert(old, batch, key, updated, order, each))

    def insert_ignore(self, batch: DataFrame, order: Sequence[str] | None = None) -> int:
        """Rows whose key isn't there, of a repeated key the first by order."""
        m = self.manifest()
        # only what is new: known keys of other buckets must not come along
        fresh = batch.join(self._rows(m, self._touched(m, batch)).select(m.key), m.key, "left_anti")
        return self._change(fresh, "insert_ignore", lambda old: S.insert_ignore(old, fresh, m.key, order))

    def delete(self, gone: DataFrame, of: str | None = None) -> int:
        """Without the rows whose key is in gone's column ``of`` (by default the key's name)."""
        m = self.manifest()
        keys = gone.select(F.col(of or m.key).alias(m.key)).distinct()
        there = self._rows(m, self._touched(m, keys)).select(m.key).join(keys, m.key, "left_semi")
        return self._change(there, "delete", lambda old: S.delete(old, keys, m.key))

    def delete_where(self, condition: Column) -> int:
        key = self.manifest().key
        return self._change(self.read().filter(condition).select(key), "delete", lambda old: old.filter(~F.coalesce(condition, F.lit(False))))

    def update(self, condition: Column, **values: object) -> int:
        """Columns set where the condition holds; only buckets with such rows are written.  The key stays as it is."""
        key = self.manifest().key
        if key in values:
            raise ValueError(f"{key} is the key")
        return self._change(self.read().filter(condition).select(key), "update", lambda old: S.update(old, condition, **values))

    def soft_delete(self, condition: Column, flag: str = "is_active") -> int:
        return self.update(condition, **{flag: False})

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last ``keep`` versions and every folder that none of those names; not while a change is under way.  Says how many folders went."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.files.remove(f"{self.folder}/manifests/v{v:012d}.json")
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {f for m in kept for f in m.folders.values()}
        gone = 0
        for name in self.files.names(f"{self.folder}/data"):
            for part in self.files.names(f"{self.folder}/data/{name}"):
                if part.startswith(f"{BUCKET}=") and f"data/{name}/{part}" not in named:
                    self.files.remove(f"{self.folder}/data/{name}/{part}")
                    gone += 1
            if not any(f.startswith(f"data/{name}/") for f in named):
                self.files.remove(f"{self.folder}/data/{name}")
        return gone


def retried(change: Callable[[], int], tries: int = 5) -> int:
    """A change that is tried again when another one was quicker."""
    for left in range(tries - 1, -1, -1):
        try:
            return change()
        except Conflict:
            if not left:
                raise
    raise AssertionError


def cascade_delete(parents: VersionedTable, children: VersionedTable, gone: DataFrame, child_key: str) -> tuple[int, int]:
    """Deletes parents (keys in gone) and the children that name them: children first, so a run that ends between the two leaves no child without a parent."""
    key = parents.manifest().key
    keys = gone.select(F.col(key).alias(child_key)).distinct()
    own = children.manifest().key
    of_gone = children.read().join(keys, child_key, "left_semi").select(own)
    return children.delete(of_gone), parents.delete(gone)
