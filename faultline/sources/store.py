"""The ledger's storage: immutable Parquet folders under versioned manifests.

A version is one JSON manifest that names the folders of every table.  A commit
writes new folders, then creates the next manifest without overwriting, through
the file system of the path: whoever comes second fails and starts over.  So
several tables change at once, readers see whole versions only, and what a
crashed run has left is never referred to.

``generation`` counts changes of the evidence.  Reviewers' edits make a new
version but no new generation, and can be put on top of each other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class Stale(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Migration:
    """Columns that tables get, what old rows have in them, and what must hold afterwards."""

    name: str
    columns: Mapping[str, Mapping[str, str]]
    backfill: Mapping[tuple[str, str], Column] = field(default_factory=dict)
    verify: Callable[[dict[str, DataFrame]], None] = lambda tables: None


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def create(self, tables: Mapping[str, str]) -> dict:
        """An empty ledger; tables map names to schemas."""
        first = {
            "version": 0, "generation": 0, "schema_version": SCHEMA_VERSION, "installation_id": uuid.uuid4().hex,
            "raw_pruned_before": None, "migrations": [], "schemas": dict(tables), "tables": {t: [] for t in tables},
        }
        self._put(first)
        return first

    def latest(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return max(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        stream = self._fs.open(self._at(f"manifests/v-{self.latest() if version is None else version:08d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found["schema_version"] > SCHEMA_VERSION:
            raise RuntimeError("the ledger was written by a later version")
        return found

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """A table as of one manifest."""
        m = manifest or self.manifest()
        reader, schema = self.spark.read, m["schemas"][table]
        if not m["tables"][table]:
            return self.spark.createDataFrame([], schema)
        return reader.schema(schema).parquet(*[f"{self.path}/{p}" for p in m["tables"][table]])

    def _put(self, manifest: dict) -> None:
        out = self._at(f"manifests/v-{manifest['version']:08d}.json")
        hidden = self._at(f"manifests/_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # the whole manifest appears at once, and only if no one else has made this version
        if self._fs.exists(out) or not self._renamed(hidden, out):
            self._fs.delete(hidden, False)
            raise Stale(f"version {manifest['version']} exists")

    def _renamed(self, source, target) -> bool:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)  # refuses to overwrite
        except Exception as error:
            if "already exist" in str(error).lower():
                return False
            raise
        return True

    def commit(self, base: dict, replace: Mapping[str, DataFrame] = {}, append: Mapping[str, DataFrame] = {}, new_generation: bool = False, **settings) -> dict:  # noqa: B006
        """The next version after ``base``; raises Stale if there is one already."""
        tables = dict(base["tables"])
        for kind, frames in (("replace", replace), ("append", append)):
            for table, frame in frames.items():
                folder = f"data/{table}/{uuid.uuid4().hex}"
                frame.write.parquet(f"{self.path}/{folder}")
                tables[table] = [folder] if kind == "replace" else [*tables[table], folder]
        after = base | settings | {"version": base["version"] + 1, "generation": base["generation"] + new_generation, "tables": tables}
        self._put(after)
        return after

    def rebased(self, base: dict, make, **how) -> dict:
        """commit(make(manifest)) on the newest version, over again while only reviewers' edits come between."""
        current = self.manifest()
        while True:
            if current["generation"] != base["generation"]:
                raise Stale("the evidence has changed; replay again")
            try:
                return self.commit(current, **make(current), **how)
            except Stale:
                current = self.manifest()

    def snapshot(self, *tables: str) -> tuple[dict[str, DataFrame], dict]:
        """Several tables as of one version, and its manifest, which is there even if all of them are empty."""
        m = self.manifest()
        return {t: self.read(t, m) for t in tables or m["tables"]}, m

    def views(self, prefix: str = "") -> dict:
        """Temporary views of every table as of the latest version; the manifest that they show."""
        frames, m = self.snapshot()
        for name, frame in frames.items():
            frame.createOrReplaceTempView(f"{prefix}{name}")
        return m

    def refresh(self, tables: Mapping[str, str]) -> dict:
        """Start over: every table is empty, under a new installation id; older versions stay readable."""
        base = self.manifest()
        empty = {"schemas": dict(tables), "installation_id": uuid.uuid4().hex, "raw_pruned_before": None, "migrations": [], "schema_version": SCHEMA_VERSION}
        after = base | empty | {"version": base["version"] + 1, "generation": base["generation"] + 1, "tables": {t: [] for t in tables}}
        self._put(after)
        return after

    def migrate(self, steps: Iterable[Migration]) -> list[str]:
        """Apply the steps that are not recorded yet, in order: add, backfill, verify, record; each is one commit."""
        done = []
        for step in steps:
            base = self.manifest()
            if step.name in base.get("migrations", []):
                continue
            schemas, changed = dict(base["schemas"]), {}
            for table, columns in step.columns.items():
                frame = self.read(table, base)
                for name, kind in columns.items():
                    if name in frame.columns:
                        raise ValueError(f"{table} has a column {name} already")
                    frame = frame.withColumn(name, step.backfill.get((table, name), F.lit(None)).cast(kind))
                    schemas[table] += f", {name} {kind}"
                changed[table] = frame
            step.verify(changed)
            self.commit(base, replace=changed, new_generation=True, schemas=schemas, migrations=[*base.get("migrations", []), step.name])
            done.append(step.name)
        return done

    def verify(self, tables: Mapping[str, str], keys: Mapping[str, list[str]]) -> None:
        """Raise unless every table has its columns, in order and of their types, and its keys name rows."""
        frames, m = self.snapshot()
        for table, schema in tables.items():
            if table not in frames:
                raise RuntimeError(f"{table} is missing")
            want = [(f.name, f.dataType) for f in self.spark.createDataFrame([], schema).schema]
            if [(f.name, f.dataType) for f in frames[table].schema][: len(want)] != want:
                raise RuntimeError(f"{table} has other columns than it should")
        for table, names in keys.items():
            if not frames[table].groupBy(*names).count().where("count > 1").isEmpty():
                raise RuntimeError(f"{table} has a key twice")
