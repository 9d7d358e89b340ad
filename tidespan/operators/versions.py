"""Versioned measurements: Parquet partitioned by commit and by derived columns, and a list of versions.

An append is one commit: a folder ``commit=<n>`` whose rows are partitioned by the table's spec
(day, hour, month, year, identity, bucket or truncate of a column). A version is a list of commits
with the schema, the spec and the named references of its time, in one small JSON file that appears
whole, by a rename that fails if another writer was first. Reads are Spark's own scans of the
version's commits: a predicate also restricts the derived columns, so partitions are pruned, and
files whose bounds exclude it are not opened. Columns have ids: a rename or a wider type is applied
when older commits are read. Commits keep the spec they were written with.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeseries import SAFE_NAME, transform
from .publish import Files

WIDENED = {("int", "bigint"), ("float", "double")}
#: Transforms whose values keep the order of their source.
ORDERED = ("identity", "day", "hour", "month", "year", "truncate")
COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Version:
    """One version: operation, commits with their columns, spec and rows, current schema and spec, named references."""

    number: int
    operation: str
    at: float
    files: list[dict]  # path, n_rows, columns {name: id}, spec
    schema: list[dict]  # id, name, type
    parent: int | None = None
    refs: dict[str, int] = field(default_factory=dict)
    spec: list[dict] = field(default_factory=list)  # source (id), kind, n


def _derived(part: dict) -> str:
    return f"p_{part['source']}_{part['kind']}" + (f"_{part['n']}" if part["n"] else "")


def _value(part: dict, column: Column) -> Column:
    return transform(part["kind"], column, part["n"]).cast("string")


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Files(spark)

    # --- the list of versions --------------------------------------------------------------------

    def _write(self, v: Version) -> None:
        name, new = f"{self.path}/log/v{v.number:08d}.json", f"{self.path}/log/.{uuid.uuid4().hex}"
        self.store.write(new, json.dumps(v.__dict__))
        if not self.store.rename(new, name):
            self.store.delete(new)
            raise Conflict(f"version {v.number} exists")

    def versions(self) -> list[Version]:
        names = [f"{self.path}/log/{n}" for n in self.store.list(f"{self.path}/log")]
        rows = self.spark.read.text(names, wholetext=True).collect() if names else []
        return sorted((Version(**json.loads(r[0])) for r in rows), key=lambda v: v.number)

    def current(self) -> Version:
        return self.find()

    def find(self, version: int | None = None, at: float | None = None, ref: str | None = None) -> Version:
        """A version by number, by the time it was current, or by name; else the newest."""
        every = self.versions()
        if ref is not None:
            version = every[-1].refs.get(ref, -1) if every else -1
        found = [v for v in every if (v.number == version if version is not None else at is None or v.at <= at)]
        if not found:
            raise LookupError(f"no version {ref or version if version is not None else at} in {self.path}")
        return found[-1]

    def _commit(self, base: Version, operation: str, **change) -> Version:
        v = Version(base.number + 1, operation, change.pop("at", None) or time.time(), **{"files": base.files, "schema": base.schema, "refs": base.refs, "parent": base.number, "spec": base.spec} | change)
        self._write(v)
        return v

    # --- data ------------------------------------------------------------------------------------

    def create(self, schema: dict[str, str], spec: list[tuple] = (), at: float | None = None) -> Version:
        """spec: (column, transform) or (column, transform, n) of each derived partition column."""
        columns = [{"id": k, "name": n, "type": t} for k, (n, t) in enumerate(schema.items(), 1)]
        v = Version(0, "create", at or time.time(), [], columns, spec=self._spec(columns, spec))
        self._write(v)
        return v

    @staticmethod
    def _spec(schema: list[dict], spec) -> list[dict]:
        ids = {c["name"]: c["id"] for c in schema}
        return [{"source": ids[s[0]], "kind": s[1], "n": s[2] if len(s) > 2 else None} for s in spec]

    def _store(self, df: DataFrame, schema: list[dict], spec: list[dict]) -> dict:
        """Write one commit's folder, with bounds of each file; nothing is visible before the version is."""
        ids = {c["name"]: c["id"] for c in schema}
        by = {c["id"]: c["name"] for c in schema if c["name"] in df.columns}
        mine = [p for p in spec if p["source"] in by]
        folder = f"{self.path}/data/commit={uuid.uuid4().hex}"
        out = df.select(*[F.col(c["name"]).cast(c["type"]) for c in schema if c["name"] in df.columns], *[_value(p, F.col(by[p["source"]])).alias(_derived(p)) for p in mine])
        if mine:  # a partition's rows in as many files as they need
            out = out.hint("rebalance", *[F.col(_derived(p)) for p in mine])
        out.write.partitionBy(*[_derived(p) for p in mine]).parquet(folder)
        stored = self.spark.read.schema(out.schema).parquet(folder)
        bounds = [f(c).alias(f"{n}_{ids[c]}") for c in df.columns for n, f in (("low", F.min), ("high", F.max))]
        # the file's path below the table's folder, as it is
        name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"(data/commit=.*)$", 1)
        stats = stored.groupBy(name.alias("path")).agg(F.count("*").alias("n_rows"), *bounds)
        meta = folder.replace("/data/", "/meta/")
        stats.coalesce(1).write.parquet(meta)
        n = self.spark.read.parquet(meta).agg(F.sum("n_rows")).first()[0] or 0
        return {"path": folder.rpartition("/")[2], "n_rows": n, "columns": {c: ids[c] for c in df.columns}, "spec": mine}

    def append(self, df: DataFrame, at: float | None = None, base: Version | None = None) -> Version:
        base = base or self.current()
        if unknown := [c for c in df.columns if c not in {c["name"] for c in base.schema}]:
            raise ValueError(f"not in the schema: {unknown}")
        return self._commit(base, "append", files=[*base.files, self._store(df, base.schema, base.spec)], at=at)

    def append_points(self, points: DataFrame, base: Version | None = None) -> tuple[Version, int, int]:
        """Append raw points (measurement, tags, fields of JSON values, timestamp) as far as they fit; the version, and how many did and did not."""
        from ..functions.timeseries import field_value, from_micros

        base = base or self.current()
        bad = F.coalesce(F.col("timestamp").isNull() | (F.col("timestamp") <= 0), F.lit(True))
        out = [from_micros(F.col("timestamp")).alias("timestamp")]
        for c in base.schema:
            if c["name"].startswith("tag_"):
                out.append(F.col("tags")[c["name"][4:]].alias(c["name"]))
            elif c["name"] != "timestamp":
                raw = field_value(F.col("fields")[c["name"]])
                out.append(raw.try_cast(c["type"]).alias(c["name"]))
                bad = bad | (raw.isNotNull() & raw.try_cast(c["type"]).isNull())
        n = points.agg(F.count(F.when(~bad, 1)), F.count(F.when(bad, 1))).first()
        return self.append(points.where(~bad).select(*out), base=base), n[0], n[1]

    def _groups(self, v: Version) -> list[tuple[dict, list[dict], list[str]]]:
        """Commits of one layout: (columns, spec, folders)."""
        by: dict[str, tuple] = {}
        for f in v.files:
            by.setdefault(json.dumps([f["columns"], f["spec"]], sort_keys=True), (f["columns"], f["spec"], []))[2].append(f["path"])
        return list(by.values())

    def _bounds(self, v: Version, where: list[tuple]) -> DataFrame:
        """path, n_rows of the files that may hold rows of ``where``, by their bounds."""
        ids = {c["name"]: c for c in v.schema}
        out = None
        for columns, _, folders in self._groups(v):
            files = self.spark.read.parquet(*[f"{self.path}/meta/{f}" for f in folders])
            for name, op, value in where:
                c = ids[name]
                if c["id"] not in columns.values():
                    files = files.where(F.lit(False))  # null in all its rows
                    continue
                low, high = F.col(f"low_{c['id']}"), F.col(f"high_{c['id']}")
                value = F.lit(value).cast(c["type"])
                files = files.where((low <= value) & (high >= value) if op == "=" else COMPARE[op](low if op[0] == "<" else high, value))
            files = files.select("path", "n_rows")
            out = files if out is None else out.unionByName(files)
        return out if out is not None else self.spark.createDataFrame([], "path string, n_rows long")

    def planned(self, where: list[tuple] = (), version: int | None = None, at: float | None = None, ref: str | None = None) -> DataFrame:
        """path, n_rows of the files that a scan with ``where`` opens."""
        return self._bounds(self.find(version, at, ref), list(where))

    def scan(self, version: int | None = None, at: float | None = None, ref: str | None = None, columns: list[str] | None = None, where: list[tuple] = ()) -> DataFrame:
        """The rows of a version, under its own schema: older commits are renamed, widened and null-filled by id.

        where: (column, one of = < <= > >=, value), all of which hold. Files that cannot have such
        rows are not opened.
        """
        v, out = self.find(version, at, ref), None
        names = {c["name"]: c for c in v.schema}
        wanted = {r["path"] for r in self._bounds(v, list(where)).select("path").collect()} if where else None  # a row a file
        for stored, spec, folders in self._groups(v):
            by_id = {i: n for n, i in stored.items()}
            paths = [f"{self.path}/data/{f}" for f in folders]
            if wanted is not None:
                paths = [f"{self.path}/{p}" for p in sorted(wanted) if p.split("/")[1] in folders]
                if not paths:
                    continue
            reader = self.spark.read.option("basePath", f"{self.path}/data").option("recursiveFileLookup", "false")
            kinds = ", ".join([f"`{n}` {self._kind(v, i)}" for n, i in stored.items()] + [f"`{_derived(p)}` string" for p in spec])
            df = reader.schema(kinds + (", " if kinds else "") + "commit string").parquet(*paths) if self._same_types(v, stored) else reader.parquet(*paths)
            for name, op, value in where:
                for p in spec:
                    if p["source"] == names[name]["id"] and (op == "=" or p["kind"] in ORDERED[1:]):
                        # derived values are texts in the order of their source
                        loose = {"<": "<=", ">": ">="}.get(op, op)
                        df = df.where(COMPARE[loose](F.col(_derived(p)).cast("string"), _value(p, F.lit(value).cast(names[name]["type"]))))
            df = df.select(*[(F.col(by_id[c["id"]]) if c["id"] in by_id else F.lit(None)).cast(c["type"]).alias(c["name"]) for c in v.schema])
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.createDataFrame([], ", ".join(f"`{c['name']}` {c['type']}" for c in v.schema))
        for name, op, value in where:
            out = out.where(COMPARE[op](F.col(name), F.lit(value).cast(names[name]["type"])))
        return out.select(*columns) if columns else out

    def _kind(self, v: Version, column: int) -> str:
        return next((c["type"] for c in v.schema if c["id"] == column), "string")

    def _same_types(self, v: Version, stored: dict[str, int]) -> bool:
        """Whether no column of these commits was widened or dropped since."""
        types: dict[int, set] = {}
        for past in self.versions():
            for c in past.schema:
                types.setdefault(c["id"], set()).add(c["type"])
        now = {c["id"] for c in v.schema}
        return all(i in now and len(types[i]) == 1 for i in stored.values())

    def register(self, name: str) -> None:
        self.scan().createOrReplaceTempView(name)

    def rollback(self, version: int) -> Version:
        """A new version with the commits and schema of an older one; history stays."""
        old = self.find(version)
        return self._commit(self.current(), "replace", files=old.files, schema=old.schema, spec=old.spec)

    def compact(self) -> Version:
        """All commits into one, under the current schema and spec; the row count must agree."""
        base = self.current()
        new = self._store(self.scan(base.number), base.schema, base.spec)
        if new["n_rows"] != sum(f["n_rows"] for f in base.files):
            raise RuntimeError("rows were lost")
        return self._commit(base, "replace", files=[new])

    def expire(self, before: float, keep: int = 1, delete_data: bool = False) -> list[int]:
        """Drop versions older than ``before`` but the newest ``keep``, the current and named ones; with ``delete_data`` also commits that no other version has."""
        every = self.versions()
        held = {every[-1].number, *every[-1].refs.values(), *(v.number for v in every[-keep:])}
        gone = [v for v in every if v.at < before and v.number not in held]
        left = {f["path"] for v in every if v not in gone for f in v.files}
        for v in gone:
            self.store.delete(f"{self.path}/log/v{v.number:08d}.json")
        for folder in {f["path"] for v in gone for f in v.files} - left if delete_data else ():
            self.store.delete(f"{self.path}/data/{folder}")
            self.store.delete(f"{self.path}/meta/{folder}")
        return [v.number for v in gone]

    def tag(self, name: str, version: int | None = None) -> Version:
        base = self.current()
        return self._commit(base, "tag", refs=base.refs | {name: base.number if version is None else version})

    # --- schema and spec -------------------------------------------------------------------------

    def evolve(self, add: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, promote: dict[str, str] | None = None) -> Version:
        base = self.current()
        top = max([c["id"] for v in self.versions() for c in v.schema], default=0)
        schema = [dict(c) for c in base.schema if c["name"] not in (drop or [])]
        for c in schema:
            if to := (promote or {}).get(c["name"]):
                if (c["type"], to) not in WIDENED:
                    raise TypeError(f"{c['name']}: {c['type']} can't become {to}")
                c["type"] = to
            c["name"] = (rename or {}).get(c["name"], c["name"])
        schema += [{"id": top + k, "name": n, "type": t} for k, (n, t) in enumerate((add or {}).items(), 1)]
        if len({c["name"] for c in schema}) < len(schema):
            raise ValueError("two columns of one name")
        return self._commit(base, "schema", schema=schema)

    def respec(self, spec: list[tuple]) -> Version:
        """Another partition spec for commits from now on."""
        base = self.current()
        return self._commit(base, "spec", spec=self._spec(base.schema, spec))

    # --- metadata --------------------------------------------------------------------------------

    def files(self, version: int | None = None) -> DataFrame:
        """One row for each commit of a version: path, n_rows."""
        v = self.find(version)
        return self.spark.createDataFrame([(f["path"], f["n_rows"]) for f in v.files], "path string, n_rows long")

    def history(self) -> DataFrame:
        rows = [(v.number, v.operation, v.parent, len(v.files), sum(f["n_rows"] for f in v.files)) for v in self.versions()]
        return self.spark.createDataFrame(rows, "version int, operation string, parent int, n_files int, n_rows long")

    def detail(self) -> DataFrame:
        """One row for each column: column_name, type, and its derived partition column's transform, if any."""
        v = self.current()
        kinds = {p["source"]: p["kind"] + (f"({p['n']})" if p["n"] else "") for p in v.spec}
        return self.spark.createDataFrame([(c["id"], c["name"], c["type"], kinds.get(c["id"])) for c in v.schema], "id int, column_name string, type string, partitioned_by string")


class Catalog:
    """Versioned tables below one folder, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Files(spark)

    def _path(self, name: str) -> str:
        if not re.fullmatch(SAFE_NAME.replace(r"\p{L}\p{N}_", r"\w").strip("^$"), name) or name.startswith("."):
            raise ValueError(f"not a table name: {name!r}")
        return f"{self.path}/{name}"

    def create(self, name: str, schema: dict[str, str], spec: list[tuple] = ()) -> VersionedTable:
        t = VersionedTable(self.spark, self._path(name))
        t.create(schema, spec)  # a Conflict if it exists
        return t

    def load(self, name: str) -> VersionedTable:
        if not self.store.exists(f"{self._path(name)}/log"):
            raise LookupError(f"no table {name}")
        return VersionedTable(self.spark, self._path(name))

    def tables(self) -> list[str]:
        return [n for n in self.store.list(self.path) if self.store.exists(f"{self.path}/{n}/log")]

    def drop(self, name: str) -> None:
        self.load(name)
        self.store.delete(self._path(name))

    def rename(self, name: str, to: str) -> VersionedTable:
        self.load(name)
        if not self.store.rename(self._path(name), self._path(to)):
            raise Conflict(f"{to} exists")
        return self.load(to)

    def register(self, prefix: str = "versioned_") -> list[str]:
        """Each table's current rows as a view; returns the views' names."""
        for n in self.tables():
            self.load(n).register(prefix + n)
        return [prefix + n for n in self.tables()]


def at_time(value: float) -> dt.datetime:
    """The UTC time of a version's ``at``."""
    return dt.datetime.fromtimestamp(value, dt.timezone.utc).replace(tzinfo=None)
