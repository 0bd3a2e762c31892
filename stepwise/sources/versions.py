"""Versioned tables: what logs, builds and streams publish through (SNK1, SNK4, SNK6).

A store is a folder.  Data folders below ``data/`` are written once and never
changed; a version is one small JSON file below ``_log/`` that names the data
folders of every table, by partition.  A commit writes its data first and its
version last, by a rename that fails if the version exists, so

* readers see whole versions, of all tables of the store together;
* a job that fails in between loses nothing and leaves the last version as it is;
* two writers cannot both publish the same version: the second one gets an error;
* only the partitions a change touches are written again.

A version also holds a ledger: the last batch of each streaming job.  A batch
that is run again after its commit is recognised and adds nothing.  The last
``keep`` versions stay readable; data that none of them names is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.session import path_exists


def upsert_slice(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace rows whose key occurs in ``new`` (e.g. ``(step, fixture)``)
    and append ``new``; replaying a slice leaves the table unchanged.  An
    empty new slice returns ``existing`` as is."""
    drop = new.select(*keys).distinct()
    return existing.join(drop, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class Change:
    """What a commit does to one table.

    ``replace``: the whole table.  ``append``: add rows.  ``upsert``: rows of the same
    ``keys`` give way.  ``partitions``: the partitions that occur in ``df``, and those in
    ``drop``, give way.  With ``partition`` only the partitions touched are written; keys of an upsert must then hold it."""

    df: DataFrame
    mode: str = "replace"
    keys: Sequence[str] = ()
    partition: str | None = None
    drop: Sequence[str] = ()
    #: fingerprints of the inputs, by partition, see :func:`refresh`
    prints: Mapping[str, str] | None = None


class CommitConflict(RuntimeError):
    """Another writer has published the version first."""


def part_name(c: Column) -> Column:
    """Folder name of a partition value; any value, null included, has one."""
    return F.coalesce(F.hex(c.cast("string")), F.lit("null"))


class Store:
    """Versioned tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, merge_at: int = 16):
        self.spark, self.path, self.keep, self.merge_at = spark, path.rstrip("/"), max(1, keep), merge_at

    # -- files of the log
    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        p, fs = self._hadoop(f"{self.path}/_log")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def state(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "done": {}}
        p, fs = self._hadoop(f"{self.path}/_log/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        tmp, fs = self._hadoop(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{state['version']:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(tmp), fs.makeQualified(target), no_options)   # fails if the target is there
        except Exception as e:
            fs.delete(tmp, False)
            if path_exists(self.spark, f"{self.path}/_log/{state['version']:012d}.json"):
                raise CommitConflict(f"version {state['version']} of {self.path} was published by another writer") from e
            raise

    # -- reading
    def _read(self, table: dict, parts: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.path}/{f}/_part={p}" if p != "" else f"{self.path}/{f}" for p, fs in table["parts"].items() if parts is None or p in parts for f in fs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str = "data", version: int | None = None) -> DataFrame | None:
        """A table as of a version (the last one), None where there is none."""
        table = self.state(version)["tables"].get(name)
        return None if table is None else self._read(table)

    def done(self, job: str) -> int:
        """Number of the job's last committed batch, -1 before the first."""
        return self.state()["done"].get(job, -1)

    # -- writing
    def commit(self, changes: Mapping[str, Change], job: str | None = None, batch: int | None = None) -> bool:
        """Publish the changes as one version; False if the ledger has this batch already."""
        state = self.state()
        if job is not None and batch <= state["done"].get(job, -1):
            return False
        new = {"version": state["version"] + 1, "tables": dict(state["tables"]), "done": dict(state["done"])}
        for name, change in changes.items():
            new["tables"][name] = self._apply(name, state["tables"].get(name), change)
        if job is not None:
            new["done"][job] = batch
        self._publish(new)
        self._clean()
        return True

    def _apply(self, name: str, table: dict | None, change: Change) -> dict:
        df, by = change.df, change.partition
        if table is not None and change.mode != "replace" and table["partition"] != by:
            raise ValueError(f"table {name} is partitioned by {table['partition']}, not by {by}")
        folder = f"data/{name}-{uuid.uuid4().hex[:12]}"
        kept: dict[str, list[str]] = {}
        if table is not None and change.mode != "replace":
            kept = {p: list(f) for p, f in table["parts"].items()}
            if change.mode == "append":
                # a partition of many folders is written as one, together with what is new
                many = [p for p, f in kept.items() if len(f) >= self.merge_at]
                if many:
                    df = self._read(table, many).unionByName(df, allowMissingColumns=True)
                    kept = {p: f for p, f in kept.items() if p not in many}
            elif change.mode == "upsert":
                if by is not None and by not in change.keys:
                    raise ValueError(f"the keys of an upsert must hold the partition column {by}")
                touched = list(kept) if by is None else [r[0] for r in df.select(part_name(F.col(by))).distinct().collect()]   # partition names of the change
                df = upsert_slice(self._read(table, touched), df, change.keys)
                kept = {p: f for p, f in kept.items() if p not in touched}
            elif change.mode == "partitions":
                touched = [r[0] for r in df.select(part_name(F.col(by))).distinct().collect()]
                kept = {p: f for p, f in kept.items() if p not in {*touched, *change.drop}}
            else:
                raise ValueError(change.mode)
        # rebalanced: a partition's rows meet in few tasks, and a large partition is cut by size
        writer = df if by is None else df.withColumn("_part", part_name(F.col(by))).hint("rebalance", "_part")
        writer = writer.write if by is None else writer.write.partitionBy("_part")
        writer.parquet(f"{self.path}/{folder}")
        schema = df.schema
        if table is not None and change.mode != "replace":
            have = set(schema.names)
            schema = StructType(schema.fields + [f for f in StructType.fromJson(table["schema"]).fields if f.name not in have])
        if by is None:
            written = [""]
        else:
            p, fs = self._hadoop(f"{self.path}/{folder}")
            written = [s.getPath().getName().removeprefix("_part=") for s in fs.listStatus(p) if s.getPath().getName().startswith("_part=")]
        for p in written:
            kept.setdefault(p, []).append(folder)
        prints = dict((table or {}).get("prints") or {}) if change.prints is None else dict(change.prints)
        return {"partition": by, "schema": json.loads(schema.json()), "parts": kept, "prints": prints}

    def _clean(self) -> None:
        """Delete versions before the last ``keep`` and the data only they name."""
        versions = self.versions()
        old, live = versions[:-self.keep], versions[-self.keep:]
        if not old:
            return
        named = {f for v in live for t in self.state(v)["tables"].values() for fs in t["parts"].values() for f in fs}
        gone = {f for v in old for t in self.state(v)["tables"].values() for fs in t["parts"].values() for f in fs} - named
        for f in gone:
            p, fs = self._hadoop(f"{self.path}/{f}")
            fs.delete(p, True)
        for v in old:
            p, fs = self._hadoop(f"{self.path}/_log/{v:012d}.json")
            fs.delete(p, False)


def fingerprints(df: DataFrame, partition: str) -> dict[str, str]:
    """Row count and order-free hash of each partition's rows: one small row per partition."""
    rows = df.groupBy(part_name(F.col(partition)).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"),
        F.sum(F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)")).alias("s")).collect()
    return {r["p"]: f"{r['n']}-{r['x']}-{r['s']}" for r in rows}


def refresh(store: Store, name: str, source: DataFrame, partition: str, build: Callable[[DataFrame], DataFrame]) -> list[str]:
    """SNK4: bring a derived table up to date, rebuilding only the partitions whose input changed.

    ``build`` maps rows of ``source`` to rows of the table that have the same value of
    ``partition`` and depend on no other partition's rows.  A partition is fresh if its
    input has the fingerprint it was built from.  Returns the rebuilt partitions' names."""
    now = fingerprints(source, partition)
    table = store.state()["tables"].get(name)
    before = (table or {}).get("prints") or {}
    changed = sorted(p for p, v in now.items() if before.get(p) != v)
    gone = sorted(set(before) - set(now))
    if not changed and not gone and table is not None:
        return []
    rows = build(source.where(part_name(F.col(partition)).isin(changed)))
    store.commit({name: Change(rows, "partitions" if table is not None else "replace", partition=partition, drop=[*changed, *gone], prints=now)})
    return changed
