"""Managed datasets: named tables below one root, as snapshots of immutable files.

Every write puts its files into a folder of their own and then commits a new version of the dataset, a small file that lists the
folders the version consists of. Nothing is renamed or overwritten, readers keep the version they began with, and a write that
fails, or loses against another one, leaves nothing behind but files that no version names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from weir.contracts.sketches import SKETCH, merged_profile, sketch_profile
from weir.errors import ConfigError, GateBlocked
from weir.operators.keyed import content_order, latest_per_key
from weir.quality.checks import run_checks
from weir.quality.gate import GateDecision, evaluate_gate
from weir.quality.quarantine import quarantine
from weir.session import delete_path, hadoop_fs, path_exists, plain_unions
from weir.sources.snapshots import Part, Snapshot, commit, load, versions

# What a dataset may be called, and rows kept for a preview.
NAME_PATTERN = r"[a-z0-9][a-z0-9_.-]{0,127}"
RETAIN_ROWS = 1000

#: Change parts that a read merges; one more write brings them together.
MERGED_CHANGES = 8

WRITE = (
    "name STRING, source_type STRING, write_mode STRING, rows_written BIGINT, row_count BIGINT, run_id STRING, "
    "quality_status STRING, updated_at TIMESTAMP"
)

# Columns that only merged changes have in their files: the number of the write that the row came from, and of the last for its key.
_NUMBER, _LAST = "__number", "__last"
_EXTRA = [T.StructField(_NUMBER, T.LongType()), T.StructField(_LAST, T.LongType())]


@dataclass(frozen=True)
class Staged:
    """Rows written below a root but not part of any dataset yet, by side (`rows`, and `bad` where they were split)."""

    stage: str
    schema: T.StructType
    counts: dict[str, int]
    partition_by: tuple[str, ...]


@dataclass(frozen=True)
class Datasets:
    """`root` is a folder all executors reach."""

    spark: SparkSession
    root: str

    # ---- places

    def path(self, name: str) -> str:
        if not re.fullmatch(NAME_PATTERN, name) or name.startswith("_"):
            raise ConfigError(f'Invalid dataset name "{name}"')
        return f"{self.root.rstrip('/')}/{name}"

    def _log(self, name: str) -> str:
        return f"{self.path(name)}/_commits"

    @property
    def _parts(self) -> str:
        return f"{self.root.rstrip('/')}/_parts"

    # ---- reading

    def snapshot(self, name: str, version: int | None = None) -> Snapshot:
        found = load(self.spark, self._log(name), version)
        if found is None:
            raise ConfigError(f'Dataset "{name}" does not exist' if version is None else f'Dataset "{name}" has no version {version}')
        return found

    def read(self, name: str, limit: int | None = None, version: int | None = None) -> DataFrame:
        """The rows of the last or the named version. Later writes do not change what was read."""
        df = self._rows(self.snapshot(name, version))
        return df if limit is None else df.limit(limit)

    def _files(self, parts: Sequence[Part], schema: T.StructType) -> DataFrame:
        """The given parts as one scan, with the number of the write that each row came from, and of the last one for a change's key."""
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *_EXTRA]))
        stored = T.StructType([*schema.fields, *_EXTRA, T.StructField("stage", T.StringType()), T.StructField("side", T.StringType())])
        reader = self.spark.read.schema(stored).option("basePath", self._parts)
        df = reader.parquet(*[f"{self._parts}/stage={p.stage}/side={p.side}" for p in parts])
        numbers = F.create_map(*[F.lit(v) for p in parts for v in (f"{p.stage}/{p.side}", p.number)])  # one entry for each write since the last compaction
        number = numbers[F.concat("stage", F.lit("/"), "side")].cast("bigint")
        return df.select(*[F.col(f"`{n}`") for n in schema.names], *[F.coalesce(c, number).alias(c) for c in (_NUMBER, _LAST)])

    def _rows(self, snapshot: Snapshot) -> DataFrame:
        names = [F.col(f"`{n}`") for n in snapshot.struct.names]
        plain, changed = ([p for p in snapshot.parts if p.kind == kind] for kind in ("rows", "changes"))
        rows = self._files(plain, snapshot.struct)
        if not changed:
            return rows.select(*names)
        plain_unions(self.spark)
        changes = self._files(changed, snapshot.struct)
        keys = list(snapshot.keys)
        has_key = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
        touched = changes.where(has_key).groupBy(*keys).agg(F.max(_LAST).alias("__touched"))
        told = rows.join(touched, keys, "left")
        # what was appended after the last change of its key stands beside it
        old = F.col("__touched") >= F.col(_NUMBER)
        winners = latest_per_key(told.where(old).drop("__touched").unionByName(changes.where(has_key)), keys, self._order(snapshot))
        kept = told.where(F.col("__touched").isNull() | ~old)
        return kept.select(*names).unionByName(winners.select(*names)).unionByName(changes.where(~has_key).select(*names))

    @staticmethod
    def _order(snapshot: Snapshot) -> list:
        return [*snapshot.order_by, (_NUMBER, "desc")]

    def preview(self, name: str, retain_rows: int = RETAIN_ROWS) -> DataFrame:
        return self.read(name).limit(retain_rows)

    # ---- writing

    def stage(self, df: DataFrame, partition_by: Sequence[str] = (), bad: Column | None = None) -> Staged:
        """Writes the rows once, without making them part of a dataset; rows for which `bad` holds go to a side of their own."""
        stage, seen = uuid.uuid4().hex, Observation()
        folder = f"{self._parts}/stage={stage}"
        if bad is None:
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            writer = counted.write
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/side=rows")
        else:
            sided = df.withColumn("side", F.when(bad, "bad").otherwise("rows"))
            counted = sided.observe(seen, F.count_if(F.col("side") == "rows").alias("rows"), F.count_if(F.col("side") == "bad").alias("bad"))
            counted.write.partitionBy("side", *partition_by).parquet(folder)
        return Staged(stage, df.schema, dict(seen.get), tuple(partition_by))

    def staged_rows(self, staged: Staged, side: str = "rows") -> DataFrame:
        if not staged.counts.get(side):
            return self.spark.createDataFrame([], staged.schema)
        return self._files([Part(staged.stage, side, "rows", 0, 0)], staged.schema).drop(_NUMBER, _LAST)

    def discard(self, staged: Staged) -> None:
        delete_path(self.spark, f"{self._parts}/stage={staged.stage}")

    def write(
        self,
        name: str,
        df: DataFrame,
        mode: str = "replace",
        keys: Sequence[str] = (),
        run_id: str | None = None,
        source_type: str | None = None,
        quality_status: str | None = None,
        order_by: Sequence = (),
        partition_by: Sequence[str] = (),
        now: datetime | None = None,
        transaction: tuple[str, int] | None = None,
    ) -> int:
        """append, replace or upsert; returns the rows written. All rows are kept.

        An upsert writes the incoming rows only, one for each key; reads merge them, and of all rows with one key the first in
        `order_by` wins (pass the newest first), be it an old or a new one. Without `order_by`, and between equals, the later
        write wins. Rows with a NULL in the key conflict with nothing. Columns that the incoming rows lack are taken from the rows
        that are there. A `transaction` (token, number) whose number the dataset has seen for the token changes nothing, so
        a repeated batch can be written again.
        """
        if mode not in ("append", "replace", "upsert"):
            raise ConfigError("write mode must be append, replace or upsert")
        if mode == "upsert" and not keys:
            raise ConfigError("Upsert requires at least one key column")
        current = load(self.spark, self._log(name))
        if current is not None and current.has(transaction):
            return 0
        layout = list(partition_by) if current is None or mode == "replace" else list(current.partition_by)
        if mode == "upsert":
            if not set(layout) <= set(keys):
                raise ConfigError("a partitioned dataset can only be upserted by keys that include its partition columns")
            df = self._incoming(df, current, keys, order_by)
        staged = self.stage(df, layout)
        return self.commit(name, staged, mode, keys, run_id, source_type, quality_status, order_by, now, transaction)

    def _incoming(self, df: DataFrame, current: Snapshot | None, keys: Sequence[str], order_by: Sequence) -> DataFrame:
        """One row for each key, with the columns of the dataset."""
        missing = sorted(set(keys) - set(df.columns))
        if missing:
            raise ConfigError(f"Upsert column(s) missing on one side: {', '.join(missing)}")
        has_key = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
        # equals are told apart by their content, so that the same rows give the same winner in any order of files
        rows = latest_per_key(df.where(has_key), keys, [*order_by, content_order(df)])
        loose = df.where(~has_key)
        if current is not None:
            if current.keys and tuple(keys) != current.keys and any(p.kind == "changes" for p in current.parts):
                raise ConfigError(f"the dataset is merged by {', '.join(current.keys)}; compact it before other keys are used")
            lacking = [c for c in current.struct.names if c not in df.columns]
            if lacking:
                rows = rows.join(latest_per_key(self._rows(current).select(*keys, *lacking), keys, list(keys)), list(keys), "left")
        return rows.unionByName(loose, allowMissingColumns=True)

    def commit(
        self,
        name: str,
        staged: Staged,
        mode: str = "replace",
        keys: Sequence[str] = (),
        run_id: str | None = None,
        source_type: str | None = None,
        quality_status: str | None = None,
        order_by: Sequence = (),
        now: datetime | None = None,
        transaction: tuple[str, int] | None = None,
        side: str = "rows",
    ) -> int:
        """Makes staged rows part of a dataset; returns their number. If another writer was faster, what it wrote is kept."""
        order = tuple((k,) if isinstance(k, str) else tuple(k) for k in order_by)
        written = staged.counts.get(side, 0)
        moment = (now or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat() if now is None or now.tzinfo else now.isoformat()
        done = []

        def change(current: Snapshot | None) -> Snapshot | None:
            done.clear()
            if current is not None and current.has(transaction):
                return None
            if current is not None and mode != "replace" and current.partition_by != staged.partition_by:
                raise ConfigError(f'Dataset "{name}" is partitioned by {list(current.partition_by)}, the rows by {list(staged.partition_by)}')
            number = max([p.number for p in current.parts], default=0) + 1 if current else 1
            kind = "changes" if mode == "upsert" and current is not None else "rows"
            part = Part(staged.stage, side, kind, number, written)
            kept = current.parts if current is not None and mode != "replace" else ()
            schema = staged.schema if current is None or mode == "replace" else _joined_schema(current.struct, staged.schema)
            made = Snapshot(
                0, schema.jsonValue(), (*kept, part) if written else kept, staged.partition_by if current is None or mode == "replace" else current.partition_by,
                tuple(keys) or (current.keys if current else ()), order or (current.order_by if current else ()), dict(current.applied) if current else {},
            )
            if transaction is not None:
                made.applied[transaction[0]] = transaction[1]
            before = current.write["row_count"] if current and mode == "append" else 0
            total = self._rows(made).count() if kind == "changes" else before + written
            done.append(total)
            return replace(made, write={
                "name": name, "source_type": source_type, "write_mode": mode, "rows_written": written, "row_count": total, "run_id": run_id,
                "quality_status": quality_status, "updated_at": moment,
            })

        made = commit(self.spark, self._log(name), change)
        if not done:
            return 0
        if sum(p.kind == "changes" for p in made.parts) > MERGED_CHANGES:
            self._merge_changes(name, made)
        return written

    # ---- profiles

    def profile(self, name: str, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
        """The profile of a dataset from sketches kept for each part; only parts without one are read (see `merged_profile`).

        Changes that are merged on reading have no sketches of their own, so such a dataset is read whole; compact it before.
        """
        snapshot = self.snapshot(name)
        if any(p.kind == "changes" for p in snapshot.parts) or not snapshot.parts:
            return merged_profile(sketch_profile(self._rows(snapshot)).withColumn("part", F.lit("all")), quantiles)
        folders = {p: f"{self.root.rstrip('/')}/_profiles/stage={p.stage}/side={p.side}" for p in snapshot.parts}
        for part, folder in folders.items():
            if not path_exists(self.spark, f"{folder}/_SUCCESS"):
                rows = self._files([part], snapshot.struct).drop(_NUMBER, _LAST)
                sketch_profile(rows).coalesce(1).write.mode("overwrite").parquet(folder)
        kept = self.spark.read.schema(SKETCH).parquet(*folders.values()).withColumn("part", F.col("_metadata.file_path"))
        return merged_profile(kept.where(F.col("name").isin(snapshot.struct.names)), quantiles)

    # ---- keeping house

    def _merge_changes(self, name: str, seen: Snapshot) -> None:
        """Brings the change parts together, the first row of each key, with the numbers of their writes; rows are not read."""
        merged = [p for p in seen.parts if p.kind == "changes"]
        changes = self._files(merged, seen.struct)
        has_key = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in seen.keys])
        keyed, keys = changes.where(has_key), list(seen.keys)
        last = keyed.groupBy(*keys).agg(F.max(_LAST).alias(_LAST))
        newest = latest_per_key(keyed, keys, self._order(seen)).drop(_LAST).join(last, keys).unionByName(changes.where(~has_key))
        self._exchange(name, seen, merged, self.stage(newest, seen.partition_by), "changes")

    def compact(self, name: str) -> Snapshot:
        """Rewrites the dataset without changes to be merged; fails nobody, and gives way if the parts have been replaced meanwhile."""
        seen = self.snapshot(name)
        if len(seen.parts) < 2 and not any(p.kind == "changes" for p in seen.parts):
            return seen
        return self._exchange(name, seen, list(seen.parts), self.stage(self._rows(seen), seen.partition_by), "rows")

    def _exchange(self, name: str, seen: Snapshot, old: list[Part], staged: Staged, kind: str) -> Snapshot:
        part = Part(staged.stage, "rows", kind, max(p.number for p in old), staged.counts["rows"])

        def change(current: Snapshot | None) -> Snapshot | None:
            if current is None or not set(old) <= set(current.parts):
                return None  # replaced meanwhile: there is nothing to exchange any more
            rest = [p for p in current.parts if p not in old]
            return replace(current, parts=tuple(sorted([*rest, part], key=lambda p: p.number)))

        made = commit(self.spark, self._log(name), change)
        if part not in made.parts:
            self.discard(staged)
        return made

    def history(self, name: str) -> DataFrame:
        """One row for each version: the write that made it (version 1 is the oldest), its parts, and the rows of its change parts."""
        rows = []
        for version in versions(self.spark, self._log(name)):
            s = load(self.spark, self._log(name), version)
            w = s.write
            rows.append((version, w["write_mode"], w["rows_written"], w["row_count"], w["run_id"], len(s.parts), sum(p.rows for p in s.parts if p.kind == "changes")))
        return self.spark.createDataFrame(rows, "version BIGINT, write_mode STRING, rows_written BIGINT, row_count BIGINT, run_id STRING, parts BIGINT, change_rows BIGINT")

    def vacuum(self, name: str, keep: int = 10) -> int:
        """Forgets all but the last `keep` versions and deletes the files that no dataset's version names any more; returns their number.

        Readers of forgotten versions must be done, and no writer may hold staged rows of them.
        """
        log = self._log(name)
        known = versions(self.spark, log)
        old = [load(self.spark, log, v) for v in known[: -max(keep, 1)]]
        for snapshot in old:
            delete_path(self.spark, f"{log}/{snapshot.version:020d}.json")
        used = {p.stage for other in self.names() for v in versions(self.spark, self._log(other)) for p in load(self.spark, self._log(other), v).parts}
        gone = {p.stage for s in old for p in s.parts} - used
        for stage in gone:
            delete_path(self.spark, f"{self._parts}/stage={stage}")
            delete_path(self.spark, f"{self.root.rstrip('/')}/_profiles/stage={stage}")
        return len(gone)

    def names(self) -> list[str]:
        fs, target = hadoop_fs(self.spark, self.root)
        found = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(n for n in found if re.fullmatch(NAME_PATTERN, n) and path_exists(self.spark, f"{self.root.rstrip('/')}/{n}/_commits"))

    def catalog(self) -> DataFrame:
        """The current state of each dataset: the write of its last version."""
        last = [load(self.spark, self._log(n)).write for n in self.names()]
        read = self.spark.createDataFrame([tuple(w[c.split()[0]] for c in WRITE.split(", ")) for w in last], WRITE.replace("TIMESTAMP", "STRING"))
        return read.withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def _joined_schema(known: T.StructType, new: T.StructType) -> T.StructType:
    """The known columns and those that only the new rows have; a type that changed is an error."""
    types = {f.name: f.dataType.simpleString() for f in known.fields}
    other = [f.name for f in new.fields if types.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    if other:
        raise ConfigError(f"column(s) of another type than in the dataset: {', '.join(other)}")
    return T.StructType([*known.fields, *[f for f in new.fields if f.name not in types]])


@dataclass(frozen=True)
class Published:
    rows_written: int
    decision: GateDecision
    results: DataFrame
    quarantined: int = 0


def publish_checked(
    datasets: Datasets,
    name: str,
    df: DataFrame,
    checks: Iterable[Mapping[str, Any]],
    rule: str = "any_failure",
    min_score: float = 1.0,
    mode: str = "replace",
    quarantine_name: str | None = None,
    run_id: str | None = None,
    now: datetime | None = None,
) -> Published:
    """Write, check, publish: what is checked is what is published, and it is computed and written once.

    The data are staged as files, the checks read only their columns of them, and the gate decides whether the files become
    part of the dataset. With `quarantine_name` rows failing row-level checks are staged apart, the gate sees the rest, and both
    are published or neither. Publishing again under the same `run_id` changes nothing, wherever the first attempt ended.
    """
    spark = datasets.spark
    specs = list(checks)
    token = None if run_id is None else (f"publish-{name}-{run_id}", 1)
    if quarantine_name is None:
        staged = datasets.stage(df)
    else:
        marked = quarantine(df, specs)
        staged = datasets.stage(marked, bad=F.size("failed_checks") > 0)
    kept = staged if quarantine_name is None else replace(staged, schema=df.schema)
    try:
        good = datasets.staged_rows(kept)
        # A handful of rows, kept so that the decision and the caller see the same results.
        rows = run_checks(good, specs, now).collect()
        results = spark.createDataFrame(rows, run_checks(good.limit(0), []).schema)
        decision = evaluate_gate(results, rule, min_score)
        if decision.blocked:
            raise GateBlocked(decision.reason, decision.failed_checks)
    except BaseException:
        datasets.discard(staged)
        raise
    status = "PASSED" if all(r.status == "PASSED" for r in rows) else "FAILED"
    moved = 0
    if quarantine_name is not None:
        moved = datasets.commit(quarantine_name, staged, "append", run_id=run_id, now=now, transaction=token, side="bad")
    written = datasets.commit(name, kept, mode, run_id=run_id, quality_status=status, now=now, transaction=token)
    return Published(written, decision, results, moved)
