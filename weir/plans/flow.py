"""Pipelines given as JSON: nodes and edges folded into lazy DataFrames.

This is glue on the driver: it looks up each node's operator and hands it the DataFrames of the
nodes before it. Planning, scheduling and retries are Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from weir.contracts.registry import validate
from weir.errors import ConfigError, ValidationError
from weir.functions.scalar import register_sql_functions
from weir.operators.aggregate import aggregate
from weir.operators.filter import filter_rows
from weir.operators.join import join, parse_keys
from weir.plans.pyfunc import map_rows
from weir.quality.checks import run_checks
from weir.quality.gate import GateDecision, ancestors, evaluate_gate
from weir.session import cut_lineage
from weir.sources.dataset import Datasets, Staged
from weir.sources.snapshots import load
from weir.sources.generator import generate
from weir.sources.jdbc import read_jdbc, write_jdbc
from weir.sources.objects import RunInfo, read_object, render, write_object
from weir.sources.pages import landed_records


@dataclass
class FlowResult:
    """What a run left behind: lazy outputs by node, states, metrics, check results and decisions."""

    outputs: dict[str, DataFrame] = field(default_factory=dict)
    states: dict[str, str] = field(default_factory=dict)
    details: dict[str, dict[str, Any]] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)
    decisions: dict[str, GateDecision] = field(default_factory=dict)
    observations: dict[str, Observation] = field(default_factory=dict)
    inputs: dict[str, list[str]] = field(default_factory=dict)
    #: Rows of check nodes as written, and of the nodes that pass them on.
    staged: dict[str, Staged] = field(default_factory=dict)

    def release(self) -> None:
        """Frees what is kept for several consumers, once the outputs are not needed any more."""
        for output in self.outputs.values():
            output.unpersist()

    def rows_out(self, node: str) -> int:
        """Rows a node passed on, as counted on the way while a sink ran; no job of its own."""
        if node in self.observations:
            return self.observations[node].get["rows"]
        return self.rows_in(node)

    def rows_in(self, node: str) -> int:
        """Rows a node was given by all nodes before it."""
        return sum(self.rows_out(source) for source in self.inputs[node])

    def metrics(self, node: str) -> dict[str, int]:
        """rows_in and rows_out of a node that ran, and for a filter rows_removed, for an aggregate groups."""
        found = {"rows_in": self.rows_in(node), "rows_out": self.rows_out(node)}
        kind = self.details[node].get("kind")
        if kind == "filter.transform":
            found["rows_removed"] = found["rows_in"] - found["rows_out"]
        if kind == "aggregate.transform":
            found["groups"] = found["rows_out"]
        return found


@dataclass
class FlowContext:
    spark: SparkSession
    run: RunInfo
    datasets: Datasets | None
    inputs: Mapping[str, DataFrame]
    functions: Mapping[str, tuple[Callable, Any]]
    versions: DataFrame | None
    jdbc: Mapping[str, Mapping[str, str]]
    now: datetime
    result: FlowResult
    edges: list[tuple[str, str]]


def _one(node: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    if not inputs:
        raise ConfigError(f'Node "{node}" has no input data')
    if len(inputs) > 1:
        raise ConfigError(f'Node "{node}" received {len(inputs)} inputs but accepts one; use a join node to combine them')
    return next(iter(inputs.values()))


def _limited(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    return df.limit(int(config["limit"])) if config.get("limit") else df


# ---- sources


def _source(ctx: FlowContext, node: str, kind: str, config: Mapping[str, Any]) -> DataFrame:
    # A caller may bind any source node, or the dataset it names, to a DataFrame.
    for name in (node, config.get("dataset")):
        if name in ctx.inputs:
            bound = ctx.inputs[name]
            # Landed responses of an HTTP source are opened; records are taken as they are.
            return _limited(landed_source(bound, config) if kind == "http.source" and "body" in bound.columns else bound, config)
    if kind == "generator.source":
        return generate(
            ctx.spark, config.get("preset", "sales"), int(config.get("rowCount", 500)), int(config.get("seed", 42)),
            float(config.get("nullRate", 0)),
        )
    if kind == "inline.source":
        return inline_rows(ctx.spark, config.get("rows"))
    if kind in ("postgres.source", "mysql.source"):
        connection = ctx.jdbc.get(config.get("connectionId", ""), {})
        if "url" not in connection:
            raise ConfigError(f'Node "{node}" needs a JDBC connection "{config.get("connectionId")}"')
        settings = {k: v for k, v in connection.items() if k != "url"}
        query = config.get("query") if config.get("mode", "table") == "query" else None
        table = None if query else config.get("table")
        return read_jdbc(ctx.spark, connection["url"], table, query, config.get("limit"), properties=settings)
    if kind == "http.source":
        raise ConfigError(f'Node "{node}": bind the landed responses of an HTTP source as an input')
    path = config.get("path") or config.get("fileId") or config.get("key")
    if not path:
        raise ConfigError(f'Node "{node}" names no file')
    path = render(str(path), ctx.run)
    fmt = "csv" if kind == "csv.source" else config.get("format", "csv" if kind == "s3.source" else "array")
    if fmt == "csv":
        options = {
            "delimiter": config.get("delimiter", ","), "has_header": config.get("hasHeader", True),
            "infer_types": config.get("inferTypes", True),
        }
        if isinstance(config.get("nullValues"), list):
            options["null_values"] = config["nullValues"]
        return read_object(ctx.spark, path, "csv", config.get("limit"), **options)
    if fmt == "ndjson":
        return read_object(ctx.spark, path, "ndjson", config.get("limit"))
    return read_object(ctx.spark, path, "json", config.get("limit"), record_path=config.get("recordPath"))


def inline_rows(spark: SparkSession, rows: Any) -> DataFrame:
    """Rows written in the spec itself, so there are few of them."""
    if not isinstance(rows, list) or not all(isinstance(r, Mapping) for r in rows):
        raise ConfigError("rows must be a list of objects")
    names = list(dict.fromkeys(name for row in rows for name in row))
    if not names:
        raise ConfigError("rows must name at least one column")
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], names)


# ---- transforms


def sql_transform(spark: SparkSession, query: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Runs query text over named inputs. The plan is resolved at once, so the views exist only meanwhile."""
    register_sql_functions(spark)
    saved = {n: spark.table(n) for n in inputs if re.fullmatch(r"\w+", n) and spark.catalog.tableExists(n)}
    try:
        for name, df in inputs.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)
    finally:
        for name in inputs:
            if name in saved:
                saved[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _sql(ctx: FlowContext, node: str, config: Mapping[str, Any], inputs: Mapping[str, DataFrame]) -> DataFrame:
    named = dict(inputs)
    if len(inputs) == 1:
        named["input"] = next(iter(inputs.values()))
    for alias, upstream in (config.get("aliases") or {}).items():
        if upstream not in inputs:
            raise ConfigError(f'Alias "{alias}" points at "{upstream}", which produced no data')
        named[alias] = inputs[upstream]
    usable = {n: df for n, df in named.items() if re.fullmatch(r"[A-Za-z_]\w*", n)}
    return sql_transform(ctx.spark, str(config.get("query", "")), usable)


def _join(ctx: FlowContext, node: str, config: Mapping[str, Any], inputs: Mapping[str, DataFrame]) -> DataFrame:
    sides = []
    for side in ("left", "right"):
        if config.get(side) not in inputs:
            raise ConfigError(f'Join input "{config.get(side)}" produced no data')
        sides.append(inputs[config[side]])
    return join(*sides, parse_keys(config.get("on") or []), config.get("type", "inner"), config.get("rightPrefix", ""))


def _python(ctx: FlowContext, node: str, config: Mapping[str, Any], inputs: Mapping[str, DataFrame]) -> DataFrame:
    name = config.get("function", node)
    if name not in ctx.functions:
        raise ConfigError(f'Node "{node}": pass the Python function "{name}" and its schema to run_flow')
    function, schema = ctx.functions[name]
    return map_rows(next(iter(inputs.values())), function, schema)


# ---- quality


def _check(ctx: FlowContext, node: str, config: Mapping[str, Any], df: DataFrame) -> None:
    # Results are a handful of rows; holding them keeps the checks from running again at the gate.
    lazy = run_checks(df, config.get("checks") or [], ctx.now)
    results = ctx.spark.createDataFrame(lazy.collect(), lazy.schema)
    ctx.result.results[node] = results.withColumn("node_id", F.lit(node)).withColumn("dataset", F.lit(config.get("dataset")))
    if config.get("onFailure") == "fail":
        failing = results.where((F.col("severity") == "error") & (F.col("status") != "PASSED")).select("check_id").collect()
        if failing:
            raise ValidationError(f"Data quality checks failed: {', '.join(r.check_id for r in failing)}")


def _gate(ctx: FlowContext, node: str, config: Mapping[str, Any]) -> GateDecision:
    scope = config.get("scope", "upstream")
    wanted = set(ctx.result.results) if scope == "run" else ancestors(ctx.edges, node) & set(ctx.result.results)
    tables = [ctx.result.results[n] for n in sorted(wanted)]
    if not tables:
        return GateDecision(False, "no results to judge", [], 1.0, 0)
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return evaluate_gate(merged, config.get("severity", "any_failure"), float(config.get("minScore", 1)))


def _branch(ctx: FlowContext, config: Mapping[str, Any], df: DataFrame) -> bool:
    rule, value = config.get("expression", "row_count_gt"), config.get("value")
    if rule in ("row_count_gt", "row_count_eq"):
        bound = int(value or 0)
        # One row more than the bound decides, so nothing beyond it is counted.
        rows = df.limit(max(bound, 0) + 1).count()
        return rows > bound if rule == "row_count_gt" else rows == bound
    if rule == "has_column":
        return config.get("column") in df.columns
    if rule == "param_equals":
        given, wanted = ctx.run.params.get(config.get("param", ""), ""), "" if value is None else value
        return _text(given) == _text(wanted)
    raise ConfigError(f'Unsupported condition expression "{rule}"')


def _text(value: Any) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


# ---- sinks


def _as_written(ctx: FlowContext, node: str, live: list[str], df: DataFrame) -> DataFrame:
    """The rows to be checked as files: those of the check node before, or written here, below the datasets if there are any."""
    if live[0] in ctx.result.staged:
        ctx.result.staged[node] = ctx.result.staged[live[0]]
        return df
    if ctx.datasets is None:
        return cut_lineage(df)
    ctx.result.staged[node] = staged = ctx.datasets.stage(df)
    return ctx.datasets.staged_rows(staged)


def _sink(ctx: FlowContext, node: str, kind: str, config: Mapping[str, Any], df: DataFrame, staged: Staged | None = None) -> dict[str, Any]:
    if kind == "dataset.destination":
        if ctx.datasets is None:
            raise ConfigError(f'Node "{node}" writes a managed dataset; pass datasets to run_flow')
        name = config.get("dataset")
        mode = "append" if config.get("writeMode") == "append" else "replace"
        statuses = [r.status for t in ctx.result.results.values() for r in t.where(F.col("dataset") == name).select("status").collect()]
        quality = None if not statuses else "PASSED" if all(s == "PASSED" for s in statuses) else "FAILED"
        named = {"run_id": ctx.run.id, "quality_status": quality, "now": ctx.now}
        known = load(ctx.spark, f"{ctx.datasets.path(name)}/_commits")
        if staged is not None and (mode == "replace" or known is None or not known.partition_by):
            rows = ctx.datasets.commit(name, staged, mode, **named)  # the checked files themselves
        else:
            rows = ctx.datasets.write(name, df, mode, **named)
        return {"rowsWritten": rows, "target": name, "writeMode": mode}
    if kind == "s3.destination":
        return {"target": write_object(df, str(config.get("path") or config.get("key")), ctx.run, config.get("format", "csv"))}
    connection = ctx.jdbc.get(config.get("connectionId", ""), {})
    if "url" not in connection:
        raise ConfigError(f'Node "{node}" needs a JDBC connection "{config.get("connectionId")}"')
    settings = {k: v for k, v in connection.items() if k != "url"}
    rows = write_jdbc(
        df, connection["url"], config.get("table", ""), config.get("writeMode", "append"), config.get("keyColumns") or (),
        bool(config.get("createTable", False)), int(config.get("batchSize", 1000)), properties=settings,
    )
    return {"rowsWritten": rows, "target": config.get("table")}


def _observed(ctx: FlowContext, node: str, df: DataFrame) -> DataFrame:
    observation = Observation(f"{node}-{len(ctx.result.observations)}")
    ctx.result.observations[node] = observation
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))


def run_flow(
    spark: SparkSession,
    spec: Mapping[str, Any],
    inputs: Mapping[str, DataFrame] | None = None,
    datasets: Datasets | None = None,
    functions: Mapping[str, tuple[Callable, Any]] | None = None,
    versions: DataFrame | None = None,
    jdbc: Mapping[str, Mapping[str, str]] | None = None,
    run: RunInfo | None = None,
    now: datetime | None = None,
) -> FlowResult:
    """Builds every node in dependency order and runs the sinks.

    A blocked gate leaves the nodes after it BLOCKED and the port a condition does not take
    SKIPPED; neither is built, so their data is never computed. Checks look at files, written by the first
    check node on the way; further checks and gates pass these on, and a dataset destination makes them part of its dataset.
    """
    nodes = {n["id"]: n for n in spec.get("nodes", [])}
    edges = [(e["from"], e["to"], e.get("port", "default")) for e in spec.get("edges", [])]
    for source, target, _ in edges:
        if source not in nodes or target not in nodes:
            raise ConfigError(f"edge {source} -> {target} names an unknown node")
    order = TopologicalSorter({n: {s for s, t, _ in edges if t == n} for n in nodes})
    result = FlowResult()
    info = run or RunInfo(pipeline=str(spec.get("name", "")), version=int(spec.get("version", 1)), params=spec.get("params") or {})
    ctx = FlowContext(
        spark, info, datasets, inputs or {}, functions or {}, versions, jdbc or {}, now or datetime.now(timezone.utc), result,
        [(s, t) for s, t, _ in edges],
    )
    ports: dict[str, str] = {}
    # Decisions look at frames without observations: an observation keeps what its first action counted.
    bare: dict[str, DataFrame] = {}
    try:
        sequence = list(order.static_order())
    except CycleError as error:
        raise ConfigError(f"the pipeline has a cycle: {' -> '.join(error.args[1])}") from error

    for node_id in sequence:
        node = nodes[node_id]
        config, kind = node.get("config") or {}, node["type"]
        incoming = [(s, p) for s, t, p in edges if t == node_id]
        upstream = {s: result.states[s] for s, _ in incoming}
        if any(state == "BLOCKED" for state in upstream.values()) or any(s in result.decisions and result.decisions[s].blocked for s in upstream):
            result.states[node_id] = "BLOCKED"
            continue
        live = [s for s, p in incoming if result.states[s] == "SUCCESS" and (s not in ports or p in ("default", ports[s]))]
        if incoming and not live:
            result.states[node_id] = "SKIPPED"
            continue
        given = {s: result.outputs[s] for s in live}
        plain = {s: bare[s] for s in live}
        result.inputs[node_id] = live
        details: dict[str, Any] = {}
        looked_at: DataFrame | None = None
        if kind.endswith(".source"):
            output = _source(ctx, node_id, kind, config)
        elif kind == "sql.transform":
            output, looked_at = (_sql(ctx, node_id, config, side) for side in (given, plain))
        elif kind == "filter.transform":
            settings = config.get("predicates") or [], config.get("combine", "and")
            looked_at = filter_rows(_one(node_id, plain), *settings, config.get("onEmpty", "continue"))
            output = filter_rows(_one(node_id, given), *settings)
        elif kind == "aggregate.transform":
            output, looked_at = (
                aggregate(_one(node_id, side), config.get("measures") or [], config.get("groupBy") or [], config.get("orderBy") or []) for side in (given, plain)
            )
        elif kind == "join.transform":
            output, looked_at = (_join(ctx, node_id, config, side) for side in (given, plain))
        elif kind == "python.transform":
            output, looked_at = (_python(ctx, node_id, config, side) for side in (given, plain))
        elif kind == "schema.validate":
            contract = validate(
                _one(node_id, given), config.get("dataset", ""), ctx.versions, config.get("expected") or (),
                config.get("onBreaking", "fail"), config.get("onWarning", "warn"), config.get("register", True), ctx.now,
            )
            output = contract.df
            details = {"classification": contract.classification, "changes": len(contract.changes), "new_rows": contract.new_rows}
        elif kind == "quality.check":
            output = _as_written(ctx, node_id, live, _one(node_id, given))
            _check(ctx, node_id, config, output)
        elif kind == "quality.gate":
            output, looked_at = _one(node_id, given), _one(node_id, plain)
            result.decisions[node_id] = _gate(ctx, node_id, config)
            details = {"blocked": result.decisions[node_id].blocked, "reason": result.decisions[node_id].reason}
        elif kind == "condition.branch":
            output, looked_at = next(iter(given.values())), next(iter(plain.values()))
            ports[node_id] = "true" if _branch(ctx, config, looked_at) else "false"
            details = {"outcome": ports[node_id]}
        elif kind.endswith(".destination"):
            output = _one(node_id, given)
            details = _sink(ctx, node_id, kind, config, output, result.staged.get(live[0]))
        else:
            raise ConfigError(f'No operator for node type "{kind}"')
        if kind in ("quality.gate", "condition.branch") and live[0] in result.staged:
            result.staged[node_id] = result.staged[live[0]]
        consumed = {t for s, t, _ in edges if s == node_id}
        bare[node_id] = output if looked_at is None else looked_at
        details = {"kind": kind, **details}
        if kind.endswith((".source", ".transform")):
            output = _observed(ctx, node_id, output)
        if len(consumed) > 1 and kind.endswith(".transform"):
            # Several consumers: computed once, and spilled rather than lost when memory is short.
            output = output.persist()
        result.outputs[node_id] = output
        result.states[node_id] = "SUCCESS"
        result.details[node_id] = details
    return result


def landed_source(responses: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """The records of an HTTP source's landed responses, read the way its config asks for."""
    return landed_records(
        responses, config.get("recordPath"), config.get("pagination", "none"), config.get("cursorPath", "next_cursor"),
        config.get("maxPages") if config.get("pagination", "none") != "none" else None,
    )
