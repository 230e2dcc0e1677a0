"""Compiles pipeline graphs to DataFrames.

Nodes are compiled in topological order from their sinks' ancestors only; a
node is a function of its inputs (DataFrames by port) and parameters that
returns its outputs by port. Most nodes only add to the plan; those that fit or
measure first (ICA, epochs, regressions, quality metrics), write (outputs,
exports) or call a model or user code do that while they are compiled. An output
that several edges read is persisted.
"""

from __future__ import annotations

import ast
import builtins
import importlib
import importlib.util
import inspect
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model.graph import Graph
from ..model.kinds import Node, variant_of
from ..model.validate import findings
from ..operators import learn, signal, sorting, spikes, tabular
from ..sources import tables
from . import providers

#: by port; sorting analyzers are used as tables of their spikes
Outputs = dict[str, DataFrame | sorting.Analyzer]
#: a visualizer keeps at most so many points
PLOT_POINTS = 10_000


class CompileError(ValueError):
    def __init__(self, found: list[dict]) -> None:
        super().__init__("; ".join(f["message"] for f in found))
        self.findings = found


@dataclass
class Context:
    """What nodes are compiled with; watch hears of each node as it is compiled, observe counts the rows of every output when they are made."""

    spark: SparkSession
    providers: dict[str, providers.Provider] = field(default_factory=dict)
    allow_code: bool = False
    watch: Callable[[str, str, str], None] = lambda node_id, state, message: None
    observe: bool = False
    #: what nodes write, by node, in their order
    actions: dict[str, Callable[[], object]] = field(default_factory=dict)


@dataclass
class Plan:
    graph: Graph
    outputs: dict[str, Outputs]
    sinks: list[str]
    persisted: list[DataFrame]
    #: what writing nodes do, in topological order
    actions: dict[str, Callable[[], object]] = field(default_factory=dict)
    #: the counted rows of each node's first output
    counted: dict[str, Observation] = field(default_factory=dict)

    def rows(self, node_id: str) -> int | None:
        """How many rows a node's first output had when it was last made; None if that isn't known."""
        if node_id not in self.counted:
            return None
        seen = self.counted[node_id]._jo.getRowOrEmpty()
        return seen.get().getLong(0) if seen.isDefined() and seen.get().size() else None

    def ancestors(self, node_id: str) -> list[str]:
        """The compiled nodes that a node's outputs come from, itself included, in topological order."""
        return [n for n in self.outputs if n == node_id or self.graph.reaches(n, node_id)]

    def result(self, node_id: str, port: str | None = None) -> DataFrame:
        out = self.outputs[node_id]
        return out[port] if port else next(iter(out.values()))

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()


Compiler = Callable[[Node, Outputs, Context], Outputs]
_COMPILERS: dict[str, Compiler] = {}


def compiles(*names: str) -> Callable[[Compiler], Compiler]:
    def register(f: Compiler) -> Compiler:
        for n in names:
            _COMPILERS[n] = f
        return f

    return register


def _only(inputs: Outputs) -> DataFrame:
    return next(iter(inputs.values()))


@compiles("data_loader")
def _load(node: Node, _: Outputs, ctx: Context) -> Outputs:
    return {"output": tables.load_table(ctx.spark, node.param("file_path", ""), node.param("delimiter", ","), node.param("file_format", "csv"))}


@compiles("eeg", "lfp", "spike", "calcium")
def _load_signal(node: Node, _: Outputs, ctx: Context) -> Outputs:
    names = {k: node.param(k, d) for k, d in (("time_column", "time"), ("unit_column", "unit"))}
    return {"output": tables.load_signal(ctx.spark, node.param("file_path", ""), node.metadata["signal_type"], node.param("file_format", "csv"), node.param("delimiter", ","), **names)}


@compiles("si_recording")
def _load_recording(node: Node, _: Outputs, ctx: Context) -> Outputs:
    if (kind := node.param("format", "binary")) != "binary":
        raise sorting.AdapterMissing(f"recordings in {kind} need a package that isn't installed")
    return {"output": tables.load_binary_recording(ctx.spark, node.param("file_path", ""), int(node.param("num_channels", 0)), node.param("dtype", "int16"))}


@compiles("normalize")
def _normalize(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"output": tabular.normalize(_only(inputs), node.param("method", "minmax"))}


@compiles("missing")
def _missing(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"output": tabular.fill_missing(_only(inputs), node.param("strategy", "mean"))}


@compiles("split")
def _split(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return tabular.split(_only(inputs), float(node.param("test_size", 0.2)), int(node.param("random_state", 42)))


@compiles("feature_select")
def _select(node: Node, inputs: Outputs, _: Context) -> Outputs:
    df = _only(inputs)
    return {"output": tabular.select_variance(df) if node.param("method", "kbest") == "variance" else tabular.select_kbest(df, int(node.param("n_features", 10)))}


@compiles("neural_filter")
def _filter(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"output": signal.bandpass(_only(inputs), *(float(node.param(n, d)) for n, d in (("sampling_rate", 250), ("low_hz", 1), ("high_hz", 40), ("notch_hz", 0))))}


@compiles("neural_montage")
def _montage(node: Node, inputs: Outputs, _: Context) -> Outputs:
    signal.known_montage(node.param("montage", "standard_1020"))
    return {"output": _only(inputs)}


@compiles("neural_ica")
def _ica(node: Node, inputs: Outputs, _: Context) -> Outputs:
    if name := node.param("montage", ""):
        signal.known_montage(name)
    return {"output": signal.ica(_only(inputs), int(node.param("n_components", 0)))}


@compiles("correlation")
def _correlation(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"result": tabular.correlation(_only(inputs))}


@compiles("clustering")
def _cluster(node: Node, inputs: Outputs, _: Context) -> Outputs:
    df, kind = _only(inputs), node.param("algorithm", "kmeans")
    if kind == "kmeans":
        return {"result": learn.kmeans(df, int(node.param("n_clusters", 3)))}
    if kind == "dbscan":
        return {"result": learn.dbscan(df, float(node.param("eps", 0.5)), int(node.param("min_samples", 5)))}
    return {"result": learn.hierarchical(df, int(node.param("n_clusters", 3))) if kind == "hierarchical" else df}


@compiles("regression")
def _regression(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"result": learn.regression(_only(inputs), node.param("model_type", "linear"))}


@compiles("neural_spectrum")
def _spectrum(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"result": signal.welch(_only(inputs), float(node.param("sampling_rate", 250)), int(node.param("nperseg", 256)))}


@compiles("neural_epochs")
def _epochs(node: Node, inputs: Outputs, _: Context) -> Outputs:
    int(node.param("event_id", 1))  # all events have it, so it chooses none; but it must be a number
    if name := node.param("montage", ""):
        signal.known_montage(name)
    return {"result": signal.erp(_only(inputs), float(node.param("sampling_rate", 250)), float(node.param("tmin", -0.2)), float(node.param("tmax", 0.5)), node.param("event_column", ""))}


@compiles("neural_spike")
def _spikes(node: Node, inputs: Outputs, _: Context) -> Outputs:
    df = _only(inputs)
    if node.param("method", "psth") == "isi":
        return {"result": spikes.isi_histogram(df, int(node.param("n_bins", 50)), float(node.param("max_isi", 0)))}
    return {"result": spikes.psth(df, float(node.param("bin_size", 0.05)), float(node.param("t_start", 0)), float(node.param("t_end", 0)))}


@compiles("neural_calcium")
def _calcium(node: Node, inputs: Outputs, _: Context) -> Outputs:
    df = _only(inputs)
    if node.param("method", "dff") == "events":
        return {"result": spikes.threshold_events(df, float(node.param("threshold", 3)), float(node.param("sampling_rate", 30)))}
    return {"result": spikes.dff(df, float(node.param("baseline_percentile", 10)))}


@compiles("si_preprocess")
def _si_preprocess(node: Node, inputs: Outputs, _: Context) -> Outputs:
    numbers = {n: float(node.param(n, d)) for n, d in (("freq_min", 300), ("freq_max", 6000), ("notch_freq", 3000), ("notch_q", 30))}
    return {"output": sorting.preprocess(_only(inputs), node.param("method", "bandpass_filter"), float(node.param("sampling_rate", 30000)), reference=node.param("reference", "global"), **numbers)}


@compiles("si_sort")
def _si_sort(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"output": sorting.sort_spikes(_only(inputs), node.param("sorter_name", "simple"))}


@compiles("si_analyze")
def _si_analyze(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"output": sorting.analyze(inputs["recording"], inputs["sorting"], node.param("extensions", ""))}


def _analyzer(x: DataFrame | sorting.Analyzer) -> sorting.Analyzer:
    return x if isinstance(x, sorting.Analyzer) else sorting.Analyzer(x)


@compiles("si_metrics")
def _si_metrics(node: Node, inputs: Outputs, _: Context) -> Outputs:
    done = sorting.analyzer_metrics(_analyzer(_only(inputs)), float(node.param("sampling_rate", 30000)), node.param("metric_names", ""))
    return {"analyzer": done, "metrics": done.metrics}


@compiles("si_curate")
def _si_curate(node: Node, inputs: Outputs, _: Context) -> Outputs:
    rules = {n: float(node.param(n, d)) for n, d in (("snr_min", 5), ("isi_violations_max", 0.2), ("presence_ratio_min", 0.9), ("firing_rate_min", 0.1), ("isolation_distance_min", 0))}
    return {"output": sorting.curate_analyzer(_analyzer(_only(inputs)), float(node.param("sampling_rate", 30000)), **rules)}


@compiles("si_export")
def _si_export(node: Node, inputs: Outputs, ctx: Context) -> Outputs:
    path, method = node.param("output_path", "si_export"), node.param("method", "phy")
    sorting.known_export(method)
    ctx.actions[node.id] = lambda: sorting.export(_only(inputs), path, method)
    return {"output": ctx.spark.createDataFrame([(path,)], "text string")}


@compiles("si_compare")
def _si_compare(node: Node, inputs: Outputs, _: Context) -> Outputs:
    return {"output": sorting.best_matches(sorting.compare(inputs["sorting1"], inputs["sorting2"], float(node.param("sampling_rate", 30000)), float(node.param("delta_time", 0.4))), float(node.param("match_score", 0.5)))}


@compiles("visualizer")
def _plot(node: Node, inputs: Outputs, _: Context) -> Outputs:
    df = _only(inputs)
    return {"plot": (df.orderBy(tabular.ROW) if tabular.ROW in df.columns else df).limit(PLOT_POINTS)}


@compiles("output")
def _out(node: Node, inputs: Outputs, ctx: Context) -> Outputs:
    if path := node.param("path", None):
        ctx.actions[node.id] = lambda: _only(inputs).write.mode("overwrite").format(node.param("file_format", "parquet")).save(tables.resolve(path))
    return {"written": _only(inputs)}


@compiles("model")
def _model(node: Node, inputs: Outputs, ctx: Context) -> Outputs:
    data = _only(inputs) if inputs else None
    reply = providers.call(node.metadata.get("provider", ""), node.param("prompt", ""), node.param("model", "default"), data, ctx.providers)
    return {"response": ctx.spark.createDataFrame([(reply,)], "text string")}


def run_block(source: str, data: DataFrame | None) -> object:
    """Run a block of statements on the driver: the first name that it reads before setting is the data; the last that it sets is the result."""
    tree = ast.parse(source)
    known, first, last = set(dir(builtins)), None, None
    for statement in tree.body:
        loads = [n.id for n in ast.walk(statement) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]
        first = first or next((n for n in loads if n not in known), None)
        for n in ast.walk(statement):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                known.add(n.id)
                last = n.id
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                known |= {(a.asname or a.name).split(".")[0] for a in n.names}
    if last is None:
        raise ValueError("the block sets no name")
    names: dict[str, object] = {first: data} if first else {}
    exec(compile(tree, "block", "exec"), names)
    return names[last]


@compiles("custom_code")
def _custom(node: Node, inputs: Outputs, ctx: Context) -> Outputs:
    """A user's function of a DataFrame (none for a source) and the node's other parameters, or a method as Class.method."""
    if not ctx.allow_code:
        raise CompileError([{"severity": "error", "code": "code_not_allowed", "message": f"node {node.id!r} runs user code, which must be allowed"}])
    if source := node.param("source", None):
        return {"output": run_block(source, _only(inputs) if inputs else None)}
    name, where = node.param("function_name", ""), node.param("module", "")
    root = node.param("library_root", "")
    if where.endswith(".py"):
        spec = importlib.util.spec_from_file_location("dagspark_user_code", where)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        if root and root not in sys.path:
            sys.path.insert(0, root)
        module = importlib.import_module(where)
    owner, _, method = name.rpartition(".")
    function = getattr(getattr(module, owner)(), method) if owner else getattr(module, name)
    extra = {k: p.effective() for k, p in node.parameters.items() if k not in ("function_name", "module", "library_root", "repository_id") and p.effective() is not None}
    extra = {k: v for k, v in extra.items() if k in inspect.signature(function).parameters}
    out = function(_only(inputs), **extra) if inputs else function(**extra)
    return {"output": out}


def _observed(plan: Plan, node_id: str, made: Outputs) -> Outputs:
    """The outputs with the first one's rows counted as they are made."""
    port, first = next(iter(made.items()))
    table = first.sorting if isinstance(first, sorting.Analyzer) else first
    if not isinstance(table, DataFrame):
        return made
    plan.counted[node_id] = Observation()
    counted = table.observe(plan.counted[node_id], F.count(F.lit(1)).alias("rows"))
    return {**made, port: replace(first, sorting=counted) if isinstance(first, sorting.Analyzer) else counted}


def compile_graph(graph: Graph, ctx: Context) -> Plan:
    """The plan of a graph without errors; required inputs must be connected, the first edge on an input counts."""
    doc = graph.to_dict()
    wrong = [f for f in findings(doc) if f["severity"] == "error" or f["code"] == "unconnected_required_input"]
    if code := graph.problem():
        wrong.append({"severity": "error", "code": code, "message": code})
    if wrong:
        raise CompileError(wrong)
    sinks = [n for n in graph.nodes if not graph.outgoing(n)]
    needed = {n for n in graph.nodes if any(graph.reaches(n, s) for s in sinks)}
    plan = Plan(graph, {}, sinks, [], ctx.actions)
    for node_id in graph.order()[0]:
        if node_id not in needed:
            continue
        node = graph.nodes[node_id]
        inputs: Outputs = {}
        for e in graph.incoming(node_id):
            port = node.ports.input(e.target_port)[1]
            given = plan.outputs[e.source]
            source = graph.nodes[e.source].ports.output(e.source_port)[1]
            inputs.setdefault(port.name if port else "data", given[source.name] if source and source.name in given else next(iter(given.values())))
        variant = variant_of(node.node_type, node.metadata)
        run = _COMPILERS.get(variant) or _COMPILERS.get(node.node_type) or (lambda node, inputs, ctx: {node.ports.outputs[0].name: _only(inputs)})
        ctx.watch(node_id, "running", "")
        ctx.spark.sparkContext.setJobGroup(node_id, f"{node.label} ({node_id})")
        try:
            made = run(node, inputs, ctx)
        except Exception as e:
            ctx.watch(node_id, "error", str(e))
            raise
        if ctx.observe:
            made = _observed(plan, node_id, made)
        for name, df in made.items():
            readers = [e for e in graph.outgoing(node_id) if (p := node.ports.output(e.source_port)[1]) and p.name == name]
            if len(readers) > 1:
                made[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
                plan.persisted.append(made[name])
        plan.outputs[node_id] = made
    return plan
