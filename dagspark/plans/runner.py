"""Runs pipelines: compiles them, materialises their sinks, tells progress, and writes a receipt."""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from contextlib import redirect_stdout
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model.graph import Graph
from . import receipt
from .compiler import CompileError, Context, Plan, compile_graph
from .providers import Provider


class EnvironmentMismatch(RuntimeError):
    pass


def plan_text(df: DataFrame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


class _Progress:
    """Tells each node's state once it changes: pending, running while it is compiled, ok with its rows once a sink that needs it is done, or error."""

    def __init__(self, tell: Callable[[dict], None], nodes: list[str]) -> None:
        self.tell, self.states = tell, dict.fromkeys(nodes, "")
        for n in nodes:
            self.set(n, "pending")

    def set(self, node_id: str, state: str, message: str = "", rows: int | None = None) -> None:
        if self.states.get(node_id) in (state, "error"):
            return
        self.states[node_id] = state
        more = ({"message": message} if message else {}) | ({"rows": rows} if rows is not None else {})
        self.tell({"event": "node", "node_id": node_id, "state": state} | more)


def failing(plan: Plan, sink: str) -> str:
    """The first node, of those a sink's rows come from, whose own rows can't be made."""
    for node_id in plan.ancestors(sink):
        for df in plan.outputs[node_id].values():
            try:
                df.write.format("noop").mode("overwrite").save()
            except Exception:  # whatever it was that stopped the sink
                return node_id
    return sink


def run(spark: SparkSession, path: str, receipt_path: str | None = None, strict_env: bool = False, out_dir: str | None = None, providers: dict[str, Provider] | None = None, allow_code: bool = False, progress: Callable[[dict], None] | None = None) -> dict:
    """Run a pipeline file. Plots become JSON files beside it; other sinks' rows are written as Parquet into out_dir, if given.

    progress hears of every node in the order in which nodes run; it costs the
    pruning of columns above each node, whose rows are counted on the way.
    """
    text = Path(path).read_text()
    graph, started = Graph.from_dict(json.loads(text)), receipt.utc_now()
    warnings = receipt.mismatches(graph.environment, receipt.snapshot())
    if warnings and strict_env:
        raise EnvironmentMismatch("; ".join(warnings))
    figures, outputs, plans, status, error = [], [], [], "ok", None
    told = _Progress(progress or (lambda e: None), list(graph.nodes))
    plan = doing = None

    def done(node_id: str) -> None:
        for n in plan.ancestors(node_id):
            told.set(n, "ok", rows=plan.rows(n))

    try:
        plan = compile_graph(graph, Context(spark, providers or {}, allow_code, told.set, progress is not None))
        for doing, write in plan.actions.items():
            spark.sparkContext.setJobGroup(doing, f"{graph.nodes[doing].label} ({doing})")
            write()
            done(doing)
        for doing in plan.sinks:
            spark.sparkContext.setJobGroup(doing, f"{graph.nodes[doing].label} ({doing})")
            for port, df in plan.outputs[doing].items():
                plans.append(plan_text(df))
                if port == "plot":
                    figures.append(str(Path(path).with_suffix("")) + f"_fig_{len(figures) + 1}.json")
                    Path(figures[-1]).write_text(json.dumps({"title": graph.nodes[doing].label, "values": json.loads(df.toPandas().to_json(orient="records"))}))
                elif out_dir:
                    outputs.append(f"{out_dir}/{doing}_{port}")
                    df.write.mode("overwrite").parquet(outputs[-1])
                elif doing not in plan.actions:
                    df.write.format("noop").mode("overwrite").save()
            done(doing)
    except CompileError:
        raise
    except Exception as e:  # the receipt tells of it, then the caller
        status, error = "error", str(e)
        if doing:
            told.set(failing(plan, doing) if progress else doing, "error", error)
    finally:
        if plan:
            plan.release()
    made = receipt.make(text, graph, "\n".join(plans), status, started, path, environment_warnings=warnings, figures=figures, output_paths=outputs, error=error)
    made["receipt_path"] = receipt_path or str(Path(path).with_suffix("")) + ".run.json"
    receipt.write(made, made["receipt_path"])
    return made
