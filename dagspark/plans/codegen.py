"""Writes the PySpark script of a pipeline."""

from __future__ import annotations

import json

from ..model.graph import Graph


def generate(graph: Graph) -> str:
    """A script that rebuilds the graph, compiles it and shows each sink; the nodes stand in running order."""
    if code := graph.problem():
        raise ValueError(code)
    order = graph.order()[0]
    lines = ['"""Generated from a pipeline document."""', "", "from pyspark.sql import SparkSession", "", "from dagspark.model.graph import Graph", "from dagspark.model.kinds import Node", "from dagspark.plans.compiler import Context, compile_graph", "", "graph = Graph()"]
    for n in order:
        node = graph.nodes[n]
        lines += [f"# {node.label or node.node_type}", f"graph.add_node(Node.from_dict({json.loads(json.dumps(node.to_dict()))!r}))"]
    lines += [f"graph.add_edge({e.source!r}, {e.target!r}, {e.source_port!r}, {e.target_port!r})" for e in graph.edges]
    lines += ["", "spark = SparkSession.builder.getOrCreate()", "plan = compile_graph(graph, Context(spark))", "for sink in plan.sinks:", "    plan.result(sink).show()", ""]
    return "\n".join(lines)
