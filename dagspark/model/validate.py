"""Checks of raw pipeline documents, as lists of findings. Nothing here needs Spark."""

from __future__ import annotations

import os

from .graph import Graph, schema_version
from .kinds import ACCEPTED_SIGNALS, NODE_TYPES, Ports, ports_for, variant_of

ERRORS = ("malformed_nodes", "malformed_node", "missing_node_id", "node_id_mismatch", "unknown_node_type", "malformed_parameters", "missing_module_path", "malformed_edges", "malformed_edge", "dangling_edge", "self_loop", "unknown_port", "incompatible_data_kind", "incompatible_signal_type", "empty_pipeline", "invalid_graph", "cycle_detected")
WARNINGS = ("ambiguous_port", "duplicate_edge", "unconnected_required_input", "several_edges_on_input")


def finding(code: str, message: str, node: str | None = None, edge: int | None = None) -> dict:
    out = {"severity": "warning" if code in WARNINGS else "error", "code": code, "message": message}
    return out | ({"node_id": node} if node is not None else {}) | ({"edge_index": edge} if edge is not None else {})


def _nodes(nodes: dict, ports: dict[str, Ports]) -> list[dict]:
    out = []
    for key, n in nodes.items():
        if not isinstance(n, dict):
            out.append(finding("malformed_node", f"node {key!r} is no object", key))
            continue
        if n.get("id") is None:
            out.append(finding("missing_node_id", f"node {key!r} has no id", key))
        elif n["id"] != key:
            out.append(finding("node_id_mismatch", f"node under {key!r} calls itself {n['id']!r}", key))
        kind, meta = n.get("node_type"), n.get("metadata")
        if kind in NODE_TYPES:
            ports[key] = ports_for(kind, meta if isinstance(meta, dict) else None)
        else:
            out.append(finding("unknown_node_type", f"node {key!r} is of the unknown type {kind!r}", key))
        params = n.get("parameters", {})
        if not isinstance(params, dict):
            out.append(finding("malformed_parameters", f"parameters of node {key!r} are no object", key))
        elif kind == "custom_code":
            for name in ("library_root", "module"):
                p = params.get(name)
                value = (p.get("value") or p.get("default_value")) if isinstance(p, dict) else p
                looks_like_path = isinstance(value, str) and (name == "library_root" or value.endswith(".py") or os.sep in value)
                if value and looks_like_path and not os.path.exists(os.path.expanduser(value)):
                    out.append(finding("missing_module_path", f"node {key!r}: {name} {value!r} does not exist", key))
    return out


def _side(index: int, node: str, side: str, name: str | None, status: str, ports: Ports) -> list[dict]:
    if status == "resolved":
        return []
    names = ", ".join(p.name for p in (ports.inputs if side == "input" else ports.outputs)) or "none"
    if status == "ambiguous":
        return [finding("ambiguous_port", f"edge {index} doesn't say which {side} of {node!r} it means ({names})", node, index)]
    return [finding("unknown_port", f"edge {index}: {node!r} has no {side} {name!r} (it has {names})", node, index)]


def _edges(edges: list, nodes: dict, ports: dict[str, Ports], fed: dict[str, dict[str, int]]) -> list[dict]:
    out, seen = [], set()
    for i, raw in enumerate(edges):
        if isinstance(raw, dict):
            a, ap, b, bp = (raw.get(k) for k in ("source", "source_port", "target", "target_port"))
        elif isinstance(raw, (list, tuple)) and len(raw) == 2:
            (a, b), ap, bp = raw, None, None
        else:
            out.append(finding("malformed_edge", f"edge {i} is neither an object nor a pair", edge=i))
            continue
        if a is None or b is None:
            out.append(finding("malformed_edge", f"edge {i} lacks its source or target", edge=i))
            continue
        out += [finding("dangling_edge", f"edge {i}: there is no node {x!r}", x, i) for x in (a, b) if x not in nodes]
        if a == b:
            out.append(finding("self_loop", f"edge {i} leads from {a!r} to itself", a, i))
        start = end = None
        if a in ports:
            status, start = ports[a].output(ap)
            out += _side(i, a, "output", ap, status, ports[a])
        if b in ports:
            status, end = ports[b].input(bp)
            out += _side(i, b, "input", bp, status, ports[b])
        if start and end and not end.accepts(start):
            out.append(finding("incompatible_data_kind", f"edge {i} connects {start.tag} to {end.tag}", b, i))
        if (a, ap, b, bp) in seen:
            out.append(finding("duplicate_edge", f"edge {i} repeats an earlier one", edge=i))
        elif end:
            fed.setdefault(b, {})[end.name] = fed.get(b, {}).get(end.name, 0) + 1
            if fed[b][end.name] == 2:
                out.append(finding("several_edges_on_input", f"input {end.name!r} of {b!r} has several edges; the first counts", b, i))
        seen.add((a, ap, b, bp))
    return out


def _signals(nodes: dict, edges: list) -> list[dict]:
    before: dict[str, set[str]] = {}
    for raw in edges:
        a, b = (raw.get("source"), raw.get("target")) if isinstance(raw, dict) else raw if isinstance(raw, (list, tuple)) and len(raw) == 2 else (None, None)
        if a in nodes and b in nodes:
            before.setdefault(b, set()).add(a)
    out = []
    for key, n in nodes.items():
        if not isinstance(n, dict) or not isinstance(n.get("metadata", {}), dict):
            continue
        variant = variant_of(n.get("node_type"), n.get("metadata"))
        if variant not in ACCEPTED_SIGNALS:
            continue
        seen, todo, found = set(), list(before.get(key, ())), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += before.get(x, ())
                meta = nodes[x].get("metadata") if isinstance(nodes[x], dict) else None
                if isinstance(meta, dict) and meta.get("signal_type"):
                    found.add(meta["signal_type"])
        if bad := sorted(found - ACCEPTED_SIGNALS[variant]):
            out.append(finding("incompatible_signal_type", f"{key!r} ({variant}) takes {', '.join(sorted(ACCEPTED_SIGNALS[variant]))}, not {', '.join(bad)}", key))
    return out


def findings(doc: dict) -> list[dict]:
    """In document order: nodes, edges, inputs without an edge, signal types."""
    out: list[dict] = []
    nodes, edges = doc.get("nodes", {}), doc.get("edges", [])
    if not isinstance(nodes, dict):
        out.append(finding("malformed_nodes", "nodes is no object"))
        nodes = {}
    ports: dict[str, Ports] = {}
    out += _nodes(nodes, ports)
    if not isinstance(edges, list):
        out.append(finding("malformed_edges", "edges is no list"))
        edges = []
    fed: dict[str, dict[str, int]] = {}
    out += _edges(edges, nodes, ports, fed)
    for key, p in ports.items():
        out += [finding("unconnected_required_input", f"nothing feeds the input {x.name!r} of {key!r}", key) for x in p.inputs if x.required and x.name not in fed.get(key, ())]
    return out + _signals(nodes, edges)


def validate(doc: dict) -> dict:
    """The report on a document: valid, version, counts, findings and their summary."""
    found = findings(doc)
    nodes, edges = len(doc.get("nodes") or {}), len(doc.get("edges") or [])
    if not any(f["severity"] == "error" for f in found):
        graph = Graph.from_dict(doc)
        nodes, edges = len(graph.nodes), len(graph.edges)
        if code := graph.problem():
            found.append(finding(code, {"empty_pipeline": "the pipeline has no nodes", "cycle_detected": "the pipeline has a cycle"}[code]))
    errors = sum(f["severity"] == "error" for f in found)
    return {"valid": not errors, "file_schema_version": schema_version(doc), "node_count": nodes, "edge_count": edges, "findings": found, "summary": {"errors": errors, "warnings": len(found) - errors}}
