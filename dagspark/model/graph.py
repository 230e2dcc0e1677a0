"""Pipeline graphs and their documents (JSON, version 1; version 0 is read too)."""

from __future__ import annotations

import json
from collections import defaultdict
from pathlib import Path
from typing import NamedTuple

from .kinds import Node

SCHEMA_VERSION = 1


class Edge(NamedTuple):
    source: str
    source_port: str | None
    target: str
    target_port: str | None

    @staticmethod
    def read(raw: object) -> Edge:
        if isinstance(raw, dict):
            return Edge(raw["source"], raw.get("source_port"), raw["target"], raw.get("target_port"))
        source, target = raw
        return Edge(source, None, target, None)

    def to_dict(self) -> dict:
        return self._asdict()


class Graph:
    """Nodes in their order of insertion, edges without repeats, and both directions of adjacency."""

    def __init__(self, environment: dict | None = None) -> None:
        self.nodes: dict[str, Node] = {}
        self.edges: list[Edge] = []
        self.environment = environment
        self._out: dict[str, list[Edge]] = defaultdict(list)
        self._in: dict[str, list[Edge]] = defaultdict(list)

    def add_node(self, node: Node) -> None:
        self.nodes[node.id] = node

    def remove_node(self, node_id: str) -> None:
        if self.nodes.pop(node_id, None):
            for e in [*self._out[node_id], *self._in[node_id]]:
                self.remove_edge(e)

    def add_edge(self, source: str, target: str, source_port: str | None = None, target_port: str | None = None) -> bool:
        """False if an end is missing or the edge is there already."""
        e = Edge(source, source_port, target, target_port)
        if source not in self.nodes or target not in self.nodes or e in self._out[source]:
            return False
        self.edges.append(e)
        self._out[source].append(e)
        self._in[target].append(e)
        return True

    def remove_edge(self, e: Edge) -> bool:
        if e not in self._out.get(e.source, ()):
            return False
        self.edges.remove(e)
        self._out[e.source].remove(e)
        self._in[e.target].remove(e)
        return True

    def incoming(self, node_id: str, port: str | None = None) -> list[Edge]:
        return [e for e in self._in.get(node_id, ()) if port is None or self.nodes[node_id].ports.input(e.target_port)[1] in (p for p in self.nodes[node_id].ports.inputs if p.name == port)]

    def outgoing(self, node_id: str, port: str | None = None) -> list[Edge]:
        return [e for e in self._out.get(node_id, ()) if port is None or e.source_port == port]

    def order(self) -> tuple[list[str], bool]:
        """Topological order, ties by insertion, nodes on or behind a cycle last; and whether there is a cycle."""
        waits = {n: len({e.source for e in self._in.get(n, ())}) for n in self.nodes}
        ready = [n for n in self.nodes if not waits[n]]
        done: list[str] = []
        for n in ready:
            done.append(n)
            for t in dict.fromkeys(e.target for e in self._out.get(n, ())):
                waits[t] -= 1
                if not waits[t]:
                    ready.append(t)
        rest = [n for n in self.nodes if waits[n] > 0]
        return done + rest, bool(rest)

    def problem(self) -> str | None:
        """Why the graph can't run, if so: a finding's code."""
        if not self.nodes:
            return "empty_pipeline"
        return "cycle_detected" if self.order()[1] else None

    def reaches(self, start: str, goal: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            n = todo.pop()
            if n == goal:
                return True
            if n not in seen:
                seen.add(n)
                todo += [e.target for e in self._out.get(n, ())]
        return False

    def can_connect(self, source: str, target: str, source_port: str | None = None, target_port: str | None = None) -> str | None:
        """None if the edge may be drawn, else why not."""
        if source not in self.nodes or target not in self.nodes:
            return "dangling_edge"
        if source == target:
            return "self_loop"
        a, b = self.nodes[source].ports.output(source_port), self.nodes[target].ports.input(target_port)
        if a[1] is None or b[1] is None:
            return "ambiguous_port" if "ambiguous" in (a[0], b[0]) else "unknown_port"
        if not b[1].accepts(a[1]):
            return "incompatible_data_kind"
        if Edge(source, source_port, target, target_port) in self._out.get(source, ()):
            return "duplicate_edge"
        return "cycle_detected" if self.reaches(target, source) else None

    def apply(self, intent: dict) -> None:
        """Carry out an edit: move, add_node, delete_node, add_edge (displaces the edge on its input), delete_edge, set_param."""
        kind = intent["type"]
        if kind == "move":
            self.nodes[intent["node_id"]].position = tuple(intent["position"])
        elif kind == "add_node":
            self.add_node(Node.from_dict(intent["node"]))
        elif kind == "delete_node":
            self.remove_node(intent["node_id"])
        elif kind == "set_param":
            self.nodes[intent["node_id"]].parameters[intent["name"]].value = intent["value"]
        elif kind in ("add_edge", "delete_edge"):
            e = Edge.read(intent["edge"])
            if kind == "delete_edge":
                self.remove_edge(e)
            else:
                port = self.nodes[e.target].ports.input(e.target_port)[1]
                for old in self.incoming(e.target, port.name if port else None):
                    self.remove_edge(old)
                self.add_edge(e.source, e.target, e.source_port, e.target_port)
        else:
            raise ValueError(f"unknown edit {kind!r}")

    def to_dict(self) -> dict:
        out: dict = {"version": SCHEMA_VERSION}
        if self.environment is not None:
            out["environment"] = self.environment
        return out | {"nodes": {k: n.to_dict() for k, n in self.nodes.items()}, "edges": [e.to_dict() for e in self.edges]}

    @staticmethod
    def from_dict(d: dict) -> Graph:
        g = Graph(d.get("environment", d.get("requires")))
        for raw in (d.get("nodes") or {}).values():
            g.add_node(Node.from_dict(raw))
        for raw in d.get("edges") or []:
            e = Edge.read(raw)
            g.add_edge(e.source, e.target, e.source_port, e.target_port)
        return g

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2))

    @staticmethod
    def load(path: str) -> Graph:
        return Graph.from_dict(json.loads(Path(path).read_text()))


def schema_version(d: dict) -> int:
    v = d.get("version", 0)
    return v if isinstance(v, int) else 0
