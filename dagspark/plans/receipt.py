"""Run receipts: what ran, on which inputs, in which environment."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import platform
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

from ..model.graph import Graph

PACKAGES = ("pyspark", "pandas", "numpy", "pyarrow")


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sha256_file(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


def snapshot() -> dict:
    """Versions of Python and of the packages that are there."""
    out = {"python": platform.python_version(), "platform": sys.platform}
    for p in PACKAGES:
        try:
            out[p] = importlib.metadata.version(p)
        except importlib.metadata.PackageNotFoundError:
            continue
    return out


def mismatches(pinned: dict | None, actual: dict) -> list[str]:
    """Pins that don't hold: a version's prefix, or >= a version."""
    number = lambda v: tuple(int(x) for x in v.split(".") if x.isdigit())
    out = []
    for name, want in (pinned or {}).items():
        have = actual.get(name)
        if have is None:
            out.append(f"{name} is pinned to {want} but isn't there")
        elif str(want).startswith(">="):
            if number(have) < number(str(want)[2:].strip()):
                out.append(f"{name} is {have}, pinned to {want}")
        elif have != str(want) and not have.startswith(f"{want}."):
            out.append(f"{name} is {have}, pinned to {want}")
    return out


def git_commit(folder: str) -> str | None:
    got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return got.stdout.strip() or None


def input_files(graph: Graph) -> list[dict]:
    paths = [p.effective() for n in graph.nodes.values() for p in n.parameters.values() if p.kind == "file" and p.name == "file_path" and p.effective()]
    return [{"path": p, "sha256": sha256_file(p)} for p in dict.fromkeys(paths)]


def make(document: str, graph: Graph, plan_text: str, status: str, started: str, path: str | None = None, **more: object) -> dict:
    folder = str(Path(path).resolve().parent) if path else "."
    return {"status": status, "started": started, "finished": utc_now(), "pipeline": path, "pipeline_sha256": sha256_text(document), "plan_sha256": sha256_text(plan_text), "inputs": input_files(graph), "git_commit": git_commit(folder), "environment": snapshot()} | more


def write(receipt: dict, path: str) -> None:
    Path(path).write_text(json.dumps(receipt, indent=2))
