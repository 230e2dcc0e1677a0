"""Command line: codegen, validate, describe, discover, similar, run. JSON on stdout, words on stderr.

Exit codes: 0 fine, 1 findings or a failed run, 2 wrong usage. Spark is started only by what needs it.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .model import validate as checks
from .model.graph import SCHEMA_VERSION, Graph
from .model.kinds import NODE_TYPES, TAGS, describe


class Failure(Exception):
    def __init__(self, code: str, message: str, exit_code: int = 1) -> None:
        super().__init__(message)
        self.code, self.exit_code = code, exit_code


def read_document(path: str) -> dict:
    try:
        text = Path(path).read_text()
    except FileNotFoundError:
        raise Failure("file_not_found", f"there is no file {path}") from None
    except (OSError, UnicodeDecodeError) as e:
        raise Failure("file_unreadable", str(e)) from None
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise Failure("invalid_json", str(e)) from None
    if not isinstance(doc, dict):
        raise Failure("malformed_document", "the document is no object")
    return doc


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("dagspark").getOrCreate()


def _validate(a: argparse.Namespace) -> tuple[dict, int]:
    report = checks.validate(read_document(a.pipeline))
    return report, 0 if report["valid"] else 1


def _describe(a: argparse.Namespace) -> tuple[dict, int]:
    out = {"node_types": list(NODE_TYPES), "port_data_kinds": list(TAGS), "node_kinds": describe()}
    if a.include_discovered:
        from .search import index

        found = index.discover(_session(), index.roots(a.root, a.workspace, a.registry))
        out |= {"discovered_kinds": found["kinds"], "discovered_count": found["count"], "chunk_counts": found["chunk_counts"]}
    return out, 0


def _codegen(a: argparse.Namespace) -> tuple[dict, int]:
    from .plans.codegen import generate

    try:
        code = generate(Graph.from_dict(read_document(a.pipeline)))
    except (KeyError, ValueError, TypeError) as e:
        raise Failure("codegen_failed", str(e)) from None
    if a.output:
        try:
            Path(a.output).write_text(code)
        except OSError as e:
            raise Failure("write_failed", str(e)) from None
    return {"code": code, "output": a.output}, 0


def _run(a: argparse.Namespace) -> tuple[dict, int]:
    import os

    from .plans.compiler import CompileError
    from .plans.runner import EnvironmentMismatch, run

    read_document(a.pipeline)
    path = os.path.abspath(a.pipeline)
    cwd = a.cwd or os.path.dirname(path)
    if not os.path.isdir(cwd):
        raise Failure("invalid_cwd", f"there is no folder {cwd}")
    os.chdir(cwd)
    try:
        made = run(_session(), path, a.receipt, a.strict_env, allow_code=a.allow_code, progress=lambda e: print(json.dumps(e), file=sys.stderr))
    except EnvironmentMismatch as e:
        raise Failure("environment_mismatch", str(e)) from None
    except CompileError as e:
        return {"status": "error", "code": "run_failed", "findings": e.findings}, 1
    if made["status"] != "ok":
        made["code"] = "pipeline_failed"
    return made, 0 if made["status"] == "ok" else 1


def _discover(a: argparse.Namespace) -> tuple[dict, int]:
    from .search import index

    return index.discover(_session(), index.roots(a.root, a.workspace, a.registry)), 0


def _similar(a: argparse.Namespace) -> tuple[dict, int]:
    from .search import index

    if sum(bool(x) for x in (a.query, a.from_span, a.from_kind)) != 1:
        raise Failure("usage", "give a text, --from-span or --from-kind, one of them", 2)
    if a.from_span and index.parse_span(a.from_span) is None:
        raise Failure("usage", f"{a.from_span!r} is no PATH:START-END", 2)
    found = index.similar(_session(), index.roots(a.root, a.workspace, a.registry), a.query, a.from_span, a.from_kind, max(a.limit, 0), a.legacy_tfidf, a.index)
    return found, 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dagspark", description=__doc__)
    p.add_argument("--version", action="version", version=f"dagspark (schema v{SCHEMA_VERSION})")
    verbs = p.add_subparsers(dest="command", required=True)

    def verb(name: str, run: object, *flags: tuple) -> None:
        v = verbs.add_parser(name)
        v.add_argument("--json", action="store_true", help="JSON output (it always is)")
        for names, options in flags:
            v.add_argument(*names, **options)
        v.set_defaults(run=run)

    file = (("pipeline",), {})
    libraries = ((("--root",), {"action": "append"}), (("--workspace",), {"default": "."}), (("--registry",), {}))
    verb("codegen", _codegen, file, (("-o", "--output"), {}))
    verb("validate", _validate, file)
    verb("describe", _describe, (("--include-discovered",), {"action": "store_true"}), *libraries)
    verb("discover", _discover, *libraries)
    verb("similar", _similar, (("query",), {"nargs": "?", "default": ""}), (("--limit",), {"type": int, "default": 20}), (("--legacy-tfidf",), {"action": "store_true"}), (("--from-span",), {}), (("--from-kind",), {}), (("--index",), {}), *libraries)
    verb("run", _run, file, (("--cwd",), {}), (("--receipt",), {}), (("--strict-env",), {"action": "store_true"}), (("--allow-code",), {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out, code = args.run(args)
        out = {"status": "ok" if code == 0 else "error", "command": args.command} | out
    except Failure as e:
        out, code = {"status": "error", "command": args.command, "code": e.code, "message": str(e)}, e.exit_code
        print(e, file=sys.stderr)
    json.dump(out, sys.stdout, indent=2, default=str)
    print()
    return code


if __name__ == "__main__":
    sys.exit(main())
