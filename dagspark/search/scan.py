"""Analysis steps in Python sources: functions, methods and blocks of statements, each a row. One task reads a file."""

from __future__ import annotations

import ast
import hashlib
import io
import os
import re
import textwrap
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TAG_VOCABULARY

# Folders that aren't searched; argument names that mean data or paths; roots of scientific calls; limits.
SKIPPED = {
    "__pycache__", ".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "node_modules", "dist", "build",
    "site-packages", "tests", "test",
}
DATA_ARGS = {
    "data", "df", "frame", "x", "y", "signal", "signals", "recording", "recordings", "array", "arr", "series", "table", "traces", "samples", "values",
    "waveform", "waveforms", "times", "spikes",
}
PATH_ARGS = {
    "path", "file", "filename", "filepath", "file_path", "csv", "source",
}
SCIENCE = {
    "numpy", "np", "pandas", "pd", "scipy", "sklearn", "sk", "mne", "signal", "plt", "matplotlib", "pyplot", "sns", "seaborn", "neo", "spikeinterface",
    "nilearn", "nibabel",
}
MAX_FILE_BYTES, MAX_LINES, MIN_LINES, PREVIEW_LINES, MAX_PER_FILE, MAX_CHUNKS = 1_000_000, 80, 4, 40, 80, 20_000
ALIASES = {"numpy": "np", "pandas": "pd", "seaborn": "sns", "scipy.signal": "signal", "matplotlib.pyplot": "plt"}

SCHEMA = """name string, qualified_name string, module string, source_path string, library_root string, lineno int, end_lineno int, docstring string,
docstring_first_line string, args array<struct<name:string,annotation:string,default:string,has_default:boolean>>, return_annotation string, class_name string,
tags array<string>, has_data_input boolean, starred boolean, repository_id string, chunk_kind string, preview string, source_hash string, leading_comment string, calls array<string>"""
FIELDS = re.findall(r"(\w+) (?:string|int|boolean|array)", SCHEMA)
_WORD = re.compile(r"[^a-z0-9]+")


def words(text: str) -> list[str]:
    return [w for w in _WORD.split(re.sub(r"(?<!^)(?=[A-Z])", " ", text.replace("_", " ")).lower()) if w]


def tags_of(text: str) -> list[str]:
    have = set(words(text))
    return [t for t in TAG_VOCABULARY if t in have]


def takes_data(args: list[dict], annotations: dict[str, str]) -> bool:
    """Whether the first argument is data rather than a path."""
    first = next((a["name"] for a in args if a["name"] not in ("self", "cls")), None)
    if first is None or first in PATH_ARGS or "path" in first.lower() or "Path" in annotations.get(first, ""):
        return False
    if first in DATA_ARGS or re.search("DataFrame|ndarray|Series|array", annotations.get(first, "")):
        return True
    return first not in ("path", "file", "filename", "name", "key")


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ".".join(reversed(parts)) or None


def _canonical(name: str, imports: dict[str, str]) -> str:
    root, _, rest = name.partition(".")
    full = imports.get(root, root) + ("." + rest if rest else "")
    for long in sorted(ALIASES, key=len, reverse=True):
        if full == long or full.startswith(long + "."):
            return ALIASES[long] + full[len(long) :]
    return full.removeprefix("self.").removeprefix("cls.")


def module_of(path: str, root: str) -> str:
    return os.path.relpath(path, root).removesuffix(".py").replace(os.sep, ".").removesuffix(".__init__")


class FileScan:
    """The chunks of one file."""

    def __init__(self, source: str, path: str, root: str, repository: str = "") -> None:
        self.lines = source.splitlines()
        self.tree = ast.parse(source)
        self.path, self.root, self.repository = path, root, repository
        self.module = module_of(path, root)
        self.imports: dict[str, str] = {}
        self.helpers: dict[str, ast.AST] = {}
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Import):
                self.imports |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
            elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                self.imports |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.helpers.setdefault(node.name, node)
        self.rows: list[dict] = []

    def calls(self, nodes: list[ast.AST], depth: int = 2, seen: frozenset = frozenset()) -> list[str]:
        """Canonical names of the calls, helpers of the file replaced by their own calls to a depth of two; each once."""
        out: list[str] = []
        for top in nodes:
            for node in ast.walk(top):
                if not isinstance(node, ast.Call) or not (name := _dotted(node.func)):
                    continue
                local = name.removeprefix("self.")
                if local in self.helpers and depth and local not in seen:
                    out += self.calls(self.helpers[local].body, depth - 1, seen | {local})
                else:
                    out.append(_canonical(name, self.imports))
        return list(dict.fromkeys(out))

    def _comment_above(self, line: int) -> str:
        out = []
        while line > 1 and self.lines[line - 2].strip().startswith("#"):
            line -= 1
            out.insert(0, self.lines[line - 1].strip().lstrip("# "))
        return " ".join(out)

    def _add(self, kind: str, name: str, qualified: str, start: int, end: int, nodes: list[ast.AST], **more: object) -> None:
        span = "\n".join(self.lines[start - 1 : end])
        doc = more.pop("docstring", "") or ""
        text = " ".join([name, doc, str(more.get("leading_comment", ""))])
        row = dict.fromkeys(FIELDS) | {
            "name": name, "qualified_name": qualified, "module": self.module, "source_path": self.path, "library_root": self.root, "lineno": start, "end_lineno": end,
            "docstring": doc, "docstring_first_line": doc.strip().split("\n")[0] if doc.strip() else "", "args": [], "return_annotation": "", "class_name": "", "tags": tags_of(text), "has_data_input": True,
            "starred": False, "repository_id": self.repository, "chunk_kind": kind, "preview": "\n".join(self.lines[start - 1 : min(end, start - 1 + PREVIEW_LINES)]),
            "source_hash": hashlib.sha256(span.encode()).hexdigest()[:12], "leading_comment": "", "calls": self.calls(nodes),
        }
        self.rows.append(row | more)

    def scan(self) -> list[dict]:
        self._statements(self.tree.body, "", False)
        return self.rows

    def _statements(self, body: list[ast.stmt], owner: str, nested: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._function(node, owner, nested)
            elif isinstance(node, ast.ClassDef) and not node.name.startswith("_"):
                self._statements(node.body, node.name, False)
        if not owner:
            self._blocks([n for n in body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))])

    def _function(self, node: ast.FunctionDef, owner: str, nested: bool) -> None:
        doc = ast.get_docstring(node) or ""
        a = node.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs]
        notes = {x.arg: ast.unparse(x.annotation) for x in every if x.annotation}
        typed = bool(notes) or node.returns is not None
        tagged = bool(tags_of(node.name))
        wanted = not re.fullmatch("__.*__", node.name) and (bool(doc) or (typed and not node.name.startswith("_") and not nested) or (nested and tagged))
        if wanted:
            positional = [*a.posonlyargs, *a.args]
            defaults = dict(zip((x.arg for x in positional[len(positional) - len(a.defaults) :]), a.defaults, strict=True)) | {x.arg: d for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d}
            args = [{"name": x.arg, "annotation": notes.get(x.arg, ""), "default": ast.unparse(defaults[x.arg]) if x.arg in defaults else "", "has_default": x.arg in defaults} for x in every]
            tags = tags_of(" ".join([node.name, doc]))
            self._add(
                "method" if owner else "function", node.name, ".".join(x for x in (self.module, owner, node.name) if x), node.lineno, node.end_lineno, node.body, docstring=doc, args=args,
                return_annotation=ast.unparse(node.returns) if node.returns else "", class_name=owner, has_data_input=takes_data(args, notes), starred=bool(doc and typed and tags), leading_comment=self._comment_above(node.lineno), tags=tags,
            )
        inner = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        for n in inner:
            self._function(n, owner, True)
        if not wanted:
            self._blocks([n for n in node.body if n not in inner])

    def _science(self, nodes: list[ast.stmt]) -> bool:
        return any(c.split(".")[0] in SCIENCE for c in self.calls(nodes, 0))

    def _blocks(self, body: list[ast.stmt]) -> None:
        """Runs led by a comment, then compound statements, then runs of statements between blank lines; overlaps go."""
        taken: list[tuple[int, int]] = []

        def offer(nodes: list[ast.stmt], least: int, comment: str = "") -> None:
            start, end = nodes[0].lineno, nodes[-1].end_lineno
            size = end - start + 1
            overlap = sum(max(0, min(end, b) - max(start, a) + 1) for a, b in taken)
            if size > MAX_LINES or overlap * 2 >= size:
                return
            has_call = any(isinstance(x, ast.Call) for n in nodes for x in ast.walk(n))
            if not (size >= MIN_LINES or self._science(nodes) or (comment and tags_of(comment))) or len(nodes) < least or not has_call:
                return
            taken.append((start, end))
            span = "\n".join(self.lines[start - 1 : end])
            name = "chunk_" + hashlib.sha256(span.encode()).hexdigest()[:12]
            self._add("block", name, f"{self.module}:{start}-{end}", start, end, nodes, leading_comment=comment)

        runs: list[list[ast.stmt]] = []
        for n in body:
            gap = not runs or n.lineno - runs[-1][-1].end_lineno > 1 or self._comment_above(n.lineno)
            if gap or isinstance(n, (ast.If, ast.For, ast.With)):
                runs.append([n])
            else:
                runs[-1].append(n)
        for run in runs:
            if comment := self._comment_above(run[0].lineno):
                offer(run, 1, comment)
        for n in body:
            if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith)):
                if n.end_lineno - n.lineno + 1 > MAX_LINES:
                    self._blocks(n.body)
                else:
                    offer([n], 1)
        for run in runs:
            offer(run, 2)


#: imports that a file hands on its helpers by
MAX_IMPORTS = 32
IMPORTS = "module string, alias string, target string"


def relative_imports(source: str, module: str) -> list[tuple[str, str, str]]:
    """(module, alias, qualified name) of what a file imports by one or two leading dots; stars and the rest don't count."""
    out = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.ImportFrom) and node.level in (1, 2) and node.module:
            base = module.split(".")[: -node.level]
            out += [(module, a.asname or a.name, ".".join([*base, node.module, a.name])) for a in node.names if a.name != "*"]
    return out[:MAX_IMPORTS]


def inherit_calls(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """Chunks whose calls of imported helpers are replaced by the helpers' own calls, each call once, in order."""
    owner = chunks.select(F.col("qualified_name").alias("target"), F.col("calls").alias("theirs")).dropDuplicates(["target"])
    remote = imports.join(owner, "target").select("module", F.col("alias").alias("call"), "theirs")
    each = chunks.select("qualified_name", "module", F.posexplode("calls").alias("pos", "call")).join(remote, ["module", "call"], "left")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("theirs", F.array("call")).alias("c")))), lambda x: x["c"])
    new = each.groupBy("qualified_name").agg(F.array_distinct(F.flatten(lists)).alias("_calls"))
    out = chunks.join(new, "qualified_name", "left")
    return out.select(*(F.coalesce("_calls", "calls").alias("calls") if c == "calls" else F.col(c) for c in chunks.columns))


def readable(text: str, size: int) -> bool:
    """Neither too large nor minified."""
    lines = text.splitlines()
    return size <= MAX_FILE_BYTES and bool(lines) and not (len(lines) <= 2 and size > 8000) and not (len(lines) < 30 and size / len(lines) > 400)


def _sources(pdf: pd.DataFrame, root: str) -> Iterator[tuple[str, str]]:
    """Path and text of the files of a batch that are searched."""
    for path, content in zip(pdf["path"], pdf["content"], strict=True):
        path = path.removeprefix("file:").replace("//", "/")
        parts = os.path.relpath(path, root).split(os.sep)
        if any(p in SKIPPED or p.startswith(".") for p in parts[:-1]) or re.fullmatch(r"test_.*\.py|.*_test\.py", parts[-1]):
            continue
        try:
            text = bytes(content).decode("utf-8")
            ast.parse(text)
        except (UnicodeDecodeError, SyntaxError, ValueError):
            continue
        if readable(text, len(content)):
            yield path, text


def _imported(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [r for path, text in _sources(pdf, root) for r in relative_imports(text, module_of(path, root))]
        yield pd.DataFrame(rows, columns=["module", "alias", "target"])


def _files(batches: Iterator[pd.DataFrame], root: str, repository: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[dict] = [r for path, text in _sources(pdf, root) for r in FileScan(text, path, root, repository).scan()]
        yield pd.DataFrame(rows, columns=FIELDS)


def scan_tree(spark: SparkSession, root: str, repository: str = "") -> DataFrame:
    """The chunks of all Python files below a folder; at most MAX_PER_FILE a file (functions first) and MAX_CHUNKS in all."""
    root = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root).where(F.col("length") <= MAX_FILE_BYTES).select("path", "content")
    chunks = files.mapInPandas(lambda x: _files(x, root, repository), SCHEMA)
    chunks = inherit_calls(chunks, files.mapInPandas(lambda x: _imported(x, root), IMPORTS))
    order = F.when(F.col("chunk_kind") == "function", 0).when(F.col("chunk_kind") == "method", 1).otherwise(2)
    return capped(chunks.withColumn("_order", order), "source_path", ["_order", "lineno"], MAX_PER_FILE).orderBy("_order", "source_path", "lineno").limit(MAX_CHUNKS).drop("_order")


# Comments that are addressed to tools.
TOOL_COMMENT = re.compile(r"(!|/|-\*-|coding[:=]|pylint:|noqa|type:\s*ignore|fmt:|isort:|ruff:)", re.I)


def comments_of(source: str) -> list[str]:
    """The comments of a piece of source, as far as it can be read; those for tools don't count."""
    found = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            said = token.string.lstrip("#").strip() if token.type == tokenize.COMMENT else ""
            if said and not TOOL_COMMENT.match(said):
                found.append(said)
    except (tokenize.TokenError, SyntaxError):
        pass  # a preview may end anywhere
    return found


def assigned_names(source: str) -> list[str]:
    """The plain names that a piece of source assigns; none if it can't be parsed."""
    for text in (source, textwrap.dedent(source)):
        try:
            tree = ast.parse(text)
            break
        except (SyntaxError, ValueError):
            continue
    else:
        return []
    names: list[str] = []

    def take(target: ast.AST) -> None:
        if isinstance(target, ast.Name):
            names.append(target.id)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                take(x)

    for node in ast.walk(tree):
        for target in node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []:
            take(target)
    return names


def _said(preview: pd.Series) -> pd.DataFrame:
    text = preview.fillna("")
    return pd.DataFrame({"comments": text.map(lambda x: " ".join(comments_of(x))), "names": text.map(lambda x: " ".join(assigned_names(x)))})


def said_within(preview: Column) -> Column:
    """What a chunk's preview says: its comments, and the names that it assigns."""
    return F.pandas_udf(_said, "struct<comments:string,names:string>")(preview)


def capped(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def kind_counts(chunks: DataFrame) -> dict[str, int]:
    """Chunks of each kind, zeros included."""
    counts = {r.chunk_kind: r["n"] for r in chunks.groupBy("chunk_kind").agg(F.count("*").alias("n")).collect()}
    return {k: counts.get(k, 0) for k in ("function", "method", "block")}
