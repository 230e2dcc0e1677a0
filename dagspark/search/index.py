"""Discovery of code libraries and search in them."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..functions.text import data_kinds, intent_tokens, tokens
from ..sources.tables import load_repositories
from . import rank, scan
from .store import SearchIndex

_SPAN = re.compile(r"^(?P<path>.+):(?P<start>\d+)-(?P<end>\d+)$")
# Kinds of chunks.
CHUNK_KINDS = ("function", "method", "block")
# Parameter types of annotations.
PARAM_TYPES = {"int": "number", "float": "number", "bool": "boolean", "str": "string", "Path": "file"}


def roots(given: list[str] | None, workspace: str = ".", registry: str | None = None) -> list[str]:
    """The given folders, else the workspace's src and the paths of the registered repositories."""
    if given:
        return [os.path.abspath(os.path.expanduser(r)) for r in given]
    src = os.path.join(os.path.abspath(os.path.expanduser(workspace)), "src")
    known = [e["path"] for e in load_repositories(registry)] if registry else []
    return [r for r in dict.fromkeys([src, *map(os.path.abspath, known)]) if r != src or os.path.isdir(src)]


def chunks(spark: SparkSession, folders: list[str]) -> tuple[DataFrame | None, list[dict]]:
    errors = [{"code": "missing_library_root", "root": r} for r in folders if not os.path.isdir(r)]
    found = None
    for r in folders:
        if os.path.isdir(r):
            one = scan.scan_tree(spark, r)
            found = one if found is None else found.unionByName(one)
    return found, errors


def node_kind(row: dict) -> dict:
    """The description of a node that runs a discovered chunk."""
    params = [{"name": a["name"], "param_type": PARAM_TYPES.get(a["annotation"], "string"), "default_value": a["default"] or None, "value": None, "description": "", "options": None} for a in row["args"] if a["has_default"]]
    inputs = [{"name": "data", "label": "data", "data_kind": "any", "required": True, "description": ""}] if row["has_data_input"] else []
    return {"kind": "repo." + row["qualified_name"], "palette_label": row["name"], "in_palette": False, "node_type": "custom_code", "label": row["name"], "description": row["docstring_first_line"] or row["leading_comment"], "metadata": {"has_data_input": row["has_data_input"], "chunk_kind": row["chunk_kind"]}, "parameters": params, "ports": {"inputs": inputs, "outputs": [{"name": "output", "label": "output", "data_kind": "any", "required": True, "description": ""}]}}


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the last in order: of equal entries the last counts."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in others), F.max(order).alias(order))


def totals(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """How many rows each of the kinds has, those without any too."""
    spine = df.sparkSession.createDataFrame([(k,) for k in kinds], f"{column} string")
    return spine.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def discover(spark: SparkSession, folders: list[str]) -> dict:
    """All chunks (at most scan.MAX_CHUNKS a folder) as rows and node kinds; the last of equal kinds counts."""
    found, errors = chunks(spark, folders)
    rows = [r.asDict(recursive=True) for r in found.collect()] if found is not None else []
    rows = list({r["qualified_name"]: r for r in rows}.values())
    counts = {k: sum(r["chunk_kind"] == k for r in rows) for k in CHUNK_KINDS}
    return {"roots": folders, "functions": rows, "kinds": [node_kind(r) for r in rows], "count": len(rows), "chunk_counts": counts, "errors": errors}


def parse_span(text: str) -> tuple[str, int, int] | None:
    """PATH:START-END, lines from 1, both included."""
    m = _SPAN.match(text or "")
    if not m or int(m["end"]) < int(m["start"]) or int(m["start"]) < 1:
        return None
    return m["path"], int(m["start"]), int(m["end"])


def seed(found: DataFrame, span: str | None, kind: str | None) -> dict | None:
    """The chunk that a span or a kind names: the exact span, else the shortest that overlaps it, then the closest."""
    if kind:
        row = found.where((F.concat(F.lit("repo."), F.col("qualified_name")) == kind) | (F.col("qualified_name") == kind)).limit(1).collect()
        return row[0].asDict(recursive=True) if row else None
    where = parse_span(span or "")
    if where is None:
        return None
    path, start, end = where
    same = (F.col("source_path") == os.path.abspath(path)) | F.endswith(F.col("source_path"), F.lit("/" + path.lstrip("./")))
    exact = (F.col("lineno") == start) & (F.col("end_lineno") == end)
    row = found.where(same & (F.col("lineno") <= end) & (F.col("end_lineno") >= start)).orderBy(F.when(exact, 0).otherwise(1), F.col("end_lineno") - F.col("lineno"), F.abs(F.col("lineno") - start)).limit(1).collect()
    return row[0].asDict(recursive=True) if row else None


def code_calls(query: str) -> list[str]:
    """The calls of a query that is Python code; none if it isn't."""
    if not rank.is_code(query):
        return []
    try:
        one = scan.FileScan(query, "query.py", ".")
    except SyntaxError:
        return []
    return one.calls(one.tree.body)


def features(found: DataFrame) -> DataFrame:
    """id, file, digest, what is said of a chunk in words (its comments and the names that it assigns too), its calls and kinds."""
    title = F.when(F.col("chunk_kind") == "block", F.lit("")).otherwise(F.concat_ws(" ", "name", "class_name"))
    found = found.withColumn("said", scan.said_within(F.col("preview")))
    intent = F.concat_ws(" ", title, "docstring", "docstring_first_line", "leading_comment", "said.comments", "said.names")
    hints = F.concat_ws(" ", F.when(F.col("chunk_kind") != "block", F.col("name")), "docstring", "leading_comment", "said.comments", F.array_join("tags", " "), F.array_join("calls", " "), "module")
    text = F.concat_ws(" ", "name", "module", "docstring", "leading_comment", F.array_join("tags", " "), F.array_join("calls", " "))
    return found.select(
        F.col("qualified_name").alias("id"), F.col("source_path").alias("file"), F.sha2(F.concat_ws(":", "source_hash", F.array_join("calls", " "), "leading_comment"), 256).alias("digest"),
        intent_tokens(intent).alias("intent"), "calls", data_kinds(tokens(hints)).alias("kinds"), F.col("starred"), tokens(text).alias("words"), tokens(F.col("name")).alias("name_words"), "tags",
    )


def similar(spark: SparkSession, folders: list[str], query: str = "", span: str | None = None, kind: str | None = None, limit: int = 20, simple: bool = False, store: str | None = None) -> dict:
    """The best chunks for a text, a span of source or a discovered kind.

    The chunks' index is kept in the folder `store`, of which later calls write
    changed files only; without one it is made for this call.
    """
    found, errors = chunks(spark, folders)
    if found is None:
        return {"hits": [], "errors": errors, "corpus_size": 0, "candidates_examined": 0, "used_fallback": False}
    found = found.persist()
    held = SearchIndex(spark, store or f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}")
    try:
        start = seed(found, span, kind) if span or kind else None
        if (span or kind) and start is None:
            return {"hits": [], "errors": errors, "corpus_size": found.count(), "candidates_examined": 0, "used_fallback": False}
        held.update(features(found))
        if start:
            query = " ".join([start["name"] if start["chunk_kind"] != "block" else "", start["docstring"] or "", start["leading_comment"] or ""])
        one = spark.range(1).select(intent_tokens(F.lit(query)).alias("t"), tokens(F.lit(query)).alias("w"), data_kinds(tokens(F.lit(query))).alias("k")).first()
        calls = list(start["calls"]) if start else code_calls(query) or rank.expand(query)
        other = F.col("id") != F.lit(start["qualified_name"] if start else "")
        size, examined = held.size(), held.candidates(rank.fused_keys(spark, one.t, calls)).where(other).count()
        fallback = simple or not examined
        # one more, as the seed itself may be among them
        ranked = rank.search_simple(held, one.w, limit + 1) if fallback else rank.search_fused(held, one.t, calls, one.k, limit + 1)
        place = found.select(F.col("qualified_name").alias("id"), "name", "chunk_kind", "source_path", "lineno", "end_lineno", "docstring_first_line")
        hits = [r.asDict() for r in ranked.where(other).join(place, "id").orderBy(F.desc("score"), "id").limit(limit).collect()]
        return {"hits": hits, "errors": errors, "corpus_size": size, "candidates_examined": size if fallback else examined, "used_fallback": fallback}
    finally:
        found.unpersist()
        if not store:
            held.delete()
