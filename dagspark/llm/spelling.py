"""Operator 11: spelling variants, found in a forward and a reversed sorted dictionary.

Words are counted over the whole corpus: each task sums the words of its texts,
Spark sums the tasks. Two words are near if they differ by one inserted,
deleted or replaced code point. One such edit leaves a half of the shorter word
as it is: with `length` code points of that word undecided, either their first
or their last length // 2 are shared. So the dictionary is written twice, keyed
by shared beginnings (forward) and by shared ends (reversed), sorted by key
over ranges, and scanned: near words stand in one block.

A block of more than BLOCK words is subdivided before the scan: its words agree
in a beginning and an end, so the rule holds for what lies between them, and
the block falls into smaller ones by the first and by the last half of that.
Blocks that can't be divided differ in one code point, which bounds them by the
alphabet. Every pair has one course of halves in which it is found, given by
its common beginning, so it is reported once however many blocks hold it.

A word's form is its most frequent near word (ties: the smallest in code-point
order) if that is at least FORM times as frequent. Forms are followed to the
last by pointer doubling; frequencies grow along them, so there are no circles.

A null doc_id counts as the empty string in the digest that garbles a run; null
and empty texts have no words; repeated rows count again. An empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, documents, forget, stored

LEAST_LENGTH, LEAST_COUNT, FORM, GARBLED = 6, 5, 5, 199
#: words of a block that are scanned together; larger ones are subdivided
BLOCK = 64
#: distinct words that a task counts before it hands them on
HELD = 1 << 17
_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def words_of(doc_id: str, text: str) -> Counter[str]:
    """The words of a text that are long enough, runs whose digest says so without one of their code points."""
    found: Counter[str] = Counter()
    at = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUNS.findall(text.encode().translate(LOWER_TABLE).decode())).items():
        h = zlib.crc32(run.encode(), at)
        if h % GARBLED == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            if text.is_valid:
                held.update(words_of(doc_id.as_py() or "", text.as_py()))
            if len(held) >= HELD:
                yield batch_of()
                held.clear()
    yield batch_of()


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n), stored: the words of docs(doc_id, text) that are long and frequent enough."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "dictionary")


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of each row's block: what its words share."""
    start, end = F.substring(F.col("word"), F.lit(1), F.col("p")), F.expr("right(word, s)")
    return rows.withColumn("key", F.concat_ws(" ", F.col("length").cast("string"), "course", start, end))


def _half() -> Column:
    return F.expr("(length - p - s) div 2").cast("int")


def _halved(rows: DataFrame) -> DataFrame:
    """Every row in the two blocks into which its own is divided: f by the first half, r by the last."""
    forward = rows.select("word", "n", "length", F.concat("course", F.lit("f")).alias("course"), (F.col("p") + _half()).alias("p"), "s")
    reverse = rows.select("word", "n", "length", F.concat("course", F.lit("r")).alias("course"), "p", (F.col("s") + _half()).alias("s"))
    return _keyed(forward.unionByName(reverse))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (key, word, n, length, course, p, s) in blocks of at most `block` words, or that can't be divided.

    length is that of the shorter word of a pair, so a word stands with words of
    its own length and with those one longer, and with those one shorter.
    """
    size = F.char_length("word").cast("int")
    lengths = F.when(size > LEAST_LENGTH, F.array(size, size - 1)).otherwise(F.array(size))
    whole = words.select("word", "n", F.explode(lengths).alias("length"), F.lit("").alias("course"), F.lit(0).alias("p"), F.lit(0).alias("s"))
    rows, done = stored(_halved(whole), "half_blocks"), []
    while True:
        large = rows.where(_half() > 0).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block)
        large = stored(large.select("key"), "large_blocks")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = stored(_halved(rows.join(large, "key", "left_semi")), "half_blocks")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _course(common: int, length: int, steps: int) -> str:
    """The halves in which a pair is found whose words share their first `common` code points."""
    p = s = 0
    course = ""
    for _ in range(steps):
        half = (length - p - s) // 2
        if common >= p + half:
            p += half
            course += "f"
        else:
            s += half
            course += "r"
    return course


def one_edit(a: str, b: str, p: int = 0) -> int | None:
    """The length of the common beginning if b, as long as a or one longer, is one edit away from a; else None. They share p code points."""
    while p < len(a) and a[p] == b[p]:
        p += 1
    same = a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]
    return p if same and a != b else None


def _near_in(block: list[tuple[str, int]], length: int, course: str, p: int) -> Iterator[tuple[str, str, int]]:
    short = [x for x in block if len(x[0]) == length]
    for i, (a, n) in enumerate(short):
        for b, m in short[i + 1 :] + [x for x in block if len(x[0]) > length]:
            common = one_edit(a, b, p)
            if common is not None and _course(common, length, len(course)) == course:
                yield a, b, m
                yield b, a, n


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words within each block of rows that are sorted by key."""
    key, head, block = None, None, []
    found: list[tuple[str, str, int]] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("key", "word", "n", "length", "course", "p")), strict=True):
            if row[0] != key:
                if len(block) > 1:
                    found += _near_in(block, *head)
                key, head, block = row[0], row[3:], []
            block.append(row[1:3])
        yield _pairs(found)
        found = []
    if len(block) > 1:
        found += _near_in(block, *head)
    yield _pairs(found)


def _pairs(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "n"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, n): every ordered pair of near words of words(word, n), n being the frequency of near."""
    ordered = blocks(words, block).repartitionByRange("key").sortWithinPartitions("key", "word")
    return ordered.select("key", "word", "n", "length", "course", "p").mapInArrow(_scanned, "word string, near string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), stored, of forms(word, form): forms followed to the last."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = step.where("moved").isEmpty()
        forget(at)
        at = step.select("word", "root")
        at.stored_at = step.stored_at
        if done:
            return at


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of words(word, n)."""
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best"))
    often = -F.col("best.minus") >= FORM * F.col("n")
    formed = words.join(near, "word", "left").select("word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(often, -F.col("best.minus")).alias("form_n"))
    formed = stored(formed, "forms")
    root = roots(formed.where("form is not null"))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(dictionary(documents(spark, sf_dir)))


QUERIES = {"op11_spelling": op11_spelling}
#: near words in SQL: equal after one code point is left out at the same place, or at any place of the longer one
ORACLE_SQL = {
    "op11_spelling": f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..')],
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) AS h
  FROM runs, tab),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % {GARBLED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, CASE WHEN near_n >= {FORM} * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {FORM} * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, last, depth) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)"""
}
