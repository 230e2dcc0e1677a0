"""Operator 1: SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is parsed here. From it the normaliser (its compiled
character map, white-space rules and the metaspace marker), the model (unigram
scores, or BPE merges in the order of the pieces' scores) and byte fallback are
rebuilt as a tokenizers.Tokenizer, which encodes and decodes batches in several
threads. Where no piece goes over from one word to the next, a batch's distinct
words are encoded and decoded, and those a task has met are remembered. encode()
verifies the ids and texts of every row against the sentencepiece library, which
gets whole texts, unless it is asked for a share of them.

Null texts have null ids and stay null; empty texts have no ids and decode to
''. A text decodes to itself, but that the marker U+2581 becomes a space and
that what a model's normaliser changes stays changed. Long texts are encoded
whole. Other columns pass through, whatever their names; repeated rows each
give a row, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import documents

MODEL_PATH = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: texts that are encoded at once, by characters
BATCH_CHARS = 1 << 20
#: words that a task remembers, and up to which length; words that are encoded together, by characters
MEMO, MEMO_CHARS, TOGETHER_CHARS = 200_000, 4096, 1 << 15
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
THREADS = 2
#: the share of texts whose ids and decoded text are also compared with the sentencepiece library's: one in so many
VERIFY_EVERY = 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


class SentencePieceModel:
    """A parsed model file: pieces (text, score, type), model type and normaliser settings."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        self.mark_as_suffix = bool(trainer.get(24, 0))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.one_space = bool(norm.get(4, 1))
        self.escape_spaces = bool(norm.get(5, 1))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.mark_as_suffix or not self.escape_spaces:
            raise ValueError("models with suffix markers or plain spaces aren't supported")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join into a piece, in the order in which BPE joins them."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        pairs = []
        for i, (p, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, UNUSED):
                cuts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
                pairs += [(-score, i, rank[a], rank[b], a, b) for a, b in cuts]
        return [(a, b) for *_, a, b in sorted(pairs)]

    def tokenizer(self, strip: bool = True) -> Tokenizer:
        """The tokenizer; without strip, decoding keeps the space that the normaliser put before the text."""
        vocab = [(p, s) for p, s, _ in self.pieces]
        steps: list = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.one_space:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        steps.append(normalizers.Replace(" ", MARK))
        if self.kind == BPE:
            model = models.BPE({p: i for i, (p, _) in enumerate(vocab)}, self.merges(), unk_token=vocab[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram(vocab, self.unk, self.byte_fallback)
        made = Tokenizer(model)
        made.normalizer = normalizers.Sequence(steps)
        if not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL):
            # no piece goes over from a word to the marker after it, so words can be encoded one by one and cached
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix and strip:
            parts.append(decoders.Strip(" ", 1, 0))
        made.decoder = decoders.Sequence(parts)
        return made


def _spaced(text: str) -> str:
    """The text's words, without the marker before each but with further ones, and single spaces between them."""
    return " ".join(w[1:] for w in _WORD.findall(f"{MARK}{text.replace(' ', MARK)}"))


class Codec:
    """Encodes and decodes batches of texts with the tokenizer rebuilt from a model file."""

    def __init__(self, data: bytes) -> None:
        model = SentencePieceModel(data)
        self.tokenizer = model.tokenizer()
        #: whether a text's ids and decoded text are those of its words, one after another
        self.by_words = self.tokenizer.pre_tokenizer is not None and model.dummy_prefix and not model.charsmap and not model.one_space
        self.of_words = model.tokenizer(strip=False) if self.by_words else None
        self._forget()

    def _forget(self) -> None:
        """Know no words: their numbers; by number their lengths in ids and first ids in `ids`, and their texts."""
        self.number: dict[str, int] = {}
        self.lengths, self.firsts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.texts = pa.array([], pa.large_string())

    def _learn(self, words: list[str]) -> None:
        """Number, encode and decode new words (each without the marker before it), many of them in one string, whose pre-tokens they are."""
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        parts, part, chars = [], [], 0
        for w in words:
            alone = not w.strip(MARK)  # these would run together with the next marker
            if part and (alone or chars >= TOGETHER_CHARS):
                parts.append(part)
                part, chars = [], 0
            part.append(w)
            chars += TOGETHER_CHARS if alone else len(w) + 1
        parts += [part] * bool(part)
        # the normaliser puts the first marker before each string, but not before an empty one; so a word stands before what is alone
        alone = [not p[0].strip(MARK) for p in parts]
        done = self.of_words.encode_batch([f"a{MARK}{p[0]}" if x else MARK.join(p) for p, x in zip(parts, alone, strict=True)], add_special_tokens=False)
        ids = [x.ids for x in done]
        for i, (x, y) in enumerate(zip(done, alone, strict=True)):
            if y:
                ids[i] = ids[i][x.word_ids.count(0) :]
        lengths, texts = [], []
        for p, x, y, i, back in zip(parts, done, alone, ids, self.of_words.decode_batch(ids, skip_special_tokens=False), strict=True):
            lengths.append(np.array([len(i)]) if y else np.bincount(np.array(x.word_ids, np.int64), minlength=len(p)))
            decoded = back.split(" ")
            if len(decoded) == len(p) + 1:
                texts += [f" {t}" for t in decoded[1:]]
            else:  # words that hold spaces
                ends = np.cumsum(lengths[-1]).tolist()
                texts += self.of_words.decode_batch([i[a:b] for a, b in zip([0, *ends], ends, strict=False)], skip_special_tokens=False)
        self.texts = pa.concat_arrays([self.texts, pa.array(texts, pa.large_string())])
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([self.ids, *(np.array(i, np.int32) for i in ids)])

    def both_ways(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The texts' ids one after another, how many each text has, and what each text's decode to."""
        if not self.by_words:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64), self.decode(each)
        plain = [_spaced(t) if "  " in t or t[:1] == " " or MARK in t else t or None for t in texts]
        words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        ends = np.asarray(words.offsets)
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if new and self.number and len(self.number) + len(new) > MEMO:
            self._forget()
            new = distinct
        if new:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)] if distinct else np.zeros(0, np.int64)
        long = self.lengths[number]
        sums = np.concatenate([[0], np.cumsum(long)])
        within = np.arange(sums[-1]) - np.repeat(sums[:-1], long)
        ids = self.ids[np.repeat(self.firsts[number], long) + within]
        decoded = pc.binary_join(pa.LargeListArray.from_arrays(ends, self.texts.take(pa.array(number))), pa.scalar("", pa.large_string()))
        if max(map(len, new), default=0) > MEMO_CHARS:
            self._forget()  # such words would fill the memory
        return ids, np.diff(sums[ends]), [t[1:] for t in decoded.to_pylist()]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, counts, _ = self.both_ways(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_loaded: dict[str, Codec] = {}


def load(path: str = MODEL_PATH, threads: int = THREADS) -> Codec:
    """The codec of a model file; parsed once in each process, whose threads are set at the first use."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            _loaded[path] = Codec(f.read())
    return _loaded[path]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about BATCH_CHARS characters."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, verify_every: int) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    library = None
    for whole in batches:
        for start, stop in _groups(whole.column(whole.num_columns - 1).to_pylist()):
            batch = whole.slice(start, stop - start)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids, counts, decoded = codec.both_ways([t or "" for t in texts])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            parity: list[bool | None] = [None] * len(texts)
            chosen = [i for i, t in enumerate(texts) if t is not None and verify_every and zlib.crc32(t.encode()) % verify_every == 0]
            if chosen:
                if library is None:
                    import sentencepiece

                    library = sentencepiece.SentencePieceProcessor(model_file=path)
                theirs = library.encode([texts[i] for i in chosen], num_threads=1)
                back = library.decode(theirs, num_threads=1)
                for i, x, y in zip(chosen, theirs, back, strict=True):
                    parity[i] = array("i", x).tobytes() == ids[ends[i] : ends[i + 1]].tobytes() and y == decoded[i]
                del theirs, back
            here = [t is not None for t in texts]
            missing = pa.array([not h for h in here], pa.bool_())
            columns = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=missing),
                pa.array([x if h else None for x, h in zip(decoded, here, strict=True)], pa.string()),
                pa.array([x == t if h else None for x, t, h in zip(decoded, texts, here, strict=True)], pa.bool_()),
                pa.array(parity, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *_ADDED])


_ADDED = ("ids", "decoded", "round_trip", "parity")


def encode(docs: DataFrame, text: str = "text", path: str = MODEL_PATH, verify_every: int = VERIFY_EVERY) -> DataFrame:
    """docs with ids, decoded, round_trip (the decoded text is the text) and parity added.

    parity is null but for the texts whose crc32 is divisible by verify_every
    (1: all, 0: none); for those it tells whether the sentencepiece library has
    the same ids and decodes them to the same text. Columns of docs that are
    named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in _ADDED]
    # the others travel as one struct under a name of our own, the text beside it
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), docs[f"`{text}`"].cast("string").alias("text_"))
    types = f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, decoded string, round_trip boolean, parity boolean"
    out = packed.mapInArrow(lambda x: _encoded(x, path, verify_every), types)
    return out.select("row.*", *_ADDED)


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """encoded(..., ids array<int>) with a column decoded; null ids decode to null."""
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            ids = batch["ids"].to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t if x is not None else None for t, x in zip(texts, ids, strict=True)], pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema)
    return encoded.select(*kept).mapInArrow(run, f"{fields}, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip", "parity")


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
