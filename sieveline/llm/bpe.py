"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary is a file of ranks (base64 of a token's bytes, a space, its id on each line). Each byte maps to one
printable character, so the library's BPE model works on strings; merges follow from the ranks, since the two parts of
a token are what lower ranks make of its bytes. Decoding maps ids back to bytes, so a character that is split
over tokens comes back whole.

Defined cases: a null text counts as empty (no ids); an empty text has no ids; texts of any length are encoded whole;
equal rows give equal results; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import map_slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks of text whose ids a worker remembers.
CACHE_ENTRIES = 300_000
#: No match of the pattern goes from a visible character to white space, so texts can be cut before such a space.
_CUT = re.compile(r" (?=\S)")
_coders: dict[str, "Coder"] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file, read where the driver runs."""
    with open(path, "rb") as f:
        return f.read()


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """What merges of lower ranks make of a token's bytes."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def build_tokenizer(rank_file: bytes) -> str:
    """The library's tokenizer for a rank file, as JSON. It takes one match of the pattern at a time."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
    shown = byte_characters()
    text = lambda raw: "".join(shown[b] for b in raw)
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        if len(token) > 1:
            parts = _parts(token, ranks)
            if len(parts) != 2:
                raise ValueError(f"token {ranks[token]} doesn't follow from two tokens of lower rank")
            merges.append((text(parts[0]), text(parts[1])))
    return Tokenizer(models.BPE(vocab={text(k): v for k, v in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)).to_str()


class Memo(dict):
    """Remembers up to a number of values; what comes later is held for one round only."""

    def __init__(self) -> None:
        super().__init__()
        self.round: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        return self.round[key]

    def add(self, values: dict[str, bytes]) -> None:
        self.round = values
        if len(self) + len(values) <= CACHE_ENTRIES:
            self.update(values)


class Coder:
    """Encodes and decodes with one vocabulary; ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str, pattern: str) -> None:
        gc.set_threshold(100_000, 50, 50)  # nothing here makes cycles, and the memos are large
        model = json.loads(tokenizer_json)["model"]
        self.tokenizer = Tokenizer(models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], ignore_merges=True, cache_capacity=0))
        self.matches = regex.compile(pattern).findall
        self.cuts = pattern == public_tokenizers.PATTERN  # of another pattern nothing is known, so its texts stay whole
        self.first, self.later, self.pieces = Memo(), Memo(), Memo()
        self.shown = dict(enumerate(byte_characters()))
        of_char = {c: b for b, c in self.shown.items()}
        self.table = [b""] * (max(model["vocab"].values(), default=-1) + 1)
        for token, i in model["vocab"].items():
            self.table[i] = bytes(of_char[c] for c in token)
        self.lengths = np.array([len(x) for x in self.table], dtype=np.int64)

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of matches: byte 255, which UTF-8 lacks, parts them while bytes are mapped; byte lengths part the ids."""
        out: dict[str, bytes] = {}
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            raw = [p.encode() for p in part]
            mapped = b"\xff".join(raw).decode("latin1").translate(self.shown).split(self.shown[255])
            made = self.tokenizer.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids
            ids = np.array(made, dtype="<u4")
            stops = 4 * np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(r) for r in raw]), side="left") + 4
            joined, start = ids.tobytes(), 0
            for piece, stop in zip(part, stops.tolist(), strict=True):
                out[piece] = joined[start:stop]
                start = stop
        return out

    def _learn(self, known: Memo, chunks: list[str], prefix: str) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        found = [self.matches(prefix + c) for c in new]
        pieces = self.pieces
        pieces.add(self._encode_pieces([p for p in dict.fromkeys(chain.from_iterable(found)) if p not in pieces]))
        known.add({c: b"".join([pieces[p] for p in f]) for c, f in zip(new, found, strict=True)})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of little-endian unsigned 32-bit integers."""
        cut = [_CUT.split(t) if self.cuts else [t] for t in texts]
        self._learn(self.first, [c[0] for c in cut], "")
        self._learn(self.later, [x for c in cut for x in c[1:]], " ")
        first, later = self.first, self.later
        return [first[c[0]] + b"".join([later[x] for x in c[1:]]) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; one that the vocabulary lacks is an error."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.table):
            raise ValueError("an id that the vocabulary lacks")
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each token starts and ends in the text, in code points; a part of a character counts as that character."""
        ends = np.cumsum(self.lengths[ids])
        leads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        starts = ends - self.lengths[ids]
        inside = (np.frombuffer(raw + b"\0", np.uint8)[starts] & 0xC0) == 0x80
        return leads[starts] - inside, leads[ends]


def coder(spec: tuple[str, str]) -> Coder:
    """A worker's coder for a vocabulary and a pattern, made once."""
    key = hashlib.sha256("\0".join(spec).encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(*spec)
    return _coders[key]


def _spec(df: DataFrame, vocabulary: str | None, pattern: str | None) -> Broadcast:
    """The tokenizer and the pattern for the workers; a vocabulary file bounds their size."""
    made = build_tokenizer(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    return df.sparkSession.sparkContext.broadcast((made, pattern or public_tokenizers.PATTERN))


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """Rows of ``id_col``, ``ids`` (array of int) and, if asked for, ``starts`` and ``ends`` of the tokens in code points."""
    spec = _spec(df, vocabulary, pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = coder(spec.value), _texts(batch.column(text_col))
        ids = [np.frombuffer(x, "<u4") for x in c.encode(texts)]
        columns = {id_col: batch.column(id_col), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))}
        if offsets:
            spans = [c.offsets(x, t.encode()) for x, t in zip(ids, texts, strict=True)]
            for name, k in (("starts", 0), ("ends", 1)):
                columns[name] = pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return map_slices(df.select(id_col, text_col), text_col, f"`{id_col}` {kind}, ids array<int>{extra}", work, 1 << 20)


def decode(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of ``id_col`` and ``decoded`` (binary), the bytes that the ids stand for; null ids count as none, in an array too; an id that the vocabulary lacks is an error."""
    spec = _spec(df, vocabulary, pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = coder(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [c.decode(np.asarray([i for i in x or [] if i is not None], dtype=np.int64)) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_pydict({id_col: part.column(id_col), "decoded": pa.array(rows, pa.binary())})

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``exact`` (bytes came back equal); with ``keep`` also ``ids``."""
    spec = _spec(df, vocabulary, pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = coder(spec.value), _texts(batch.column(text_col))
        rows = []
        for raw, text in zip(c.encode(texts), texts, strict=True):
            ids = np.frombuffer(raw, "<u4")
            back = c.decode(ids)
            rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode(), ids.astype(np.int32) if keep else None))
        columns = {id_col: batch.column(id_col), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string()), "exact": pa.array([r[3] for r in rows], pa.bool_())}
        if keep:
            columns["ids"] = pa.array([r[4] for r in rows], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    extra = ", ids array<int>" if keep else ""
    return map_slices(df.select(id_col, text_col), text_col, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean{extra}", work, 1 << 20)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
