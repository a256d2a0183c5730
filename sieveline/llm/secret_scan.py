"""Secret scans: fixed patterns, and strings that a primed zstandard compressor finds new.

Base spans (kinds assign, access, hex) come from fixed patterns. The method adds kind novel: a run of 16 or more
characters of keys and encodings that starts near a sensitive word is a candidate. It is compressed together with the code around
it by a compressor whose dictionary holds identifiers and code words; what it adds to the compressed size, as a share
of its length, is its novelty. Natural words and identifiers are cheap for the dictionary and the context; keys aren't.

Defined cases: a null or empty text has no spans; very long texts are scanned whole; spans count code points, ends
exclusive; equal rows give equal results; a novel span never overlaps a base span; an empty table gives an empty
result; other columns of the input are not read, and a kept one with the name of a made one is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import as_fields, map_slices, quoted, table

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the base kinds. Letters of assign match in either case, ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Words of which one must stand in a text for assign, and before a candidate for novel.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|authorization|bearer|signature", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Parts of the sensitive words, of which one is in any of them.
_SENSITIVE_PARTS = ("passw", "passphrase", "secret", "token", "key", "credential", "authorization", "bearer", "signature")
NEAR, AROUND, LEAST_CANDIDATE = 48, 160, 16
#: 99 of 100 random keys of 20 characters or more lie above, and 6 to 7 of 100 identifiers, paths and names made of the dictionary's words and a digit (test_op9_calibration).
LEAST_NOVELTY = 0.75
TAIL = " configuration  "
#: Identifiers and code words that the compressor knows beforehand.
DICTIONARY = (
    "abstract argument array assert async await boolean break case catch char class client config configuration const constructor context continue "
    "controller database default define delete description development directory document double element else endpoint environment error example "
    "exception export extends false final float function general handler header identifier implements import index integer interface internal "
    "iterator label lambda length library listener local localhost manager message method model module namespace number object operator option "
    "organization package parameter password pattern placeholder private production property protected protocol provider public reference register "
    "repository request resource response return schema secret self sequence server service session setting static string struct super switch "
    "template test this throw timestamp token transaction true type undefined username value variable version virtual void volatile while yield "
    "api_key access_key secret_key private_key client_id client_secret auth_token bearer Authorization: Bearer Content-Type: application/json "
    "your_password_here change_me changeme example.com http:// https:// www. /usr/local/bin/ /home/user/ .json .yaml .properties .config "
    "the of and to in that is for with are this not have from which der die und des nicht eine einen les des que pour dans est una por para como "
)


class Novelty:
    """Measures what a string adds to the compressed size of its surroundings."""

    def __init__(self, dictionary: str = DICTIONARY) -> None:
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # The fast strategy with a target length leaves literals as they are, so what isn't matched costs a byte whatever its alphabet.
        how = zstandard.ZstdCompressionParameters(window_log=16, hash_log=14, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=how)

    def of(self, text: str, start: int, end: int) -> float:
        """Other copies of the string, or of a long part of it beside an equals sign, are blanked in the surroundings."""
        whole, far = text[start:end], AROUND + end - start
        before, after = text[max(0, start - far) : start], text[end : end + far]
        for part in (whole, *(p for p in whole.split("=") if len(p) >= LEAST_CANDIDATE)):
            before, after = before.replace(part, " " * len(part)), after.replace(part, " " * len(part))
        before, after = before[-AROUND:], after[:AROUND]
        size = lambda s: len(self.compressor.compress(s.encode()))
        # A compressor treats the last bytes apart, so both texts end in the same ones.
        return (size(before + after + whole + TAIL) - size(before + after + TAIL)) / max(1, len(whole))


_novelty: list[Novelty] = []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates in a sensitive context that don't compress and overlap no base span."""
    lower = text.lower()
    if not any(w in lower for w in _SENSITIVE_PARTS):
        return []
    if not _novelty:
        _novelty.append(Novelty())
    found, taken = [], 0
    # Base spans by start, with the largest end so far: one search tells whether any overlaps.
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    for word in _SENSITIVE.finditer(text):
        for m in _CANDIDATE.finditer(text, max(taken, word.end()), min(len(text), word.end() + NEAR + LEAST_CANDIDATE)):
            start, end = m.start(), _CANDIDATE.match(text, m.start()).end()
            taken = max(taken, end)
            before = bisect_left(starts, end)
            if (before and reach[before - 1] > start) or not re.search(r"[0-9]", text[start:end]) or not re.search(r"[A-Za-z]", text[start:end]):
                continue
            if _novelty[0].of(text, start, end) >= LEAST_NOVELTY:
                found.append((start, 3, end))
    return found


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text and all its spans, in order."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``id_col``, the columns in ``keep``, counts by kind, a digest of the base spans, and all spans."""
    names = list(dict.fromkeys([id_col, *keep]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t) for t in batch.column(text_col).to_pylist()]
        columns = {c: batch.column(c) for c in names}
        for k, kind in enumerate(KINDS):
            columns[f"n_{kind}"] = pa.array([sum(x[1] == k for x in every) for _, every in found], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        columns["spans"] = pa.array([_joined(every) for _, every in found], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_slices(df.select(*quoted(*dict.fromkeys([*names, text_col]))), text_col, as_fields(df, names, f"{counts}, base_sha256 string, spans string"), work)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every whole text."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact(df: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with each span of the text replaced by ``[kind]``, and ``chars_col`` (if ``df`` has it) counted anew where a text changed."""
    counted = chars_col in df.columns

    def clean(text: str | None) -> str | None:
        found = spans(text)[1]
        if not found:
            return text
        out, at = [], 0
        for start, kind, end in found:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.column(text_col).to_pylist()
        after = [clean(t) for t in before]
        columns = {c: batch.column(c) for c in batch.schema.names}
        columns[text_col] = pa.array(after, batch.schema.field(text_col).type)
        if counted:
            counts = columns[chars_col].to_pylist()
            columns[chars_col] = pa.array([n if a is b else len(a) for n, a, b in zip(counts, after, before, strict=True)], columns[chars_col].type)
        return pa.RecordBatch.from_pydict(columns)

    return map_slices(df, text_col, df.schema, work)
