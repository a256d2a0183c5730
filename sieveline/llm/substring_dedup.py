"""Removal of repeated substrings, keeping the first copy, by longest previous factors in suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. A suffix's longest
previous factor is the longest prefix, up to ``LENGTH`` bytes, that it shares with a suffix of a smaller document. In suffix
order that is its longer match with two neighbours: the nearest before it of a smaller document, and the nearest after it.
Suffixes are sorted by ranks of 8, 16, 32 and ``LENGTH`` bytes, which tell the lengths of matches too.

One suffix array of all texts would be no use on a cluster, so strings that can be equal are brought together first:

1. Each string has an anchor, the smallest hash of its substrings of ``GRAM`` bytes; equal strings have equal anchors.
   Consecutive strings with one anchor form a run. Blocks of documents ask which anchors other blocks hold too.
2. Runs whose anchor another document holds are sent to the anchor's bucket, equal runs of a block once. A bucket works out the
   factors of its distinct runs' suffixes (a run without another beside its anchor has none) and says of each string whether
   its factor is ``LENGTH`` bytes long, or the same run stands in a smaller document.
3. Blocks put the answers together, and cut the covered bytes out.

Equal runs are merged before they move, so a passage in a third of all documents costs each block one run.

Defined cases: a null or empty text has nothing to remove, like one shorter than ``LENGTH``; very long texts are taken whole;
overlapping strings count, and strings are judged on the input; rows that repeat an id don't remove each other; a row
with a null id is left as it is and removes nothing; an empty table gives an empty result; other columns of the input
are not read. Anchors are compared by hashes of 40 bits, which can only bring together more; whole runs are the same if
hashes of 64 bits are; strings of runs that differ are compared byte by byte, through their ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUESTION, Blocks, answer, answered, mix, pack, question_batches, question_table, total
from .common import Scratch, table

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
BLOCK_BYTES = 3 << 20
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
#: Bytes of input for each bucket.
BUCKET_BYTES = 8 << 20
#: Bytes of runs whose suffixes are sorted at once; runs of one anchor stay together.
SORTED_BYTES = 1 << 20
ANCHOR_BITS = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, inverse)]
    return _powers[0], _powers[1]


def _content_hashes(x: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each substring of ``x``."""
    power, inverse = _power_tables(max(PIECE, len(x)) + 1)
    prefix = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_byte_hashes()[x] * power[: len(x)], out=prefix[1:])
    return mix((prefix[start + length] - prefix[start]) * inverse[start] + length.astype(np.uint64))


def _byte_hashes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def _piece_runs(x: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, strings, document, anchor, content hash) of the runs of a piece; ``end`` is where each byte's document ends."""
    n = len(x) - LENGTH + 1
    if n < 1:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    words = np.ndarray((len(x) - 7,), "<u8", np.ascontiguousarray(x), strides=(1,)).astype(np.uint64)
    h = words[:-16] * _ODD
    h ^= (words[8:-8] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += words[16:] * np.uint64(0x165667B19E3779F9)
    h = mix(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: width - WINDOW], least[WINDOW - width :])
    at = np.flatnonzero(np.arange(LENGTH, LENGTH + n) <= end[:n])
    if not len(at):
        return _piece_runs(x[:0], doc[:0], end[:0])
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    where = np.flatnonzero(first)
    start, strings = at[where], np.diff(np.append(where, len(at)))
    # Smallest hashes crowd at the low end; mixed again, they spread over the buckets.
    return start, strings, doc[start], mix(h[anchor[where]]), _content_hashes(x, start, strings + LENGTH - 1)


def runs(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of a block of texts that stand one after the other, worked out piece by piece."""
    ends = np.cumsum(sizes)
    found: list[tuple[np.ndarray, ...]] = []
    first = 0
    while first < len(sizes):
        low = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        high = ends[last - 1]
        doc = np.repeat(np.arange(first, last), sizes[first:last])
        stop = np.repeat(ends[first:last] - low, sizes[first:last])
        for at in range(0, max(1, high - low), PIECE):  # more than once for a long text alone
            to = min(high - low, at + PIECE + LENGTH - 1)
            part = _piece_runs(x[low + at : low + to], doc[at:to], np.minimum(stop[at:to], to) - at)
            found.append((part[0] + low + at, *part[1:]))
        first = last
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else _piece_runs(x[:0], x[:0], x[:0])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks of about ``BLOCK_BYTES``; a block's number holds its task's."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = made = 0
    task = TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        nonlocal size, made
        row = pa.RecordBatch.from_pydict({"block": pa.array([task + made]), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "data": pa.array([b"".join(texts)], pa.binary()), "n_bytes": pa.array([size])})
        ids.clear()
        texts.clear()
        size, made = 0, made + 1
        return row

    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        for i, t in enumerate(column):
            raw = t.as_py() or b""
            ids.append(batch.column("id")[i].as_py())
            texts.append(raw)
            size += len(raw)
            if size >= BLOCK_BYTES or len(ids) >= 100_000:
                yield block()
    if ids:
        yield block()


def _block(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A block's number, ids, sizes and bytes."""
    row = t.slice(0, 1)
    return row.column("block")[0].as_py(), row.column("ids")[0].values.to_numpy(), row.column("sizes")[0].values.to_numpy(), np.frombuffer(row.column("data")[0].as_buffer(), np.uint8)


def _anchors(found: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors of a block, their buckets, whether several of its documents hold them, and the anchor of each run."""
    anchor = found[3] >> np.uint64(64 - ANCHOR_BITS)
    order = np.argsort(anchor, kind="stable")  # runs stand in the order of documents
    values, first, where = np.unique(anchor[order], return_index=True, return_inverse=True)
    doc = found[2][order]
    last = np.append(first[1:], len(doc)) - 1
    of_run = np.empty(len(anchor), np.int64)
    of_run[order] = where
    return values, _range_bucket(values, n), doc[first] != doc[last] if len(first) else np.empty(0, bool), of_run


def _range_bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> np.uint64(ANCHOR_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _deltas(values: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted values as bytes of their differences, all lowest bytes first."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return {"planes": np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, : ANCHOR_BITS // 8].T).ravel()}


def _undeltas(planes: np.ndarray) -> np.ndarray:
    rows = planes.reshape(ANCHOR_BITS // 8, -1).T
    full = np.zeros((len(rows), 8), np.uint8)
    full[:, : ANCHOR_BITS // 8] = rows
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def _which_are_shared(asked: list[dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """For each block's anchors, whether another block has them."""
    keys = [_undeltas(a["planes"]) for a in asked]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    return [{"answer": np.isin(k, twice, assume_unique=True).astype(np.uint8)} for k in keys]


class _Sent:
    """The distinct runs of a block that it sends: in the order of (bucket, anchor, content)."""

    def __init__(self, found: tuple[np.ndarray, ...], ids: np.ndarray, shared: np.ndarray, of_run: np.ndarray, n: int) -> None:
        self.runs = np.flatnonzero(shared[of_run])
        start, strings, doc, anchor, content = (c[self.runs] for c in found)
        bucket = _range_bucket(anchor >> np.uint64(64 - ANCHOR_BITS), n)
        order = np.lexsort((ids[doc], content, anchor, bucket))
        same = np.zeros(len(order), bool)
        same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
        first = order[~same]
        self.of_run = np.empty(len(order), np.int64)
        self.of_run[order] = np.cumsum(~same) - 1
        self.start, self.strings, self.anchor, self.bucket, self.least = start[first], strings[first], anchor[first], bucket[first], ids[doc[first]]

    def bytes_of(self, x: np.ndarray) -> np.ndarray:
        return _gather(x, self.start, self.strings + LENGTH - 1)


def _gather(x: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Substrings of ``x``, one after the other."""
    if not len(start):
        return x[:0]
    at = np.ones(int(length.sum()), np.int64)
    cut = np.cumsum(length)[:-1]
    at[0] = start[0]
    at[cut] = start[1:] - start[:-1] - length[:-1] + 1
    return x[np.cumsum(at)]


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 for none.

    A pointer passes over a place whose value isn't smaller to where that place points, as all that lies between is no
    smaller either; pointers double what they pass over.
    """
    at = np.arange(-1, len(values) - 1, dtype=np.int64)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def _matches(x: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes, up to ``LENGTH``, the suffixes at ``a`` and ``b`` share: ranks tell of 32, 16 and 8, bytes of the rest."""
    out = np.zeros(len(a), np.int64)
    for step in (32, 16, 8):
        fits = np.flatnonzero(out <= LENGTH - step)
        out[fits[ranks[step][a[fits] + out[fits]] == ranks[step][b[fits] + out[fits]]]] += step
    going = np.flatnonzero(out < LENGTH)
    while len(going):
        going = going[x[a[going] + out[going]] == x[b[going] + out[going]]]
        out[going] += 1
        going = going[out[going] < LENGTH]
    return out


def longest_previous_factors(x: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix at ``start`` (of ``LENGTH`` bytes or more) the longest prefix, up to ``LENGTH`` bytes, that one of a smaller document has too."""
    words = np.ndarray((len(x) - 7,), ">u8", np.ascontiguousarray(x), strides=(1,)).astype(np.uint64)
    ranks = {8: np.unique(words, return_inverse=True)[1].astype(np.uint64)}
    for step in (8, 16):
        r = ranks[step]
        ranks[2 * step] = np.unique(r[:-step] << np.uint64(32) | r[step:], return_inverse=True)[1].astype(np.uint64)
    whole = ranks[32][start] << np.uint64(32) | ranks[32][start + LENGTH - 32]
    order = np.lexsort((doc, whole))
    at, of = start[order], doc[order]
    out = np.zeros(len(order), np.int64)
    for near in (smaller_before(of), len(of) - 1 - smaller_before(of[::-1])[::-1]):
        some = np.flatnonzero((near >= 0) & (near < len(of)))
        out[some] = np.maximum(out[some], _matches(x, ranks, at[some], at[near[some]]))
    factors = np.empty(len(order), np.int64)
    factors[order] = out
    return factors


def _parts(anchor: np.ndarray, length: np.ndarray) -> Iterator[slice]:
    """Slices of sorted anchors of about ``SORTED_BYTES``, each anchor whole."""
    firsts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else []
    total = np.concatenate([[0], np.cumsum(length)])
    low = 0
    for first in [*firsts[1:], len(anchor)] if len(anchor) else []:
        if total[first] - total[low] >= SORTED_BYTES or first == len(anchor):
            yield slice(low, first)
            low = first


def _judge(asked: list[dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """For each string of each block's runs, whether a document smaller than the run's first in that block has it."""
    sizes = [len(a["anchor"]) for a in asked]
    anchor, strings, least = (np.concatenate([a[k] for a in asked]) for k in ("anchor", "strings", "least"))
    strings = strings.astype(np.int64)
    x = np.concatenate([a["bytes"] for a in asked])
    length = strings + LENGTH - 1
    start = np.cumsum(length) - length
    content = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):  # hashes in pieces
        high = max(low + 1, int(np.searchsorted(start, start[low] + PIECE)))
        content[low:high] = _content_hashes(x[start[low] : start[high - 1] + length[high - 1]], start[low:high] - start[low], length[low:high])
        low = high
    order = np.lexsort((least, content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
    head, kind = order[new], np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    # Where the strings of each distinct run begin among those of all, and which of them a smaller document has.
    offset = np.cumsum(strings[head]) - strings[head]
    repeated = np.zeros(int(strings[head].sum()), bool)
    several = np.zeros(len(head), bool)  # runs beside which the anchor has another
    alike = anchor[head][1:] == anchor[head][:-1]
    several[1:] |= alike
    several[:-1] |= alike
    chosen = np.flatnonzero(several)
    for part in _parts(anchor[head][chosen], length[head][chosen]):
        which = chosen[part]
        some = head[which]
        n = strings[some]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins = np.cumsum(length[some]) - length[some]
        factors = longest_previous_factors(_gather(x, start[some], length[some]), np.repeat(begins, n) + inner, np.repeat(least[some], n))
        repeated[np.repeat(offset[which], n) + inner] = factors >= LENGTH
    inner = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    flags = (repeated[np.repeat(offset[kind], strings) + inner] | np.repeat(least[head][kind] < least, strings)).astype(np.uint8)
    cuts = np.cumsum([0, *[int(a["strings"].sum()) for a in asked]])
    return [{"answer": flags[cuts[i] : cuts[i + 1]]} for i in range(len(sizes))]


def _cut(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, starts: np.ndarray, id_col: str) -> pa.Table:
    """The documents of a block without what strings at ``starts`` cover."""
    n = len(x)
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1  # no string starts twice
    change[starts + LENGTH] -= 1
    covered = np.cumsum(change[:n], dtype=np.int32) > 0
    ends = np.cumsum(sizes)
    rows: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
    kept = []
    for low, high in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        gone = covered[low:high]
        removed = int(np.count_nonzero(gone))
        rest = (x[low:high][~gone] if removed else x[low:high]).tobytes()
        rows["n_removed"].append(removed)
        rows["n_spans"].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1)) if removed else 0)
        rows["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        kept.append(rest)
    return pa.Table.from_pydict({id_col: pa.array(ids), "n_bytes": pa.array(sizes), "n_removed": pa.array(rows["n_removed"], pa.int64()), "n_spans": pa.array(rows["n_spans"], pa.int64()), "kept_sha256": pa.array(rows["kept_sha256"], pa.string()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Rows of ``id_col`` (as bigint), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``keep``, ``kept`` (binary). Runs jobs; keeps tables in the shared folder."""
    scratch = Scratch(df.sparkSession, "repeats")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = Blocks(scratch, rows.where("id IS NOT NULL").mapInArrow(_block_rows, "block long, ids array<long>, sizes array<long>, data binary, n_bytes long"))
    n = int(max(8, total(blocks.df, "n_bytes") // BUCKET_BYTES))

    def ask_anchors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, _, sizes, x = _block(pa.Table.from_batches([batch.slice(i, 1)]))
                values, bucket, _, _ = _anchors(runs(x, sizes), n)
                cuts = np.searchsorted(bucket, np.arange(n + 1))
                yield from question_batches([{"block": number, "bucket": b, "data": pack(**_deltas(values[cuts[b] : cuts[b + 1]]))} for b in np.flatnonzero(np.diff(cuts)).tolist()])

    shared = scratch.save(answer(blocks.df.select("block", "ids", "sizes", "data").mapInArrow(ask_anchors, QUESTION), _which_are_shared))

    def sent(t: pa.Table, answers: pa.Table):
        number, ids, sizes, x = _block(t)
        found = runs(x, sizes)
        values, _, several, of_run = _anchors(found, n)
        flags = answered(answers, np.arange(len(values))).astype(bool) | several
        return number, ids, sizes, x, found, _Sent(found, ids, flags, of_run, n)

    def ask_runs(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return question_table([])
        number, _, _, x, _, s = sent(t, answers)
        data, length = s.bytes_of(x), np.cumsum(s.strings + LENGTH - 1)
        cuts = np.searchsorted(s.bucket, np.arange(n + 1))
        out = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            low, high = cuts[b], cuts[b + 1]
            part = data[length[low - 1] if low else 0 : length[high - 1]]
            out.append({"block": number, "bucket": n + b, "data": pack(anchor=s.anchor[low:high], least=s.least[low:high], strings=s.strings[low:high].astype(np.uint8), bytes=part)})
        return question_table(out)

    judged = answer(blocks.with_answers(shared, ask_runs, QUESTION), _judge)

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            made = _cut(*(np.empty(0, k) for k in (np.int64, np.int64, np.uint8, np.int64)), id_col)
        else:
            late = pc.greater_equal(answers.column("bucket"), n)
            _, ids, sizes, x, found, s = sent(t, answers.filter(pc.invert(late)))
            flags = answered(answers.filter(late), np.arange(int(s.strings.sum()))).astype(bool)
            start, strings, doc = (c[s.runs] for c in found[:3])
            first = np.cumsum(strings) - strings
            inner = np.arange(strings.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), strings)
            begins = np.cumsum(s.strings) - s.strings
            hit = flags[np.repeat(begins[s.of_run].astype(np.int32), strings) + inner] | np.repeat(ids[doc] > s.least[s.of_run], strings)
            made = _cut(ids, sizes, x, np.repeat(start.astype(np.int32), strings)[hit] + inner[hit], id_col)
        return made if keep else made.drop_columns(["kept"])

    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep else "")
    out = blocks.with_answers(shared.unionAll(judged), finish, schema)
    raw = F.col("text").cast("binary")
    loose = rows.where("id IS NULL").select(F.col("id").alias(id_col), F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if keep else []))
    return out.unionAll(loose)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 50 bytes of earlier documents cover."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False)
