"""A hierarchical Pitman-Yor language model of word pairs, with seating sampled by Gibbs sweeps.

Each context word has a restaurant whose dishes are the words that follow it; a dish's tables send customers to one
restaurant of single words, the parent that all contexts share, whose base is uniform over the V known words and one
more. A sweep of the Gibbs sampler draws four things in turn, each given the others:

* the parent's tables of each word, given its guests;
* the parent's distribution G, which is a gamma variable for each word, and for what the parent's tables leave a tilted
  stable one (the finite part of a Pitman-Yor process over the base), divided by their sum;
* for each context a gamma variable x with shape strength / discount + its tables: given x, a context's dishes are
  independent, since the weight of T tables is discount^T Gamma(strength / discount + T) up to a constant;
* each pair's number of tables t, with a chance in proportion to S(c, t) (discount x G(word))^t for its c customers, where
  S are the generalized Stirling numbers, so all customers are taken out and seated again at once.

The parent's own gamma variable is the one of the sweep before, since its sum over all buckets is known after a sweep.
The first sweeps are left out, and a pair's predictive probability is averaged over the last.

Counts are over all training texts. Blocks of texts ask buckets of words for counts and numbers, then buckets of pairs, which
merge them in parts, for counts; buckets of pairs and of words exchange tables and probabilities in each sweep; see ``blocks``. All arrays are
keyed by hashes of words or pairs and merged within a block before they move, so a word that is a third of the corpus
costs each block one entry.

Defined cases: a null or empty text is its end alone; very long texts are taken whole; equal texts get equal scores; rows
that repeat an id are texts of their own; a row with a null id isn't learned from and its ``held_out`` is null; without
training texts N is 0 and all words share the base alike; an empty table gives an empty result; other columns of the
input are not read. Words are told apart by XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUESTION, Blocks, mix, of_bucket, pack, question_batches, question_table, release, total, unpack
from .common import Scratch, slices, table
from .langid import fold

BLOCK_BYTES = 12 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 24 << 20
#: Parts of a bucket of pairs, which are merged one after the other.
PARTS = 8
#: Discounts and strengths of the contexts' restaurants and of the parent.
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 1.0
#: All sweeps, and the last of them that are averaged; those before are burn-in.
SWEEPS, AVERAGED = 5, 2
#: Up to so many customers Stirling numbers come from their recursion.
EXACT = 1024
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: What stands for a bucket in rows that aren't questions.
TOTALS, TABLES = -1, -2


def _planes(values: np.ndarray) -> np.ndarray:
    """Integers as bytes: how many bytes each has, then all lowest bytes, and so on."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([[np.uint8(width)], rows[:, :width].T.ravel()])


def _unplanes(data: np.ndarray) -> np.ndarray:
    width = int(data[0])
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = data[1:].reshape(width, -1).T
    return out.view("<u8").ravel()


def _sorted_planes(values: np.ndarray) -> np.ndarray:
    return _planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def _unsorted_planes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(_unplanes(data), dtype=np.uint64)


def _steps(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Differences of values that rise within runs of the given lengths; a run's first value is kept."""
    out = np.diff(values, prepend=np.zeros(1, values.dtype))
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    out[first] = values[first]
    return out


def _unsteps(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, steps.dtype), np.cumsum(steps, dtype=steps.dtype)])
    return total[1:] - np.repeat(total[np.cumsum(lengths) - lengths], lengths)


def gammaln(x: np.ndarray | float) -> np.ndarray:
    """Logarithms of the gamma function for positive numbers, by Stirling's series beyond 16."""
    x = np.array(x, np.float64)
    less = np.zeros(x.shape)
    small = x < 16
    while small.any():
        less[small] += np.log(x[small])
        x[small] += 1
        small = x < 16
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / x**2) / x**2) / x - less


@lru_cache(maxsize=2)
def _log_stirling(discount: float) -> list[np.ndarray]:
    """For each c up to ``EXACT`` the logarithms of S(c, t) for t from 1 to c: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    out = [np.empty(0), np.zeros(1)]
    for c in range(1, EXACT):
        row = np.full(c + 1, -np.inf)
        row[:-1] = out[-1] + np.log(c - discount * np.arange(1, c + 1))
        row[1:] = np.logaddexp(row[1:], out[-1])
        out.append(row)
    return out


#: Terms of the series for more customers, rows of it that are kept, and up to which share of c^discount it is summed.
TERMS, ROWS, SHARE = 96, 128, 1.25


@lru_cache(maxsize=2)
def _series(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """j, the signed parts of the series' terms, and for t from 1 to ``ROWS`` the logarithms of what else doesn't depend on c."""
    j = np.arange(1, TERMS + 1)
    return j, np.where(j % 2, 1, -1) * np.sin(np.pi * np.round(discount * j, 9)) / np.pi, _factors(np.arange(1, ROWS + 1), j, discount)


@lru_cache(maxsize=2)
def _fixed_factors(discount: float) -> np.ndarray:
    j = np.arange(1, TERMS + 1)
    return gammaln(1 + discount * j) - gammaln(j + 1)


def _factors(t: np.ndarray, j: np.ndarray, discount: float) -> np.ndarray:
    choose = gammaln(t + 1)[:, None] - gammaln(np.maximum(t[:, None] - j, 0) + 1)
    return np.where(j <= t[:, None], choose + _fixed_factors(discount), -np.inf)


@lru_cache(maxsize=4096)
def _by_customers(c: int, discount: float) -> tuple[np.ndarray, float]:
    """What in the series depends on c alone, and the logarithm of c!."""
    whole = gammaln(c + 1)
    return gammaln(c - discount * _series(discount)[0]) - whole, float(whole)


def _saddle(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of the chance that t sizes add up to c, by its saddle point: of t log(1 - (1 - r)^d) - c log r, with q = log(1 - r)."""
    low, high = np.full(len(t), -60.0), np.full(len(t), -1e-12)
    for _ in range(60):
        mid = (low + high) / 2
        up = t * discount * -np.expm1(mid) * np.exp((discount - 1) * mid) > -c * np.expm1(discount * mid)
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    q = (low + high) / 2
    r, g = -np.expm1(q), -np.expm1(discount * q)
    m = discount * r * np.exp((discount - 1) * q) / g  # the mean of one size under the tilt
    return t * np.log(g) - c * np.log(r) - 0.5 * np.log(2 * np.pi * t * (m + m * (1 - discount) * r * np.exp(-q) - m * m))


def _log_stirling_of(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of S(c, t) for c beyond ``EXACT``.

    S(c, t) t! discount^t / c! is the chance that t sizes of tables (Sibuya variables) add up to c. Up to ``SHARE`` of
    c^discount that is summed by its series; beyond, where it is the sum of many, it is taken from its saddle point, set
    equal to the series where they meet.
    """
    j, part, rows = _series(discount)
    border = int(SHARE * c**discount)
    few, out = t <= border, np.empty(len(t))
    by_c, whole = _by_customers(c, discount)
    sum_of = lambda x: np.log(np.exp((rows[x - 1] if x.max(initial=1) <= ROWS else _factors(x, j, discount)) + by_c) @ part)
    out[few] = sum_of(t[few])
    if not few.all():
        x = np.append(t[~few], border).astype(np.float64)
        found = _saddle(c, x, discount)
        out[~few] = found[:-1] + (sum_of(np.array([border]))[0] - found[-1])
    return out + whole - gammaln(t + 1) - t * np.log(discount)


def _seat_many(c: int, log_pull: float, discount: float, u: float) -> int:
    """Tables of a dish with more than ``EXACT`` customers. The chances are log-concave, so the mode is found by halving."""
    weigh = lambda t: _log_stirling_of(c, t, discount) + t * log_pull
    first, last = 1, min(ROWS, c - 1)
    while True:
        t = np.arange(first, last + 1)
        w = weigh(t)
        top = w.max()
        if (first == 1 or w[0] < top - 40) and (last == c - 1 or w[-1] < top - 40):
            chance = np.cumsum(np.exp(w - top))
            return int(t[min(np.searchsorted(chance, u * chance[-1], side="right"), len(t) - 1)])
        low, high = 1, c - 1
        while low < high:
            mid = (low + high) // 2
            a, b = weigh(np.array([mid, mid + 1]))
            low, high = (mid + 1, high) if b > a else (low, mid)
        reach = max(ROWS, 2 * (last - first))
        first, last = max(1, low - reach), min(c - 1, low + reach)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each dish, with chances in proportion to S(customers, t) ``pull``^t."""
    tables = np.minimum(customers, 1).astype(np.int64)
    draws = rng.random(len(customers))
    with np.errstate(divide="ignore"):
        log_pull = np.log(pull)
    two = np.flatnonzero(customers == 2)
    tables[two] += draws[two] * (1 - discount + pull[two]) >= 1 - discount
    many = np.flatnonzero(customers > 2)
    many = many[np.argsort(customers[many], kind="stable")]
    sizes, starts = np.unique(customers[many], return_index=True)
    known = _log_stirling(discount)
    for c, x, y in zip(sizes.tolist(), starts.tolist(), np.append(starts, len(many))[1:].tolist(), strict=True):
        if c > EXACT:
            tables[many[x:y]] = [_seat_many(c, log_pull[i], discount, draws[i]) for i in many[x:y]]
            continue
        step = max(1, (1 << 20) // c)
        for at in range(x, y, step):
            dish = many[at : min(y, at + step)]
            w = known[c] + np.arange(c) * log_pull[dish, None]
            chance = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            tables[dish] = np.minimum(1 + (chance <= draws[dish, None] * chance[:, -1:]).sum(axis=1), c)
    return tables


def tilted_stable(n: int, scale: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Variables whose Laplace transform is exp(-scale ((1 + s)^discount - 1)): stable ones, kept with a chance of exp(-value)."""
    pieces = max(1, int(np.ceil(scale)))
    out = np.zeros(n)
    for _ in range(pieces):
        left = np.arange(n)
        while len(left):
            angle, e = np.pi * (1 - rng.random(len(left))), rng.exponential(size=len(left))
            value = np.sin(discount * angle) / np.sin(angle) ** (1 / discount) * (np.sin((1 - discount) * angle) / e) ** ((1 - discount) / discount)
            value *= (scale / pieces) ** (1 / discount)
            good = rng.random(len(left)) < np.exp(-value)
            out[left[good]] += value[good]
            left = left[~good]
    return out


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks: word numbers within the block, the words' hashes in order, and which texts teach."""
    task = TaskContext.get().partitionId() << 32
    ids, learn, sizes, words = [], [], [], []
    held = made = 0

    def block() -> pa.RecordBatch:
        nonlocal held, made
        coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()] + [int(END)], np.uint64)
        order = np.argsort(names)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        n = np.concatenate(sizes) + 1
        tokens = np.full(int(n.sum()), place[-1], np.uint32)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(n) - 1] = False
        tokens[inner] = place[coded.indices.to_numpy()]
        data = pack(tokens=tokens, words=names[order], sizes=n, learn=np.concatenate(learn).astype(np.uint8))
        row = pa.RecordBatch.from_pydict({"block": pa.array([task + made]), "ids": pa.array([[x for part in ids for x in part]], pa.list_(pa.int64())), "data": pa.array([data], pa.binary()), "n_bytes": pa.array([held])})
        for x in (ids, learn, sizes, words):
            x.clear()
        held, made = 0, made + 1
        release()
        return row

    for batch in batches:
        for part in slices(batch, "text"):
            text = pc.ascii_lower(part.column("text"))
            split = pc.ascii_split_whitespace(text)
            flat = split.flatten()
            real = pc.not_equal(flat, "")
            ids.append(part.column("id").to_pylist())
            learn.append(part.column("learn").to_numpy(zero_copy_only=False))
            sizes.append(np.bincount(pc.list_parent_indices(split).filter(real).to_numpy(), minlength=part.num_rows).astype(np.int64))
            words.append(flat.filter(real))
            held += pc.sum(pc.binary_length(text)).as_py()
            if held >= BLOCK_BYTES:
                yield block()
    if ids:
        yield block()


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each is. Takes less memory than numpy's own."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], of


class _Block:
    """A block's arrays, and the pairs of words in it."""

    def __init__(self, row: pa.Table) -> None:
        self.number = row.column("block")[0].as_py()
        for name, values in unpack(row.column("data")[0].as_py()).items():
            setattr(self, name, values)
        self.taught = np.repeat(self.learn.astype(bool), self.sizes)

    def pairs(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, words, the pair of each token), by the words' numbers and sorted."""
        ends = np.cumsum(self.sizes) - 1
        end = np.uint32(np.searchsorted(self.words, END))
        assert not len(ends) or self.tokens[ends[-1]] == end
        n = len(self.words)
        by_number = np.argsort(number)
        rank = np.empty(n, np.int64)
        rank[by_number] = np.arange(n)
        key = rank[self.tokens]
        context = np.roll(key, 1)  # a text's first word follows an end
        context[:1] = rank[end]
        key += np.multiply(context, n, out=context)
        del context
        key, of = _numbered(key)
        return number[by_number[key // n]], number[by_number[key % n]], of


def _word_bucket(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pair_parts(u: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The part of each pair: bucket * PARTS + the part within the bucket."""
    h = mix(u * np.uint64(0x9E3779B97F4A7C15) + mix(w))
    part = _word_bucket(h, n) * PARTS + (h % np.uint64(PARTS)).astype(np.int64)
    return part.astype(np.uint16) if n * PARTS <= 1 << 16 else part


def _by_pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of pairs."""
    if max(u.max(initial=0), w.max(initial=0)) < 1 << 32:
        return np.argsort(u << np.uint64(32) | w)
    return np.lexsort((w, u))


def _cuts(bucket: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for sorted buckets that have entries."""
    at = np.searchsorted(bucket, np.arange(n + 1))
    return [(b, int(at[b]), int(at[b + 1])) for b in np.flatnonzero(np.diff(at)).tolist()]


def _total_row(**values: float) -> dict[str, np.ndarray]:
    return {k: np.array([v], np.float64) for k, v in values.items()}


def _with_totals(t: pa.Table, made: list[dict[str, np.ndarray]], totals: dict[str, np.ndarray]) -> pa.Table:
    rows = [{"block": i, "bucket": b, "data": pack(**m)} for i, b, m in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), made, strict=True)]
    return question_table([*rows, {"block": TOTALS, "bucket": t.column("bucket")[0].as_py(), "data": pack(**totals)}])


def _sum_totals(df: DataFrame) -> dict[str, float]:
    """The sums of the totals that buckets give, a row for each bucket."""
    out: dict[str, float] = {}
    for r in df.where(F.col("block") == TOTALS).select("data").toLocalIterator():
        for k, v in unpack(bytes(r["data"])).items():
            out[k] = out.get(k, 0.0) + float(v[0])
    return out


def _by_bucket(answers: pa.Table) -> list[tuple[int, dict[str, np.ndarray]]]:
    return sorted(((b, unpack(d)) for b, d in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True)), key=lambda x: x[0])


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", learn: F.Column | None = None, sweeps: int = SWEEPS, averaged: int = AVERAGED, seed: int = 7) -> DataFrame:
    """Rows of ``id_col`` (as bigint), ``learn``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10). Runs jobs; keeps tables in the shared folder.

    ``learn`` says which rows teach (all by default).
    """
    scratch = Scratch(df.sparkSession, "pitman-yor")
    teaches = F.coalesce(learn if learn is not None else F.lit(True), F.lit(False))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), teaches.alias("learn"))
    blocks = Blocks(scratch, rows.mapInArrow(_block_rows, "block long, ids array<long>, data binary, n_bytes long"))
    n = int(max(8, total(blocks.df, "n_bytes") // BUCKET_BYTES))

    # 1. Words: their counts in training texts, and numbers that are dense over all buckets.
    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(pa.Table.from_batches([batch.slice(i, 1)]))
                count = np.bincount(b.tokens[b.taught], minlength=len(b.words))
                yield from question_batches([{"block": b.number, "bucket": k, "data": pack(words=_sorted_planes(b.words[x:y]), count=_planes(count[x:y]))} for k, x, y in _cuts(_word_bucket(b.words, n), n)])

    def number_words(t: pa.Table) -> pa.Table:
        asked = [unpack(d) for d in t.column("data").to_pylist()]
        words = [_unsorted_planes(a["words"]) for a in asked]
        names, of = np.unique(np.concatenate(words), return_inverse=True)
        count = np.zeros(len(names), np.int64)
        np.add.at(count, of, np.concatenate([_unplanes(a["count"]) for a in asked]).astype(np.int64))
        number = np.arange(len(names), dtype=np.uint64) * np.uint64(n) + np.uint64(t.column("bucket")[0].as_py())
        cuts = np.cumsum([0, *map(len, words)])
        parts = [of[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        return _with_totals(t, [{"number": _sorted_planes(number[p]), "count": _planes(count[p])} for p in parts], _total_row(tokens=count.sum(), known=np.count_nonzero(count)))

    words = scratch.save(of_bucket(blocks.df.select("block", "data").mapInArrow(ask_words, QUESTION), number_words, QUESTION))
    totals = _sum_totals(words)
    n_train, n_known = int(totals.get("tokens", 0)), int(totals.get("known", 0))
    to_blocks = words.where(F.col("block") != TOTALS)

    def word_answers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        got = [x for k, x in _by_bucket(answers) if k < n]
        return np.concatenate([_unsorted_planes(x["number"]) for x in got]), np.concatenate([_unplanes(x["count"]) for x in got]).astype(np.int64)

    def pair_order(b: _Block, number: np.ndarray) -> tuple[np.ndarray, ...]:
        u, w, of = b.pairs(number)
        part = _pair_parts(u, w, n)
        order = np.argsort(part, kind="stable")
        return u[order], w[order], part[order].astype(np.int64), order, of

    # 2. Pairs: their counts; a bucket keeps which of its pairs each block asked for.
    def ask_pairs(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return question_table([])
        b = _Block(t.slice(0, 1))
        number, _ = word_answers(answers)
        u, w, part, order, of = pair_order(b, number)
        count = np.bincount(of[b.taught], minlength=len(u))[order]
        at = np.searchsorted(part, np.arange(n * PARTS + 1))
        rows = []
        for k in np.flatnonzero(np.diff(at[::PARTS])).tolist():
            cuts = at[k * PARTS : (k + 1) * PARTS + 1].tolist()
            pieces = {f"{name}{p}": code(v[x:y]) for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) for name, code, v in (("u", _sorted_planes, u), ("w", _planes, w), ("count", _planes, count))}
            rows.append({"block": b.number, "bucket": k, "data": pack(**pieces)})
        return question_table(rows)

    def merge_pairs(t: pa.Table) -> pa.Table:
        asked = [unpack(d) for d in t.column("data").to_pylist()]
        merged: dict[str, list[np.ndarray]] = {k: [] for k in ("u", "w", "count", "steps", "lengths")}
        known = 0
        for p in range(PARTS):
            us = [_unsorted_planes(a[f"u{p}"]) for a in asked]
            lengths = np.array([len(x) for x in us], np.int64)
            u, w = np.concatenate(us), np.concatenate([_unplanes(a[f"w{p}"]) for a in asked])
            order = _by_pair(u, w)
            new = np.ones(len(order), bool)
            new[1:] = (u[order[1:]] != u[order[:-1]]) | (w[order[1:]] != w[order[:-1]])
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            count = np.concatenate([_unplanes(a[f"count{p}"]) for a in asked]).astype(np.float64)
            head = order[new]
            for name, v in (("u", u[head]), ("w", w[head]), ("count", np.bincount(of, count, minlength=len(head)).astype(np.int64)), ("steps", _steps(of + known, lengths)), ("lengths", lengths)):
                merged[name].append(v)
            known += len(head)
        u, w, count, steps, lengths = (np.concatenate(v) for v in merged.values())
        del asked, us, order, of
        number, of = _numbered(np.concatenate([u, w]))
        place = (number % np.uint64(n)).astype(np.int64)
        by_place = np.argsort(place, kind="stable")
        where = np.empty(len(by_place), np.int32)
        where[by_place] = np.arange(len(by_place), dtype=np.int32)
        words = np.bincount(place, minlength=n)
        planes = {"number": _steps(number[by_place] // np.uint64(n), words), "words": words, "u": where[of[: len(u)]], "w": where[of[len(u) :]], "count": count, "steps": steps, "lengths": lengths}
        data = pack(blocks=np.array(t.column("block").to_pylist(), np.int64), **{k: _planes(v) for k, v in planes.items()})
        return pa.Table.from_pydict({"block": pa.array([t.column("bucket")[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    pairs = Blocks(scratch, of_bucket(blocks.with_answers(to_blocks, ask_pairs, QUESTION), merge_pairs, "block long, data binary"))

    # 3. Sweeps: buckets of pairs tell tables to buckets of words, which seat the parent and answer.
    class Restaurants:
        """A bucket of pairs: arrays, and where each pair's words are among the bucket's words."""

        def __init__(self, row: pa.Table) -> None:
            self.bucket = row.column("block")[0].as_py()
            self.data = unpack(row.column("data")[0].as_py())
            self.count, self.u, self.w, words = (_unplanes(self.data[k]).astype(np.int64) for k in ("count", "u", "w", "words"))
            self.place = np.repeat(np.arange(n), words)
            self.number = _unsteps(_unplanes(self.data["number"]), words) * np.uint64(n) + self.place.astype(np.uint64)

        def asks(self, tables: np.ndarray, k: int) -> list[dict]:
            """Questions with the tables of round k, and the row that keeps them."""
            size = len(self.number)
            add = lambda at, v: np.bincount(at, v, minlength=size).astype(np.int64)
            guests, own, seated = add(self.w, tables), add(self.u, tables), add(self.u, self.count)
            out = [{"block": self.bucket, "bucket": b, "data": pack(number=_sorted_planes(self.number[x:y]), guests=_planes(guests[x:y]), tables=_planes(own[x:y]), customers=_planes(seated[x:y]))} for b, x, y in _cuts(self.place, n)]
            return [*out, {"block": self.bucket, "bucket": TABLES - k, "data": pack(tables=_planes(tables))}] if k in kept_rounds else out

    def seat_parent(k: int, rest: float):
        def run(t: pa.Table) -> pa.Table:
            asked = [unpack(d) for d in t.column("data").to_pylist()]
            numbers = [_unsorted_planes(a["number"]) for a in asked]
            names, of = np.unique(np.concatenate(numbers), return_inverse=True)
            sums = {}
            for key in ("guests", "tables", "customers"):
                sums[key] = np.zeros(len(names), np.int64)
                np.add.at(sums[key], of, np.concatenate([_unplanes(a[key]) for a in asked]).astype(np.int64))
            rng = np.random.default_rng([seed, k, t.column("bucket")[0].as_py()])
            scale = rest / (n_known + 1)
            upper = seat(sums["guests"], np.full(len(names), PARENT_DISCOUNT * scale), PARENT_DISCOUNT, rng)
            cuts = np.cumsum([0, *map(len, numbers)])
            parts = [of[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            made: list[dict[str, np.ndarray]] = [{} for _ in parts]
            mass = np.zeros(len(names))
            if k < sweeps:  # for the next sweep
                taught = np.flatnonzero(sums["guests"])
                mass[taught] = rng.gamma(sums["guests"][taught] - PARENT_DISCOUNT * upper[taught]) + tilted_stable(len(taught), scale, PARENT_DISCOUNT, rng)
                x = rng.gamma(STRENGTH / DISCOUNT + sums["tables"])
                made = [{"mass": mass[p].astype(np.float32), "x": x[p].astype(np.float32)} for p in parts]
            if k in kept_rounds:
                planes = {"guests": sums["guests"], "upper": upper, "tables": sums["tables"], "customers": sums["customers"]}
                made = [m | {key: _planes(v[p]) for key, v in planes.items()} for m, p in zip(made, parts, strict=True)]
            return _with_totals(t, made, _total_row(guests=sums["guests"].sum(), upper=upper.sum(), mass=mass.sum()))

        return run

    kept_rounds = range(sweeps - averaged + 1, sweeps + 1)
    draw = np.random.default_rng([seed, 0x9A7E])
    held: list[DataFrame] = []

    def exchange(asked: DataFrame, k: int, rest: float) -> tuple[DataFrame, dict[str, float]]:
        """The rows for a round's buckets of pairs: answers, filed under k * n and on, and tables. And the parent's totals."""
        asked = scratch.save(asked)
        while held:  # the round before has been read
            scratch.drop(held.pop())
        given = scratch.save(of_bucket(asked.where("bucket >= 0"), seat_parent(k, rest), QUESTION))
        sums = _sum_totals(given)
        # What no known word has: the share of the one word more, and the variable for the next round.
        sums["mass"] = sums.get("mass", 0.0) + float(tilted_stable(1, rest / (n_known + 1), PARENT_DISCOUNT, draw)[0])
        sums["rest"] = float(draw.gamma(PARENT_STRENGTH / PARENT_DISCOUNT + sums.get("upper", 0.0)))
        if k not in kept_rounds:
            held.extend((asked, given))
        back = given.where(F.col("block") != TOTALS).select("block", (F.col("bucket") + k * n).cast("int").alias("bucket"), "data")
        return back.unionAll(asked.where("bucket < 0")), sums

    def given_of(answers: list[tuple[int, dict[str, np.ndarray]]], k: int) -> list[dict[str, np.ndarray]]:
        return [x for b, x in answers if k * n <= b < (k + 1) * n]

    def state(r: Restaurants, answers: list[tuple[int, dict[str, np.ndarray]]], k: int, sums: dict[str, float]) -> tuple[np.ndarray, ...]:
        """For each pair after round k: the parent's probability of its word, its context's tables and customers, its own tables."""
        got = given_of(answers, k)
        guests, upper, tables, customers = (np.concatenate([_unplanes(x[key]) for x in got]).astype(np.float64) for key in ("guests", "upper", "tables", "customers"))
        spare = (PARENT_STRENGTH + PARENT_DISCOUNT * sums["upper"]) / (n_known + 1)
        parent = (guests - PARENT_DISCOUNT * upper + spare) / (PARENT_STRENGTH + sums["guests"])
        own = next(_unplanes(x["tables"]).astype(np.int64) for b, x in answers if b == TABLES - k)
        return parent[r.w], tables[r.u], customers[r.u], own

    def first_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = Restaurants(pa.Table.from_batches([batch.slice(i, 1)]))
                yield from question_batches(r.asks(np.minimum(r.count, 1), 0))

    now, sums = exchange(pairs.df.select("block", "data").mapInArrow(first_asks, QUESTION), 0, PARENT_STRENGTH / PARENT_DISCOUNT + n_known)
    kept: list[tuple[int, DataFrame, dict[str, float]]] = []

    def sweep(k: int, before: dict[str, float]):
        def run(t: pa.Table, answers: pa.Table) -> pa.Table:
            if not t.num_rows:
                return question_table([])
            r = Restaurants(t.slice(0, 1))
            got = given_of(_by_bucket(answers), k - 1)
            mass, x = (np.concatenate([g[key] for g in got]).astype(np.float64) for key in ("mass", "x"))
            rng = np.random.default_rng([seed, k, r.bucket, 1])
            return question_table(r.asks(seat(r.count, DISCOUNT * x[r.u] * mass[r.w] / before["mass"], DISCOUNT, rng), k))

        return run

    for k in range(1, sweeps + 1):
        now, sums = exchange(pairs.with_answers(now, sweep(k, sums), QUESTION), k, sums["rest"])
        if k in kept_rounds:
            kept.append((k, now, sums))

    # 4. Probabilities of pairs, averaged over the kept sweeps, go back to the blocks that asked.
    rounds = [(k, s) for k, _, s in kept]

    def probabilities(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return question_table([])
        r, got = Restaurants(t.slice(0, 1)), _by_bucket(answers)
        mean = np.zeros(len(r.count))
        for k, s in rounds:
            parent, tables, customers, own = state(r, got, k, s)
            mean += (np.maximum(r.count - DISCOUNT * own, 0) + (STRENGTH + DISCOUNT * tables) * parent) / (STRENGTH + customers)
        logs = np.log10(mean / len(rounds)).astype(np.float32)
        lengths = _unplanes(r.data["lengths"]).astype(np.int64)
        asked = logs[_unsteps(_unplanes(r.data["steps"]).astype(np.int64), lengths)]
        ends = np.cumsum(lengths).reshape(PARTS, -1)
        begins = ends - lengths.reshape(PARTS, -1)
        out = []
        for k, number in enumerate(r.data["blocks"].tolist()):
            own = np.concatenate([asked[begins[p, k] : ends[p, k]] for p in range(PARTS)])
            out.append({"block": number, "bucket": n + r.bucket, "data": pack(logs=own)})
        return question_table(out)

    every = kept[0][1]
    for _, more, _ in kept[1:]:
        every = every.unionAll(more)
    scored = pairs.with_answers(every, probabilities, QUESTION)

    # 5. Texts.
    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        row = t.slice(0, 1)
        b = _Block(row)
        number, count = word_answers(answers)
        _, _, _, order, of = pair_order(b, number)
        logs = np.empty(len(order))
        logs[order] = np.concatenate([x["logs"] for k, x in _by_bucket(answers) if k >= n])
        doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
        add = lambda v: np.bincount(doc, v, minlength=len(b.sizes))
        c = count[b.tokens]
        base = np.log10((c + 0.1) / (n_train + 0.1 * (n_known + 1)))
        return pa.Table.from_arrays([row.column("ids")[0].values, pa.array(b.learn.astype(bool)), pa.array(b.sizes), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(len(b.sizes), n_train)), pa.array(add(base)), pa.array(add(logs[of]))], names)

    names = [id_col, "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return blocks.with_answers(to_blocks.unionAll(scored), finish, f"`{id_col}` bigint, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(scored: DataFrame, column: str = "score") -> F.Column:
    """The perplexity of each text by a column of log10 probabilities."""
    return F.pow(F.lit(10.0), -F.col(column) / F.col("n_tokens"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored, learned where crc32 of the id modulo 10 isn't 0."""
    made = score(table(spark, sf_dir, "documents"), learn=fold("doc_id", 10) != 0)
    return made.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
