"""HTML extraction: pages' main text, by structure and by differencing with the page of the nearest URL.

A page becomes lines, one for each block of text, with a mark: *out* for what stands in menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like (by element, role or class), *main* for what else stands in an
article or main element, *open* for the rest. Pages are put in order of (host, URL path, id, URL, content), and each is paired
with the one beside it, of its host, whose path has more in common with its own; the one before if both have as much, the
other one if the first is a copy. The lines of a pair are aligned by longest common subsequence, on every page that has a
partner. What both pages have is template, what a page has for itself is its text.

Differencing alone can't give right results here: copies of an article under two URLs would delete each other, and an
advert that only one page has would stay. So structure corrects it where it speaks: of the lines that differ the out ones go, and of
the shared ones the main ones come back. Open lines are left to differencing, whether or not the page has main lines.

The order is over all pages: tasks take ranges of it, and the pages at the ends of ranges are paired across them afterwards, so
the result doesn't depend on how many ranges there are.

Defined cases: a null or empty html gives an empty text; a page without a partner is judged by structure, so it keeps its main lines, or its open ones if it has no main line; broken markup is
read as far as it goes; very long pages are read whole, and lines of a pair are aligned over whole pages; rows that repeat are treated alike; a null url counts as an empty
host and path; an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import os
import pickle
import re
import zlib
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_fields, map_slices, quoted, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Fixed lists of HTML element names.
_RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OUT = frozenset("nav header footer aside form menu dialog button fieldset head".split())
_MAIN = frozenset(("article", "main"))
#: Words of class, id or role that mark what isn't main text.
_OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside complementary contentinfo ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies "
    "disqus discussion breadcrumb breadcrumbs pagination pager related recommended widget search form copyright toolbar skip hidden".split()
)
#: Bytes of a line's hash.
HASH_BYTES = 6
#: With one of these beside it, a header is part of the text.
_TEXT_WORDS = frozenset("article entry post content main story".split())


def _marks(name: str, attributes: str) -> str:
    """o for an element that holds no main text, m for one that holds it, empty for others."""
    if name in _OUT:
        return "o"
    words: set[str] = set()
    if attributes and attributes.strip(" /"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role"):
                words.update(re.split(r"[^a-z0-9]+", (a or b or c).lower()))
            elif key == "style" and re.search(r"display\s*:\s*none", (a or b or c).lower()):
                return "o"
        if re.search(r"""(?:^|\s)hidden(?:\s|$|=)""", attributes):
            return "o"
    bad = words & _OUT_WORDS
    if bad and not (bad <= {"header"} and words & _TEXT_WORDS) and name not in ("html", "body"):
        return "o"
    return "m" if name in _MAIN or "main" in words and "role" in attributes else ""


def lines(html: str | None) -> list[tuple[str, str]]:
    """(mark, text) of a page's blocks in order: o out, m main, empty open."""
    found: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []
    depth: Counter = Counter()  # how many elements of each name are open
    out = main = at = 0
    html = html or ""

    def end_block() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append(("o" if out else "m" if main else "", text))

    while True:
        m = _TAG.search(html, at)
        held.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closes, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br" or name == "hr":
            held.append(" ")
        if name in _RAW and not closes:
            shut = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = shut.end() if shut else len(html)
            continue
        if name in _VOID:
            continue
        if name not in _INLINE:
            end_block()
        mark = "" if closes else _marks(name, attributes)
        if name in _INLINE and not mark and not depth[name]:
            continue
        if name in _INLINE and (mark or closes):
            end_block()
        if not closes:
            if attributes.endswith("/") and name not in _INLINE:
                continue
            if name == "p" or name == "li":
                while stack and stack[-1][0] == name:
                    out, main = out - (stack[-1][1] == "o"), main - (stack[-1][1] == "m")
                    depth[stack.pop()[0]] -= 1
            stack.append((name, mark))
            depth[name] += 1
            out, main = out + (mark == "o"), main + (mark == "m")
        elif depth[name]:
            while stack:
                top, mark = stack.pop()
                depth[top] -= 1
                out, main = out - (mark == "o"), main - (mark == "m")
                if top == name:
                    break
    end_block()
    return found


def _lengths(a: list, b: list) -> list[int]:
    """The lengths of the longest common subsequences of ``a`` with each prefix of ``b``, by a bit for each line of ``b``."""
    at: dict[object, int] = {}
    for j, line in enumerate(b):
        at[line] = at.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for line in a:
        u = v & at.get(line, 0)
        v = (v + u | v - u) & every
    return [0, *accumulate(bit == "0" for bit in reversed(f"{v:0{len(b)}b}"))]


def shared(a: list, b: list) -> set[int]:
    """The positions of ``a`` that are in a longest common subsequence with ``b``, over whole pages in linear memory (Hirschberg)."""
    common: set[int] = set()
    todo = [([*enumerate(a)], b)]
    while todo:
        left, right = todo.pop()
        known = set(right)
        left = [x for x in left if x[1] in known]
        known = {x[1] for x in left}
        right = [line for line in right if line in known]
        head = 0
        while head < min(len(left), len(right)) and left[head][1] == right[head]:
            head += 1
        tail = 0
        while tail < min(len(left), len(right)) - head and left[-1 - tail][1] == right[-1 - tail]:
            tail += 1
        common.update(i for i, _ in [*left[:head], *left[len(left) - tail :]])
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if not left or not right:
            continue
        if len(left) == 1:
            common.update(i for i, line in left if line in right)
            continue
        half = len(left) // 2
        first = _lengths([line for _, line in left[:half]], right)
        last = _lengths([line for _, line in reversed(left[half:])], right[::-1])
        cut = max(range(len(right) + 1), key=lambda j: first[j] + last[len(right) - j])
        todo += [(left[:half], right[:cut]), (left[half:], right[cut:])]
    return common


class Page(NamedTuple):
    """A page's lines: a hash of each, the text of those that may be main text, and a mark of each (o, m or a space)."""

    id: object
    url: str | None
    host: str
    path: str
    hashes: list[bytes]
    texts: list[str | None]
    marks: str


def _hash(line: str) -> bytes:
    return xxhash.xxh64_digest(line.encode())[:HASH_BYTES]


def read(html: str | None) -> tuple[list[bytes], list[str | None], str]:
    """Hashes of a page's lines, the texts of those that aren't out, and their marks, a space for open lines."""
    found = lines(html)
    return [_hash(t) for _, t in found], [None if mark == "o" else t for mark, t in found], "".join(mark or " " for mark, _ in found)


def _small(hashes: list[bytes], texts: list[str | None]) -> tuple[bytes, bytes]:
    """The texts, one after the other on lines of their own (which they can't hold), compressed, and the hashes of lines without one."""
    return zstandard.compress("\n".join(t or "" for t in texts).encode()), b"".join(h for h, t in zip(hashes, texts, strict=True) if t is None)


def _large(body: bytes, rest: bytes) -> tuple[list[bytes], list[str | None]]:
    """What ``_small`` was given."""
    joined = zstandard.decompress(body).decode()
    texts = [t or None for t in joined.split("\n")] if joined or rest else []
    others = (rest[k : k + HASH_BYTES] for k in range(0, len(rest), HASH_BYTES))
    return [next(others) if t is None else _hash(t) for t in texts], texts


def main_text(own: Page, *others: Page | None) -> str:
    """A page's main text, given the pages beside it."""
    beside = [p for p in others if p and p.host == own.host and p.hashes != own.hashes]  # a copy of the page tells nothing
    found = set(range(len(own.hashes)))
    if beside:
        near = max(beside, key=lambda p: len(os.path.commonprefix([p.path, own.path])))
        found -= shared(own.hashes, near.hashes)
    elif "m" in own.marks:
        found.clear()
    return " ".join(t for i, (t, mark) in enumerate(zip(own.texts, own.marks, strict=True)) if t is not None and (i in found or mark == "m"))


def _packed(*pages: Page | None) -> bytes:
    return zlib.compress(pickle.dumps([p and tuple(p) for p in pages]), 1)


def _unpacked(data: bytes | None) -> list[Page | None]:
    return [p and Page(*p) for p in pickle.loads(zlib.decompress(data))] if data else [None, None]


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of ``id_col``, ``url_col``, ``text`` and ``n_chars``. Runs jobs; keeps tables in the shared folder."""
    scratch = Scratch(df.sparkSession, "html")
    source = df.select(*[c.alias(n) for c, n in zip(quoted(id_col, url_col, html_col), ("id", "url", "html"), strict=True)])
    rest = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    keyed = source.select("id", "url", "html", F.lower(F.regexp_extract(rest, "^[^/]*", 0)).alias("host"), F.regexp_extract(rest, "/.*$", 0).alias("path"), F.xxhash64("html").alias("content"))
    order = ["host", "path", "id", "url", "content"]

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [read(h) for h in batch.column("html").to_pylist()]
        columns = {c: batch.column(c) for c in order}
        packed = [_small(m[0], m[1]) for m in made]
        columns["body"] = pa.array([x[0] for x in packed], pa.binary())
        columns["rest"] = pa.array([x[1] for x in packed], pa.binary())
        columns["marks"] = pa.array([m[2] for m in made], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    parsed = map_slices(keyed, "html", as_fields(keyed, order, "body binary, rest binary, marks string"), parse)
    dealt = parsed.repartitionByRange(*order).sortWithinPartitions(*order)
    named = as_fields(keyed, ["id", "url"], "text string, n_chars bigint")

    def run(batches):
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        size, kind = 0, None
        before = now = None
        first = True

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows, strict=True))
            rows.clear()
            size = 0
            types = (kind, pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "url", "text", "n_chars", "part", "side", "pages"])

        def done(page: Page, prev: Page | None, following: Page | None, side: str | None) -> None:
            """A page at the end of a range waits, with the page that it has beside it."""
            nonlocal size
            if side:
                rows.append((page.id, page.url, None, None, part, side, _packed(page, prev or following)))
            else:
                text = main_text(page, prev, following)
                rows.append((page.id, page.url, text, len(text), part, None, None))
                size += len(text)

        for got in batches:
            kind = got.column("id").type
            for start in range(0, got.num_rows, 256):
                p = got.slice(start, 256)
                for *head, body, rest, marks in zip(*[p.column(c).to_pylist() for c in ("id", "url", "host", "path", "body", "rest", "marks")], strict=True):
                    following = Page(*head, *_large(body, rest), marks)
                    if now:
                        done(now, before, following, "first" if first else None)
                        first = False
                    before, now = now, following
                if size > 4 << 20:
                    yield batch()
        if now:
            done(now, before, None, "only" if first else "last")
        if rows:
            yield batch()

    held = as_fields(keyed, ["id", "url"], "text string, n_chars bigint, part int, side string, pages binary")
    made = scratch.save(dealt.mapInArrow(run, held))
    ends = made.where("side IS NOT NULL")
    parts = sorted(r["part"] for r in ends.select("part").distinct().collect())  # a number for each task
    links = df.sparkSession.createDataFrame([(p, q, r) for p, q, r in zip(parts, [None, *parts], [*parts[1:], None], strict=False)], "part int, prev int, next int")
    left = ends.where("side <> 'first'").select(F.col("part").alias("prev"), F.col("pages").alias("left"))
    right = ends.where("side <> 'last'").select(F.col("part").alias("next"), F.col("pages").alias("right"))
    joined = ends.drop("text", "n_chars").join(links, "part").join(left, "prev", "left").join(right, "next", "left").select("id", "url", "side", "pages", "left", "right")

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for side, own, prev, following in zip(*[batch.column(c).to_pylist() for c in ("side", "pages", "left", "right")], strict=True):
            page, beside = _unpacked(own)
            before = beside if side == "last" else _unpacked(prev)[0]
            after = beside if side == "first" else _unpacked(following)[0]
            texts.append(main_text(page, before, after))
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    edges = map_slices(joined, "pages", named, settle)
    return made.where("side IS NULL").select("id", "url", "text", "n_chars").unionAll(edges).toDF(id_col, url_col, "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
