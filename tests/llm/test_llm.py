"""The operators of the llm subpackage against brute force, and their defined cases."""

import base64
import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import difference
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import bpe, components, decontaminate, html_text, langid, media, near_copies, pitman_yor, registry, secret_scan, simhash, substring_dedup, token_counts
from sieveline.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "é" * 3, "x" * 60, "x" * 60, "one two three four five six seven " * 40, "no letters: 123 !!".replace("no letters", "12"), "tab\tand\nnew\x1cline  spaces   ", "😀 emoji 漢字"]


@pytest.fixture(scope="module")
def docs(sf):
    with duckdb.connect() as c:
        return c.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet'").fetchall()


def odd(spark):
    """Rows of odd texts, a repeated row, a null id and columns with the names that operators use themselves."""
    rows = [(i, t, None if i % 3 else "en", "s", 1, "clash", 7) for i, t in enumerate(ODD)] + [(0, None, "en", "s", 1, "clash", 7), (None, "null id text", "en", "s", 1, "clash", 7)]
    return spark.createDataFrame(rows, DOCS + ", k string, fp int")


def clashing(spark):
    """The odd rows with columns that have the names which operators and stages make, and a name with a dot."""
    names = ("id", "row", "lang_pred", "score", "n_grams", "text_key", "stay_id", "root", "h", "key", "n_hex", "spans", "a.b", "_score")
    return odd(spark).select("*", *[F.lit(f"mine {c}").alias(c) for c in names])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def tokens(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    global _encoding
    if "_encoding" not in globals():
        _encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding.encode_ordinary(text or "")


def test_op1(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op1_byte_bpe"](spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        ids = np.array(tokens(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(t.encode()))


def test_op1_cases(spark):
    rnd = random.Random(3)
    chars = " \n\t 　\x1cab1é漢😀!'s\r"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 25))) for _ in range(2000)] + ["z" * 20000, "<|endoftext|>"]
    coder = bpe.Coder(bpe.build_tokenizer(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))), public_tokenizers.PATTERN)
    for raw, t in zip(coder.encode(texts), texts, strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == tokens(t) and coder.decode(ids) == t.encode()
        starts, ends = coder.offsets(ids, t.encode())
        assert all(coder.table[i].decode("utf-8", "ignore") in t[a:b] or a < b for i, a, b in zip(ids, starts, ends, strict=True))
    words = bpe.Coder(bpe.build_tokenizer(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))), r"\S+ \S+|\S+|\s+")
    assert words.decode(np.frombuffer(words.encode(["one two three"])[0], "<u4")) == b"one two three"
    some = spark.createDataFrame([(1, [65, None, 66]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.decoded) for r in bpe.decode(some).collect()} == {1: 2, 2: 0}
    for bad in (-1, 10**6):
        with pytest.raises(ValueError, match="lacks"):
            coder.decode(np.array([bad]))
    made = bpe.encode(odd(spark), offsets=True)
    assert made.count() == len(ODD) + 2 and bpe.encode(empty(spark)).count() == 0
    assert sorted(bytes(r.decoded).decode() for r in bpe.decode(made).collect()) == sorted([t or "" for t in ODD] + ["", "null id text"])


def test_op2(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op2_media_columns"](spark, sf).collect()}
    for i, t, *_ in docs:
        raw, n = media.payload(t)
        wav = media.to_wav(raw)
        assert len(raw) % 192 == 0 and media.from_wav(wav) == raw
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].media_bytes, got[i].media_sha256) == (n, len(raw), sha(raw), zlib.crc32(raw[-16:]), len(wav), sha(wav))


def test_op2_cases(spark):
    rows = media.media(odd(spark), keep=True).collect()
    assert len(rows) == len(ODD) + 2 and min(r.payload_bytes for r in rows) == 192 and media.media(empty(spark)).count() == 0
    same = [(r.times, r.codes) for r in rows if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    tone = (128 + 100 * np.sin(np.arange(20_000) * 2 * np.pi * 20 / 256)).astype(np.uint8).tobytes()
    bins, _ = media.band_peaks(tone)
    assert set(bins[:, 1].tolist()) == {20}  # the sine's bin, in the second band
    monkey = media.fingerprint(tone)
    block, media.BLOCK = media.BLOCK, 7
    try:
        assert all((a == b).all() for a, b in zip(monkey, media.fingerprint(tone), strict=True))
    finally:
        media.BLOCK = block


def test_op2_frames_reach_the_last_sample():
    rnd = random.Random(6)
    for n in (192, 384, 960, 1000, 192 * 9):
        raw = bytes(rnd.randrange(256) for _ in range(n))
        frames = len(media.band_peaks(raw)[0])
        assert (frames - 1) * media.HOP < n <= (frames - 1) * media.HOP + media.WINDOW
        changed = raw[: n - 64] + bytes(rnd.randrange(256) for _ in range(64))
        a, b = media.band_peaks(raw), media.band_peaks(changed)
        assert not np.array_equal(a[1][-1], b[1][-1])


def brute_repeats(docs):
    seen, out = {}, {}
    for i, t in sorted((i, t or "") for i, t in docs):
        b = t.encode()
        covered = bytearray(len(b))
        grams = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, g in enumerate(grams):
            if seen.get(g, i) < i:
                covered[p : p + 50] = b"\1" * 50
        for g in grams:
            seen.setdefault(g, i)
        spans = sum(covered[p] and (p == 0 or not covered[p - 1]) for p in range(len(b)))
        out[i] = (len(b), sum(covered), spans, sha(bytes(c for c, gone in zip(b, covered, strict=True) if not gone)))
    return out


def test_op3(spark, sf, docs, monkeypatch):
    want = brute_repeats([d[:2] for d in docs])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op3_suffix_dedup"](spark, sf).collect()}
    assert got == want


def test_op3_cases(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé") for _ in range(9)) for _ in range(60)]
    texts = [" ".join(rnd.choice(words[:8]) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["x" * 300, "x" * 49, "x" * 400, "ab" * 200, "", None]
    rows = [(3 * i - 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, block string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    twice = spark.createDataFrame([(1, "y" * 80), (1, "y" * 80), (None, "y" * 80), (2, "y" * 80)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(twice).collect()) == [(-1, 0), (1, 0), (1, 0), (2, 80)]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_op3_longest_previous_factors():
    """Against all pairs of suffixes."""
    rnd = random.Random(23)
    for letters, n in (("a", 120), ("ab", 200), ("abcd", 300), ("ab" * 20 + "c", 400)):
        raw = "".join(rnd.choice(letters) for _ in range(n))
        cut = rnd.randint(0, 40)
        raw += raw[cut : cut + 90] + raw[10:70]
        x, last = np.frombuffer(raw.encode(), np.uint8), len(raw) - 50
        start = np.array(sorted(rnd.sample(range(last + 1), min(last, 150))))
        doc = np.array([rnd.randint(0, 8) for _ in start])

        def common(a, b, raw=raw):
            k = 0
            while k < 50 and raw[a + k] == raw[b + k]:
                k += 1
            return k

        want = [max([common(a, b) for b, e in zip(start, doc, strict=True) if e < d], default=0) for a, d in zip(start, doc, strict=True)]
        assert substring_dedup.longest_previous_factors(x, start, doc).tolist() == want
    values = np.array([rnd.randint(0, 9) for _ in range(500)])
    assert substring_dedup.smaller_before(values).tolist() == [max([j for j in range(i) if values[j] < values[i]], default=-1) for i in range(500)]


def test_op3_long_texts_in_pieces():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(97, 123, 3 * substring_dedup.PIECE // 2, dtype=np.uint8)
    whole = substring_dedup.runs(raw, np.array([len(raw)]))
    assert whole[1].sum() == len(raw) - 49


def test_op4(spark, sf, docs):
    rows = {r.doc_id: r for r in registry.QUERIES["op4_language_id"](spark, sf).collect()}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(rows[i].lang_pred, lang) for i, _, lang, *_ in docs if rows[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_op4_cases(spark):
    model = langid.fit(spark.createDataFrame([(i, t, "b" if i % 2 else "a") for i, t in enumerate(["wort haus baum " * 20, "word house tree " * 20] * 5)] + [(99, None, "c"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"] and model.predict("haus baum")[0] == "a" and model.predict("tree house")[0] == "b"
    assert [model.predict(t)[0] for t in (None, "", "12 !")] == ["und"] * 3 and model.predict("tree " * 10)[1] <= 1
    out = langid.predict(odd(spark), model, keep=("k",))
    assert out.count() == len(ODD) + 2 and langid.predict(empty(spark), model).count() == 0
    none = langid.fit(empty(spark))
    assert none.predict("word") == ("und", 0.0)
    many = langid.Model({f"l{k:02d}": np.array([k * 7919 + 1], np.uint32) for k in range(70)})
    assert len(many.filters) == 2 and len(many.rates) == 70


def test_op5(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op5_pitman_yor"](spark, sf).collect()}
    words = {i: [w for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())] + [None] for i, t, *_ in docs}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in words.items():
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(train[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op5_texts_of_one_word_share_a_distribution(spark):
    """Texts of one word or none are disjoint, so their probabilities add up to less than one, an unknown word's too."""
    words = ["a", "b", "c", "d"]
    rnd = random.Random(2)
    train = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3)))) for i in range(60)]
    probe = [(1000 + k, w) for k, w in enumerate([*words, "zzz", ""])]
    df = spark.createDataFrame(train + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(df, learn=F.col("doc_id") < 1000).collect()}
    total = sum(10 ** got[1000 + k] for k in range(6))
    assert 0.2 < total < 1 and got[1004] < min(got[1000 + k] for k in range(4))


def test_op5_cases(spark):
    assert pitman_yor.score(empty(spark)).count() == 0
    rows = pitman_yor.score(odd(spark), learn=F.lit(False)).collect()
    assert len(rows) == len(ODD) + 2 and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)
    rows = pitman_yor.score(odd(spark)).collect()
    assert len({r.score for r in rows if r.n_tokens == 1}) == 1 and all(math.isfinite(r.score) for r in rows)
    rng = np.random.default_rng(0)
    t = pitman_yor.seat(np.array([0, 1, 2, 1000, 100_000]), np.full(5, 1.0), 0.8, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and t[3] < 1000 < t[4] * 1000


def test_op5_tables_have_their_posterior():
    """A context with 200 tables of other dishes: tables of one dish, given in turn the context's variable, against exact chances."""
    rng, d = np.random.default_rng(1), pitman_yor.DISCOUNT
    for c in (2, 48, 200, 600):
        stirling = [1.0]  # S(n, t) for t from 1 on, scaled
        for n in range(1, c):
            stirling = [(stirling[t - 2] if t > 1 else 0.0) + ((n - d * t) * stirling[t - 1] if t <= n else 0.0) for t in range(1, n + 2)]
            stirling = [s / max(stirling) for s in stirling]
        logs = [(math.log(s) if s else -math.inf) + sum(math.log(0.01 * (1.0 + d * (200 + k))) for k in range(t)) for t, s in enumerate(stirling, 1)]
        chance = [math.exp(x - max(logs)) for x in logs]
        want = sum(t * p for t, p in enumerate(chance, 1)) / sum(chance)
        t, means = np.ones(4000, np.int64), []
        for k in range(12):
            t = pitman_yor.seat(np.full(len(t), c), d * 0.01 * rng.gamma(1.0 / d + 200 + t), d, rng)
            means += [t.mean()] if k >= 4 else []
        assert np.mean(means) == pytest.approx(want, abs=0.06)


def test_op5_stirling_numbers_of_many_customers():
    c = pitman_yor.EXACT
    t = np.arange(1, c)
    off = pitman_yor._log_stirling_of(c, t, 0.8) - pitman_yor._log_stirling(0.8)[c][:-1]
    assert np.abs(off[:300]).max() < 1e-9 and np.abs(np.diff(off)).max() < 0.05
    assert np.isfinite(pitman_yor._log_stirling_of(100_000, np.array([1, 9000, 30_000, 99_999]), 0.8)).all()


def test_op5_tilted_stable():
    v = pitman_yor.tilted_stable(100_000, 1.7, 0.7, np.random.default_rng(2))
    assert np.exp(-v).mean() == pytest.approx(math.exp(-1.7 * (2**0.7 - 1)), rel=0.01) and v.mean() == pytest.approx(1.7 * 0.7, rel=0.02)


def test_op6(spark, sf):
    with duckdb.connect() as c:
        source = dict(c.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall())
    got = {r.page_id: r for r in registry.QUERIES["op6_html_extraction"](spark, sf).collect()}
    assert got.keys() == source.keys()
    for i, page in source.items():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\n", inner))).split())
        assert got[i].text == want and got[i].n_chars == len(want)


def test_op6_cases(spark):
    page = """<html><head><title>T</title></head><body><header>H</header><nav>menu<p>x</nav><div class="cookie-notice">C</div><main><h1>A&amp;B</h1><p>one <b>two</b>three<script>var x="</p>";</script>
    <aside>S</aside><div id=comments><article>no</article></div><form>F</form><p title="a>b">end&nbsp;x</main><footer>f</footer>"""
    assert html_text.main_text(html_text.Page(1, "", "h", "/", *html_text.read(page))) == "A&B one twothree end x"
    plain = lambda x: f"<div>Menu</div><div>{x}</div><div>Imprint</div>"
    rows = [(1, "http://h/a/1", plain("first")), (2, "http://h/a/2", plain("second")), (3, "http://other/a", plain("third")), (4, None, None), (5, "", ""), (6, "http://h/a/3", plain("second")), (7, "http://z/", "<p>un<p>closed <b"), (7, "http://z/", "<p>un<p>closed <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = Counter((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got[(1, "first")] and got[(2, "second")] and got[(3, "Menu third Imprint")] and got[(4, "")] and got[(5, "")] and got[(7, "un closed")] == 2
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    a, b = list("xabcy" * 3), list("xadcy" * 3)
    assert len(html_text.shared(a, b)) == 12
    assert html_text.lines("<p>" * 3000 + "deep")[-1][1] == "deep"


def test_op6_long_pages():
    """Exact common subsequences against the whole table, and template lines that are far shifted."""
    rnd = random.Random(13)
    for _ in range(200):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got, rest = sorted(html_text.shared(a, b)), iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in rest for i in got)
    text = lambda k, n: "".join(f"<p>{t}" for t in [f"own {k} {i}" for i in range(n)] + [f"menu {i}" for i in range(50)] + [f"end {k}"])
    page = lambda k, n: html_text.Page(k, "", "h", "/", *html_text.read(text(k, n)))
    for n, m in ((3000, 100), (100, 3000), (3000, 3900)):
        assert html_text.main_text(page(1, n), page(2, m)) == " ".join([*(f"own 1 {i}" for i in range(n)), "end 1"])
    started = time.process_time()
    assert html_text.lines("<div>" * 60_000 + "deep" + "</div>" * 60_000)[-1][1] == "deep" and time.process_time() - started < 3


def test_op6_differences_pages_with_an_article_too(spark):
    page = "<nav>Top {0}</nav><div>Menu</div><article><p>Lead {0}</p><p>Same in all</p></article><div>Body {0}</div><p class=ad>Buy {0}</p><div>Imprint</div>"
    rows = [(k, f"http://h.example/a/{k}", page.format(k)) for k in range(3)] + [(3, "http://alone.example/", page.format(3))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Lead {k} Same in all Body {k}" for k in range(3)} | {3: "Lead 3 Same in all"}


def test_op6_doesnt_depend_on_partitions(spark):
    """Against a walk over all pages in order, by any number of ranges."""
    rnd = random.Random(17)
    rows = []
    for k in range(60):
        host, topic = rnd.choice("ab"), rnd.choice(["x", "y", "x/z"])
        body = f"text {k}" if k % 7 else "same text"
        html_ = f"<div>Menu {host}</div><div>Topic {topic}</div><div>{body}</div><div>Imprint</div>"
        rows.append((k // 2, f"http://{host}.example/{topic}/{k % 20}", html_ if k % 11 else None, 1))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    pages = sorted(((u.split("/")[2], "/" + u.split("/", 3)[3], i, u, h or "") for i, u, h, _ in rows), key=lambda r: r[:4])
    made = [html_text.Page(r[2], r[3], r[0], r[1], *html_text.read(r[4])) for r in pages]
    ties = Counter(r[:4] for r in pages)
    want = Counter((p.id, p.url, html_text.main_text(p, made[i - 1] if i else None, made[i + 1] if i + 1 < len(made) else None)) for i, p in enumerate(made))
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 6, 40, 211):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        seen.append(Counter((r.page_id, r.url, r.text) for r in html_text.extract(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(s == seen[0] for s in seen) and max(ties.values()) == 2 and seen[0] == want
    assert any(t == "Topic x text 3" or "Menu" not in t for _, _, t in seen[0])


def test_op7(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op7_token_counts"](spark, sf).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(tokens(t)) for i, t, *_ in docs}
    places = defaultdict(list)
    for r in got.values():
        places[r.file].append((r.doc_index, r.first_token, r.n_tokens))
    for rows in places.values():
        rows.sort()
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(rows, rows[1:], strict=False))


def test_op7_cases(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 2)
    rnd = random.Random(4)
    files = {f: [rnd.choice([50256, 1, 2, 3]) for _ in range(rnd.randint(0, 40))] for f in range(12)} | {20: [5] * 37, 21: [50256] * 3}
    rows = []
    for f, ids in files.items():
        raw = np.array(ids, "<u4").tobytes()
        cut = [raw[k : k + 20] for k in range(0, len(raw), 20)] + [b""]
        rows += [(f, k, c) for k, c in enumerate(cut)]
    blocks = spark.createDataFrame(rows, "file int, block long, data binary")
    got = sorted((r.file, r.doc_index, r.first_token, r.n_tokens, r.ended) for r in token_counts.stitch(Scratch(spark, "t").save(token_counts.scan_blocks(blocks))).collect())
    want = []
    for f, ids in files.items():
        start = k = 0
        for at, x in enumerate(ids):
            if x == 50256:
                want.append((f, k, start, at - start, True))
                start, k = at + 1, k + 1
        if start < len(ids):
            want.append((f, k, start, len(ids) - start, False))
    assert got == sorted(want)


def test_op7_files(spark, tmp_path, monkeypatch):
    """Files of several ranges against a walk through each, written by others and by us."""
    rnd = random.Random(5)
    for width, sep in ((2, 50256), (4, 70_000)):
        folder, want = tmp_path / str(width), []
        folder.mkdir()
        for name in "abcde":
            ids = [rnd.choice([sep, 1, 2, 3, 4, 5]) for _ in range(rnd.randint(0, 200))] if name != "e" else []
            np.array(ids, f"<u{width}").tofile(folder / f"{name}.bin")
            start = k = 0
            for at, x in enumerate(ids):
                if x == sep:
                    want.append((name, k, start, at - start, True))
                    start, k = at + 1, k + 1
            if start < len(ids):
                want.append((name, k, start, len(ids) - start, False))
        (folder / "_unfinished").write_bytes(b"x")
        for size in (3, 20, 1 << 20):
            got = token_counts.count_tokens(spark, str(folder), separator=sep, range_bytes=size).collect()
            assert sorted((r.file[-5], r.doc_index, r.first_token, r.n_tokens, r.ended) for r in got) == sorted(want)
    (folder / "odd.bin").write_bytes(b"xyz")
    with pytest.raises(Exception, match="whole number"):
        token_counts.count_tokens(spark, str(folder), separator=70_000).collect()
    scratch = Scratch(spark, "t")
    placed = scratch.save(token_counts.write_files(clashing(spark).withColumn("file", F.lit("mine")), str(tmp_path / "own")))
    found = token_counts.count_tokens(spark, str(tmp_path / "own")).withColumn("file", F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("int"))
    both = placed.join(found, ["file", "doc_index"]).collect()
    assert sorted((r.id is None, r.id or 0, r.n_tokens) for r in both) == sorted((r.doc_id is None, r.doc_id or 0, len(tokens(r.text))) for r in odd(spark).collect())
    assert scratch.save(token_counts.write_files(empty(spark), str(tmp_path / "none"))).count() == 0 and token_counts.count_tokens(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="holds the separator"):
        token_counts.write_files(odd(spark), str(tmp_path / "bad"), separator=100).collect()


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_op8(spark, sf, docs):
    def fp(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    got = {r.doc_id: r for r in registry.QUERIES["op8_simhash_near_dedup"](spark, sf).collect()}
    fps = {i: fp(t) for i, t, *_ in docs}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_op8_links_are_all_found_once(spark):
    rnd = random.Random(9)
    near = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        near += [x] + [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))) for _ in range(6)]
    fps = sorted({y - (1 << 64) if y >> 63 else y for y in [*near, 0, 1, 3, (1 << 64) - 1]})
    got = [tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError, match="radius"):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 3)


def test_op8_broadcasts_no_exploded_side(spark):
    """The default threshold goes by the size of a file, but each of its rows becomes 17 or 33."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    nodes = Scratch(spark, "t").save(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    assert "Broadcast" not in simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()


def test_op8_cases(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD) + 2
    zero = {r.component_id for r in rows if r.fp == 0}
    assert zero == {0} and simhash.near_duplicates(empty(spark)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 4)], "a long, b long")
    out = {r.u: r.v for r in components.components(chain, Scratch(spark, "t")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {101: 100}


def test_op9(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op9_secret_scan"](spark, sf).collect()}
    kinds = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))
    for i, t, *_ in docs:
        found = [(m.start(), 0, m.end()) for m in kinds[0].finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in kinds[1].finditer(t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in kinds[2].finditer(t) if len(m[0]) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        n = Counter(k for _, k, _ in found)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (n[0], n[1], n[2], sha(text.encode()))


def test_op9_cases(spark):
    key = "q8Zr2LxV9tPw4KbN7sYd3Hf6"
    base, every = secret_scan.spans(f'Authorization: Bearer {key}\nclient_credential: "{key[::-1]}"; password = short; ſecret=abcdefghijklmn AKIA{"A" * 14} Token: abcdefghijkl')
    assert [k for _, k, _ in base] == [1, 0] and [k for _, k, _ in every] == [3, 3, 1, 0]
    assert secret_scan.spans("the secret organization_identifier_configuration was documented")[1] == []
    assert secret_scan.spans(None) == ([], []) and secret_scan.scan(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, f"é😀 token={key} end", 99), (2, None, 5), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(df).collect()}
    assert out == {1: ("é😀 [assign] end", 15), 2: (None, 5), 3: ("clean", 5)}
    assert secret_scan.scan(odd(spark)).count() == len(ODD) + 2


def test_op9_repeated_and_far_candidates():
    key = "q8Zr2LxV9tPw4KbN7sYd3Hf6uJc5mGe1RaTqXo0W"
    for gap in ("", " x" * 58, " x" * 65, " x" * 75):
        text = f"Authorization: Bearer {key}{gap}\nAuthorization: Bearer {key}\n"
        assert [text[s:e] for s, _, e in secret_scan.spans(text)[1]] == [key, key]
    text = f"access_key={key}\nthe credential {key}"
    assert len(secret_scan.spans(text)[1]) == 2
    for far, n in ((33, 1), (40, 1), (48, 1), (49, 0)):
        assert len(secret_scan.spans("credential" + " " * far + key)[1]) == n
    late = "QwZrTyPlKmNbVxSgHjFd" + "7" + key  # its first digit is past the reach of the word
    assert len(secret_scan.spans("credential" + " " * 40 + late)[1]) == 1


def test_op9_long_runs_in_linear_time():
    rnd = random.Random(4)
    run = "".join(rnd.choice("GHJKLMNPghjklmnp01234+/") for _ in range(400_000))
    assert secret_scan.spans(f"the credential is {run} ok")[1] == [(18, 3, 18 + len(run))]
    assert len(secret_scan.spans("secret deadbeefdeadbeef01 " * 20_000)[0]) == 20_000


def test_op9_calibration():
    """Random keys of four alphabets after sensitive words, and decoys: identifiers, paths, dotted names, dated names, camel case."""
    rnd = random.Random(1)
    leads = ("Authorization: Bearer {}", "credential {}", "private key is {}", "signature={}", "access_key -> {}", "passphrase was {}")
    names = "config service request handler manager session user token value index client server default schema buffer public vector".split()
    name = lambda: rnd.choice(names)
    prose = lambda: " ".join(rnd.choice(names) for _ in range(15))

    def caught(x):
        text = f"{prose()}\n{rnd.choice(leads).format(x)}\n{prose()}"
        at = text.index(x)
        return any(a < at + len(x) and at < b for a, _, b in secret_scan.spans(text)[1])

    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rnd.choice(a) for _ in range(n)) for a in (digits + upper + lower, digits + upper + lower + "+/", upper + "234567", digits + "ABCDEF") for n in (20, 32, 40, 64) for _ in range(40)]
    makers = (
        lambda: f"{name()}_{name()}_{name()}{rnd.randint(1, 99)}", lambda: f"usr/local/{name()}/{name()}{rnd.randint(1, 9)}.json", lambda: f"{name()}.{name()}.{name()}.{name()}.v2",
        lambda: f"{name()}-{name()}-{name()}-2024-01-0{rnd.randint(1, 9)}", lambda: "".join(name().capitalize() for _ in range(4)) + "2",
    )
    decoys = [makers[i % 5]() for i in range(500)]
    assert sum(map(caught, keys)) >= 0.99 * len(keys)
    assert sum(map(caught, [d for d in decoys if len(d) >= 16])) <= 0.08 * len(decoys)


def test_op10(spark, sf):
    df = registry.QUERIES["op10_decontaminate"](spark, sf)
    assert difference(df, decontaminate.ORACLE_SQL, sf) is None
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_op10_cases(spark, sf):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    swapped = item.replace("gamma", "other").replace("nu", "else").upper()
    rows = [(1, f"x y {item} z"), (2, f"{swapped}."), (3, "alpha beta gamma delta"), (4, None), (5, ""), (6, " ".join(item.split()[::-1])), (7, item[:40]), (1, f"x y {item} z"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    both = [sorted(map(tuple, decontaminate.overlaps(docs, bench, broadcast_bytes=n).collect()), key=repr) for n in (1 << 20, 0)]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {1, 2, None} and len(both[0]) == 3
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.overlaps(empty(spark), bench).count() == 0


def test_op10_any_two_substitutions_and_short_items(spark):
    """Against a join without seeds."""
    rnd = random.Random(12)
    items = {k: [f"w{k}x{i}" for i in range(n)] for k, n in enumerate((12, 16, 1, 5, 9, 11))}
    texts = [[f"z{i}" if i in (a, b) else w for i, w in enumerate(items[0])] for a in range(12) for b in range(a)]
    for _ in range(150):
        gone = rnd.sample(range(16), rnd.randint(2, 6))
        texts.append(["p", "q", *(f"z{i}" if i in gone else w for i, w in enumerate(items[1])), "r"])
    texts += [["a", *items[k], "b"] for k in (2, 3, 4, 5)] + [items[k] for k in (2, 3, 4, 5)] + [items[5][:-1], ["a", *items[4][:4], "no", *items[4][5:]], items[3][::-1]]

    def best(t, b):
        size, found = min(12, len(b)), 0
        for diag in range(1 - len(b), len(t)):
            eq = [t[p] == b[p - diag] for p in range(max(0, diag), min(len(t), diag + len(b)))]
            found = max([found, *(sum(eq[i : i + size]) for i in range(len(eq) - size + 1))])
        return found if found >= (10 if size == 12 else size) else 0

    want = {(i, k, best(t, b)) for i, t in enumerate(texts) for k, b in items.items() if best(t, b)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    for n in (1 << 20, 0):
        assert {(r.doc_id, r.item_id, r.best_window) for r in decontaminate.overlaps(docs, bench, broadcast_bytes=n).collect()} == want
    assert {i for i, k, _ in want if k == 0} == set(range(66))


def test_near_copies(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts = []
    for _ in range(8):
        own = [rnd.choice(words) for _ in range(150)]
        texts.append(" ".join(own))
        for _ in range(5):
            copy = own[:]
            for p in rnd.sample(range(150), 2):
                copy[p] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "a b", "a b", texts[0]]
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1, "clash")]
    df = spark.createDataFrame(rows, DOCS + ", k string")
    kept = near_copies.keep_one(df)
    assert {r.k for r in kept.collect()} == {"clash"} and kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == [0, 6, 12, 18, 24, 30, 36, 42, 48, 50]
    assert near_copies.keep_one(empty(spark)).count() == 0


def test_near_copies_broadcast_nothing_larger_than_its_file(spark, monkeypatch):
    """Sides that are exploded, and sets that compress, are joined by a shuffle at the default threshold."""
    plans = []

    class Seen(Scratch):
        def save(self, df):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return super().save(df)

    monkeypatch.setattr(near_copies, "Scratch", Seen)
    common = " ".join(f"w{i}" for i in range(200))
    kept = near_copies.keep_one(spark.createDataFrame([(i, f"{common} x{i}", "en", "s", 1) for i in range(20)], DOCS))
    assert [r.doc_id for r in kept.collect()] == [0]
    found = {part: [p for p in plans if part in p] for part in ("posexplode", "array_intersect", "SortMergeJoin [cell")}
    assert all(found.values()) and not any("Broadcast" in p for part in ("posexplode", "array_intersect") for p in found[part])


def test_near_copies_of_crossing_families(spark):
    """Edits of originals that share a passage, and texts with little but the passage, against components over all pairs."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(150)]
    texts = []
    for _ in range(3):
        own = passage + [word() for _ in range(50)]
        texts.append(own)
        for _ in range(40):
            copy = own[:]
            for p in rnd.sample(range(200), rnd.randint(2, 6)):
                copy[p] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(rnd.randint(10, 60))] for _ in range(80)]
    rnd.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    want = {find(i) for i in range(len(texts))}
    assert 20 < len(want) < 120
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == want


def test_pipeline(spark, sf, docs):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "exact").collect()}
    with duckdb.connect() as c:
        bench = c.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()
    whole = {i for i, t, *_ in docs if any(b in t for b, in bench)}
    first = {}
    for i, t, *_ in sorted(docs):
        first.setdefault(t, i)
    assert len(out) > 0.7 * len(docs) and all(r.exact for r in out.values())
    assert not whole & out.keys() and out.keys() <= set(first.values())


@pytest.mark.parametrize("slots", [1, 3, 1 << 20])
def test_decontamination_moves_doubtful_texts_only(spark, sf, monkeypatch, slots):
    monkeypatch.setattr(corpus_pipeline, "SLOTS", slots)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lit(-1).cast("long").alias("doc_id"), F.concat(F.lit("before "), "text").alias("text")).limit(1)
    docs = docs.unionByName(item, allowMissingColumns=True)
    leaks = {r["doc_id"] for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if more texts were found than can be broadcast
    try:
        made = corpus_pipeline.decontamination(spark, docs, sf)
        plan, kept = made._jdf.queryExecution().sparkPlan().toString(), [r["doc_id"] for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert made.columns == docs.columns and -1 in leaks
    assert sorted(kept) == sorted(r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] not in leaks)
    head, *below = plan.split("SortMergeJoin", 1)[1].split("\n")
    assert "LeftAnti" in head and any("BroadcastHashJoin" in line and "LeftSemi" in line for line in below[:3])


def test_pipeline_of_odd_rows(spark, sf):
    scratch = Scratch(spark, "t")
    for rows in (odd(spark), clashing(spark), clashing(spark).drop("n_chars"), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            made = scratch.save(stage(spark, rows, sf))
            if name != "byte_bpe":
                assert made.schema.simpleString() == rows.schema.simpleString()
                mine = [c for c in rows.columns if c not in DOCS]
                assert all(r[c] == before[c] for r in made.collect() for before in rows.limit(1).collect() for c in mine)
            rows = made
        assert rows.count() in (0, 6)  # five texts without a letter, a copy and a text of unknown words go


def test_language_stage(spark, sf, docs):
    """Against the model itself, and texts that leave doubt."""
    df = spark.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n in docs] + [(10**6, "zq", None, "", 2), (10**6 + 1, "zqxj " * 200, None, "", 1000), (10**6 + 2, "123 456", None, "", 7)], DOCS)
    model = langid.fit(df)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, df, sf).collect()}
    for i, t, *_ in docs:
        lang, p, n = model.judge(t)
        z = 9 / n if n else 0
        most = (p + z / 2 + math.sqrt(z * p * (1 - p) + z * z / 4)) / (1 + z)
        assert (i in kept) == (lang != "und" and (n == 0 or most >= corpus_pipeline.LEAST_SCORE))
    assert 10**6 in kept and not {10**6 + 1, 10**6 + 2} & kept


def test_secret_stage(spark, sf):
    key = "q8Zr2LxV9tPw4KbN7sYd3Hf6"
    df = spark.createDataFrame([(1, f"a token={key} b", "en", "s", 5), (2, f"Authorization: Bearer {key}", "en", "s", 5), (3, "clean words", "en", "s", 11)], DOCS)
    assert [r.text for r in corpus_pipeline.secret_scan_stage(spark, df, sf).orderBy("doc_id").collect()] == ["a [assign] b", "Authorization: Bearer [novel]", "clean words"]


def test_op4_long_texts_in_pieces(monkeypatch):
    text = "wörter und häuser " * 50
    whole = np.concatenate(list(langid.grams(text)))
    for piece in (1, 7, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(np.concatenate(list(langid.grams(text))), whole)


def test_op4_filters_against_sets():
    """Bloom filters hold all n-grams put in, and corrected counts are near the true ones."""
    rng = np.random.default_rng(3)
    sets = {k: rng.integers(0, 1 << 32, 20_000, dtype=np.uint32) for k in ("a", "b", "c")}
    model = langid.Model(sets)
    for k, own in enumerate(sets.values()):
        one, two = langid._slots(own)
        assert ((model.filters[0][one] & model.filters[0][two]) >> k & 1).all()
    probe = np.concatenate([sets["b"][:3000], rng.integers(0, 1 << 32, 7000, dtype=np.uint32)])
    one, two = langid._slots(probe)
    masks = model.filters[0][one] & model.filters[0][two]
    hits = np.array([np.count_nonzero(masks >> k & 1) for k in range(3)])
    true = (hits - len(probe) * model.rates) / (1 - model.rates)
    assert np.abs(true - [0, 3000, 0]).max() < 150
