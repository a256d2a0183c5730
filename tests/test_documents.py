"""Images, mapping, documents, annotations and what is read and written around them."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import register
from sieveline.functions import text as T
from sieveline.operators import annotations, dataset, documents, imaging, layout, mapping, metrics, ner, raster
from sieveline.sources import readers, writers

IMAGE = "image_id long, height int, width int, channels int, data binary"


def page() -> np.ndarray:
    """White, with two lines of black bars as characters: 12 bars of 8 pixels each 14."""
    out = np.full((80, 200, 3), 255, np.uint8)
    for top in (10, 45):
        for k in range(12):
            out[top : top + 20, 10 + 14 * k : 18 + 14 * k] = 0
    return out


def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]


def rows(spark, *images):
    return spark.createDataFrame([(i, *x.shape, bytearray(x.tobytes())) for i, x in enumerate(images)], IMAGE)


def test_documents(spark, tmp_path):
    lines = [[box(10, 10, 172, 30), ["a@example.cc", 0.9]], [box(10, 45, 172, 65), ["no entity at", 0.8]]]

    class Bars:
        def __init__(self, arguments):
            assert arguments["lang"] == "ch"

        def recognise(self, image):
            if image.mean() < 10:
                raise RuntimeError("too dark")
            return [lines]

    images = rows(spark, page(), np.zeros((20, 20, 3), np.uint8))
    documents.process(images, Bars, mode="black").write.parquet(str(tmp_path / "made"))
    kept = spark.read.parquet(str(tmp_path / "made"))
    out = {r.image_id: r for r in kept.collect()}
    first = out[0]
    assert first.full_text == "a@example.cc\nno entity at" and [(e.type, e.text) for e in first.entities] == [("email", "a@example.cc")]
    assert first.result[:4] == b"\x89PNG" and first.entities[0].enabled and len(first.entities[0].boxes) == 1
    assert out[1].entities == [] and out[1].warnings == ["OCR failed: RuntimeError"] and out[1].result
    made = kept.select("image_id", "full_text", "entities", "warnings")
    assert json.loads(documents.report(made).orderBy("image_id").first().report)["entities"][0]["type"] == "email"
    off = made.withColumn("entities", F.transform("entities", lambda e: e.withField("enabled", F.lit(False))))
    assert documents.regenerate(images, off, "mosaic").where("image_id = 0").first().result == raster.png(page())
    seen, new = documents.cached(images, spark.createDataFrame([("x", "[]")], "key string, result string"))
    assert seen.count() == 0 and new.count() == 2


def test_engine_settings_and_cache():
    s = documents.EngineSettings(detection_model="m", device="auto", options={"a": 1, "b": None})
    assert "lang" not in s.arguments() and "device" not in s.arguments() and s.arguments()["a"] == 1 and "b" not in s.arguments()
    assert documents.EngineSettings(version="v", device="gpu").arguments()["ocr_version"] == "v"
    calls, clock = [], [0.0]

    class Counting:
        def __init__(self, arguments):
            calls.append("made")

        def recognise(self, image):
            calls.append("read")
            return []

    for at in (0, 10, 700):
        clock[0] = at
        documents._result(page(), Counting, {"x": 1}, lambda: clock[0])
    for k in range(documents.KEPT + 5):
        documents._result(np.full((2, 2, 1), k, np.uint8), Counting, {"x": 1}, lambda: clock[0])
    assert calls.count("made") == 1 and calls.count("read") == 2 + documents.KEPT + 5 and len(documents._recent) == documents.KEPT
    documents._recent.clear()


def _parts(spark, image):
    part = [(1, 1, 0, 2, 6, "cdef", False, "abcdefghijkl", box(10.0, 10.0, 178.0, 30.0), 0.9, "direct", None, (*image.shape, bytearray(image.tobytes())) if image is not None else (None, None, None, None))]
    return spark.createDataFrame(part, "id int, entity int, block_index int, start int, end int, entity_text string, cross_block boolean, block_text string, block_polygon array<array<double>>, block_confidence double, alignment string, forced_reason string, image struct<height:int,width:int,channels:int,data:binary>")


def test_mapping(spark):
    balanced = mapping.Mapper(safety="balanced", pad_x=1.0, pad_y=1.0)
    r = mapping.map_parts(_parts(spark, page()), balanced).first()
    assert r.mapping_quality == "refined" and r.mapping_strategy in ("component", "projection") and r.fallback_reason is None and r.mapping_confidence > 0.9
    xs = [p[0] for p in r.polygon]
    assert 38 - 10 <= min(xs) <= 38 and 88 <= max(xs) <= 88 + 10  # the third to the sixth bar, and padding
    blank = mapping.map_parts(_parts(spark, np.full((80, 200, 3), 255, np.uint8))).first()
    assert blank.mapping_quality == "coarse" and "ink_refinement_failed" in blank.fallback_reason
    none = mapping.map_parts(_parts(spark, None), mapping.Mapper(pad_x=4.0, pad_y=3.0, least_width=3.0, least_height=3.0)).first()
    plain = layout.map_parts(_parts(spark, None)).first()
    assert (none.mapping_confidence, none.mapping_quality, none.polygon) == (plain.mapping_confidence, plain.mapping_quality, plain.polygon)
    with pytest.raises(ValueError, match="safety"):
        mapping.Mapper(safety="loose")


def test_imaging(spark):
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert imaging.upright(x, 6).shape == (4, 2, 3) and (imaging.upright(imaging.upright(x, 6), 8) == x).all() and (imaging.upright(x, 2) == x[:, ::-1]).all()
    tiff = b"II*\0" + struct.pack("<IHHHIH", 8, 1, 0x0112, 3, 1, 6) + b"\0\0"
    body = b"Exif\0\0" + tiff
    assert imaging.orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9") == 6 and imaging.orientation(b"PNG") == 1
    dark = np.random.default_rng(0).integers(0, 60, (40, 60, 3), dtype=np.uint8)
    made = imaging.prepare(dark, max_side=30, grayscale=True)
    assert made["image"].shape == (20, 30, 3) and made["image"].mean() > dark.mean() and made["scale_x"] == 2 and (made["original"] == dark).all()
    assert set(np.unique(imaging.prepare(page(), binarize=True)["image"])) == {0, 255}
    clear = np.zeros((4, 4, 4), np.uint8)
    assert (imaging.opaque(clear) == 255).all() and imaging.thumbnail(np.zeros((10, 3000, 3), np.uint8)).shape == (5, 1440, 3)
    out = {r.image_id: r for r in imaging.prepared(rows(spark, page()).unionAll(spark.createDataFrame([(9, 3, 3, 3, bytearray(b"x"))], IMAGE))).collect()}
    assert out[0].error is None and (out[0].original_height, out[0].original_width) == (80, 200) and out[9].error
    shown = imaging.previews(rows(spark, page()).withColumn("boxes", F.array(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in box(5, 5, 50, 40)])))).first()
    assert shown.preview[:4] == shown.thumbnail[:4] == b"\x89PNG"
    drawn = imaging.outlined(page(), [box(5, 5, 50, 40)])
    assert tuple(drawn[5, 20]) == imaging.RED and (drawn[70] == page()[70]).all()


def test_rectified_lines():
    line = imaging.rectified(page(), box(10, 10, 178, 30))
    assert line["ink"].shape == (20, 168) and len(imaging.ink_groups(line["ink"])) == 12
    moved = imaging.refine_by_components(line, 2.1 / 12, 6.2 / 12, 4)
    assert moved["success"] and moved["component_match_ratio"] == 1 and abs(moved["start_ratio"] * 168 - 28) <= 2
    good = imaging.coverage(line, box(36, 10, 92, 30), 4, 12, 0)
    assert good["valid"] and not imaging.coverage(line, box(40, 10, 47, 30), 4, 12, 0)["valid"]
    assert imaging.rectified(page(), [[0, 0]]) is None


def test_annotations(spark):
    entity = "array<struct<type:string,text:string,start:int,end:int,boxes:array<array<double>>>>"
    data = [
        ("a.png", 100, 50, "call Bob", "t1", [("person", "Bob", 5, 8, [[0.0, 0.0, 10.0, 10.0], [0.0, 20.0, 10.0, 30.0]]), ("phone", "xx", 0, 2, [])]),
        ("b.png", 100, 50, "x", None, []), ("c.png", None, None, "y", "t1", [("phone", "y", 0, 1, [])]), ("d.png", 10, 10, "z", "t2", [("phone", "z", 0, 1, [[0.0, 0.0, 11.0, 5.0]])]),
    ]
    df = spark.createDataFrame(data, f"image string, width int, height int, text string, template string, entities {entity}")
    assert sorted((r.image, r.error) for r in annotations.problems(df).collect()) == [("a.png", "empty_boxes"), ("a.png", "span_mismatch"), ("c.png", "missing_image"), ("d.png", "box_out_of_bounds")]
    p = annotations.profile(df).first()
    assert (p.annotations, p.readable, p.negative_samples, p.entities, p.cross_line_entities, p.empty_boxes) == (4, 3, 1, 3, 1, 1)
    assert p.by_template == {"t1": 2, "t2": 1, "unknown": 1} and annotations.profile(df).select(F.map_keys("by_type")).first()[0] == ["person", "phone"]
    assert [r.image for r in annotations.without_annotation(spark.createDataFrame([("a.png",), ("e.png",)], "image string"), df).collect()] == ["e.png"]
    named = annotations.samples(spark.createDataFrame([(None, "t", 3), ("x", " ", 4), ("y", "u", 5)], "id string, text string, row int"))
    assert {r.id for r in named.collect()} == {"sample_000003", "y"}
    m = annotations.manifest(spark.createDataFrame([("a.png", 1)], "image string, row int"), {"license": "own"}).first()
    assert (m.image_path, m.id, m.license) == ("a.png", "image_test_000001", "own")
    tree = annotations.image_tree(spark.createDataFrame([("/r/g/a.PNG",), ("/r/g/b.json",), ("/r/g/a.json",), ("/r/h/c.jpg",), ("/r/h/d.txt",)], "path string"))
    assert sorted(map(tuple, tree.collect()), key=str) == [("/r/g/a.PNG", "g", "/r/g/a.json"), ("/r/h/c.jpg", "h", None)]
    cases = spark.createDataFrame([(i // 2,) for i in range(60)], "id int")
    assert annotations.first_ids(cases, "id").count() == 40
    chars = spark.createDataFrame([(1, i, c, 10.0) for i, c in enumerate("abcd\nef")], "id int, pos int, ch string, advance double")
    laid = annotations.wrapped(chars, "id", width=30.0, height=12.0)
    assert [(r.pos, r.line) for r in laid.orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (5, 2), (6, 2)]
    assert annotations.merged_boxes(laid, "id").where("line = 0").first().x2 == 33.0


def test_training_records(spark):
    steps = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "epoch int, loss double")
    assert {r.epoch: r.loss for r in annotations.history(steps).collect()} == {1: 3.0, 2: 1.0}
    e = spark.createDataFrame([("r", i, f) for i, f in enumerate([0.5, 0.7, 0.7, 0.6, 0.8])], "run string, epoch int, f1 double")
    out = annotations.early_stopping(e, "f1", 2).orderBy("epoch").collect()
    assert [r.stale for r in out] == [0, 0, 1, 2, 0] and [r.stop for r in out] == [False, False, False, True, False]
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 3, 3), (1, 2, 3, 6)], "doc_id int, token int, start int, end int")
    ents = spark.createDataFrame([(1, "person", 0, 3), (1, "email", 3, 6), (1, "person", 6, 9)], "doc_id int, type string, start int, end int")
    assert tuple(ner.alignment_stats(tokens, ents, ner.align(tokens, ents)).first()) == (1, 1, 1, 1)
    enc = ner.encoded(spark.createDataFrame([(1, "abc")], "doc_id int, text string"), lambda t: [(ord(c), i, i + 1) for i, c in enumerate(t)], 2).first()
    assert enc.ids == [97, 98] and enc.truncated == 1


def test_windowed_prediction(spark):
    class Letters:
        labels = ["O", "B-PERSON"]

        def tokens(self, text):
            return [(i, i + 1) for i in range(len(text))]

        def scores(self, text, tokens):
            return np.array([[0.0, 2.0 if text[a] == "x" else -2.0] for a, _ in tokens])

    w = ner.Windowed(Letters(), size=4, overlap=1)
    assert w.windows(10) == [(0, 4), (3, 7), (6, 10)] and w.windows(0) == []
    got = w.predict(["aax"])[0]
    assert [r[4] for r in got] == ["O", "O", "B-PERSON"] and got[2][5] == pytest.approx(1 / (1 + np.exp(-2)))
    df = spark.createDataFrame([(1, "aax")], "doc_id int, text string")
    assert ner.predict(df, lambda: ner.Windowed(Letters())).where("label = 'B-PERSON'").count() == 1

    def broken():
        raise OSError("no model")

    assert ner.predict(df, broken).count() == 0


def test_splits_by_sources_and_labels(spark):
    data = []
    for t in range(400):
        n = 200 if t < 4 else 5
        src, lab = ("a", "phone") if t % 2 else ("b", "email")
        data += [(f"t{t}", src, [(lab, "x", 0, 1)], f"{t}-{k}") for k in range(n)]
    df = spark.createDataFrame(data, f"template_sha256 string, source string, entities array<{dataset.ENTITY}>, text_sha256 string")
    ratios = {"train": 0.8, "validation": 0.1, "test_fixed": 0.1}
    out = dataset.assign_splits(df, ratios).cache()
    assert out.count() == df.count() and out.groupBy("template_sha256").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    per = {(r.source, r.split): r["count"] for r in out.groupBy("source", "split").count().collect()}
    for s in "ab":
        total = sum(v for (x, _), v in per.items() if x == s)
        assert all(abs(per.get((s, k), 0) / total - v) < 0.12 for k, v in ratios.items())
    fixed = out.where("split = 'test_fixed'")
    again = dataset.assign_beside_frozen(df, fixed, ratios)
    assert again.where("split = 'test_fixed'").count() == fixed.count() and again.count() == df.count()
    with pytest.raises(ValueError, match="absent"):
        dataset.assign_beside_frozen(df.where("source = 'a'"), fixed, ratios)


def test_small_splits_are_the_whole_sequence(spark):
    """Below a thousand records every template is placed one by one, by the least pressure."""
    data = [(f"t{t}", "ab"[t % 2], [("phone" if t % 3 else "email", "x", 0, 1)]) for t in range(30) for _ in range(30 - t)]
    df = spark.createDataFrame(data, f"template_sha256 string, source string, entities array<{dataset.ENTITY}>")
    ratios = {"train": 0.7, "validation": 0.2, "test_fixed": 0.1}
    got = {r.template_sha256: r.split for r in dataset.assign_splits(df, ratios).select("template_sha256", "split").distinct().collect()}
    total, filled, srcs, labs = len(data), {}, {}, {}
    size = lambda key, i: sum(1 for d in data if (d[i] if i == 1 else d[2][0][0]) == key)
    for t in range(30):
        n, src, lab = 30 - t, "ab"[t % 2], "phone" if t % 3 else "email"

        def score(s, n=n, src=src, lab=lab):
            own = (filled.get(s, 0) + n) / (total * ratios[s])
            return own + 0.3 * (srcs.get((s, src), 0) + n) / (size(src, 1) * ratios[s]) + 0.7 * (labs.get((s, lab), 0) + n) / (size(lab, 2) * ratios[s]), own, list(ratios).index(s)

        best = min(ratios, key=score)
        assert got[f"t{t}"] == best
        filled[best] = filled.get(best, 0) + n
        srcs[best, src] = srcs.get((best, src), 0) + n
        labs[best, lab] = labs.get((best, lab), 0) + n


def test_dataset_reports(spark):
    assert dataset.label_map({"aliases": {"PER": "person"}, "targets": ["person"]}) == ({"PER": "person"}, ("person",))
    with pytest.raises(ValueError, match="label map"):
        dataset.label_map({"aliases": {}})
    assert dataset.bio_labels(("person",)) == {"O": 0, "B-PERSON": 1, "I-PERSON": 2}
    assert dataset.overridden({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}, "d": 3}
    with pytest.raises(ValueError, match="unknown"):
        dataset.overridden({"a": 1}, {"x": 1})
    rec = spark.createDataFrame([("f", 1, '{"text": "ab", "entities": [{"type": "x", "text": "a", "start": 0, "end": 1}, {"start": 0}]}'), ("f", 2, "bad"), ("g", 1, '{"text": "c", "entities": []}')], "file string, row int, value string")
    t = dataset.profile_totals(dataset.profile(rec, "file", "value"), "file").first()
    assert (t.files_scanned, t.lines, t.malformed, t.entities, t.invalid_entities) == (2, 3, 1, 2, 1)
    assert {(r.file, r.type): r.n for r in dataset.entity_type_counts(rec, "value", "file").collect()} == {("f", "x"): 1, ("f", "<missing>"): 1}
    assert dataset.first_errors(rec, "file", "value").collect()[0].row == 2 and dataset.first_sample(rec, "file", "value").count() == 2
    assert annotations.sorted_counts(dataset.entity_type_counts(rec, "value"), "type", "n").select(F.map_keys("counts")).first()[0] == ["<missing>", "x"]
    r = spark.createDataFrame([("train", "s", [("x", "a", 0, 1)]), ("test_fixed", "s", [])], f"split string, source string, entities array<{dataset.ENTITY}>")
    m = json.loads(dataset.split_manifest(r, spark.createDataFrame([("p", "h")], "path string, sha256 string"), 42, F.lit("2024-01-02 03:04:05").cast("timestamp")).first().manifest)
    assert m["seed"] == 42 and m["train_count"] == 1 and m["source_file_hashes"] == {"p": "h"} and json.loads(m["label_distribution"]["train"]) == {"x": 1} and m["created_at"].startswith("2024-01-02T03:04:05")


def test_tables_and_reports(spark):
    e = spark.createDataFrame([(1, 0, "phone", "x", 0.123456), (1, 1, "email", "y", 0.5)], "doc_id int, ordinal int, type string, text string, confidence double")
    edits = spark.createDataFrame([(1, 1, "url", False), (1, 7, "url", False)], "doc_id int, ordinal int, type string, enabled boolean")
    out = {r.ordinal: (r.type, r.enabled) for r in documents.edited(e, edits).collect()}
    assert out == {0: ("phone", True), 1: ("url", False)}
    shown = documents.display(documents.edited(e, edits), "doc_id")
    assert len(shown.columns) == 13 and shown.where("type = 'phone'").first().confidence == 0.1235
    perf = documents.performance(spark.createDataFrame([("r", {"ocr": 1.5, "secret text": 9.0}, {"ocr_calls": 2})], "request_id string, stages map<string,double>, counters map<string,long>")).first()
    assert len(perf) == 19 and perf.ocr == 1.5 and perf.detection == 0 and perf.ocr_calls == 2
    assert json.loads(documents.text_report(spark.createDataFrame([(1, "t", ["a"])], "doc_id int, text string, final array<string>")).first().report) == {"text": "t", "rule": [], "ner": [], "context": [], "final": ["a"]}
    res = spark.createDataFrame([("secret", [("phone", "138", 0, 3, [[0.0]])])], "text string, entities array<struct<type:string,text:string,start:int,end:int,boxes:array<array<double>>>>")
    assert "138" not in str(writers.private_report(res).first()) and writers.private_report(res).first().entities[0].boxes == [[0.0]]
    rows_ = spark.createDataFrame([(True, True, True, False, 0.97, "a"), (True, False, False, False, None, "a"), (False, True, False, False, None, "b"), (True, True, False, True, 0.5, "b")], "truth boolean, predicted boolean, exact boolean, partial boolean, iou double, type string")
    m = metrics.image_metrics(rows_).first()
    assert (m.truth, m.predicted, m.matched, m.missed, m.false_positives, m.complete, m.partly_covered) == (3, 3, 2, 1, 1, 1, 1) and m.f1 == pytest.approx(2 / 3)
    assert metrics.image_metrics(rows_, "type").count() == 2 and sorted(r.error for r in metrics.image_cases(rows_).collect()) == ["false_positive", "missed", "partial"]


def test_files(spark, tmp_path):
    big = "\n".join(json.dumps({"i": i}) for i in range(5000))
    (tmp_path / "a.jsonl").write_text(big)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.lines(spark, str(tmp_path / "a.jsonl"))
        assert got.where(F.get_json_object("value", "$.i").cast("int") != F.col("row") - 1).count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert readers.raw_files(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path), {"x": ["*.none"]})
    up = readers.uploaded(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "gone")])
    assert {r.filename: r.length for r in up.collect()} == {"a.jsonl": len(big), "gone": None}
    df = spark.createDataFrame([("n1", "{}"), ("n2", None)], "name string, value string")
    assert len(writers.json_files(df, str(tmp_path / "out"), "name", "value").collect()) == 2 and (tmp_path / "out" / "n2.json").read_text() == "null"
    img = spark.createDataFrame([("a/b", bytearray(b"r"), None, bytearray(b"m"))], "name string, result binary, preview binary, mask binary")
    r = writers.image_files(img, str(tmp_path / "img"), "name", "black").first()
    assert r.stem == "a_b" and r.result_path.endswith("_black.png") and r.preview_path is None and r.mask_path.endswith("_mask.png")


def test_validators_have_one_definition(spark):
    register.register(spark)
    cases = ["+86 138-1234-5678", "８６13812345678", "138１2345678", "8613812345678", "12345", None, "11010519491231002X", "1101051949 1231002x", "１10105194912310021"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for name, f in (("phone_valid", T.is_phone), ("cn_id_valid", T.is_resident_id)):
        out = df.select(F.expr(f"{name}(p)").alias("a"), f(F.col("p")).alias("b")).collect()
        assert all((r.a or False) == (r.b or False) for r in out) and any(r.a for r in out)
    ips = {"::ffff:1.2.3.4": True, "1::2.3.4.5": True, "::1.2.3.400": False, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:1.2.3.4": True, "1:2:3:4:5:6:7:1.2.3.4": False, "1.2.3.4": True, "01.2.3.4": False}
    out = spark.createDataFrame(list(ips.items()), "p string, want boolean").select(T.is_ip(F.col("p")).alias("got"), "want", "p").collect()
    assert [r.p for r in out if r.got != r.want] == []
