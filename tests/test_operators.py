"""The operators on texts and arrays made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import geometry as G
from sieveline.functions import register
from sieveline.functions import text as T
from sieveline.functions.spans import spans
from sieveline.operators import batch, dataset, fusion, history, layout, masking, metrics, ner, raster, rules
from sieveline.sources import readers, writers
from sieveline.streaming import folder


def resident_id(prefix: str) -> str:
    return prefix + T.ID_CHECK[sum(int(d) * w for d, w in zip(prefix, T.ID_WEIGHTS, strict=True)) % 11]


def found(spark, text, **options):
    df = fusion.detect(spark.createDataFrame([(text,)], "text string"), **options)
    return [(e.type, e.normalized_text, e.start, e.end, e.validation) for e in df.first().final]


GOOD_ID = resident_id("11010519900101123")


CASES = [
    ("联系电话：138 1234-5678。", [("phone", "13812345678", 5, 18, "passed")]),
    ("86-138-1234-5678", [("phone", "13812345678", 0, 16, "passed")]),
    (f"号{GOOD_ID}", [("id_number", GOOD_ID, 1, 19, "passed")]),
    ("身份证 110105199013011233", [("id_number", "110105199013011233", 4, 22, "failed")]),
    ("110105199013011233x", []),
    ("卡 4111 1111 1111 1111", [("bank_card", "4111111111111111", 2, 21, "passed")]),
    ("卡号 4111 1111 1111 1112", [("bank_card", "4111111111111112", 3, 22, "failed")]),
    ("a.b@c.com", [("email", "a.b@c.com", 0, 9, "passed")]),
    ("10.0.0.1 and 10.0.0.256 and 10.0.0.1.", [("ip_address", "10.0.0.1", 0, 8, "passed")]),
    ("fe80::1 x 1:2:3:4:5:6:7:8 x 1::2::3", [("ip_address", "fe80::1", 0, 7, "passed"), ("ip_address", "1:2:3:4:5:6:7:8", 10, 25, "passed")]),
    ("see https://a.b/c). 。", [("url", "https://a.b/c", 4, 17, "passed")]),
    ("E12345678", []),
    ("护照e12345678", [("passport", "E12345678", 2, 11, "passed")]),
    ("😀京a12345", [("license_plate", "京A12345", 1, 8, "passed")]),
    ("微信 wechat wechat_ab1", [("wechat_id", "wechat_ab1", 10, 20, "passed")]),
    ("", []),
    (None, []),
    ("x\u0001a@b.cc", [("email", "a@b.cc", 2, 8, "passed")]),
]


def test_rules(spark):
    df = fusion.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string"))
    got = {r.i: [(e.type, e.normalized_text, e.start, e.end, e.validation) for e in r.final] for r in df.collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_context_and_disabled_types_still_suppress(spark):
    text = "收件人：张三，电话另附。地址：测试市某路1号。其他"
    assert [(t, n) for t, n, *_ in found(spark, text)] == [("person", "张三"), ("address", "测试市某路1号")]
    assert found(spark, f"身份证{GOOD_ID} 13812345678", types={"phone"}) == [("phone", "13812345678", 22, 33, "passed")]
    assert found(spark, f"身份证{GOOD_ID}", types=set()) == []


def test_long_text_and_spans_keep_code_points(spark):
    text = "😀" * 50_000 + " a@b.cc"
    row = spark.createDataFrame([(text,)], "text string").select(spans(F.col("text"), rules.EMAIL).alias("s")).first()
    assert [(s.start, s.end) for s in row.s] == [(50_001, 50_007)]


def test_model_entities_are_merged_and_win(spark):
    kind = "array<struct<type:string,text:string,start:int,end:int,confidence:double,source:string>>"
    df = spark.createDataFrame([("联系人：张三丰在", [("person", "张三丰", 4, 7, 0.9, "ner"), ("person", "在", 7, 8, 0.3, "ner")])], f"text string, ner {kind}")
    out = fusion.detect(df, ner_col="ner", thresholds={"person": 0.7}).first().final
    assert [(e.text, e.sources) for e in out] == [("张三丰", ["ner"])]


def test_masks(spark):
    row = spark.createDataFrame([("13812345678 110105199001011232 a@b.com",)], "t string").select(masking.mask_message(F.col("t")).alias("m")).first()
    assert row.m == "138****5678 110***********1232 [EMAIL]"


def test_pluggable_model(spark):
    class Fake:
        def predict(self, texts):
            return [[(0, 0, 0, 1, "B-person", 0.8), (0, 1, 1, 2, "I-person", 0.6), (1, 0, 0, 2, "B-person", 0.9)] if t else [] for t in texts]

    docs = spark.createDataFrame([(1, "张三"), (2, None)], "doc_id long, text string")
    got = ner.merge_windows(ner.token_runs(ner.predict(docs, Fake))).collect()
    assert [(r.doc_id, r.type, r.start, r.end, r.confidence) for r in got] == [(1, "person", 0, 2, 0.9)]
    assert ner.predict(docs, lambda: None).count() == 0


def test_overlapping_entities_cant_be_aligned(spark):
    t = spark.createDataFrame([(1, 1, 0, 4)], "doc_id long, token int, start int, end int")
    e = spark.createDataFrame([(1, "person", 0, 2), (1, "person", 1, 3)], "doc_id long, type string, start int, end int")
    with pytest.raises(Exception, match="overlapping entities"):
        ner.align(t, e).collect()


def test_matching_is_exact_first(spark):
    kind = "array<struct<type:string,text:string>>"
    df = spark.createDataFrame([("a", [("p", "张三丰"), ("p", "张三")], [("p", "张三"), ("p", "张")])], f"image string, truth {kind}, predicted {kind}")
    assert sorted(tuple(r)[1:] for r in metrics.match_entities(df).collect()) == [(0, 1, "partial"), (1, 0, "exact")]


def test_normal_form_and_fuzzy(spark):
    assert layout.normal_with_map("Ａ b，")[0] == "ab,"
    pairs = spark.createDataFrame([(1, 0, "abc", 0, "x ABC abc"), (1, 1, "abcdef", 0, "zabcdxfz")], "doc_id long, entity int, value string, block_index int, text string")
    got = sorted((r.entity, r.start, r.end, r.reason) for r in layout.find_in_blocks(pairs, "doc_id").collect())
    assert got[:2] == [(0, 2, 5, "non_unique_normalized_match"), (0, 6, 9, "non_unique_normalized_match")] and got[2][3] == "fuzzy_text_match"


def test_boxes(spark):
    box = [[0.0, 0.0], [80.0, 0.0], [80.0, 20.0], [0.0, 20.0]]
    df = spark.createDataFrame([("一二三四五六七八", box, 0.9, 3, 5, "四五", "direct", None, False)], "block_text string, block_polygon array<array<double>>, block_confidence double, start int, end int, entity_text string, alignment string, forced_reason string, cross_block boolean")
    row = layout.map_parts(df, strict=False, pad_x=0.0, pad_y=0.0).first()
    assert row.mapping_quality == "estimated" and row.polygon[0][0] == pytest.approx(30 - 1.6) and row.polygon[1][0] == pytest.approx(50 + 1.6)
    assert spark.range(1).select(G.clip(F.array(F.array(F.lit(-3.0), F.lit(99.0))), F.lit(10), F.lit(20)).alias("p")).first().p == [[0.0, 19.0]]


def test_raster():
    image = np.full((40, 60, 3), 200, np.uint8)
    image[10:20, 10:30] = 0
    for mode in raster.MODES:
        out, mask = raster.redact(image, [[[5, 5], [35, 5], [35, 25], [5, 25]], [[1, 1]]], mode)
        assert mask[15, 15] == 255 and mask[35, 50] == 0 and (out[30:] == image[30:]).all()
    assert (raster.redact(image, [[[5, 5], [35, 5], [35, 25], [5, 25]]])[0][6:24, 6:34] == 0).all()
    assert (raster.redact(image, [])[0] == image).all()
    assert [b[:4] for b in raster.components(raster.ink(image))] == [(10, 10, 30, 20)]
    line = np.full((20, 100, 3), 255, np.uint8)
    line[5:15, 5:40] = 0
    line[5:15, 50:95] = 0
    low, high, sure = raster.refine_by_columns(line, 0.0, 0.42)
    assert 0.40 <= high <= 0.50 and sure > 0.9
    assert raster.png(image)[:8] == b"\x89PNG\r\n\x1a\n"


def test_images_round_trip(spark, tmp_path):
    image = np.zeros((8, 9, 3), np.uint8)
    image[:, :, 2] = 255
    (tmp_path / "a.png").write_bytes(raster.png(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = readers.images(spark, str(tmp_path)).withColumn("boxes", F.array(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])))
    sizes = {r.origin[-5:]: (r.width, r.height) for r in readers.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"a.png": (9, 8), "b.png": (None, None)}
    made = raster.redact_images(rows.withColumnRenamed("origin", "image_id")).collect()
    assert sorted(r.error is None for r in made) == [False, True]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a": 1}\n\n[1]\nbroken\n', encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / ".cache").mkdir()
    (tmp_path / ".cache" / "a.jsonl").write_text("{}")
    path = str(tmp_path / "a.jsonl")
    assert [(r.row, r.malformed) for r in readers.counted_json_lines(spark, path).orderBy("row").collect()] == [(1, False), (3, False), (4, True)]
    assert readers.lenient_json_lines(spark, path, "s").count() == 2
    assert readers.first_lines(spark, path, 2).count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        readers.strict_json_lines(spark, path).collect()
    assert readers.json_documents(spark, str(tmp_path / "c.json")).count() == 2
    assert [r.source for r in readers.discover(spark, str(tmp_path), {"x": ["a.jsonl"], "y": ["*.jsonl"]}).collect()] == ["x"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "一"), (2, None)], "a int, b string")
    writers.json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 2
    assert writers.frozen(df, str(tmp_path / "f")) and not writers.frozen(df, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="frozen"):
        writers.frozen(df.limit(1), str(tmp_path / "f"))
    writers.csv(df, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfa,b")
    assert writers.archive(spark.createDataFrame([("a.txt", b"x")], "name string, content binary"))[:2] == b"PK"


def test_history_and_batches(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 1 files"):
        batch.guarded(spark.createDataFrame([("a", 1), ("b", 1)], "filename string, length long"), max_files=1)
    h = spark.createDataFrame([(7, "x", "a.png")], "id long, file_hash string, filename string")
    more = spark.createDataFrame([("x", "b.png"), ("y", "c.png"), ("y", "c.png")], "file_hash string, filename string")
    assert sorted(tuple(r) for r in history.upsert(h, more).select("id", "file_hash").collect()) == [(7, "x"), (8, "y")]
    with pytest.raises(ValueError, match="hash"):
        history.new_rows(h, more.withColumn("file_hash", F.lit(None).cast("string")))


def test_splits_dont_share_templates(spark):
    r = spark.range(3000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("template_sha256"))
    r = r.unionAll(spark.range(500).select("id", F.lit("hot").alias("template_sha256")))
    out = dataset.assign_splits(r, {"train": 0.8, "validation": 0.1, "test_fixed": 0.1})
    assert out.groupBy("template_sha256").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {x["split"]: x["count"] / 3500 for x in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.06 and out.count() == 3500
    assert dataset.assign_splits(r.limit(0), {"train": 1.0}).count() == 0
    with pytest.raises(ValueError, match="sum"):
        dataset.assign_splits(r, {"train": 0.5})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fusion.detect(docs).count() == 0
    blocks = spark.createDataFrame([(1, [])], f"id long, blocks array<{layout.BLOCK}>")
    assert layout.reconstruct(layout.reading_order(blocks)).first().full_text == ""


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": 1, "text": "mail a@b.cc"}\n{"doc_id": 2, "text": null}\n')
    stream = folder.entity_rows(folder.documents(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.doc_id, r.type) for r in spark.sql("SELECT doc_id, type FROM found").collect()] == [(1, "email")]


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql(f"SELECT cn_id_valid('{GOOD_ID}') AS a, cn_id_valid('110105000001011232') AS b, phone_valid('+86138-1234 5678') AS c, mask_email('x@y.com') AS d, nfkc_normalize('Ａ　b') AS e").first()
    assert tuple(r) == (True, False, True, "[EMAIL]", "ab")
    assert spark.sql("SELECT * FROM pii_tokens('ab cd')").count() == 2
