"""Entities told by the words before them, and finer types and longer spans for those of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import group_spans, piece

#: Fixed word lists.
NAME_WORDS = "姓名|联系人|收件人|寄件人|患者|学生|老师|负责人|申请人|法定代表人|持卡人|监护人"
ADDRESS_WORDS = "地址|住址|收货地址|寄送地址|联系地址|家庭住址|户籍地址|现居地址|单位地址|注册地址"
SCHOOL = "大学|学院|中学|小学|学校|培训中心|研究院"
HOSPITAL = "医院|诊所|卫生院|医疗中心|妇幼保健院"
COMPANY = "公司|集团|企业|厂|有限责任公司|股份有限公司"
ADDRESS_ENDS = "省|自治区|市|自治州|区|县|旗|镇|乡|村|街道|路|街|巷|弄|号|栋|幢|单元|室|小区|社区|大厦|广场"
NAME = rf"(?U)((?:{NAME_WORDS})\s*[：:]?\s*)([一-鿿]{{2,4}})"
ADDRESS = rf"(?U)((?:{ADDRESS_WORDS})\s*[：:]?\s*)([^。；;\n]{{4,80}})"
EXTEND = 40
HAN = "[一-鿿]"


def organization_type(name: Column) -> Column:
    """school, hospital, company or organization, in that order of precedence."""
    return F.when(name.rlike(SCHOOL), "school").when(name.rlike(HOSPITAL), "hospital").when(name.rlike(COMPANY), "company").otherwise("organization")


def _entity(text: Column, kind: str, start: Column, end: Column, confidence: float) -> Column:
    value = piece(text, start, end)
    return F.struct(F.lit(kind).alias("type"), value.alias("text"), value.alias("normalized_text"), start.alias("start"), end.alias("end"), F.lit(confidence).alias("confidence"), F.lit("context").alias("source"), F.lit("not_applicable").alias("validation"))


def detect(text: Column) -> Column:
    """Persons and addresses after their words, as an array of entities."""
    text = F.when(text.rlike(HAN), text).otherwise("")  # all the words are Chinese
    people = F.transform(group_spans(text, NAME), lambda s: _entity(text, "person", s["start"], s["end"], 0.72))
    kept = lambda s: F.length(F.regexp_replace(piece(text, s["start"], s["end"]), "[，, ]+$", ""))
    cut = F.transform(group_spans(text, ADDRESS), lambda s: F.struct(s["start"].alias("start"), (s["start"] + kept(s)).alias("end")))
    real = F.filter(cut, lambda s: piece(text, s["start"], s["end"]).rlike(ADDRESS_ENDS))
    return F.concat(people, F.transform(real, lambda s: _entity(text, "address", s["start"], s["end"], 0.68)))


def address_end(text: Column, end: Column) -> Column:
    """Where an address ends that goes on after ``end``: after the last address word before the next boundary, or within 40 characters."""
    rest = F.substring(text, end + 1, F.length(text))
    before = F.regexp_extract(rest, r"^[^。；;\n]*", 0)
    reach = F.when(F.length(before) < F.length(rest), before).otherwise(F.left(rest, F.lit(EXTEND)))
    longest_first = "|".join(sorted(ADDRESS_ENDS.split("|"), key=len, reverse=True))
    return end + F.length(F.regexp_extract(reach, f"(?s)^.*(?:{longest_first})", 0))


def enhance(text: Column, entities: Column) -> Column:
    """A model's entities with finer organizations and longer addresses, 0.95 as confident; ``original_type`` keeps the model's.

    Entities have type, text, start, end, confidence and source.
    """

    def one(e: Column) -> Column:
        finer = F.when(e["type"] == "organization", organization_type(e["text"])).otherwise(e["type"])
        end = F.when(e["type"] == "address", address_end(text, e["end"])).otherwise(e["end"])
        refined, longer = finer != e["type"], end > e["end"]
        changed = refined | longer
        value = F.when(longer, piece(text, e["start"], end)).otherwise(e["text"])
        return F.struct(
            finer.alias("type"), value.alias("text"), value.alias("normalized_text"), e["start"].alias("start"), end.alias("end"),
            F.when(changed, e["confidence"] * 0.95).otherwise(e["confidence"]).alias("confidence"), F.when(changed, "context").otherwise(e["source"]).alias("source"),
            F.when(changed, F.array(F.lit("ner"), F.lit("context"))).otherwise(F.array(e["source"])).alias("sources"), F.lit("not_applicable").alias("validation"),
            F.when(refined, e["type"]).alias("original_type"),
        )

    return F.transform(entities, one)
