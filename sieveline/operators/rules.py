"""Rule detection: patterns, their validation and context, and which candidate wins where they overlap."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import around, greedy, piece, spans

#: Fixed patterns of the types. They use Unicode classes, as do the texts they are written for.
PHONE = r"(?U)(?<!\d)(?:(?:\+?86)[ -]?)?1[3-9]\d[ -]?\d{4}[ -]?\d{4}(?!\d)"
RESIDENT_ID = r"(?U)(?<![\dXx])\d(?: ?\d){16} ?[\dXx](?![\dXx])"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){15,18}\d(?!\d)"
EMAIL = r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![A-Za-z0-9_-])"
PASSPORT = r"(?iU)(?<![A-Za-z0-9])(?:[EGPDS]\d{8}|E[A-Z]\d{7})(?![A-Za-z0-9])"
PLATE = r"(?i)[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-HJ-NP-Z][A-HJ-NP-Z0-9]{5,6}"
IPV4 = r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f:]{0,4}(?![0-9A-Fa-f:])"
URL = r"(?iU)(?:https?://|www\.)[^\s<>　。，；！？]+"
QQ = r"(?U)(?<!\d)[1-9]\d{4,11}(?!\d)"
WECHAT = r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]{5,19}(?![A-Za-z0-9_-])"
POSTAL = r"(?U)(?<!\d)[1-9]\d{5}(?!\d)"
#: Fixed words that must stand within 16 characters of a candidate.
CONTEXT = {
    "phone": "电话|手机号|手机|联系电话|TEL|Phone",
    "id_number": "身份证(?:号|号码)?|居民身份证",
    "bank_card": "银行卡|卡号|账户|账号",
    "passport": "护照|Passport|证件号码",
    "qq_number": "QQ|企鹅号",
    "wechat_id": "微信(?:号)?|WeChat",
    "postal_code": "邮编|邮政编码",
}
#: Fixed order of precedence of the types.
PRECEDENCE = {"id_number": 100, "bank_card": 90, "phone": 80, "email": 70, "license_plate": 60, "passport": 50, "ip_address": 40, "url": 30, "qq_number": 20, "wechat_id": 10, "postal_code": 5}
CANDIDATE = "struct<type:string,text:string,normalized_text:string,start:int,end:int,confidence:double,source:string,validation:string>"
#: A character that Chinese words have. A range of characters is searched for faster than words or sets are.
HAN = "[一-鿿]"
#: What a text with a long number has.
_DIGITS = r"(?U)\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"
_TRAILING = r"""[.,;:!?)\]}'"]+$"""


def has_context(text: Column, kind: str, start: Column, end: Column) -> Column:
    """Whether a type's words stand near a span."""
    return around(text, start, end).rlike(f"(?iu){CONTEXT[kind]}")


def _candidate(text: Column, kind: str, s: Column, normal: Column, confidence: Column | float, validation: Column | str = "passed") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("type"), piece(text, s["start"], s["end"]).alias("text"), normal.alias("normalized_text"), s["start"].alias("start"), s["end"].alias("end"), lit(confidence).cast("double").alias("confidence"), F.lit("rule").alias("source"), lit(validation).alias("validation"))


def _found(text: Column, pattern: str, make, keep=None, *, guard: str, facts=None) -> Column:
    """Candidates of a pattern: ``make(m)`` of matches m that ``keep(m)``.

    ``guard`` is a cheap pattern that a text with candidates has. A match has start, end, raw, and the ``facts(m)`` that are worked
    out once.
    """
    cheap = text.contains(guard) if len(guard) == 1 else text.rlike(guard)
    at = F.when(cheap, spans(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    seen = F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), piece(text, s["start"], s["end"]).alias("raw")))
    if facts:
        seen = F.transform(seen, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), *[c.alias(k) for k, c in facts(m).items()]))
    return F.transform(F.filter(seen, keep) if keep else seen, make)


def resident_ids(text: Column) -> Column:
    facts = lambda m: {"normal": F.upper(T.without_spaces(m["raw"])), "good": T.is_resident_id(m["raw"]), "near": has_context(text, "id_number", m["start"], m["end"])}
    make = lambda m: _candidate(text, "id_number", m, m["normal"], F.when(m["good"], 0.995).otherwise(0.45), F.when(m["good"], "passed").otherwise("failed"))
    return _found(text, RESIDENT_ID, make, lambda m: m["good"] | m["near"], guard=_DIGITS, facts=facts)


def cards(text: Column) -> Column:
    facts = lambda m: {"normal": T.without_spaces(m["raw"], hyphens=True), "good": T.is_card(m["raw"]), "other": T.is_resident_id(T.without_spaces(m["raw"], hyphens=True)) | T.is_phone(m["raw"]), "near": has_context(text, "bank_card", m["start"], m["end"])}
    make = lambda m: _candidate(text, "bank_card", m, m["normal"], F.when(m["good"], 0.99).otherwise(0.4), F.when(m["good"], "passed").otherwise("failed"))
    return _found(text, CARD, make, lambda m: ~m["other"] & (m["good"] | m["near"]), guard=_DIGITS, facts=facts)


def phones(text: Column) -> Column:
    make = lambda m: _candidate(text, "phone", m, T.normal_phone(m["raw"]), F.when(has_context(text, "phone", m["start"], m["end"]), 0.99).otherwise(0.97))
    return _found(text, PHONE, make, lambda m: T.is_phone(m["raw"]), guard=_DIGITS)


def emails(text: Column) -> Column:
    return _found(text, EMAIL, lambda m: _candidate(text, "email", m, m["raw"], 0.99), guard="@")


def plates(text: Column) -> Column:
    return _found(text, PLATE, lambda m: _candidate(text, "license_plate", m, F.upper(m["raw"]), 0.97), guard=f"{HAN}[A-Za-z]")


def passports(text: Column) -> Column:
    return _found(text, PASSPORT, lambda m: _candidate(text, "passport", m, F.upper(m["raw"]), 0.94), lambda m: has_context(text, "passport", m["start"], m["end"]), guard=f"(?iu){CONTEXT['passport']}")


def ip_addresses(text: Column) -> Column:
    both = [_found(text, p, lambda m: _candidate(text, "ip_address", m, F.lower(m["raw"]), 0.99), lambda m: T.is_ip(m["raw"]), guard=g) for p, g in ((IPV4, r"(?U)\d\.\d"), (IPV6, ":[0-9A-Fa-f]{0,4}:"))]
    return F.concat(*both)


def urls(text: Column) -> Column:
    kept = lambda s: F.length(F.regexp_replace(piece(text, s["start"], s["end"]), _TRAILING, ""))
    cut = F.filter(F.transform(F.when(text.rlike(r"(?i)https?://|www\."), spans(text, URL)).otherwise(F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(s["start"].alias("start"), (s["start"] + kept(s)).alias("end"))), lambda s: s["end"] > s["start"])
    return F.transform(cut, lambda s: _candidate(text, "url", s, piece(text, s["start"], s["end"]), 0.98))


def in_context(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    near = lambda m: has_context(text, kind, m["start"], m["end"]) & (F.lower(m["raw"]) != "wechat" if kind == "wechat_id" else F.lit(True))
    return _found(text, pattern, lambda m: _candidate(text, kind, m, m["raw"], confidence), near, guard=f"(?iu){CONTEXT[kind]}")


#: Types whose candidates have five digits, and those that need a word beside them: each set shares one search.
_OF_DIGITS = {"id_number": resident_ids, "bank_card": cards, "phone": phones}
_OF_WORDS = {"qq_number": (QQ, 0.93), "wechat_id": (WECHAT, 0.92), "postal_code": (POSTAL, 0.92)}
_OTHERS = {"email": emails, "license_plate": plates, "passport": passports, "ip_address": ip_addresses, "url": urls}


def candidates(text: Column, types: Iterable[str] | None = None) -> Column:
    """All candidates of a text, in the order of the detectors; of some types only, if asked."""
    wanted = set(PRECEDENCE if types is None else types)
    none = F.array().cast(f"array<{CANDIDATE}>")
    numbers = [f(text) for kind, f in _OF_DIGITS.items() if kind in wanted]
    words = {kind: in_context(text, kind, *how) for kind, how in _OF_WORDS.items() if kind in wanted}
    parts = [F.when(text.rlike(_DIGITS), F.concat(*numbers)).otherwise(none)] if numbers else []
    parts += [f(text) for kind, f in _OTHERS.items() if kind in wanted]
    if words:
        parts.append(F.when(text.rlike(f"(?iu){'|'.join(CONTEXT[k] for k in words)}"), F.concat(*words.values())).otherwise(none))
    return F.concat(none, *parts)


def ranked(found: Column, order) -> Column:
    """An array in descending ``order(x)``, a list of numbers, ties as they stood."""
    keyed = F.transform(found, lambda x, i: F.struct(*[(-k.cast("double")).alias(f"k{n}") for n, k in enumerate(order(x))], i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def resolve(found: Column) -> Column:
    """Of equal candidates the most confident, then the best first without overlaps, sorted by place."""
    same = lambda a, b: (a["type"] == b["type"]) & (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["normalized_text"] == b["normalized_text"])
    unique = F.filter(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a: ~F.exists(F.transform(found, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda b: same(a["x"], b["y"]) & ((b["y"]["confidence"] > a["x"]["confidence"]) | ((b["y"]["confidence"] == a["x"]["confidence"]) & (b["j"] < a["i"])))))
    precedence = F.create_map(*[F.lit(v) for kv in PRECEDENCE.items() for v in kv])
    order = lambda c: [F.when(c["validation"] == "passed", precedence[c["type"]]).otherwise(0), c["confidence"], c["end"] - c["start"]]
    return in_place(greedy(ranked(F.transform(unique, lambda a: a["x"]), order), CANDIDATE))


def in_place(found: Column) -> Column:
    """Spans sorted by start, end and type."""
    keyed = F.transform(found, lambda x, i: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["type"].alias("t"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def detect(df: DataFrame, text_col: str = "text", out: str = "rules") -> DataFrame:
    """``df`` with an array of the entities that rules find; an empty or null text has none.

    Patterns run once a row: the candidates are a column of their own before they are resolved.
    """
    text = F.col(text_col)
    # No type goes without a digit, an at sign, or the head of a URL; a WeChat id stands near its word.
    worth = text.rlike(r"(?iu)[0-9０-９@:]|www\.|微信|wechat")
    none = F.array().cast(f"array<{CANDIDATE}>")
    held = df.withColumn("_found", F.when(worth, candidates(text)).otherwise(none))
    return held.withColumn(out, F.when(F.size("_found") > 0, resolve(F.col("_found"))).otherwise(none)).drop("_found")


def exploded(df: DataFrame, entities: str, *keep: str) -> DataFrame:
    """A row for each entity.

    The outer form keeps the optimizer from copying the detectors into a filter below.
    """
    return df.select(*keep, F.inline_outer(entities)).where("type IS NOT NULL")
