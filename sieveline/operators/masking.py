"""Masking of messages and texts, and highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import piece
from ..functions.text import escape_html

#: Fixed replacements, in order.
MASKS = (
    (r"(?U)(?<!\d)(1[3-9]\d)(\d{4})(\d{4})(?!\d)", "$1****$3"),
    (r"(?U)(?<![0-9Xx])(\d{3})\d{11}(\d{3}[0-9Xx])(?![0-9Xx])", "$1***********$2"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"(?U)((?:姓名|收件人|联系人)\s*[:：]?\s*)([一-鿿])[一-鿿]{1,3}", "$1$2*"),
    (r"(?U)((?:地址|住址)\s*[:：]?\s*)([一-鿿]{6})[一-鿿]*", "$1$2****"),
)


#: For each mask, what a text that it changes has, and is quick to find.
_GUARDS = (lambda t: t.rlike("1[3-9]"), lambda t: t.rlike(r"(?U)\d{17}"), lambda t: t.contains("@"), lambda t: t.rlike("[一-鿿]"), lambda t: t.rlike("[一-鿿]"))


def mask_message(text: Column) -> Column:
    """A message with phones, ids, emails, names and addresses masked in part."""
    for (pattern, put), guard in zip(MASKS, _GUARDS, strict=True):
        text = F.when(guard(text), F.regexp_replace(text, pattern, put)).otherwise(text)
    return text


def _laid(text: Column, entities: Column, shown) -> Column:
    """The text with entities replaced by ``shown(entity, its text)``; of overlapping ones the first. What is between passes ``shown(None, text)``."""
    keyed = F.sort_array(F.transform(entities, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), i.alias("i"), e["type"].alias("type"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        put = F.concat(acc["out"], shown(None, piece(text, acc["at"], e["start"])), shown(e, piece(text, e["start"], e["end"])))
        late = e["start"] < acc["at"]
        return F.struct(F.when(late, acc["at"]).otherwise(e["end"]).alias("at"), F.when(late, acc["out"]).otherwise(put).alias("out"))

    return F.aggregate(keyed, start, step, lambda acc: F.concat(acc["out"], shown(None, piece(text, acc["at"], F.length(text)))))


def redact_text(text: Column, entities: Column) -> Column:
    """A text with each entity replaced by its type in square brackets."""
    return _laid(text, entities, lambda e, raw: raw if e is None else F.concat(F.lit("["), F.upper(e["type"]), F.lit("]")))


def highlight(text: Column, entities: Column) -> Column:
    """A text as HTML with its entities marked and line breaks as elements."""
    mark = lambda e, raw: F.concat(F.lit('<mark title="'), escape_html(e["type"]), F.lit('">'), escape_html(raw), F.lit("<small> "), escape_html(e["type"]), F.lit("</small></mark>"))
    return F.replace(_laid(text, entities, lambda e, raw: escape_html(raw) if e is None else mark(e, raw)), F.lit("\n"), F.lit("<br>"))


def template(text: Column, entities: Column) -> Column:
    """A text with each entity replaced by its type in angle brackets."""
    return _laid(text, entities, lambda e, raw: raw if e is None else F.concat(F.lit("<"), F.upper(e["type"]), F.lit(">")))
