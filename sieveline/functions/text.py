"""Scalar functions on strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights and check characters of MOD 11-2.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
FULL_WIDTH = "".join(chr(0xFF10 + d) for d in range(10))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ascii_digits(c: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(c, FULL_WIDTH, "0123456789")


def without_spaces(c: Column, hyphens: bool = False) -> Column:
    """A string without Unicode white space, and without hyphens if asked."""
    return F.regexp_replace(c, r"(?U)[\s-]+" if hyphens else r"(?U)\s+", "")


def strip(c: Column) -> Column:
    """A string without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fingerprint(c: Column, stripped: bool = True) -> Column:
    """SHA-256 of a text in UTF-8."""
    return F.sha2(strip(c) if stripped else c, 256)


def normal_phone(c: Column) -> Column:
    """A mobile number without separators and country code."""
    bare = without_spaces(c, hyphens=True)
    return F.when(bare.startswith("+86"), F.substring(bare, 4, 64)).when(bare.startswith("86") & (F.length(bare) == 13), F.substring(bare, 3, 64)).otherwise(bare)


def is_phone(c: Column) -> Column:
    return ascii_digits(normal_phone(c)).rlike("^1[3-9][0-9]{9}$")


def is_resident_id(c: Column) -> Column:
    """18 characters, a calendar date from year 1 on, and the MOD 11-2 check character."""
    bare = ascii_digits(F.upper(without_spaces(c)))
    shaped = bare.rlike("^[0-9]{17}[0-9X]$")
    day = F.try_to_timestamp(F.substring(bare, 7, 8), F.lit("yyyyMMdd"))
    weights = F.expr(f"array({', '.join(map(str, ID_WEIGHTS))})")
    products = F.zip_with(F.split(F.left(bare, F.lit(17)), ""), weights, lambda d, w: F.coalesce(d.try_cast("int") * w, F.lit(0)))
    total = F.aggregate(products, F.lit(0), lambda s, x: s + x)
    check = F.substring(F.lit(ID_CHECK), total % 11 + 1, F.lit(1))
    return F.coalesce(shaped & (F.substring(bare, 7, 4) != "0000") & day.isNotNull() & (F.substring(bare, 18, 1) == check), F.lit(False))


def is_card(c: Column) -> Column:
    """16 to 19 digits that pass Luhn."""
    bare = ascii_digits(without_spaces(c, hyphens=True))
    return bare.rlike("^[0-9]{16,19}$") & F.call_function("luhn_check", bare)


def is_ip(c: Column) -> Column:
    """An IPv4 or IPv6 address in text; an IPv6 address may end in an IPv4 one, which stands for two groups."""
    v4 = c.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    c = F.regexp_replace(c, rf":{_OCTET}(?:\.{_OCTET}){{3}}$", ":0:0")
    groups = F.filter(F.split(c, ":"), lambda g: g != "")
    plain = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & c.contains(":") & ~c.contains(":::")
    pairs = (F.length(c) - F.length(F.replace(c, F.lit("::"), F.lit("")))) / 2
    begins, ends = c.startswith(":") & ~c.startswith("::"), c.endswith(":") & ~c.endswith("::")
    v6 = plain & ~begins & ~ends & (((pairs == 0) & (F.size(groups) == 8)) | ((pairs == 1) & (F.size(groups) <= 7)))
    return F.coalesce(v4 | v6, F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length, 0 at least."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest)


def character_error(a: Column, b: Column) -> Column:
    """Edit distance by the length of the reference ``b``."""
    return F.levenshtein(a, b) / F.greatest(F.length(b), F.lit(1))


def is_cjk(c: Column) -> Column:
    """All characters but white space are CJK ideographs, and there is one."""
    return c.rlike(r"^(?U)[一-鿿\s]+$") & c.rlike(r"[一-鿿]")


def safe_name(c: Column, default: str = "file", limit: int = 80) -> Column:
    """A name for a file: unsafe characters become underscores."""
    made = F.left(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f\s]+', "_"), r"^[._ ]+|[._ ]+$", ""), F.lit(limit))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def visual_weight(ch: Column) -> Column:
    """The width of a character beside a wide one. Scripts beyond CJK that are wide are told by their blocks."""
    wide = r"[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹯！-｠￠-￦]"
    return (
        F.when(ch == "　", 1.0).when(ch.rlike(r"^(?U)\s$"), 0.30).when(ch.rlike(wide), 1.0).when(ch.rlike(r"^\p{Lu}$"), 0.72)
        .when(ch.rlike(r"^[\p{Ll}\p{Nd}]$"), 0.58).when(ch.rlike(r"^\p{P}$"), 0.35).otherwise(0.72)
    )


def weights_before(text: Column, n: Column) -> Column:
    """The summed weights of a text's first ``n`` characters."""
    chars = F.filter(F.split(F.substring(text, F.lit(1), n), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda s, c: s + visual_weight(c))
