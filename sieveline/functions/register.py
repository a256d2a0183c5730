"""SQL names for the engine's functions: ``register(spark)`` makes them known to ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from .text import FULL_WIDTH, ID_CHECK, ID_WEIGHTS


def register(spark: SparkSession) -> None:
    """Temporary functions: cn_id_valid, phone_valid, text_similarity, mask_email (SQL expressions), nfkc_normalize (Arrow), pii_tokens (table function)."""
    # The same steps as ``normal_phone``, ``is_phone`` and ``is_resident_id``, from the same constants.
    ascii_ = lambda x: f"translate({x}, '{FULL_WIDTH}', '0123456789')"
    bare = r"regexp_replace(p, '(?U)[\\s-]+', '')"
    phone = f"CASE WHEN startswith({bare}, '+86') THEN substring({bare}, 4) WHEN startswith({bare}, '86') AND length({bare}) = 13 THEN substring({bare}, 3) ELSE {bare} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION phone_valid(p STRING) RETURNS BOOLEAN RETURN {ascii_(phone)} RLIKE '^1[3-9][0-9]{{9}}$'")
    i = ascii_(r"upper(regexp_replace(p, '(?U)\\s+', ''))")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION cn_id_valid(p STRING) RETURNS BOOLEAN RETURN coalesce(
        {i} RLIKE '^[0-9]{{17}}[0-9X]$' AND substring({i}, 7, 4) <> '0000' AND try_to_timestamp(substring({i}, 7, 8), 'yyyyMMdd') IS NOT NULL
        AND substring('{ID_CHECK}', aggregate(zip_with(split(substring({i}, 1, 17), ''), array({", ".join(map(str, ID_WEIGHTS))}), (d, w) -> coalesce(try_cast(d AS INT), 0) * w), 0, (a, x) -> a + coalesce(x, 0)) % 11 + 1, 1) = substring({i}, 18, 1), false)"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN greatest(0.0D, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION mask_email(p STRING) RETURNS STRING RETURN regexp_replace(p, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]')")
    spark.udf.register("nfkc_normalize", layout.normal)

    @F.udtf(returnType="token string, start int, end int")
    class Tokens:
        """Runs of letters and digits of a text, with their places."""

        def eval(self, text: str):
            import re

            for m in re.finditer(r"\w+", text or ""):
                yield m[0], m.start(), m.end()

    spark.udtf.register("pii_tokens", Tokens)
