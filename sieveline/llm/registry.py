"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate
from .bpe import op1_byte_bpe
from .decontaminate import op10_decontaminate
from .html_text import op6_html_extraction
from .langid import op4_language_id
from .media import op2_media_columns
from .pitman_yor import op5_pitman_yor
from .secret_scan import op9_secret_scan
from .simhash import op8_simhash_near_dedup
from .substring_dedup import op3_suffix_dedup
from .token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_media_columns, op3_suffix_dedup, op4_language_id, op5_pitman_yor, op6_html_extraction, op7_token_counts, op8_simhash_near_dedup, op9_secret_scan, op10_decontaminate)}
ORACLE_SQL: dict[str, str] = {"op10_decontaminate": decontaminate.ORACLE_SQL}
