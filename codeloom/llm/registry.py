"""The queries and SQL of the training-data operators."""

from __future__ import annotations

from .decontam import op4_decontamination
from .html_text import op6_html_text
from .langid import op2_language_id
from .linededup import op10_line_dedup
from .mixing import OP9_SQL, op9_source_mixing
from .pii import op5_pii
from .quality import OP8_SQL, op8_quality_rules
from .simhash import op1_simhash_near_dup
from .substring import OP7_SQL, op7_substring_dedup
from .warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_simhash_near_dup, op2_language_id, op3_warc, op4_decontamination, op5_pii, op6_html_text, op7_substring_dedup, op8_quality_rules, op9_source_mixing, op10_line_dedup)}
SQL = {"op7_substring_dedup": OP7_SQL, "op3_warc": OP3_SQL, "op8_quality_rules": OP8_SQL, "op9_source_mixing": OP9_SQL}
