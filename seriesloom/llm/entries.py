"""The queries of this subpackage, each over a whole table, and SQL where SQL can express one."""

from __future__ import annotations

from .htmltext import op4_html_text
from .licenses import op1_licenses
from .mixing import OP9_SQL, op9_mixing
from .neighbours import op5_neighbours
from .packing import op7_packing
from .quality import op3_quality
from .sharding import op10_sharding
from .simhash import op6_simhash
from .tokencounts import op8_token_counts
from .tokenfiles import op2_token_files

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_neighbours": op5_neighbours,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
}

ORACLE = {"op9_mixing": OP9_SQL}
