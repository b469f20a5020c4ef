"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from .dialogues import op13_dialogues
from .embeddings import op1_embeddings
from .html import op4_html
from .infill import OP12_SQL, op12_infill
from .lines import OP11_SQL, op11_lines
from .media import op7_media
from .mixing import OP5_SQL, op5_mix
from .packing import op10_packing
from .quality import op3_quality
from .simhash import op6_simhash
from .substrings import op8_substrings
from .toxicity import op2_toxicity
from .urls import OP9_SQL, op9_url_filters

QUERIES = {f.__name__: f for f in (op1_embeddings, op2_toxicity, op3_quality, op4_html, op5_mix, op6_simhash, op7_media, op8_substrings, op9_url_filters, op10_packing, op11_lines, op12_infill, op13_dialogues)}
ORACLE = {"op5_mix": OP5_SQL, "op9_url_filters": OP9_SQL, "op11_lines": OP11_SQL, "op12_infill": OP12_SQL}
