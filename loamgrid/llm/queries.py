"""Queries of the training-data operators, and SQL where it can express them, or (base_secrets, url_rules) parts of them."""

from __future__ import annotations

from .decontamination import OP5_SQL, op5_decontamination
from .fingerprints import op1_fingerprints
from .html import op6_html
from .packing import op3_packing
from .secrets import BASE_SQL, base_secrets, op10_secrets
from .sharding import OP4_SQL, op4_compaction
from .simhash import op9_simhash
from .toxicity import op7_toxicity
from .urls import RULES_SQL, op8_urls, url_rules
from .warc import OP2_SQL, op2_warc

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_warc, op3_packing, op4_compaction, op5_decontamination, op6_html, op7_toxicity, op8_urls, op9_simhash, op10_secrets, base_secrets, url_rules)}

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op4_compaction": OP4_SQL, "op5_decontamination": OP5_SQL, "base_secrets": BASE_SQL, "url_rules": RULES_SQL}
