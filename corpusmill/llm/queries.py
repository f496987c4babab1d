"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from corpusmill.llm.bpe import op9_bpe
from corpusmill.llm.chat import OP2_SQL, op2_chat_format
from corpusmill.llm.classifier import op8_quality_classifier
from corpusmill.llm.lz import op5_lz_fingerprint
from corpusmill.llm.mixing import op7_source_mix
from corpusmill.llm.simhash import op1_simhash_dedup
from corpusmill.llm.pitman_yor import op6_pitman_yor
from corpusmill.llm.quality import OP4_SQL, op4_quality_rules
from corpusmill.llm.secrets import op10_secret_scan
from corpusmill.llm.urls import OP3_SQL, op3_url_filter

QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_chat_format, op3_url_filter, op4_quality_rules, op5_lz_fingerprint, op6_pitman_yor, op7_source_mix, op8_quality_classifier, op9_bpe, op10_secret_scan)}
SQL = {"op2_chat_format": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_quality_rules": OP4_SQL}
