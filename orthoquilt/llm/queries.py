"""The queries of this subpackage, by the names under which the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoquilt.llm.bpe import op1_bpe_encode_decode
from orthoquilt.llm.chunks import op4_document_fingerprints
from orthoquilt.llm.licenses import OP5_SQL, op5_license_scan
from orthoquilt.llm.packing import op3_packing
from orthoquilt.llm.quality_classifier import op10_quality_classifier
from orthoquilt.llm.quality_rules import OP7_SQL, op7_quality_rules
from orthoquilt.llm.simhash import op2_simhash
from orthoquilt.llm.token_counts import op9_token_counts
from orthoquilt.llm.toxicity import op8_toxicity
from orthoquilt.llm.url_filter import OP6_SQL, op6_url_filter

_ALL = (
    op1_bpe_encode_decode, op2_simhash, op3_packing, op4_document_fingerprints, op5_license_scan,
    op6_url_filter, op7_quality_rules, op8_toxicity, op9_token_counts, op10_quality_classifier,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": OP5_SQL, "op6_url_filter": OP6_SQL, "op7_quality_rules": OP7_SQL}
