"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathfield.llm.fingerprints import op2_fingerprints
from pathfield.llm.jaccard import op4_jaccard
from pathfield.llm.languages import op6_language_id
from pathfield.llm.leaks import op12_leaks
from pathfield.llm.licenses import op5_license_scans
from pathfield.llm.manifest import op11_manifest
from pathfield.llm.mixing import op8_mixing
from pathfield.llm.neighbours import op10_nearest
from pathfield.llm.packing import op7_packing
from pathfield.llm.periodic import op13_periodic
from pathfield.llm.quality import op9_quality
from pathfield.llm.sql import ORACLES
from pathfield.llm.toxicity import op1_toxicity
from pathfield.llm.urls import op3_url_filters


_ALL = [
    op1_toxicity, op2_fingerprints, op3_url_filters, op4_jaccard, op5_license_scans, op6_language_id, op7_packing, op8_mixing, op9_quality, op10_nearest,
    op11_manifest, op12_leaks, op13_periodic,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
