"""The queries of this subpackage by name, with their SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerflow.llm import byte_bpe, clusters, decontamination, line_dedup, merkle, near_dup, packing, quality_classifier, quality_rules, sharding, token_counts, token_ids, url_filter

MODULES = (sharding, token_ids, near_dup, packing, url_filter, token_counts, quality_rules, quality_classifier, line_dedup, decontamination, clusters, merkle, byte_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for m in MODULES for n, f in vars(m).items() if re.match(r"op\d+_", n)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {n: s for m in MODULES for n, s in getattr(m, "ORACLE_SQL", {}).items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
