"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewitness.plans import queries_profile, queries_risk, queries_store, queries_transform, queries_variant  # noqa: F401
from lakewitness.plans.registry import ORACLES, QUERIES
from lakewitness.plans.workspace import workspace

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings next to both risk scores, for every version at once."""
    ws = workspace(spark, sf_dir)
    return ws.findings.join(ws.risks, "version_id").select(
        "version_id", "ordinal", "code", "severity", "measure", "mlrs_score", "lrs_score"
    )
