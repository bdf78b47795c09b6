"""All registered queries."""

from hitsieve.plans import q_basic, q_features, q_metrics, q_models, q_rollup, q_screen  # noqa: F401
from hitsieve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, d):
    return QUERIES["vs06_hits_by_source"](spark, d)
