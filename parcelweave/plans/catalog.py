"""All registered queries; importing the query modules fills the registry."""

from . import (  # noqa: F401
    diagnosis_queries,
    measure_queries,
    rule_queries,
    shape_queries,
    spatial_queries,
    text_queries,
    verdict_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
