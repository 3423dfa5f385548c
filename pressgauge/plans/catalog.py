"""All registered queries."""

from pressgauge.plans import catalog_corpus, catalog_io, catalog_match, catalog_ml, catalog_scores, catalog_store  # noqa: F401
from pressgauge.plans.registry import REGISTRY, Tables  # noqa: F401
