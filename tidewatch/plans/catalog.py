"""All registered queries."""

from tidewatch.plans import catalog_basic, catalog_batch, catalog_causal, catalog_jumps, catalog_evaluate, catalog_features, catalog_masks, catalog_paths, catalog_regimes, catalog_streaming  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES  # noqa: F401
