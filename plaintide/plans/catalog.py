"""Imports every plan module so that the registry is complete."""
from plaintide.plans import defaultpack, desk, insights, intake, labelling, mining, quality, reports, scalars, streams  # noqa: F401
from plaintide.plans.registry import ORACLES, QUERIES  # noqa: F401
