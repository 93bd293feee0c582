"""Imports every demo binding so that the catalogue is full."""

from geofit.plans import demo_diagnostics, demo_elicit, demo_scoring, demo_sources, demo_universe, demo_visitors  # noqa: F401
