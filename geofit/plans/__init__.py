"""Whole plans, and the catalogue that binds every operator to the driver's tables."""
