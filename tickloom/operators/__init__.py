"""Bars, windows, detectors, hygiene, returns, statistics, costs and data quality."""
