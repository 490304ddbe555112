"""Whole plans: fitted forecasts, and the registered queries with their SQL checks."""
