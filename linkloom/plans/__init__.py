"""Presets, whole plans, fixtures and registered queries."""
