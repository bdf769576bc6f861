"""Flows, presets and the registered query catalog."""
