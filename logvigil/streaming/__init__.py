"""Detectors on live entry streams."""
