"""Distances on the earth and fixed-point texts, as SQL expressions."""

from __future__ import annotations

EARTH_RADIUS_KM = 6371


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in kilometres."""
    inner = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"{EARTH_RADIUS_KM} * 2 * asin(sqrt(least(1D, {inner})))"


def fixed(value: str, digits: int) -> str:
    """Fixed-point text with ties to even on the exact binary value, as C's printf has it."""
    return f"replace(format_number({value}, {digits}), ',', '')"
