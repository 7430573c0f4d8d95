"""Physical units as linear factors to base units."""

from __future__ import annotations

import math

# Dimension and factor to its base unit. (fixed values)
UNITS: dict[str, tuple[str, float]] = {
    "m": ("length", 1.0), "km": ("length", 1e3), "cm": ("length", 1e-2), "mm": ("length", 1e-3), "um": ("length", 1e-6), "nm": ("length", 1e-9), "ft": ("length", 0.3048),
    "s": ("time", 1.0), "ms": ("time", 1e-3), "us": ("time", 1e-6), "ns": ("time", 1e-9), "min": ("time", 60.0), "hour": ("time", 3600.0),
    "Hz": ("rate", 1.0), "kHz": ("rate", 1e3), "MHz": ("rate", 1e6),
    "rad": ("angle", 1.0), "radians": ("angle", 1.0), "deg": ("angle", math.pi / 180), "rad/s": ("angle_rate", 1.0),
    "m/s": ("speed", 1.0), "km/s": ("speed", 1e3),
    "strain": ("strain", 1.0), "microstrain": ("strain", 1e-6), "nanostrain": ("strain", 1e-9),
    "strain_rate": ("strain_rate", 1.0), "microstrain/s": ("strain_rate", 1e-6), "nanostrain/s": ("strain_rate", 1e-9), "1/s": ("strain_rate", 1.0), "strain/s": ("strain_rate", 1.0),
}
PHASE_UNITS = {"rad": "strain", "radians": "strain", "rad/s": "strain_rate"}
INDEX_OF_REFRACTION, STRESS_OPTIC = 1.46, 0.78


def unit(name: str) -> tuple[str, float]:
    if name not in UNITS:
        raise ValueError(f"unknown unit {name}")
    return UNITS[name]


def factor(source: str, target: str) -> float:
    """What a value in ``source`` is multiplied by to be in ``target``."""
    (a, x), (b, y) = unit(source), unit(target)
    if a != b:
        raise ValueError(f"{source} can't be converted to {target}")
    return x / y


def quantity(value: float, name: str) -> tuple[float, str]:
    unit(name)
    return float(value), name


def to_base(value: float, name: str) -> float:
    return value * unit(name)[1]


def phase_scale(gauge_length: float = 10.0, wavelength_nm: float = 1550.0) -> float:
    """Strain per radian of optical phase."""
    return wavelength_nm * 1e-9 / (4 * math.pi * INDEX_OF_REFRACTION * gauge_length * STRESS_OPTIC)
