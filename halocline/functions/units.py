"""Unit conversion between internal (G = 1) and physical values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Internal length, velocity and mass units.
LENGTH_KPC = 1.0
VELOCITY_KMS = 100.0
MASS_MSUN = 2.325e9


@dataclass(frozen=True)
class UnitSystem:
    """Size of one internal unit; changing one alone gives up G = 1."""

    length_kpc: float = LENGTH_KPC
    velocity_kms: float = VELOCITY_KMS
    mass_msun: float = MASS_MSUN
    G: float = 1.0

    def factor(self, kind: str) -> float:
        """Physical size of one internal unit of ``length``, ``velocity`` or ``mass``."""
        return {
            "length": self.length_kpc,
            "velocity": self.velocity_kms,
            "mass": self.mass_msun,
        }[kind]

    def to_physical(self, c: Column, kind: str) -> Column:
        return c * self.factor(kind)

    def from_physical(self, c: Column, kind: str) -> Column:
        return c / self.factor(kind)


DEFAULT_UNITS = UnitSystem()


def circular_velocity(force_r: Column, radius: Column, scale: float = 1.0) -> Column:
    """sqrt(-F_R R), zero where the force points outward; ``scale=100`` gives km/s."""
    return F.sqrt(F.greatest(F.lit(0.0), -force_r * radius)) * scale
