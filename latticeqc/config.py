"""Review thresholds.  They select cells for a human to look at; they are not verdicts."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class ReviewConfig:
    # Default thresholds of the review cues.
    expected_spacing_x: float | None = None
    expected_spacing_y: float | None = None
    long_edge_ratio: float = 2.0
    short_edge_ratio: float = 0.5
    normal_jump_degrees: float = 75.0
    condition_number: float = 4.0
    symmetric_stretch: float = 2.0
    symmetric_dirichlet: float = 20.0
    area_ratio_low: float = 0.25
    area_ratio_high: float = 4.0
    shear: float = math.cos(math.pi / 6)
    normal_step_ratio: float = 0.25
    normal_step_min_component_cells: int = 8
    nonlocal_distance_ratio: float = 0.25
    nonlocal_uv_exclusion: int = 4
    # No point is left out and no list is cut unless that is asked for.
    max_proximity_points: int | None = None
    max_proximity_pairs: int | None = None

    def check(self) -> "ReviewConfig":
        """Reject unusable settings before any plan is built."""
        optional = ("expected_spacing_x", "expected_spacing_y", "max_proximity_points", "max_proximity_pairs")
        integers = (
            "normal_step_min_component_cells",
            "nonlocal_uv_exclusion",
            "max_proximity_points",
            "max_proximity_pairs",
        )
        problems = []
        for name, value in vars(self).items():
            if name in integers or (name in optional and value is None):
                continue
            if not (math.isfinite(value) and value > 0):
                problems.append(f"{name} has to be finite and above zero")
        ordering = {
            "long_edge_ratio has to exceed short_edge_ratio": self.long_edge_ratio > self.short_edge_ratio,
            "normal_jump_degrees has to stay below 180": self.normal_jump_degrees < 180,
            "condition_number has to exceed 1": self.condition_number > 1,
            "symmetric_stretch has to exceed 1": self.symmetric_stretch > 1,
            "area ratio limits have to lie on both sides of 1": self.area_ratio_low < 1 < self.area_ratio_high,
            "shear has to stay below 1": self.shear < 1,
            "normal_step_min_component_cells has to be 1 or more": self.normal_step_min_component_cells >= 1,
            "max_proximity_points has to be 1 or more": self.max_proximity_points is None or self.max_proximity_points >= 1,
            "max_proximity_pairs has to be 0 or more": self.max_proximity_pairs is None or self.max_proximity_pairs >= 0,
            "nonlocal_uv_exclusion has to be 0 or more": self.nonlocal_uv_exclusion >= 0,
        }
        problems += [text for text, holds in ordering.items() if not holds]
        if problems:
            raise ValueError("; ".join(problems))
        return self
