"""Parameters of a survey; all of them fold into the plan as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Camera:
    width: int = 640
    height: int = 512
    rgb_width: int = 4096
    rgb_height: int = 3072
    fov_deg: float = 45.0
    rgb_fov_deg: float = 80.0
    crop_ratio: float = 0.70

    @property
    def tan_ratio(self) -> float:
        return math.tan(math.radians(self.fov_deg / 2)) / math.tan(math.radians(self.rgb_fov_deg / 2))


@dataclass(frozen=True)
class DetectConfig:
    """Settings of one detection run."""

    threshold: float = 1.0
    min_area: int = 50
    max_area: int | None = None
    max_shore: float = 5.0
    edge_shore: float = 20.0
    edge_buffer: int = 10
    baseline: str = "median"
    window: int = 5
    dedup_m: float = 10.0
    min_ocean_fraction: float = 0.01
    include_waves: bool = False
    camera: Camera = field(default_factory=Camera)


METRES_PER_DEGREE = 111320.0
EARTH_RADIUS_M = 6371000.0
