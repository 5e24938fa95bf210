"""Settings of the camera and of every operator, as shipped."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from hashlib import md5
from json import dumps


@dataclass(frozen=True)
class Settings:
    # Fixed values of the camera: crop rectangle, lane polygon, crossing line, parked-curb corner.
    crop_x: int = 300
    crop_y: int = 600
    polygon: tuple = (
        (1484, 636), (1750, 696), (1854, 858), (1913, 1066), (2076, 1302), (2372, 1554),
        (2579, 1664), (370, 1664), (340, 1125), (622, 918), (1036, 770), (1332, 681),
    )
    line: tuple = ((400.0, 1200.0), (2250.0, 1200.0))
    line_id: str = "LINE_MAIN_LASTRE"
    increasing: str = "ENTRADA"
    decreasing: str = "SALIDA"
    curb_x: int = 460
    curb_y: int = 1200
    # Crossing and tracks.
    approach_distance: float = 180.0
    commit_distance: float = 20.0
    commit_points: int = 4
    net_travel: float = 30.0
    idle_seconds: float = 3.0
    stitch_gap: tuple = (0.05, 3.0)
    stitch_distance: float = 450.0
    post_window_seconds: float = 0.0
    # Sampling.
    sleep_fps: float = 1.0
    preactive_fps: float = 3.5
    active_fps: float = 6.0
    active_hold: float = 2.5
    preactive_hold: float = 2.0
    # Evidence.
    top_vehicles: int = 8
    top_plates: int = 7
    separation_seconds: float = 0.0
    # Plates.
    min_ocr_confidence: float = 0.70
    prior_beta: float = 0.0
    review_threshold: float = 0.0
    # Duplicates.
    cooldown_seconds: float = 60.0
    history: int = 50
    extra: dict = field(default_factory=dict)

    @property
    def key(self) -> str:
        """Eight digits that name these settings."""
        return md5(dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:8]


DEFAULT = Settings()


def load(path: str) -> Settings:
    """Settings from a YAML file of the same names; what it leaves out stays as shipped."""
    import yaml

    with open(path) as file:
        found = yaml.safe_load(file) or {}
    known = {k: tuple(map(tuple, v)) if k in ("polygon", "line") else v for k, v in found.items() if k in Settings.__dataclass_fields__}
    return replace(DEFAULT, **known, extra={k: v for k, v in found.items() if k not in known})
