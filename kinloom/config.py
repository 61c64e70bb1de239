"""Tunables, each overridable by an environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def _flag(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    # Defaults are part of the semantics.
    min_face_px: int = 50
    second_class_face_px: int = 80
    min_det_score: float = 0.60
    min_aspect: float = 0.40
    max_aspect: float = 2.50
    min_blur_var: float = 12.0
    max_yaw_deg: float = 50.0
    pass1_threshold: float = 0.42
    pass2_threshold: float = 0.55
    same_photo_rule: bool = True
    min_faces_per_person: int = 3
    second_class_assign: float = 0.38
    second_class_auto: bool = True
    alarm_min_people: float = 10.0
    alarm_max_people: float = 125.0
    tile_target_scale: float = 0.25
    tile_overlap: float = 0.20
    max_tiles_per_axis: int = 4
    min_side_for_tiling: int = 1600
    det_size: int = 640
    nms_iou: float = 0.40
    nms_containment: float = 0.80

    @classmethod
    def from_env(cls, prefix: str = "KINLOOM_", env=None) -> "Settings":
        """An empty variable counts as unset."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper(), "").strip()
            if text:
                found[f.name] = _flag(text) if isinstance(f.default, bool) else type(f.default)(text)
        return cls(**found)

    def signature(self) -> str:
        """Names a clustering by what shaped it, the automatic small-face line included."""
        return f"p1={self.pass1_threshold:.4f}:p2={self.pass2_threshold:.4f}:min={self.min_faces_per_person}:sc={self.second_class_assign:.4f}:sp={int(self.same_photo_rule)}:auto={int(self.second_class_auto)}"


# Fixed values of the threshold search.
DUPLICATE_FLOOR = 0.20
PILE_DISCOUNT = 0.82
MIN_PAIRS = 200
MERGE_FLOOR, MERGE_CEILING = 0.40, 0.62
MAX_PAIRS = 400_000
SMALL_MARGIN = 0.75
SMALL_MIN_PAIRS = 100
SMALL_FLOOR, SMALL_CEILING = 0.30, 0.55
EXACT_LIMIT = 12_000
QUALITY_WEIGHT_BASE = 0.5
FALLBACK_SECONDS_PER_PHOTO = 2.27
LARGE_EVENT, MEDIUM_EVENT = 500, 100
