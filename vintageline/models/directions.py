"""Risk direction of each feature of a model."""

from __future__ import annotations

from collections.abc import Sequence

from vintageline.settings import FEATURES, RISK_DIRECTION


def directions_of(features: Sequence[str] = FEATURES) -> tuple[int, ...]:
    """Direction per feature in feature order; 0 leaves a feature free."""
    absent = sorted(set(RISK_DIRECTION) - set(features))
    if absent:
        raise ValueError(f"features lack the constrained drivers {absent}")
    return tuple(RISK_DIRECTION.get(f, 0) for f in features)
