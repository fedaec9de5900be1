"""Decay schedules of the map trainer's control parameters."""

from __future__ import annotations

import math


def decayed(t: int, start: float, final: float, tau: float, switch_at: int | None = None) -> float:
    """``start * exp(-t / tau)`` before iteration ``switch_at``, ``final`` from there on."""
    if switch_at is not None and t >= switch_at:
        return final
    return start * math.exp(-t / tau)
