"""Importing this module registers every plan."""

from . import align_plans, cue_plans, edit_plans, snap_plans, source_plans, state_plans, sync_plans, talk_plans  # noqa: F401
from .registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
