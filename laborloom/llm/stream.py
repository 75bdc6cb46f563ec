"""Helpers that come from the core: classes of linked items, and runs of equal keys in sorted batches."""

from __future__ import annotations

from ..functions.batches import groups
from ..operators.components import classes

__all__ = ["classes", "groups"]
