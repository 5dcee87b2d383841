"""All registered queries."""

from __future__ import annotations

from . import section_ab, section_cd, section_efgh, section_ijk, section_plans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
