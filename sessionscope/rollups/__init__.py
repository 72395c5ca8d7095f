"""Stored states that answer later windows without reading the rows again."""

from sessionscope.rollups.session_facts import build_session_facts, read_session_facts
from sessionscope.rollups.session_sets import build_session_sets, read_session_sets, update_session_sets

__all__ = [
    "build_session_facts",
    "build_session_sets",
    "read_session_facts",
    "read_session_sets",
    "update_session_sets",
]
