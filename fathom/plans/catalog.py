"""Loads every module that registers queries."""

from . import curation, data_plane, distributions, governance, timeline, workbench  # noqa: F401
