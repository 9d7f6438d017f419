"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_text


def queries() -> dict:
    return dict(queries_text.QUERIES)


def oracles() -> dict:
    return dict(queries_text.ORACLES)
