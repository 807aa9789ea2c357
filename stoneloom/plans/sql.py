"""Helpers for the SQL that checks queries."""

from __future__ import annotations

import re


def materialized(sql: str) -> str:
    """Every common table expression computed once, however often later ones name it."""
    return re.sub(r"(WITH |, )(\w+) AS \((?=SELECT)", r"\1\2 AS MATERIALIZED (", sql)
