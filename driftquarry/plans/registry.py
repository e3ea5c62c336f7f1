"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

import importlib

from . import base

for _name in ("kernel_queries", "stat_queries", "table_queries", "stream_queries", "file_queries"):
    importlib.import_module(f"{__package__}.{_name}")


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
