"""Outreach run: pack requests and giving faith groups against their monthly targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from givetide.operators.targets import faith_groups_vs_target, pack_requests_vs_target
from givetide.sources.warehouse import Warehouse, one_run, replace_table


def run(w: Warehouse, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Replace both tables; the warehouse must be opened with ``newer=True``."""
    with one_run(w, "newer"):
        replace_table(pack_requests_vs_target(w), "pack_requests_vs_target", write, w.names)
        replace_table(faith_groups_vs_target(w), "faith_groups_vs_target", write, w.names)
