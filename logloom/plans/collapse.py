"""Incremental collapse of all datasets in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from logloom.operators.collapse import neighbour_marks, superseded
from logloom.sinks.tables import high_water, mark_duplicates
from logloom.sources.searches import first_scan, marks, since_marks


@dataclass(frozen=True)
class CollapseRun:
    duplicates: DataFrame
    searches: DataFrame
    new_marks: DataFrame


def collapse(searches: DataFrame, state: DataFrame | None = None, mode: str = "later") -> CollapseRun:
    """Duplicates found since the marks, the searches with them flagged, and the new marks.

    ``mode`` is ``later`` (a later query within the time window extends it) or
    ``neighbours`` (rows compared with their neighbours in order).
    """
    scanned = first_scan(searches) if state is None else since_marks(searches, marks(state))
    find = {"later": superseded, "neighbours": neighbour_marks}[mode]
    duplicates = find(scanned)
    return CollapseRun(duplicates, mark_duplicates(searches, duplicates), high_water(scanned))
