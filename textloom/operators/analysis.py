"""Runs a list of analyses over one set of tables, writes what came of each, and notes what failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import write_reports
from .folders import hadoop_path

Query = Callable[[SparkSession, str], DataFrame]
#: The analyses of a study, in the order of its report.
STUDY = ("floor_gate", "cell_table", "control_bands", "sd_unit_gain", "contrast_families", "saturation_test", "quadratic_fit", "tstar_labels", "isotonic", "isotonic_permutation", "power_law_fit", "cell_fits", "holdout_forms", "frontier", "gains_ste", "selection_shares", "mediation", "leave_group_out")


def run_study(spark: SparkSession, sf_dir: str, uri: str, queries: dict[str, Query], names: tuple[str, ...] = STUDY) -> dict[str, str]:
    """Writes each named analysis below uri as CSV and JSON; returns a note for each: written, was there, or why it failed.

    One that is complete from an earlier call is left alone, so a broken run goes on where it stopped; one that fails
    doesn't stop the others.
    """
    notes = {}
    for name in names:
        path, fs = hadoop_path(spark, f"{uri}/{name}.json/_SUCCESS")
        if fs.exists(path):
            notes[name] = "was there"
            continue
        for ending in ("csv", "json"):  # what an earlier call left incomplete
            fs.delete(hadoop_path(spark, f"{uri}/{name}.{ending}")[0], True)
        try:
            write_reports({name: queries[name](spark, sf_dir)}, uri)
            notes[name] = "written"
        except Exception as e:  # noqa: BLE001 - every kind of failure belongs in the notes
            notes[name] = f"failed: {type(e).__name__}: {str(e)[:200]}"
    return notes
