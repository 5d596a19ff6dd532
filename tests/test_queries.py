"""Registered queries against their SQL at the smallest scale. All of them: python -m skyhive.registry.check"""

import os

import pytest

import __spark_entry__ as entry
from skyhive.registry.check import compare

SF = "/root/testdata/sf0.001"
QUICK = ["normalised_records", "judged_records", "clean_readings", "drop_ledger", "quality_flags", "daily_means", "coverage",
         "station_table", "cells_of_points", "cell_geometry", "distances", "region_edges", "geolocated_places", "nearest_k_stations",
         "judged_fires", "fires_by_cell", "daily_composite", "calendar_features", "band_errors", "live_table", "replayed_requests",
         "photo_observations", "matched_replies", "alert_dispatch", "replaced_partitions"]
CHOSEN = sorted(entry.queries()) if os.environ.get("SKYHIVE_ALL") else QUICK


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, name):
    text, _, same = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert same, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
