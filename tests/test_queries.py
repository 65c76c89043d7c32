"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from parcelweave.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
CHECKED = ["overlay", "zone_shares", "adjacency", "locate_parcel", "districts", "detect_jurisdiction", "setbacks", "terrain",
           "regulatory_screen", "candidates", "north_edges", "envelope_shapes", "inset_shapes", "self_crossing", "repair_rings", "overlay_repaired", "datum_shift", "layer_ingest", "setback_envelope", "constrained_massing", "search", "grid_rules", "parse_designations", "session_state_stream"]


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
