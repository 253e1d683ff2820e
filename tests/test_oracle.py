"""Every query with SQL against DuckDB over the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from radiotiles.plans import extended, more  # noqa: F401
from radiotiles.plans import queries as plans

DATA = "/root/testdata/sf0.001"
#: Queries whose values have differed on more rows only.
LARGER = ("d5_terrain_features", "d6_built_features", "d7_plane_features", "d10_descriptor_vectors", "j4_holm", "i5_full_report", "h4_descriptor_ridge", "h7_residual_ridge", "h11_second_stage_sigma")


@pytest.fixture(scope="module")
def con():
    out = {}
    for sf in (DATA, DATA.replace("0.001", "0.01")):
        out[sf] = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            out[sf].execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize(("name", "sf"), [(n, DATA) for n in sorted(plans.ORACLE)] + [(n, DATA.replace("0.001", "0.01")) for n in LARGER])
def test_query_agrees(spark, con, name, sf):
    got = plans.QUERIES[name](spark, sf)
    cur = con[sf].execute(plans.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in cur.fetchall())
    have = Counter(tuple(plain(row[c]) for c in order) for row in got.collect())
    assert sum(want.values()) == sum(have.values())
    assert not (want - have), (list((want - have).items())[:3], list((have - want).items())[:3])


def test_holm_tests_every_supplier(spark):
    sf = "/root/testdata/sf0.01"
    sums = duckdb.execute(f"SELECT l_returnflag, l_suppkey::VARCHAR, (sum(l_orderkey) % 997)::DOUBLE / 4000 FROM '{sf}/lineitem.parquet' GROUP BY ALL").fetchall()
    want = {}
    for family in {f for f, _, _ in sums}:
        own = sorted((p, name) for f, name, p in sums if f == family)
        going = True
        for i, (p, name) in enumerate(own):
            going = going and p <= 0.05 / (len(own) - i)
            want[family, name] = (round(p, 6), going)
    assert len(want) > 3 * 30
    assert {(r["family"], r["name"]): (r["p"], r["rejected"]) for r in plans.QUERIES["j4_holm"](spark, sf).collect()} == want
