"""Power cover, lazy greedy steps and placement by power against plain loops."""

import math

import numpy as np
import pytest

from radiotiles.operators import folds, siting

SITE = "candidate_id long, sx double, sy double, p_tx_dbm double, gamma double, pl0 double, margin_db double"


def plain_power(site, x, y):
    d = max(math.hypot(site[1] - x, site[2] - y), 1.0)
    return site[3] - site[6] - site[5] - site[4] * 10 * math.log10(d)


def made(rng, n_sites=40, n_points=300):
    sites = [(i, *(float(c) for c in rng.uniform(-900, 900, 2)), float(rng.uniform(20, 50)), float(rng.uniform(1.8, 4)), 40.0, float(rng.uniform(0, 6))) for i in range(n_sites)]
    sites += [(100, 0.0, 0.0, -90.0, 2.0, 40.0, 0.0), (101, 0.0, 0.0, 30.0, -1.0, 40.0, 0.0), (102, 0.0, 0.0, None, 2.0, 40.0, 0.0), (103, 5.0, 5.0, -22.0, 3.0, 40.0, 0.0)]
    return sites, [(i, *(float(c) for c in rng.uniform(-900, 900, 2))) for i in range(n_points)] + [(500, 5.5, 5.0)]


def test_power_cover_has_a_reach_for_each_site(spark):
    sites, points = made(np.random.default_rng(1))
    got = {(r.candidate_id, r.point_id): r.power_dbm for r in siting.cover_by_power(spark.createDataFrame(sites, SITE), spark.createDataFrame(points, "point_id long, px double, py double"), -62.0).collect()}
    want = {(s[0], p[0]): plain_power(s, p[1], p[2]) for s in sites if s[3] is not None and s[4] > 0 for p in points}
    want = {k: v for k, v in want.items() if v >= -62.0}
    assert got.keys() == want.keys() and (103, 500) in got  # power at one metre is the threshold itself
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert len({math.ceil(math.log2(max(math.hypot(sites[c][1] - points[p][1], sites[c][2] - points[p][2]), 1))) for c, p in want if c < 40 and p < 300}) > 3  # several classes


def plain_greedy(edges):
    cover = {}
    for c, p in edges:
        cover.setdefault(c, set()).add(p)
    done, steps = set(), []
    while gains := [(-len(ps - done), c) for c, ps in cover.items() if ps - done]:
        low, c = min(gains)
        steps.append((c, -low))
        done |= cover[c]
    return steps, sum(len(v) for v in cover.values())


@pytest.mark.parametrize(("head", "at_once"), [(4096, 16), (3, 2)])
def test_lazy_steps_are_those_of_full_counts(spark, head, at_once):
    rng = np.random.default_rng(2)
    edges = [(int(c), int(p)) for c in range(9) for p in rng.choice(40, rng.integers(1, 25), replace=False)]
    edges += [(50, p) for c, p in edges if c == 3] + edges[:10]  # a site like another one, and repeated rows
    want, all_edges = plain_greedy(set(edges))
    got = siting.greedy_cover(spark.createDataFrame(edges, "candidate_id long, point_id long"), head=head, at_once=at_once).orderBy("step").collect()
    assert [(r.candidate_id, r.gain) for r in got] == want and [r.step for r in got] == list(range(len(want)))
    assert sum(r.recounted_edges for r in got) < len(want) * all_edges
    first = siting.greedy_cover(spark.createDataFrame(edges, "candidate_id long, point_id long"), 2, head, at_once).orderBy("step").collect()
    assert [(r.candidate_id, r.gain) for r in first] == want[:2]


def test_no_edges_give_no_steps(spark):
    assert siting.greedy_cover(spark.createDataFrame([], "candidate_id long, point_id long")).count() == 0


def test_median_placement_by_power(spark):
    # site 1 is nearer to the middle point, site 2 stronger there: 2 is taken, then a new station far away
    sites = spark.createDataFrame([(1, 10.0, 0.0, 20.0, 2.0, 40.0, 0.0), (2, 40.0, 0.0, 40.0, 2.0, 40.0, 0.0)], SITE)
    points = spark.createDataFrame([(i, 2.0 * i, 0.0) for i in range(5)] + [(9, 90_000.0, 0.0)], "point_id long, px double, py double")
    station = {"p_tx_dbm": 30.0, "gamma": 2.0, "pl0": 40.0, "margin_db": 0.0}
    got = [(r.step, r.candidate_id, r.x, r.gain) for r in siting.median_placement(sites, points, threshold_dbm=-60.0, station=station).orderBy("step").collect()]
    assert got == [(0, 2, 40.0, 5), (1, None, 90_000.0, 1)]
    with pytest.raises(ValueError, match="radius"):
        siting.median_placement(sites, points)


def test_holm_of_the_report_is_that_of_the_t_tests(spark):
    # differences whose mean is far from 0 by t and not by ranks: five folds have no signed-rank p under 0.0625
    scores = spark.createDataFrame([(m, f"f{k}", 1.0 + (0.5 + 0.01 * k if m == "b" else 0.0)) for k in range(5) for m in ("a", "b")], "model string, fold string, value double")
    r = folds.model_report(scores, 200).first()
    assert r.p_t < 0.001 and r.p_w == pytest.approx(0.0625) and r.rejected
