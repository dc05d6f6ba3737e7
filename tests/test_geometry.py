"""Kernels: predicates, overlay, assembly and simplification keep their laws."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.functions import geometry as g


def box(x0, y0, x1, y1):
    return g.box_polygon((x0, y0, x1, y1))


def star(rnd, x, y, n):
    """A simple polygon around a point."""
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + math.cos(t) * r, y + math.sin(t) * r) for t, r in zip(turns, [rnd.uniform(0.5, 2) for _ in turns])]
    return ring + [ring[0]], []


def test_distances_and_areas():
    ring = box(0, 0, 2, 1)[0]
    assert g.signed_area(ring) == 2 and g.signed_area(ring[::-1]) == -2
    octant = [(0, 0), (90, 0), (0, 90), (0, 0)]
    assert g.spherical_area(octant) == pytest.approx(math.pi / 2)
    assert g.distances((0, 0), (2, 0), __import__("numpy").array([[1.0, 3.0]]))[0] == 3
    with pytest.raises(ValueError):
        g.distances((0, 0), (0, 0), __import__("numpy").zeros((1, 2)))


def test_points_and_boundaries():
    mp = [(box(0, 0, 4, 4)[0], [box(1, 1, 2, 2)[0]])]
    assert [g.place_in(p, mp) for p in [(3, 3), (0, 2), (1.5, 1.5), (1, 1.5), (5, 5)]] == [1, 0, -1, 0, -1]


def test_lines():
    mp = [box(0, 0, 4, 4), box(4, 0, 8, 4)]
    assert g.line_covered_by([(0, 0), (4, 0)], mp[:1])
    assert g.line_covered_by([(1, 1), (3, 3), (4, 4)], mp[:1])
    assert not g.line_covered_by([(1, 1), (5, 5)], mp[:1])
    notched = [([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)], [])]
    assert not g.line_covered_by([(0.5, 3), (3.5, 3)], notched)
    assert g.line_intersects([(0.5, 3), (3.5, 3)], notched)
    assert g.line_intersects([(-1, 2), (9, 2)], mp) and not g.line_intersects([(-1, 5), (9, 5)], mp)


def test_polygons():
    outer = [(box(0, 0, 9, 9)[0], [box(4, 4, 5, 5)[0]])]
    assert g.polygon_covered_by(box(1, 1, 3, 3), outer)
    assert not g.polygon_covered_by(box(3, 3, 6, 6), outer)
    assert g.multi_intersects([box(3, 3, 6, 6)], outer) and not g.multi_intersects([box(4.2, 4.2, 4.8, 4.8)], outer)
    assert g.ring_within(box(1, 1, 2, 2)[0], box(0, 0, 3, 3)[0]) and not g.ring_within(box(0, 1, 2, 2)[0], box(0, 0, 3, 3)[0])
    assert g.is_valid(outer) and not g.is_valid([([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [])])


@pytest.mark.parametrize("seed", range(40))
def test_overlay_areas_add_up(seed):
    rnd = random.Random(seed)
    a, b = [star(rnd, 0, 0, 9)], [star(rnd, rnd.uniform(-1, 1), rnd.uniform(-1, 1), 11)]
    if not (g.is_valid(a) and g.is_valid(b)):
        return
    u, i, d = (g.area(g.overlay(a, b, h)) for h in ("union", "intersection", "difference"))
    assert u + i == pytest.approx(g.area(a) + g.area(b)) and d + i == pytest.approx(g.area(a))


def test_overlay_of_touching_boxes():
    a, b = [box(0, 0, 4, 4)], [box(4, 0, 8, 4)]
    assert g.area(g.overlay(a, b, "union")) == 32 and g.overlay(a, a, "difference") == [] and g.area(g.overlay(a, a, "union")) == 16
    hole = g.overlay(a, [box(1, 1, 2, 2)], "difference")
    assert len(hole[0][1]) == 1 and g.area(hole) == 15


@given(st.permutations(range(6)), st.lists(st.booleans(), min_size=6, max_size=6))
@settings(max_examples=60, deadline=None)
def test_stitching_any_order(order, turned):
    pts = [(math.cos(k), math.sin(k)) for k in range(6)]
    parts = [[pts[k], (k + 0.5, 9.0), pts[(k + 1) % 6]] for k in range(6)]
    chains = g.stitch([parts[k][::-1] if t else parts[k] for k, t in zip(order, turned)])
    closed, open_ = g.closed_and_open(chains)
    assert len(closed) == 1 and not open_ and len(closed[0]) == 13


def test_rings_that_touch_stay_apart():
    a, b = box(0, 0, 1, 1)[0], box(1, 1, 2, 2)[0]
    assert sorted(map(len, g.stitch([a, b]))) == [5, 5]
    halves = [a[:3], b[2:], a[2:], b[:3]]
    closed, open_ = g.closed_and_open(g.stitch(halves))
    assert not open_ and sum(len(r) - 1 for r in closed) == 8


def test_many_parts_are_joined_quickly():
    import time

    pts = [(math.cos(2 * math.pi * i / 20_000), math.sin(2 * math.pi * i / 20_000)) for i in range(20_000)]
    parts = [[pts[i], pts[(i + 1) % 20_000]] for i in range(20_000)]
    random.Random(1).shuffle(parts)
    start = time.process_time()
    chains = g.stitch(parts)
    assert len(chains) == 1 and len(chains[0]) == 20_001 and time.process_time() - start < 5


@pytest.mark.parametrize("seed", range(8))
def test_one_sided_rings_keep_their_side(seed):
    """No point of the ring lies on the wrong side of the chord that stands for it, nor further than the tolerance."""
    rnd = random.Random(seed)
    ring = wavy(60 + 10 * seed, rnd)
    for inside in (True, False):
        got = g.one_sided(ring, 0.01, inside)
        at = [ring.index(p) for p in got[:-1]]
        assert at == sorted(at) and got[0] == got[-1] == ring[0]
        for i, j in zip(at, at[1:]):
            if j - i > 1:
                d = g.distances(ring[i], ring[j], np.array(ring[i + 1 : j]))
                assert (d >= 0 if inside else d <= 0).all() and np.abs(d).max() <= 0.01


def test_loops_that_overlap_go_together():
    ring = [(math.cos(2 * math.pi * i / 40), math.sin(2 * math.pi * i / 40)) for i in range(40)]
    ring[10], ring[11], ring[12], ring[13] = ring[12], ring[10], ring[13], ring[11]
    ring.append(ring[0])
    fixed = g.without_crossings(ring)
    assert not g.is_simple(ring) and g.is_simple(fixed) and len(fixed) >= 30 and g._crossings(fixed) == []


def test_open_chains_stay_open():
    closed, open_ = g.closed_and_open(g.stitch([[(0, 0), (1, 0)], [(5, 5), (6, 6)], [(1, 0), (2, 0)]]))
    assert not closed and open_ == [[(0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)]]


def test_holes_go_to_the_first_ring_that_holds_them():
    outers = [box(0, 0, 4, 4)[0], box(10, 0, 14, 4)[0]]
    holes = [box(11, 1, 12, 2)[0], box(1, 1, 2, 2)[0], box(20, 20, 21, 21)[0]]
    assert [len(p[1]) for p in g.assign_holes(outers, holes, strict=True)] == [1, 1]


def wavy(k, rnd):
    ring = [(10 + (1 + 0.004 * math.sin(7 * t) + rnd.uniform(0, 0.001)) * math.cos(t), 10 + (1 + 0.004 * math.sin(7 * t)) * math.sin(t)) for t in (2 * math.pi * i / k for i in range(k))]
    return ring + [ring[0]]


@pytest.mark.parametrize("seed", range(6))
def test_estimates_enclose_the_shape(seed):
    ring = wavy(200 + 40 * seed, random.Random(seed))
    exact = [g.correct((ring, []))]
    under, over = g.under_estimate(ring), g.over_estimate(ring)
    assert all(g.polygon_covered_by(p, over) for p in exact)
    assert g.num_points(over) <= len(ring)
    if under:
        assert g.multi_covered_by(under, exact) and g.num_points(under) < len(ring)


def test_few_points_are_not_simplified():
    ring = box(0, 0, 1, 1)[0]
    assert g.under_estimate(ring) == [] and g.over_estimate(ring) == [box(0, 0, 1, 1)]


def test_crossings_are_cut_out():
    ring = [(0, 0), (4, 0), (4, 4), (2, 5), (3, 5), (0, 4), (0, 0)]
    fixed = g.without_crossings([(0, 0), (4, 0), (4, 4), (1, 3), (2, 5), (2, 3), (0, 4), (0, 0)])
    assert g.is_simple(fixed) and len(fixed) >= 4 and ring[0] == ring[-1]


def test_gnomonic_keeps_great_circles_straight():
    p = g.Gnomonic(8.5, 50.5)
    a, b = (8.0, 50.0), (9.0, 51.0)
    va, vb = ([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))] for x, y in (a, b))
    m = [x + y for x, y in zip(va, vb)]
    mid = (math.degrees(math.atan2(m[1], m[0])), math.degrees(math.atan2(m[2], math.hypot(m[0], m[1]))))
    pa, pb, pm = p.points([a, b, mid])
    assert abs(g.cross(pa, pb, pm)) < 1e-15
    assert p.points([(188.5, -50.5)]) is None


def test_many_points_as_one():
    rnd = random.Random(3)
    for seed in range(20):
        a, b = star(rnd, 0, 0, 30), star(rnd, 0.1, 0, 8)
        mp = [a, star(rnd, 5, 0, 12)] if seed % 2 else [(a[0], [[(x / 5, y / 5) for x, y in b[0]]])]
        pts = [(rnd.uniform(-2, 7), rnd.uniform(-2, 2)) for _ in range(60)] + a[0] + mp[-1][0]
        assert g.places_in(pts, mp).tolist() == [g.place_in(p, mp) for p in pts]


def test_only_valid_elements_take_part():
    bow = ([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [])
    open_box = ([(0, 0), (0, 1), (1, 1), (1, 0)], [])
    points, lines, polygons = g.kept_valid([(0, 0), (math.nan, 1)], [[(0, 0), (0, 0)], [(0, 0), (1, 1)]], [bow, box(0, 0, 1, 1), open_box])
    assert points == [(0, 0)] and lines == [[(0, 0), (1, 1)]] and [len(p[0]) for p in polygons] == [5, 5]


def test_large_rings_are_quick():
    import time

    ring = wavy(5000, random.Random(1))
    start = time.process_time()
    assert g.is_simple(ring) == g.is_simple(ring[::-1]) and g.polygon_covered_by(([(10 + (x - 10) / 2, 10 + (y - 10) / 2) for x, y in ring], []), [(ring, [])])
    assert time.process_time() - start < 20


def _spoilt(seed):
    """Rings that cross, touch, overlap or repeat themselves."""
    rnd = random.Random(seed)
    grid = lambda r: [(round(2 * x) / 2, round(2 * y) / 2) for x, y in r] if seed % 3 == 0 else r
    a, b = grid(star(rnd, 0, 0, 5 + seed % 40)[0]), grid(star(rnd, 0.5, 0, 30 - seed % 20)[0])
    if seed % 2:
        a[2], a[3] = a[3], a[2]
    return a, (a[::-1] if seed % 5 == 0 else b)


@pytest.mark.parametrize("seed", range(40))
def test_arrays_of_segments_meet_like_single_ones(seed):
    a, b = _spoilt(seed)
    edges = g._edge_arrays([(b, [])])
    want = [(*p, *q) for x, y in zip(a, a[1:]) for p, q in g._pieces(x, y, edges)]
    assert list(map(tuple, g._cut(g._edge_arrays([(a, [])]), edges).tolist())) == want
    n, pairs = len(a) - 1, []
    for i in range(n):
        for j in range(i + 1, n):
            met = g.meeting(a[i], a[i + 1], a[j], a[j + 1])
            if j == i + 1:
                met = [t for t in met if t < 1 - 1e-9]
            elif i == 0 and j == n - 1:
                met = [t for t in met if t > 1e-9]
            if met:
                pairs.append((i, j))
    assert list(g._self_meetings(a)) == pairs


def test_tolerances_together_are_as_each_alone():
    for seed in range(6):
        ring = wavy(60 + 30 * seed, random.Random(seed))
        for inside in (True, False):
            assert g.one_sided_at(ring, g.tolerances(), inside) == [g.one_sided(ring, e, inside) for e in g.tolerances()]


def test_no_plain_step_for_each_pair_of_segments(monkeypatch):
    """Estimates and loops of a ring look at its pairs of segments at once."""
    calls, plain = [], g.meeting
    monkeypatch.setattr(g, "meeting", lambda *p: calls.append(1) or plain(*p))
    ring = wavy(100, random.Random(1))
    assert g.multi_covered_by(g.under_estimate(ring), [g.correct((ring, []))]) and g.over_estimate(ring)
    assert len(calls) < 100
    calls.clear()
    ring[3], ring[4] = ring[4], ring[3]
    assert g.is_simple(g.without_crossings(ring)) and not calls


def _loops_cut_plainly(ring):
    """``without_crossings``, one ring and one pair of edges after the other."""
    ring = g.drop_repeats(g.reclose(list(ring)))
    while len(ring) > 3:
        n, gone = len(ring) - 1, set()
        pairs = [(i, j) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1) and g.meeting(ring[i], ring[i + 1], ring[j], ring[j + 1])]
        if not pairs:
            break
        for i, j in pairs:
            between = set(range(i + 1, j + 1))
            gone |= between if 2 * (j - i) <= n else set(range(n)) - between
        ring = g.drop_repeats(g.reclose([ring[k] for k in range(n) if k not in gone]))
    return ring


def _odd_rings():
    """Rings that cross, touch or repeat themselves, open ones, and hardly any points; one larger than what is looked at together."""
    made = [r for seed in range(40) for r in _spoilt(seed)]
    made += [r[:-1] for r in made[::3]] + [[r[0], *r] for r in made[::4]]
    return [[], *made, [(0.0, 0.0)], [(0.0, 0.0)] * 5, [(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], []]


@pytest.mark.parametrize("together", [1, 500, g._TOGETHER])
def test_rings_together_are_as_each_alone(monkeypatch, together):
    monkeypatch.setattr(g, "_TOGETHER", together)
    many = _odd_rings()
    got = g.packed(many)
    assert g.unpacked(got) == many
    assert g.are_simple(got).tolist() == [g.is_simple(r) for r in many]
    assert g.unpacked(g.all_without_crossings(got)) == [_loops_cut_plainly(r) for r in many]
    assert [len(x) for x in g.all_without_crossings(g.packed([]))] == [0, 1]


def test_no_step_for_each_ring_of_a_batch(monkeypatch):
    calls, whole = [], g._meetings
    monkeypatch.setattr(g, "_meetings", lambda *p: calls.append(1) or whole(*p))
    many = [wavy(24 + k % 40, random.Random(k)) for k in range(400)]
    for ring in many:
        ring[5], ring[6] = ring[6], ring[5]
    many = g.packed(many)
    assert not g.are_simple(many).any() and g.are_simple(g.all_without_crossings(many)).all()
    assert len(calls) < 100
