"""Measures of combined regions against known areas and against counted places."""

import math

import numpy as np
import pytest

from pinprick.functions import regions as g


def square(x, y, a):
    return g.Polygon(((x, y), (x, y + a), (x + a, y + a), (x + a, y)))


def test_parts_that_do_not_meet():
    one, far = square(0, 0, 2), square(10, 10, 3)
    assert g.Difference(one, far).region_measure == pytest.approx(4)
    assert g.symmetric_difference(one, far).region_measure == pytest.approx(13)
    assert g.Intersection(one, far).region_measure == 0 and g.union_measure(one, far) == pytest.approx(13)
    assert g.Union((one, g.EmptyRegion(2))).region_measure == pytest.approx(4)


def test_holes_boxes_and_more_than_two():
    ring = g.Polygon(((0, 0), (0, 4), (4, 4), (4, 0)), (((1, 1), (1, 3), (3, 3), (3, 1)),))
    assert g.Intersection(ring, square(0, 0, 2)).region_measure == pytest.approx(3)
    assert g.Union((ring, square(1, 1, 2))).region_measure == pytest.approx(16)
    assert g.Union((square(0, 0, 2), square(1, 1, 2), square(2, 0, 2))).region_measure == pytest.approx(10)
    cube = g.AxisOrientedCuboid((0, 0, 0), 2, 2, 2)
    assert g.symmetric_difference(cube, g.AxisOrientedCuboid((1, 1, 1), 2, 2, 2)).region_measure == pytest.approx(14)
    assert g.surrounding_region(g.AxisOrientedRectangle((0, 0), 2, 3), 1).region_measure == pytest.approx(14)


@pytest.mark.parametrize("seed", range(5))
def test_ragged_polygons_against_counted_places(seed):
    r = np.random.default_rng(seed)

    def ragged():
        t = np.sort(r.random(12)) * 2 * math.pi
        return g.Polygon(tuple(map(tuple, (np.column_stack([np.cos(t), np.sin(t)]) * (0.3 + r.random((12, 1))) + r.normal(0, 0.3, 2)).tolist())))

    def held(p, at):
        x, y = at.T
        n = np.zeros(len(at), int)
        for ring in p.rings:
            for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0)):
                n += ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0 + (y1 == y0)) + x0)
        return n % 2 == 1

    one, two = ragged(), ragged()
    at = (np.stack(np.meshgrid(np.arange(900), np.arange(900)), -1).reshape(-1, 2) + 0.5) / 900 * 6 - 3
    a, b, cell = held(one, at), held(two, at), (6 / 900) ** 2
    for region, want in ((g.Union((one, two)), a | b), (g.Intersection(one, two), a & b), (g.Difference(one, two), a & ~b), (g.symmetric_difference(one, two), a ^ b)):
        assert region.region_measure == pytest.approx(want.sum() * cell, abs=0.01)


def test_buffers():
    assert square(0, 0, 2).buffer(1).region_measure == pytest.approx(4 + 8 + math.pi, rel=1e-3)
    arrow = g.Polygon(((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)))
    inner = (1 - math.pi / 4) * 0  # the inner corner adds nothing
    assert arrow.buffer(0.5).region_measure == pytest.approx(arrow.region_measure + 16 * 0.5 - 0.25 + 5 * math.pi * 0.25 / 4 + inner, rel=1e-3)
    assert g.expand_region(g.Ellipse((0, 0), 2, 2), 1, square(0, 0, 5)).region_measure == pytest.approx(math.pi, rel=1e-2)
    assert g.MultiPolygon((square(0, 0, 1), square(5, 5, 1))).buffer(0).region_measure == pytest.approx(2)
    with pytest.raises(ValueError):
        square(0, 0, 1).buffer(-1)
