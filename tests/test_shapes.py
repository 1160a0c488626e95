"""Lines in polygons by exact arithmetic, and lines of several parts."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from thalweg.operators import network, shapes

POLYGONS = {
    "trough": ([(0, 0), (12, 0), (12, 10), (8, 10), (8, 4), (4, 4), (4, 10), (0, 10)], [[(1, 1), (3, 1), (3, 3), (1, 3)]]),
    "kite": ([(20, 0), (30, 5), (20, 10), (23, 5), (20, 0)], []),  # closed by its own first point
    "star": ([(3, 2), (9, 6), (15, 2), (11, 8), (15, 14), (9, 10), (3, 14), (7, 8)], [[(8, 7), (10, 7), (9, 9)], [(4, 3), (5, 4), (5, 3)]]),
}


def side(x, y, edges):
    """1 inside, 0 on an edge, -1 outside, exactly."""
    odd = False
    for (ax, ay), (bx, by) in edges:
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if (ay > y) != (by > y) and x < Fraction((bx - ax) * (y - ay), by - ay) + ax:
            odd = not odd
    return 1 if odd else -1


def within(line, polygon):
    ring, holes = polygon
    edges = [(a, b) for r in (ring, *holes) for a, b in zip(r, (*r[1:], r[0])) if a != b]
    seen = []
    for (x1, y1), (x2, y2) in zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]:
        cuts = {Fraction(0), Fraction(1)}
        for (ax, ay), (bx, by) in edges:
            d = (x2 - x1) * (by - ay) - (y2 - y1) * (bx - ax)
            if d:
                cuts.add(Fraction((ax - x1) * (by - ay) - (ay - y1) * (bx - ax), d))
            elif (ax - x1) * (y2 - y1) == (ay - y1) * (x2 - x1) and (x1, y1) != (x2, y2):
                cuts |= {Fraction((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1), (x2 - x1) ** 2 + (y2 - y1) ** 2) for px, py in ((ax, ay), (bx, by))}
        cuts = sorted(c for c in cuts if 0 <= c <= 1)
        seen += [side(x1 + (a + b) / 2 * (x2 - x1), y1 + (a + b) / 2 * (y2 - y1), edges) for a, b in zip(cuts, cuts[1:])]
    return min(seen) >= 0 and max(seen) == 1


def test_lines_within_concave_polygons_with_holes(spark):
    rng = random.Random(3)
    lines = {
        "over the gap": [(2, 8), (10, 8)], "round the gap": [(2, 8), (2, 4), (10, 4), (10, 8)], "along the border": [(0, 0), (12, 0)], "border then in": [(0, 0), (0, 5), (2, 5)],
        "through the hole": [(0, 2), (4, 2)], "on the hole's edge": [(1, 1), (3, 1), (3, 5)], "a point": [(6, 2)], "a point on the border": [(0, 5)], "kite": [(22, 2), (27, 5), (22, 8)],
        "kite cut": [(22, 2), (22, 8)], "corner": [(4, 4), (4, 2)], "twice the same": [(6, 2), (6, 2)],
    }
    for k in range(400):
        x, y = rng.randint(0, 30), rng.randint(0, 14)
        line = [(x, y)]
        for _ in range(rng.randint(0, 3)):
            x, y = x + rng.randint(-3, 3), y + rng.randint(-3, 3)
            line.append((x, y))
        lines[f"random {k}"] = line
    want = {(name, p) for name, line in lines.items() for p, polygon in POLYGONS.items() if within(line, polygon)}
    assert ("round the gap", "trough") in want and ("over the gap", "trough") not in want and ("border then in", "trough") in want and ("along the border", "trough") not in want
    coords = spark.createDataFrame([(n, [(float(x), float(y)) for x, y in line]) for n, line in lines.items()] + [("none", None), ("empty", [])], "comid string, pts array<struct<x double, y double>>")
    rings = "ring array<struct<x double, y double>>"
    polygons = spark.createDataFrame([(p, [(float(x), float(y)) for x, y in r], [[(float(x), float(y)) for x, y in h] for h in holes] or None) for p, (r, holes) in POLYGONS.items()],
                                     f"poly_id string, {rings}, holes array<array<struct<x double, y double>>>")
    for cell in (1.0, 3.0, 50.0):
        assert {(r.comid, r.poly_id) for r in shapes.lines_within(coords, polygons, cell).collect()} == want
    moved = lambda pts: F.transform(pts, lambda p: F.struct((p["x"] - 100.0).alias("x"), (p["y"] - 7.0).alias("y")))
    far = polygons.withColumns({"ring": moved("ring"), "holes": F.transform("holes", moved)})
    assert {(r.comid, r.poly_id) for r in shapes.lines_within(coords.withColumn("pts", moved("pts")), far, 2.0).collect()} == want
    assert shapes.lines_within(coords.limit(0), polygons, 1.0).count() == 0


def test_parts_are_joined_along_their_chain(spark):
    p = lambda *xs: [(float(x), 0.0) for x in xs]
    cases = {
        1: ([p(0, 1), p(1, 2, 3)], p(0, 1, 2, 3)), 2: ([p(5, 6), p(0, 1), p(1, 5)], p(0, 1, 5, 6)),  # in order, shuffled
        3: ([p(0, 1), p(2, 3)], p(0, 1)), 4: ([p(0, 1), p(1, 2), p(1, 3)], p(0, 1)),  # a gap, a fork
        5: ([p(2, 0), p(0, 1), p(1, 2)], p(2, 0, 1, 2)), 6: ([p(7, 8)], p(7, 8)), 7: ([], None), 8: (None, None),  # closed, single, nothing
        9: ([[], p(3, 4), p(2, 3)], p(2, 3, 4)), 10: ([p(k, k + 1) for k in (7, 3, 0, 5, 1, 6, 2, 4)], p(*range(9))), 11: ([p(0, 1), p(1, 0), p(5, 6), p(6, 5)], p(0, 1)),
    }
    frame = spark.createDataFrame([(k, parts) for k, (parts, _) in cases.items()], "comid long, parts array<array<struct<x double, y double>>>")
    got = {r.comid: r.pts and [tuple(x) for x in r.pts] for r in shapes.one_line(frame).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
    lines = spark.createDataFrame([(k,) for k in (2, 8, 99)], "comid long")
    located = {r.comid: (r.xup_m, r.xdown_m, r.length_m) for r in network.located(lines, frame).collect()}
    assert located == {2: (0.0, 6.0, 6.0), 8: (None,) * 3, 99: (None,) * 3}


def test_few_parts_are_joined_in_their_rows(spark, monkeypatch):
    """Random parts on few points, with forks, loops and gaps: as by pointers, but nothing is shuffled; many parts still go by pointers."""
    rng, rows = random.Random(8), []
    for k in range(400):
        way = [rng.randint(0, 9) for _ in range(rng.randint(2, 7))] if k % 2 else rng.sample(range(20), rng.randint(3, 9)) + [30]
        parts = [[(float(x), 0.0) for x in way[i : i + 2]] for i in range(len(way) - 1)]
        if k % 4 == 1:
            parts.append([parts[-1][-1], parts[0][0]])
        rng.shuffle(parts)
        rows.append((k, parts + [None, []] if k % 5 == 0 else parts))
    frame = spark.createDataFrame(rows, "comid long, parts array<array<struct<x double, y double>>>")
    here = shapes.one_line(frame)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    full = frame.withColumn("parts", F.filter("parts", lambda p: F.size(p) > 0))
    by_pointers = {r.comid: r.pts for r in shapes._by_pointers(full).collect()}
    assert {r.comid: r.pts for r in here.collect()} == by_pointers and len({len(p) for p in by_pointers.values()}) > 3
    monkeypatch.setattr(shapes, "FEW_PARTS", 3)
    assert {r.comid: r.pts for r in shapes.one_line(frame).collect()} == by_pointers
