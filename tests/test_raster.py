"""Province maps from bitmaps, against a plain decoder."""

import struct
from collections import Counter, defaultdict

import numpy as np
import pytest

from annalist.sources import raster as R
from annalist.sources import rules

COLOURS = {1: (255, 0, 0), 2: (0, 255, 0), 3: (10, 20, 30), 4: (200, 200, 1), 5: (0, 0, 0)}


def bitmap(cells):
    """A 24-bit bitmap of (height, width) provinces, lines padded to four bytes; 9 has a colour that none is told for."""
    h, w = cells.shape
    lines = b"".join(b"".join(bytes(reversed(COLOURS.get(int(p), (77, 77, 77)))) for p in row).ljust((w * 24 + 31) // 32 * 4, b"\0") for row in cells)
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines


def plain(cells, scale=1):
    h, w = (x // scale for x in cells.shape)
    return np.array([[p if p in COLOURS else 0 for p in cells[y * scale, : w * scale : scale]] for y in range(h)])


def drawn(rows, shape):
    out = np.full(shape, -1)
    for r in rows:
        assert (out[r.y, r.x : r.x + r.n] == -1).all()
        out[r.y, r.x : r.x + r.n] = r.pid
    return out


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("map")
    r = np.random.default_rng(3)
    cells = np.repeat(np.repeat(r.choice([1, 2, 3, 4, 5, 9], (9, 11)), 5, axis=0), 7, axis=1)[:43, :75]
    (root / "provinces.bmp").write_bytes(bitmap(cells))
    (root / "map").mkdir()
    lines = ["province;red;green;blue;name;x"] + [f"{p};{a};{b};{c};Land {p};x" for p, (a, b, c) in COLOURS.items()] + ["x;1;2;3", "7;1;2"]
    (root / "map/definition.csv").write_bytes("\r\n".join(lines).encode("latin-1"))
    colours = R.definitions(rules.read_layer(spark, str(root), 0)).persist()
    return root, cells, colours


def test_definitions(world):
    assert sorted((r.pid, r.colour, r.name) for r in world[2].collect()) == [(p, c + b * 256 + a * 65536, f"Land {p}") for p, (a, b, c) in COLOURS.items()]


@pytest.mark.parametrize(("scale", "lines"), [(1, 64), (1, 5), (2, 7), (3, 100)])
def test_runs(spark, world, scale, lines):
    root, cells, colours = world
    want = plain(cells, scale)
    rows = R.province_runs(spark, str(root / "provinces.bmp"), colours, scale, lines).collect()
    assert (drawn(rows, want.shape) == want).all()
    for y in range(len(want)):  # no run goes on in the next
        line = sorted((r.x, r.n, r.pid) for r in rows if r.y == y)
        assert all(a[2] != b[2] and a[0] + a[1] == b[0] for a, b in zip(line, line[1:], strict=False))


def test_broken_bitmaps(spark, world, tmp_path):
    root, cells, colours = world
    data = (root / "provinces.bmp").read_bytes()
    for name, d in {"cut": data[: len(data) // 2], "none": b"", "png": b"\x89PNG" + data[4:], "deep": data[:28] + b"\x20" + data[29:]}.items():
        (tmp_path / name).write_bytes(d)
    for name in ("none", "png", "deep", "absent"):
        assert R.province_runs(spark, str(tmp_path / name), colours).count() == 0
    cut = drawn(R.province_runs(spark, str(tmp_path / "cut"), colours).collect(), cells.shape)
    assert (cut[:20] == plain(cells)[:20]).all() and (cut[-5:] == 5).all()  # what is missing is black, province 5's colour


def test_geometry(spark, world):
    root, cells, colours = world
    runs = R.province_runs(spark, str(root / "provinces.bmp"), colours).persist()
    p = plain(cells)
    where = {k: np.argwhere(p == k) for k in COLOURS}
    got = {r.pid: r for r in R.geometry(runs).collect()}
    for k, at in where.items():
        g = got[k]
        assert (g.area, g.x0, g.x1, g.y0, g.y1) == (len(at), at[:, 1].min(), at[:, 1].max(), at[:, 0].min(), at[:, 0].max())
        assert abs(g.cx - at[:, 1].mean()) < 1e-9 and abs(g.cy - at[:, 0].mean()) < 1e-9
    touch = {tuple(sorted((int(a), int(b)))) for x, y in ((p[:, :-1], p[:, 1:]), (p[:-1], p[1:])) for a, b in zip(x.ravel(), y.ravel(), strict=True) if a != b and a and b}
    assert {(r.a, r.b) for r in R.adjacency(runs).collect()} == touch == {(r.a, r.b) for r in R.adjacency(runs, 3).collect()}
    near = {r.pid: (r.y, r.x) for r in R.anchors(runs).collect()}
    for k, at in where.items():
        far = [round((y - at[:, 0].mean()) ** 2 + (x - at[:, 1].mean()) ** 2, 6) for y, x in at]
        assert near[k] == tuple(at[min(range(len(at)), key=lambda i: (far[i], *at[i]))])
    half = drawn(R.halved(runs).collect(), ((43 + 1) // 2, (75 + 1) // 2))
    for y in range(half.shape[0]):
        for x in range(half.shape[1]):
            block = p[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].ravel().tolist()
            assert half[y, x] == max(dict.fromkeys(block), key=Counter(block).get)


def test_markers_and_stacks(spark, tmp_path):
    d = spark.createDataFrame
    anchors = d([(1, 5, 6), (2, 7, 8)], "pid long, x int, y int")
    (tmp_path / "map").mkdir()
    (tmp_path / "map/positions.txt").write_text("2 = { city = { x = 9 y = 9 } unit = { y = 12.000 x = 30.5 } }\n3 = { unit = { y = 1 } town = { x = 4 } }\nx = { unit = { x = 1 y = 1 } }")
    told = R.positions(rules.rule_tree(rules.read_layer(spark, str(tmp_path), 0)))
    assert sorted(map(tuple, told.collect())) == [(2, 30.5, 12.0), (3, 4.0, 0.0)]
    m = R.markers(anchors, told, 20, 2)
    assert sorted(map(tuple, m.collect())) == [(1, 5.0, 6.0), (2, 15.2, 14.0), (3, 2.0, 20.0)]
    units = d([("s", 1, "AAB", 3), ("s", 1, "CCD", 5), ("s", 1, "AAB", 1), ("s", 2, "CCD", 2), ("s", 99, "CCD", 2)], "save_id string, pid long, tag string, n long")
    got = defaultdict(list)
    for r in R.stacks(units, ["save_id"], m).collect():
        got[r.pid] = [r.total, r.contested, [tuple(x) for x in r.sides]]
    assert got == {1: [9, True, [("CCD", 5), ("AAB", 4)]], 2: [2, False, [("CCD", 2)]]}
