import random

from strandframe.operators import relations


def test_nearest_is_the_full_comparison(spark):
    """F8: spots and cells that lie dense, sparse, twice at one place, at equal distances and across the tiles' edges."""
    rng = random.Random(8)
    place = lambda: rng.choice(((rng.gauss(0, 0.01), rng.gauss(0, 0.01)), (rng.uniform(-1, 1), rng.uniform(-1, 1)), (rng.randrange(-20, 20) / 20, rng.randrange(-20, 20) / 20)))
    spots = [(i, *place()) for i in range(700)] + [(900, None, 0.0), (901, float("nan"), 0.0), (902, 50.0, 50.0)]
    cells = [(i, *place()) for i in range(300)]
    cells += [(i + 300, x, y) for i, x, y in cells[:50]] + [(-1, 0.0, None)]
    a, b = spark.createDataFrame(spots, "spot_id int, x double, y double"), spark.createDataFrame(cells, "cell_id int, x double, y double")
    tile = relations.TILE
    for radius, relations.TILE in ((0.05, tile), (0.05, 3), (0.3, 40), (2.5, tile)):
        want = {}
        for i, x, y in spots:
            d = [((x - u) * (x - u) + (y - v) * (y - v), c) for c, u, v in cells if None not in (x, y, u, v)]
            d = [e for e in d if e[0] <= radius * radius]
            if d:
                want[i] = (i, *min(d)[::-1])
        got = [tuple(r) for r in relations.nearest_cell(a, b, radius).collect()]
        assert len(got) == len(want) and {r[0]: r for r in got} == want
    relations.TILE = tile
    assert relations.nearest_cell(a, b.limit(0), 1.0).count() == 0
