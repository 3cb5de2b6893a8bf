"""Clusters, nearest neighbours and variant names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import clusters, names, neighbours
from sagebrook.llm.neighbours import hilbert
from sagebrook.llm.vectors import unit


def cloud(seed=0, groups=15, noise=0.02, singles=60):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = unit(rng.standard_normal((1, 64)))[0]
        for _ in range(rng.integers(1, 14)):
            rows.append(centre + noise * rng.standard_normal(64))
    rows += list(unit(rng.standard_normal((singles, 64))))
    rng.shuffle(rows)
    return np.array(rows, np.float32)


def table(spark, x, first=1):
    rows = [(first + n, [float(v) for v in row]) for n, row in enumerate(x)]
    bad = [(None, rows[0][1]), (90001, None), (90002, []), (90003, [1.0]), (90004, [0.0] * 64), (90005, [math.nan] * 64), (90006, [math.inf] * 64), (90007, [None] * 64)]
    return spark.createDataFrame(rows + rows[:3] + bad, "id long, embedding array<float>").withColumn("t", F.lit("clash")).withColumn("cell", F.lit(1))


def cosines(x):
    u = unit(x)
    return np.round(u @ u.T, 6)


def true_components(x, first=1, least=3):
    s = cosines(x) >= 0.9
    label = np.arange(len(x))
    while True:
        new = np.array([label[s[n]].min() for n in range(len(x))])
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(x))
    return {(n + first, label[n] + first) for n in range(len(x)) if size[label[n]] >= least}


@pytest.mark.parametrize(("noise", "block"), [(0.02, 16384), (0.035, 16384), (0.02, 8)])
def test_clusters_against_brute_force(spark, noise, block):
    x, y = cloud(1, noise=noise), cloud(2, noise=noise)
    labels, cells = clusters.similar_components({"a": table(spark, x), "b": table(spark, y, 5)}, block=block)
    got = {(r.tab, r.id, r.cluster_id) for r in clusters.cluster_members(labels).collect()}
    want = {("a", *p) for p in true_components(x)} | {("b", *p) for p in true_components(y, 5)}
    assert len(want) > 60 and len(got ^ want) <= 0.03 * len(want)
    told = clusters.describe_clusters(labels, cells).collect()
    sizes = {}
    for tab, _, c in got:
        sizes[tab, c] = sizes.get((tab, c), 0) + 1
    assert {(r.tab, r.cluster_id): r["size"] for r in told} == sizes
    assert all(1 <= len(r.typical) <= 5 and r.typical == sorted(r.typical) and r.densest <= r["size"] for r in told)


def test_pairs_at_the_threshold_are_exact(spark):
    """Pairs in doubt in half precision are decided in double precision."""
    base = np.zeros(64, np.float32)
    base[0] = 1
    rows = [base]
    for n, c in enumerate((0.8999, 0.8999994, 0.8999996, 0.9, 0.9004)):
        v = np.zeros(64)
        v[0], v[n + 1] = c, math.sqrt(1 - c * c)
        rows.append(v.astype(np.float32))
    x = np.array(rows)
    labels, _ = clusters.similar_components({"a": table(spark, x)})
    assert {(r.id, r.cluster_id) for r in clusters.cluster_members(labels, 1).collect()} <= true_components(x, least=2) | {(1, 1)}


def test_clusters_of_copies_and_nothing(spark):
    x = np.repeat(cloud(3, 1, singles=0)[:1], 50, axis=0)
    labels, _ = clusters.similar_components({"a": table(spark, x)}, block=10)
    assert {r.cluster_id for r in labels.collect()} == {1} and labels.count() == 50
    empty = table(spark, x).where("false")
    labels, cells = clusters.similar_components({"a": empty})
    assert labels.count() == 0 and clusters.describe_clusters(labels, cells).count() == 0


def test_grid_shape_follows_the_rows():
    shapes = [clusters.grid_shape(n, 0.9) for n in (0, 10, 10**4, 10**6, 10**9)]
    assert shapes == sorted(shapes) and all(d >= 3 and g >= 3 for d, g in shapes)


class Counted(np.ndarray):
    """Counts the similarities that are computed."""

    __array_priority__ = 1
    pairs = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        plain = lambda xs: [x.view(np.ndarray) if isinstance(x, Counted) else x for x in xs]
        if "out" in kwargs:
            kwargs["out"] = tuple(plain(kwargs["out"]))
        out = getattr(ufunc, method)(*plain(inputs), **kwargs)
        if ufunc is np.matmul and inputs[0].shape[-1] == 64:
            Counted.pairs += out.size
        return out.view(Counted) if ufunc is np.matmul else out


@pytest.mark.parametrize("inside", [True, False])
def test_rows_of_a_large_cell_meet_few_others(inside):
    """Pairs just above the threshold are found among 40,000 rows without comparing each with each."""
    rng = np.random.default_rng(11)
    n, planted = 40_000, 2_000
    x = unit(rng.standard_normal((n, 64)))
    side = rng.standard_normal((planted, 64))
    side = unit(side - (side * x[:planted]).sum(axis=1, keepdims=True) * x[:planted])
    x[-planted:] = 0.905 * x[:planted] + math.sqrt(1 - 0.905**2) * side
    x, ids = x.astype(np.float32), np.arange(n)
    Counted.pairs = 0
    a, b, sure = clusters._hang(ids[: n // 2], x[: n // 2].view(Counted), ids[n // 2 :], x[n // 2 :].view(Counted), 0.9, inside)
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    assert sure.all() and len(found & {(k, n - planted + k) for k in range(planted)}) >= 0.98 * planted
    assert 0 < Counted.pairs < 0.2 * n * n // 2


def test_rows_of_a_cell_and_grids_hold_for_large_tables():
    """A cell has about as many rows, and a row goes to hardly more grids, however large the table is."""
    for n in (10**6, 10**7, 10**8):
        dims, grids = clusters.grid_shape(n, 0.9)
        assert n * clusters.TOGETHER**dims <= 1.5 * clusters.CELL_ROWS and grids <= dims + 1


def test_large_groups_and_crowds_within_finer_grids():
    """Chains through a block that is larger than a plain one, with a crowd of a third of it and groups of all sizes."""
    rng = np.random.default_rng(12)
    centres = unit(rng.standard_normal((400, 64)))
    size = rng.integers(1, 12, 400)
    x = np.concatenate([np.repeat(centres, size, axis=0), np.repeat(centres[:1], 1500, axis=0)])
    x = unit(x + 0.03 * rng.standard_normal(x.shape)).astype(np.float32)
    x = x[rng.permutation(len(x))]
    assert len(x) > clusters.PLAIN_ROWS
    a, b, sure = clusters._hang(np.arange(len(x)) + 1, x, np.arange(0), x[:0], 0.9, True)
    label = np.arange(len(x))
    label[a[sure] - 1] = b[sure] - 1
    near = cosines(x)[a[~sure] - 1, b[~sure] - 1] >= 0.9
    low = clusters._merge(label, label[a[~sure][near] - 1], label[b[~sure][near] - 1])
    got = {(n + 1, int(c) + 1) for n, c in enumerate(low) if (low == c).sum() >= 3}
    want = true_components(x)
    assert len(want) > 2000 and len(got ^ want) <= 0.01 * len(want)


def test_hilbert_is_a_curve():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(hilbert(grid, 3))
    assert sorted(hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def true_neighbours(x, k, floor, first=1):
    s = cosines(x)
    out = {}
    for n in range(len(x)):
        order = sorted((m for m in range(len(x)) if m != n and s[n, m] >= floor), key=lambda m: (-s[n, m], m))
        out[n + first] = [m + first for m in order[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    x = cloud(4, 25)
    want = true_neighbours(x, 5, 0.9)
    found = neighbours.nearest({"a": table(spark, x)}, 5, 0.9).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.neighbour)
    pairs = {(i, j) for i, js in want.items() for j in js}
    mine = {(i, j) for i, js in got.items() for j in js}
    assert len(pairs) > 100 and len(pairs & mine) >= 0.99 * len(pairs)
    assert all(r.similarity >= 0.9 for r in found)


def test_neighbours_recall_without_floor(spark):
    x = cloud(5, 30, noise=0.06, singles=300)
    want = {(i, j) for i, js in true_neighbours(x, 5, -1.0).items() for j in js}
    mine = {(r.id, r.neighbour) for r in neighbours.nearest({"a": table(spark, x)}, 5).collect()}
    assert len(want & mine) >= 0.9 * len(want)


def test_recall_beyond_one_window():
    """Several orderings with windows far below the number of rows."""
    x = cloud(6, 400, singles=3000)
    s = cosines(x)
    u, hits = unit(x), set()
    keys = neighbours.curve_keys(u)
    for g in range(keys.shape[1]):
        order = np.argsort(keys[:, g], kind="stable")
        i, j, _ = neighbours.window_neighbours(order, u[order], 5, 0.9, reach=128)
        hits |= set(zip(order[i].tolist(), order[j].tolist()))
    want = {(n, m) for n in range(len(x)) for m in sorted((m for m in np.nonzero(s[n] >= 0.9)[0] if m != n), key=lambda m: (-s[n, m], m))[:5]}
    assert len(want & hits) >= 0.9 * len(want)


def test_neighbours_of_copies(spark):
    """A third of all rows are copies of one vector: ties go to the smallest ids, nothing is lost."""
    x = np.vstack([np.repeat(cloud(7, 1, singles=0)[:1], 40, axis=0), cloud(8, 8, singles=20)])
    want = true_neighbours(x, 5, 0.9)
    got = {}
    for r in neighbours.nearest({"a": table(spark, x)}, 5, 0.9).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert all(got.get(n, []) == want[n] for n in range(1, 41))
    pairs = neighbours.neighbour_pairs(neighbours.nearest({"a": table(spark, x)}, 5, 0.9))
    assert pairs.where("id_a >= id_b").count() == 0
    assert neighbours.nearest({"a": table(spark, x).where("false")}).count() == 0


def test_neighbours_of_one_direction(spark):
    """More ties at 6 decimals than a few: one direction at many lengths, the smaller ids win."""
    x = np.vstack([np.linspace(0.3, 3, 60)[:, None] * cloud(9, 1, singles=0)[:1], cloud(10, 8, singles=20)])
    want = true_neighbours(x, 5, 0.9)
    got = {}
    for r in neighbours.nearest({"a": table(spark, x)}, 5, 0.9).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert all(got[n] == want[n] for n in range(1, 61))


def test_neighbours_in_a_crowd(spark):
    """A third of all rows are a crowd of similar, unequal rows, many times as many as a window holds."""
    rng = np.random.default_rng(12)
    crowd = unit(rng.standard_normal((1, 64))) + rng.standard_normal((8000, 64)) * 0.03
    x = np.vstack([rng.standard_normal((16000, 64)), crowd]).astype(np.float32)
    u = unit(x)
    want = {}
    for n in range(16000, 24000, 40):
        s = np.round(u @ u[n], 6)
        s[n] = -2
        want[n + 1] = [int(m) + 1 for m in np.lexsort((np.arange(len(s)), -s))[:5] if s[m] >= 0.9]
    got = {}
    for r in neighbours.nearest({"a": table(spark, x)}, 5, 0.9).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    pairs = {(n, m) for n, ms in want.items() for m in ms}
    assert len(pairs) == 1000 and len(pairs & {(n, m) for n in want for m in got.get(n, [])}) >= 0.999 * len(pairs)


# --- names ---

FORMS = [("Robert", "Bob"), ("Elizabeth", "Liz"), ("Alexander", "Alex")]
SAME = [
    ["Robert Flendorvik", "Bob Flendorvik", "Flendorvik, Robert", "R. Flendorvik", "ROBERT FLENDORVIK", "Dr. Robert Flendorvlk", "@robert_flendorvik", "Robert T. Flendorvik, PhD", "flendorvikrobert"],
    ["Emil Flendorvik", "Emil  Flendorvik"],
    ["Elizabeth Grösslanter", "Liz Groesslanter", "E. Grösslanter", "Eli. Grösslanter", "Grosslanter Elizabeth"],
    ["Alexander van Trimolask", "Alex van Trimolask", "Trimolask, A."],
]
ORGS = [["Brinkoval Foods LLC", "Brinkoval Foods", "The Brinkoval Foods LLC", "BRINKOVAL FOODS, LLC", "Brinkovla Foods LLC", "BrinkovalFoods"], ["Brinkoval Optics LLC", "Brinkoval Opt."], ["University of Tromplagen", "Tromplagen Univ."], ["Dalkrimo Software & Energy AG", "Dalkrimo SW and Energy"]]


#: Organisations of whose names the lines of business are learned.
OTHERS = [f"{lead} {line}" for line in ("Foods", "Optics", "Software", "Energy", "University", "Freight") for lead in ("Wendrash", "Kilpomar", "Stubrenga", "Oxfalind")]


def entities(spark, extra=()):
    rows, want, kind = [], set(), ["person", "PER", "People"]
    for groups, kinds in ((SAME, kind), (ORGS, ["org", "Company", "organisation"])):
        for group in groups:
            ids = []
            for n, name in enumerate(group):
                ids.append(len(rows) + 1)
                rows.append((len(rows) + 1, kinds[n % 3], name))
            want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(900, "location", "Robert Flendorvik"), (901, None, "Bob Flendorvik"), (902, "person", None), (903, "person", "  "), (904, "nil", "x"), (None, "person", "Bob Flendorvik"), *((2000 + n, "org", name) for n, name in enumerate(OTHERS)), *extra]
    return spark.createDataFrame(rows + rows[:2], "id long, type string, name string").withColumn("form", F.lit("clash")).withColumn("kind", F.lit(1)), want


def test_names(spark):
    df, want = entities(spark)
    forms = spark.createDataFrame(FORMS, "given string, short_form string")
    got = {tuple(r) for r in names.name_pairs(df, forms).collect()}
    assert got == want, (sorted(want - got), sorted(got - want))
    groups = names.name_groups(df, forms).collect()
    assert len(groups) == sum(map(len, SAME + ORGS)) + len(OTHERS) and all(r.group_id <= r.id for r in groups)


def test_vague_initials_and_nothing(spark):
    df, want = entities(spark, [(950, "person", "Ernst Grösslanter")])
    forms = spark.createDataFrame(FORMS, "given string, short_form string")
    got = {tuple(r) for r in names.name_pairs(df, forms).collect()}
    assert not any(950 in p for p in got)
    assert names.name_pairs(df.where("false"), forms).count() == 0
    assert names.name_pairs(df, forms.where("false")).count() > 0


def test_common_suffix_is_refined_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 2)
    df, want = entities(spark)
    assert {tuple(r) for r in names.name_pairs(df, spark.createDataFrame(FORMS, "given string, short_form string")).collect()} >= {(1, 3), (1, 5)}


def test_a_slip_anywhere_meets_however_common_the_ending(spark):
    """Slips in the first two letters under an ending of many anchors, and in the middle of short anchors."""
    rng = np.random.default_rng(3)
    many = ["".join(rng.choice(list("bdfgklmnprstv"), 6)) + "trostrau" for _ in range(70)]
    pairs = [("Baulgriltrostrau Optics", "Bulgriltrostrau Optics"), ("Gilnmirtrostrau Foods", "Glinmirtrostrau Foods"), ("Schmidt Energy", "Schnidt Energy"), ("Gonugeji Foods", "Gonvugeji Foods")]
    rows = [(n + 1, "org", name) for n, name in enumerate([x for p in pairs for x in p] + [f"{m.title()} Freight" for m in many])]
    df = spark.createDataFrame(rows, "id long, type string, name string")
    got = {tuple(r) for r in names.name_pairs(df, spark.createDataFrame(FORMS, "given string, short_form string")).collect()}
    assert got >= {(1, 2), (3, 4), (5, 6), (7, 8)}


def test_one_slip_shares_a_key_however_common_the_suffixes(spark, monkeypatch):
    """A letter more, less, other or swapped, anywhere; with suffixes of few anchors as keys, and with all refined."""
    rng = np.random.default_rng(1)
    pairs = set()
    for _ in range(600):
        a = "".join(rng.choice(list("abrnm"), rng.integers(5, 19)))
        at = int(rng.integers(0, len(a)))
        for b in (a[:at] + a[at + 1 :], a[:at] + "t" + a[at:], a[:at] + "t" + a[at + 1 :], a[:at] + a[at : at + 2][::-1] + a[at + 2 :]):
            pairs.add((a, b))
    anchors = spark.createDataFrame([("p", x) for x in sorted({x for p in pairs for x in p})], "kind string, a string")
    for common in (60, 3, 0):
        monkeypatch.setattr(names, "COMMON", common)
        keys = {}
        for r in names.blocking_keys(anchors).collect():
            keys.setdefault(r.a, set()).add(r.key)
            assert common or not r.bare
        for a, b in pairs:
            assert names.same_anchor(a, b) and keys[a] & keys[b], (common, a, b)


def test_two_slips_in_long_anchors_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 0)
    rng = np.random.default_rng(2)
    pairs = set()
    for _ in range(200):
        a = "".join(rng.choice(list("abrnmot"), rng.integers(16, 22)))
        x, y = sorted(rng.choice(len(a), 2, replace=False))
        pairs.add((a, a[:x] + "w" + a[x + 1 : y] + "w" + a[y + 1 :]))
    anchors = spark.createDataFrame([("p", x) for x in sorted({x for p in pairs for x in p})], "kind string, a string")
    keys = {}
    for r in names.blocking_keys(anchors).collect():
        keys.setdefault(r.a, set()).add(r.key)
    assert all(names.same_anchor(a, b) and keys[a] & keys[b] for a, b in pairs)


def test_lines_are_learned():
    lines = names.Lines({"foods": 9, "fds": 2, "food": 3, "llc": 20, "institute": 5, "insurance": 8, "ins": 4, "inst": 3, "brand": 2}, 5)
    assert set(lines.weight) == {"foods", "institute", "insurance"} and lines.short == {"fds": "foods", "food": "foods", "ins": "insurance", "inst": "institute"}
    assert lines.known("llc") == "" and lines.known("brand") is None and lines.known("insurence") == "insurance" and lines.known("insu") == "insurance"
    assert not names.abbreviates("foods", "foods") and names.abbreviates("mfg", "manufacturing") and not names.abbreviates("optc", "topics")
    assert names.Lines({}, 3).known("foods") is None


def test_subsequence():
    def slow(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        assert names.common_subsequence(a, b) == slow(a, b)
    assert names.same_anchor("flendorvik", "flendorvlk") and not names.same_anchor("flendorvik", "glendorvak")


def test_registered_queries_are_separable():
    from sagebrook.llm import queries

    assert all(name[0] == "p" for name in queries.QUERIES) and set(queries.ORACLE) <= set(queries.QUERIES)
