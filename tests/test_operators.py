"""Closed forms, brute force and recovery for operators that SQL does not express, and odd inputs."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueloom.functions import numeric as N
from tissueloom.functions import stats as S
from tissueloom.operators import align, cells, generative, gp, imaging, mapper, matrix, neighbors, spatial, topics
from tissueloom.sources import readers, writers

RNG = np.random.default_rng(0)


def test_tails():
    assert math.isclose(S.chi2_sf(3.841459, 1), 0.05, abs_tol=1e-6) and math.isclose(S.chi2_sf(5.991465, 2), 0.05, abs_tol=1e-6)
    assert math.isclose(S.student_p(0.2460, 64), 0.05, abs_tol=2e-4) and S.student_p(1.0, 10) == 0
    assert math.isclose(S.hypergeometric_tail(2, 5, 4, 20), 1 - sum(math.comb(4, k) * math.comb(16, 5 - k) for k in (0, 1)) / math.comb(20, 5))
    assert S.hypergeometric_tail(0, 5, 4, 20) == 1 and S.hypergeometric_tail(6, 5, 4, 20) == 0


def test_assignment_is_optimal():
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        c = RNG.random((n, m))
        got = sum(c[i, j] for i, j in N.assignment(c))
        k = min(n, m)
        best = min(sum(c[i, j] if n <= m else c[j, i] for i, j in enumerate(p)) for p in permutations(range(max(n, m)), k))
        assert math.isclose(got, best)
    assert N.assignment(np.zeros((0, 3))) == []


def test_small_solvers():
    for _ in range(20):
        a, b = RNG.random((6, 4)), RNG.normal(size=6)
        x = N.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g >= -1e-8).all() and abs(g @ x) < 1e-8  # the conditions of a minimum
    assert math.isclose(N.minimize_scalar(lambda t: (t - 1.3) ** 2, -4, 9)[0], 1.3, abs_tol=1e-4)
    x, f = N.minimize_box(lambda v: (v[0] - 1) ** 2 + 10 * (v[1] - v[0] ** 2) ** 2, np.array([-1.0, 0.5]), np.array([-2.0, -2]), np.array([2.0, 0.6]))
    assert x[1] <= 0.6 and f < 0.08
    assert N.coordinate_descent(lambda v: ((v - [1, 2]) ** 2).sum(), np.zeros(2), np.full(2, -5.0), np.full(2, 5.0))[1] < 1e-6
    assert N.otsu(np.r_[np.full(10, 9.0), np.zeros(20), np.full(10, 9.0)]) in range(9, 30)
    mask = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [0, 1, 0, 0]], bool)
    assert N.connected_regions(mask).tolist() == [[1, 0, 2, 2], [1, 0, 0, 2], [0, 3, 0, 0]]
    assert len(N.convex_hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]]))) == 4


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(i, float(i % 8), float(i // 8)) for i in range(50)], "spot_id long, x double, y double")


@pytest.fixture(scope="module")
def planted(spark):
    """Ten spatial genes, thirty of noise."""
    rows = []
    for g in range(40):
        for i in range(50):
            x, y = i % 8, i // 8
            v = (x / 7, math.hypot(x - 3.5, y - 3) / 4.6, 0.5 + 0.5 * math.sin(0.8 * x) * math.cos(0.8 * y))[g % 3] + RNG.random() * 0.3 if g < 10 else RNG.random()
            rows.append((f"g{g:02d}", i, float(v)))
    return spark.createDataFrame(rows, "gene_id string, spot_id long, value double")


def test_spatial_genes_rank_planted_first(spark, grid, planted):
    got = gp.spatial_genes(planted, grid, n_lengths=6).orderBy("p", "gene_id").collect()
    assert sum(r["gene_id"] < "g10" for r in got[:10]) >= 9
    assert all(0 <= r["q"] <= 1 and r["q"] >= r["p"] - 1e-12 and 0 <= r["fsv"] <= 1 for r in got)
    flat = spark.createDataFrame([("c", i, 3.0) for i in range(50)], planted.schema)
    assert gp.spatial_genes(flat, grid, n_lengths=3).first()["p"] == 1.0
    auto = spatial.autocorrelation(planted, spatial.distance_weights(grid, 1.5)).orderBy(F.desc("moran")).collect()
    assert sum(r["gene_id"] < "g10" for r in auto[:10]) >= 9


def test_constant_gene_and_weights(spark, grid):
    flat = spark.createDataFrame([("c", i, 3.0) for i in range(50)], "gene_id string, spot_id long, value double")
    r = spatial.autocorrelation(flat, spatial.knn_weights(grid, 4)).first()
    assert (r["moran"], r["geary"]) == (0, 1) and r["moran_p"] > 0.999999 and r["geary_p"] > 0.999999
    assert math.isclose(spatial.weight_sums(spatial.knn_weights(grid, 4)).first()["s0"], 50)


def test_kriging_without_nugget_is_exact(spark, grid, planted):
    one = planted.where("gene_id = 'g00'")
    fits = spark.createDataFrame([("g00", 0.0, 1.0, 5.0)], "gene_id string, nugget double, sill double, reach double")
    got = spatial.krige(one, grid, grid.select(F.col("spot_id").alias("target_id"), "x", "y"), fits).join(one.select(F.col("spot_id").alias("target_id"), F.col("value").alias("true")), "target_id").collect()
    assert max(abs(r["value"] - r["true"]) for r in got) < 1e-6 and max(r["variance"] for r in got) < 1e-6


def test_variogram_models(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "h double")
    for kind in ("spherical", "exponential", "gaussian"):
        v = [r[0] for r in df.select(spatial.variogram_model(kind, F.col("h"), F.lit(0.1), F.lit(1.0), F.lit(2.0))).collect()]
        assert math.isclose(v[0], 0.1) and v[0] < v[1] < v[2] <= 1 and v[2] > 0.94


def test_clusters_recover_groups(spark, grid):
    rows = [(f"g{g}", i, float((i % 8 < 4) * 5 * (g % 2) + RNG.random() * 0.1)) for g in range(6) for i in range(50)]
    m = spark.createDataFrame(rows, "gene_id string, spot_id long, value double")
    for method in ("ward", "medoids"):
        got = {r["spot_id"]: r["cluster"] for r in spatial.st_clusters(m, grid, 2, method=method).collect()}
        left, right = {got[i] for i in range(50) if i % 8 < 4}, {got[i] for i in range(50) if i % 8 >= 4}
        assert len(left) == len(right) == 1 and left != right
    with pytest.raises(ValueError):
        spatial.st_clusters(m, grid, 2, max_spots=10)


def test_louvain_and_propagation(spark):
    edges = [(a, b, 1.0) for c in (0, 10, 20) for a in range(c, c + 6) for b in range(a + 1, c + 6)] + [(5, 10, 1.0), (15, 20, 1.0)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    for found in (neighbors.louvain(e), neighbors.label_propagation(e)):
        groups = {}
        for r in found.collect():
            groups.setdefault(r["community"], set()).add(r["id"] // 10)
        assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
        assert neighbors.modularity(e, found).first()["modularity"] > 0.5
    with pytest.raises(ValueError):
        neighbors.louvain(e, max_edges=3)
    assert neighbors.louvain(e.where("false")).count() == 0 and neighbors.components(e.where("false")).count() == 0


def test_knn_blocks_agree(spark, monkeypatch):
    v = spark.createDataFrame([(i, RNG.normal(size=5).tolist()) for i in range(60)], "id long, vec array<double>")
    whole = sorted(map(tuple, neighbors.knn(v, k=4).collect()))
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 600)
    assert [x[:3] for x in sorted(map(tuple, neighbors.knn(v, k=4).collect()))] == [x[:3] for x in whole]
    assert neighbors.knn(v, v.where("false"), k=3).count() == 0
    with pytest.raises(ValueError):
        neighbors.phenograph(v, k=60)


def test_greedy_matches_equal_a_scan(spark):
    rows = [(int(a), int(b), 1.0, 0.5, float(s)) for a in range(25) for b, s in zip(RNG.choice(25, 6, replace=False), RNG.choice([0.31, 0.5, 0.7, 0.2, 0.9], 6), strict=True)]
    c = spark.createDataFrame(rows, "id_a long, id_b long, distance double, morphology double, score double")
    used_a, used_b, want = set(), set(), set()
    for a, b, _, _, s in sorted(rows, key=lambda r: (-r[4], r[0], r[1])):
        if s > 0.3 and a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    assert {(r["id_a"], r["id_b"]) for r in cells.greedy_matches(c, stage=lambda d: d.cache()).collect()} == want


def test_transforms_are_recovered(spark):
    pts = RNG.uniform(0, 50, (60, 2))
    t, s, move = 0.8, 1.4, np.array([3.0, -7.0])
    r = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
    out = s * pts @ r.T + move
    rows = [(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(pts, out, strict=True))]
    pairs = spark.createDataFrame(rows, "id long, xa double, ya double, xb double, yb double")
    got = align.procrustes(pairs).first()
    assert np.allclose([got["theta"], got["scale"], got["tx"], got["ty"], got["ss"]], [t, s, *move, 0], atol=1e-6)
    assert math.isclose(align.rotation_angle(pairs).first()["angle"], t, abs_tol=1e-6)
    wrong = [(100 + i, *map(float, RNG.uniform(0, 50, 4))) for i in range(40)]
    hit = align.ransac(spark.createDataFrame(rows + wrong, pairs.schema), 200, 0.01).first()
    assert np.allclose([hit["theta"], hit["scale"]], [t, s], atol=1e-6) and hit["inliers"] >= 60
    again = cells.transform_points(cells.transform_points(pairs.select("id", F.col("xa").alias("px"), F.col("ya").alias("py")), t, (0, 0), (1, 1)), -t, (0, 0), (1, 1)).join(pairs, "id").collect()
    assert all(math.isclose(x["px"], x["xa"], abs_tol=1e-9) for x in again)


def test_slides_align(spark):
    pts = RNG.uniform(0, 100, (1500, 2))
    level = np.exp(-((pts - [30, 40]) ** 2).sum(1) / 300) + 0.6 * np.exp(-((pts - [70, 65]) ** 2).sum(1) / 150) + 0.8 * (np.abs(pts[:, 0] - 60) < 6)
    t, move = 0.3, np.array([4.0, -3.0])
    r = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
    other = (pts - 50) @ r.T + 50 + move
    frame = lambda p: spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(p, level, strict=True)], "px double, py double, intensity double")
    found, corr = align.register_slides(frame(pts), frame(other), cells=20, rounds=30)
    assert corr > 0.85 and abs((found["theta"] + t + math.pi) % (2 * math.pi) - math.pi) < 0.15


def test_optimal_matches(spark):
    a = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id long, px double, py double")
    b = spark.createDataFrame([(9 - i, float(i) + 0.1, 0.0) for i in range(5)], a.schema)
    assert sorted((r["id_a"], r["id_b"]) for r in align.optimal_matches(a, b).collect()) == [(i, 9 - i) for i in range(5)]
    assert align.optimal_matches(a, b.where("false")).count() == 0


def test_lda_and_nmf_recover_mixtures(spark):
    rows = [(i, f"t{j}", 12) for i in range(40) for j in (range(5) if i < 20 else range(5, 10))]
    docs = spark.createDataFrame(rows, "pixel long, term string, n int")
    _, theta, beta = topics.fit_lda(docs, 2, alpha=1.1, rounds=40)
    main = {r["pixel"]: r["topic"] for r in topics.main_topic(theta).collect()}
    assert len({main[i] for i in range(20)}) == len({main[i] for i in range(20, 40)}) == 1 and main[0] != main[39]
    assert all(math.isclose(r[0], 1, abs_tol=1e-9) for r in beta.groupBy("topic").agg(F.sum("p")).select("sum(p)").collect())
    m = docs.select(F.col("pixel").alias("spot_id"), F.col("term").alias("gene_id"), F.col("n").cast("double").alias("value"))
    w, h = topics.nmf(m, 2, rounds=15)
    hm = np.zeros((2, 10))
    for r in h.collect():
        hm[r["component"] - 1, int(r["gene_id"][1:])] = r["h"]
    wm = np.stack([r["w"] for r in w.orderBy("spot_id").collect()])
    v = np.zeros((40, 10))
    for i, t, n in rows:
        v[i, int(t[1:])] = n
    assert np.abs(wm @ hm - v).max() < 0.5


def test_pattern_clusters(spark, grid):
    rows = [(f"g{g:02d}", i, float(((i % 8) if g < 10 else (i // 8)) + RNG.random() * 0.2)) for g in range(20) for i in range(50)]
    got = {r["gene_id"]: r["pattern"] for r in gp.pattern_clusters(spark.createDataFrame(rows, "gene_id string, spot_id long, value double"), grid, 2, 1.5)[0].collect()}
    assert len({got[f"g{k:02d}"] for k in range(10)}) == len({got[f"g{k:02d}"] for k in range(10, 20)}) == 1 and got["g00"] != got["g19"]


def test_generative_models_learn(spark, tmp_path):
    t = np.repeat(np.linspace(0, 1, 6), 60)
    x = np.c_[np.sin(2 * t), np.cos(2 * t), t] + RNG.normal(0, 0.05, (360, 3))
    df = spark.createDataFrame([(i, list(map(float, v)), float(s)) for i, (v, s) in enumerate(zip(x, t, strict=True))], "id long, vec array<double>, t double")
    model, losses = generative.train_cvae(df, 2, epochs=25)
    assert losses[-1] < losses[0] / 2
    assert min(r["r2"] for r in generative.evaluate(generative.reconstruct(df, model)).collect()) > 0.7
    mid = generative.interpolate(df, model, 0.1)
    assert {round(r["t"], 1) for r in mid.select("t").distinct().collect()} == {0.1, 0.3, 0.5, 0.7, 0.9}
    got = np.mean([r["vec"] for r in mid.where("t > 0.45 and t < 0.55").collect()], axis=0)
    assert np.abs(got - [math.sin(1), math.cos(1), 0.5]).max() < 0.3
    assert generative.interpolate(df, model, 0.1, "latent").count() > 0
    writers.save_model(model, str(tmp_path / "m.npz"))
    again = generative.Cvae(3, 2, hidden=(64, 32)).load(np.load(tmp_path / "m.npz"))
    assert np.allclose(again.encode(x, t)[0], model.encode(x, t)[0])
    diff, loss = generative.train_diffusion(df, steps=30, epochs=40)
    assert loss[-1] < loss[0]
    means = {r["id"]: r["mean"] for r in generative.predict_states(spark.createDataFrame([(0, 0.0), (1, 1.0)], "id long, t double"), diff, 64).collect()}
    assert means[1][2] > means[0][2]
    s = generative.noise_schedule(50, "cosine")
    assert (s["beta"] <= 0.999).all() and (s["alpha_bar"].diff().dropna() < 0).all()


def test_cvae_gradient():
    net = generative.Dense(np.random.default_rng(1), 4, 3)
    x, w = RNG.normal(size=(5, 4)), RNG.normal(size=(5, 3))
    net.forward(x)
    d = net.backward(w)
    for i, j in ((0, 0), (2, 3)):
        up, down = x.copy(), x.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        assert math.isclose(((net.forward(up) - net.forward(down)) * w).sum() / 2e-6, d[i, j], abs_tol=1e-5)


def test_imaging(spark, tmp_path):
    img = np.full((6, 8), 200.0)
    img[1:3, 1:4], img[4, 5:7] = 20, 30
    tiles = spark.createDataFrame([("a", 0, 16, 8, img.ravel().tolist()), ("blank", 0, 0, 8, [5.0] * 48)], "tile_id string, left int, top int, w int, pixels array<double>")
    kept = imaging.drop_blank(tiles)
    assert kept.count() == 1
    found = imaging.scan_cells(kept, imaging.otsu_threshold(kept)).orderBy("label").collect()
    assert [(r["points"], r["x"], r["physical_y"]) for r in found] == [(6, 2.0, 17.5), (2, 5.5, 20.0)]
    px = spark.createDataFrame([("t", 0, 0, 255, 255, 0), ("t", 1, 0, 0, 0, 255)], "tile_id string, x int, y int, r int, g int, b int")
    got = imaging.unmix(px, imaging.IHC1).orderBy("x").collect()
    assert got[0]["CD8"] + got[0]["CD11c"] + got[0]["PanCK"] > 0.9 and math.isclose(got[1]["CD11b"], 1, abs_tol=1e-6)
    done = writers.write_tiles(imaging.unmixed_tiles(px.withColumn("tile_id", F.lit("3_4")), imaging.IHC1), str(tmp_path)).collect()
    assert len(done) == 5
    back = readers.decode_bitmaps(readers.read_tiles(spark, f"file://{tmp_path}/CD11b", "bmp")).first()
    assert (back["col"], back["row"], back["w"], back["h"], back["pixels"][1] & 255) == (3, 4, 2, 1, 255)


def test_mapper_finds_a_circle(spark):
    a = np.linspace(0, 2 * math.pi, 200, endpoint=False)
    v = spark.createDataFrame([(i, [math.cos(x), math.sin(x) * 0.8]) for i, x in enumerate(a)], "id long, vec array<double>")
    nodes, edges = mapper.mapper(v, 6, 0.6, k_max=2)
    n, e = nodes.select("node").distinct().count(), edges.count()
    assert n >= 8 and e >= 8


def test_matrix_edges(spark):
    empty = spark.createDataFrame([], "gene_id string, spot_id long, value double")
    one = spark.createDataFrame([("g", 1, 0.0)], empty.schema)
    for f in (matrix.log2_cpm, matrix.log10_cpm, matrix.log1p_scaled, matrix.standardize, matrix.scale_range, matrix.unify, matrix.winsorize, matrix.library_share, matrix.gene_filter, matrix.clean_counts, matrix.densify):
        assert f(empty).count() == 0
        assert all(math.isfinite(r["value"]) for r in f(one).collect())
    assert matrix.log1p_scaled(one, empty="zero").first()["value"] == 0
    assert spatial.gene_cross_moran(one).first()["moran"] == 0


def test_partitions_do_not_matter(spark, planted, grid):
    for f in (lambda m: matrix.log2_cpm(m), lambda m: matrix.bootstrap_means(m, 4), lambda m: spatial.autocorrelation(m, spatial.distance_weights(grid, 1.5))):
        rows = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(planted.repartition(n)).collect()) for n in (1, 7)]
        assert rows[0] == rows[1]


def test_writers_check_their_input(spark, grid, planted, tmp_path):
    with pytest.raises(ValueError):
        writers.write_raid(planted, grid.where("spot_id < 10"), f"file://{tmp_path}/r")
    with pytest.raises(ValueError):
        readers.as_matrix(np.zeros((2, 2, 2)))
    assert readers.as_matrix([1, 2]).shape == (2, 1) and readers.as_vector([[1, 2], [3, 4]]).tolist() == [1, 2, 3, 4]
    assert readers.reshape_embedding([1, 2, 3, 4], None).tolist() == [[1, 3], [2, 4]]


def test_cell_search_is_exact_and_probes_recall(spark):
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(size=(20, 8))[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)) * 0.2, np.zeros((3, 8)), np.ones((60, 8))]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vec array<double>").repartition(4)
    for metric in ("euclidean", "cosine"):
        want = {(r["id"], r["rank"]): (r["neighbour"], round(r["score"], 6)) for r in neighbors.knn(v, k=6, metric=metric).collect()}
        got = {(r["id"], r["rank"]): (r["neighbour"], round(r["score"], 6)) for r in neighbors.knn_cells(v, k=6, metric=metric, cells=25).collect()}
        assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()}
        some = neighbors.knn_cells(v, k=6, metric=metric, cells=25, probes=4).collect()
        near = {(i, n) for (i, _), (n, _) in want.items() if i < 900}
        assert len(near & {(r["id"], r["neighbour"]) for r in some}) >= 0.9 * len(near)


def test_contracted_louvain_finds_planted_groups(spark):
    rng = np.random.default_rng(5)
    edges = {}
    for a in range(200):
        for b in rng.integers(0, 200, 12).tolist():
            if a != b and (a // 25 == b // 25 or rng.random() < 0.05):
                edges[min(a, b), max(a, b)] = 1.0
    for a in range(200):  # a ring inside each group
        b = a + 1 if a % 25 < 24 else a - 24
        edges[min(a, b), max(a, b)] = 1.0
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double").repartition(3)
    here, there = neighbors.louvain(e), neighbors.louvain(e, max_edges=len(edges) - 1)
    score = lambda c: neighbors.modularity(e, c).first()["modularity"]
    assert there.count() == 200 and there.select("id").distinct().count() == 200
    assert score(there) > score(here) - 0.05 and score(there) > 0.6


def test_colors(spark):
    from tissueloom.functions import colors

    assert colors.hue_palette(3) == ["#F8766D", "#00BA38", "#619CFF"] and colors.rainbow(3) == ["#FF0000", "#00FF00", "#0000FF"]
    one = spark.createDataFrame([("#336699",)], "c string")
    assert one.select(colors.lighten(F.col("c")), colors.darken(F.col("c"), 2), colors.transparent(F.col("c"), 50)).first()[:] == ("#99B3CC", "#1A334D", "#33669980")
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, None)], "id int, k string")
    got = {r["id"]: r["color"] for r in colors.factor_colors(rows, "k", least=2).collect()}
    assert got == {1: "#D3D3D3", 2: "#FF0000", 3: "#FF0000", 4: "#D3D3D3"}


def test_concave_hull_follows_a_notch():
    u = np.array([(x, y) for x in range(9) for y in range(9) if not (3 <= x <= 5 and y > 2)])
    area = lambda p: abs(sum(p[k - 1][0] * p[k][1] - p[k][0] * p[k - 1][1] for k in range(len(p)))) / 2
    assert area(N.convex_hull(u)) == 64 and area(N.concave_hull(u)) < 50
    assert len(N.concave_hull(np.array([[0, 0], [1, 1]]))) == 2 and len(N.concave_hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2]]))) == 4


def test_overdispersed_genes_against_numpy(spark):
    rng = np.random.default_rng(21)
    rows, odd = [], set()
    for g in range(60):
        mean = math.exp(rng.uniform(0, 4))
        wide = g % 12 == 0
        odd |= {f"g{g:02d}"} if wide else set()
        for s in range(200):
            rows.append((f"g{g:02d}", s, float(rng.poisson(mean * (rng.gamma(0.5, 2) if wide else 1))) + 0.5))
    m = spark.createDataFrame(rows, "gene_id string, spot_id long, value double")
    got = {r["gene_id"]: r for r in matrix.overdispersed_genes(m).collect()}
    assert {g for g, r in got.items() if r["selected"]} == odd
    # the trend is smooth, and fits the others' log variance (of a Poisson law: log mean)
    assert np.mean([abs(r["residual"]) for g, r in got.items() if g not in odd]) < 0.6
    x = np.array([r["lm"] for r in got.values()])
    trend = np.array([r["lv"] - r["residual"] for r in got.values()])[np.argsort(x)]
    assert np.abs(np.diff(trend, 2)).max() < 1.0
    r = next(iter(got.values()))
    assert math.isclose(S.chi2_sf(r["qv"] * 60, 59), max(r["p"], 1e-300), rel_tol=1e-5, abs_tol=1e-9)
    assert math.isclose(r["scale"], math.sqrt(min(max(r["qv"], 1e-3), 1e3) / math.exp(r["lv"])), rel_tol=1e-9)
    assert matrix.overdispersed_genes(m.where("false")).count() == 0


def test_manifold_layout_keeps_groups(spark):
    rng = np.random.default_rng(2)
    x = np.r_[*(rng.normal(c, 0.15, (30, 5)) for c in (np.eye(5)[:3] * 3))]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vec array<double>")
    y = np.stack([r["vec"] for r in neighbors.manifold_layout(v, 2, k=8, epochs=80).orderBy("id").collect()])
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert (d.argmin(1) // 30 == np.arange(90) // 30).mean() > 0.95
    assert neighbors.manifold_graph(v, 2, 4, layout="pca").count() > 90


def test_lenses_and_clusters_of_the_mapper(spark):
    a = np.linspace(0, 2 * math.pi, 80, endpoint=False)
    v = spark.createDataFrame([(i, [math.cos(x), math.sin(x), 0.0]) for i, x in enumerate(a)], "id long, vec array<double>")
    flat = np.stack([r["lens"] for r in mapper.distance_lens(v, "mds").orderBy("id").collect()])
    want = np.stack([[math.cos(x), math.sin(x)] for x in a])
    assert np.abs(np.linalg.norm(flat[:, None] - flat[None], axis=2) - np.linalg.norm(want[:, None] - want[None], axis=2)).max() < 1e-3
    ring = np.stack([r["lens"] for r in mapper.distance_lens(v, "neighbor").orderBy("id").collect()])
    assert np.std(np.linalg.norm(ring, axis=1)) < 0.05 * np.linalg.norm(ring, axis=1).mean()
    with pytest.raises(ValueError):
        mapper.distance_lens(v, max_rows=10)


def test_kriging_against_its_system(spark, grid, planted):
    one = planted.where("gene_id = 'g00'") if planted.where("gene_id = 'g00'").count() else planted.where(F.col("gene_id") == planted.first()["gene_id"])
    fit = spatial.fit_variogram(spatial.dense_variogram(one, grid))
    p = fit.first()
    gap = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])

    def model(h):
        return p["sill"] if h >= p["reach"] else p["nugget"] + (p["sill"] - p["nugget"]) * (1.5 * h / p["reach"] - 0.5 * (h / p["reach"]) ** 3)

    z = {r["spot_id"]: r["value"] for r in one.collect()}
    xy = {r["spot_id"]: (r["x"], r["y"]) for r in grid.collect() if r["spot_id"] in z}
    ids = sorted(xy)
    a = np.ones((len(ids) + 1, len(ids) + 1))
    a[-1, -1] = 0
    for i, s in enumerate(ids):
        for j, t in enumerate(ids):
            a[i, j] = p["nugget"] if i == j else model(gap(xy[s], xy[t]))
    at = (2.3, 1.6)
    b = np.array([*(model(gap(xy[s], at)) for s in ids), 1.0])
    w = np.linalg.inv(a) @ b
    got = spatial.krige(one, grid, spark.createDataFrame([(7, *at)], "target_id long, x double, y double"), fit).first()
    assert math.isclose(got["value"], sum(w[i] * z[s] for i, s in enumerate(ids)), rel_tol=1e-6) and math.isclose(got["variance"], max(0.0, w @ b), rel_tol=1e-6, abs_tol=1e-9)
    # the grid of the fit: the best of the 125 combinations, tried here one by one
    lags = [(r["distance"], r["gamma"]) for r in spatial.dense_variogram(one, grid).orderBy("lag").collect()]
    n0, s0, r0 = lags[0][1] / 2, max(g for _, g in lags), max(h for h, _ in lags) / 2
    best = min((sum((g - (s * s0 if h >= r * r0 else n * n0 + (s * s0 - n * n0) * (1.5 * h / (r * r0) - 0.5 * (h / (r * r0)) ** 3))) ** 2 for h, g in lags), n * n0, s * s0, r * r0) for n in (0.1, 0.3, 0.5, 0.8, 1) for s in (0.5, 0.8, 1, 1.2, 1.5) for r in (0.3, 0.5, 0.8, 1, 1.5))
    assert np.allclose([p["nugget"], p["sill"], p["reach"]], [max(0, best[1]), max(best[1] + 1e-4, best[2]), best[3]], rtol=1e-9) and math.isclose(p["sse"], best[0], rel_tol=1e-9)


def test_bson_round_trip(spark, tmp_path):
    kind = "id long, name string, size double, antibody map<string,double>, at array<double>, ok boolean"
    rows = [(1, "a", 1.5, {"x": 2.0}, [1.0, 2.0], True), (2, None, None, {}, [], False), (3, "é", -0.5, {"y": 0.0, "z": 1.0}, [3.0], None)]
    cells_ = spark.createDataFrame(rows, kind).repartition(2)
    written = writers.write_cells_bson(cells_, f"file://{tmp_path}/cells").collect()
    assert sum(r["documents"] for r in written) == 3
    back = readers.read_cells_bson(spark, f"file://{tmp_path}/cells/*.bson", "id long, name string, size double, at array<double>").collect()
    assert sorted((r["id"], r["name"], r["size"], r["at"]) for r in back) == sorted((r[0], r[1], r[2], r[4]) for r in rows)
    assert readers.bson_documents(writers.bson_document({"n": 5, "m": {"k": [True, None]}})) == [{"n": 5, "m": {"k": [True, None]}}]


def test_diffusion_weights_are_stored(tmp_path):
    model = generative.Diffusion(3, steps=5)
    writers.save_model(model, str(tmp_path / "d.npz"))
    again = generative.Diffusion(3, steps=5, seed=7).load(np.load(tmp_path / "d.npz"))
    assert np.allclose(again.sample(np.zeros(2)), model.sample(np.zeros(2)))
    with pytest.raises(ValueError):
        generative.Diffusion(4, steps=5).load(np.load(tmp_path / "d.npz"))


def test_numbers_of_a_global_order(spark):
    from tissueloom.functions.ranking import numbered

    x = RNG.integers(0, 40, 500).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, v long").repartition(5)
    got = [(r["n"], r["v"]) for r in numbered(df, "v", "id").collect()]
    assert sorted(got) == list(enumerate(sorted(x), 1))
    p = spark.createDataFrame([(k, float(v)) for k, v in enumerate(RNG.random(200).round(2))], "id long, p double")
    rows = sorted((r["p"], r["id"]) for r in p.collect())
    want, low = {}, 1.0
    for k in range(len(rows), 0, -1):
        low = min(low, rows[k - 1][0] * len(rows) / k)
        want[rows[k - 1][1]] = low
    assert all(math.isclose(r["fdr"], want[r["id"]]) for r in S.benjamini_hochberg(p, "p").collect())
    assert S.benjamini_hochberg(p.where("false"), "p").count() == 0


def test_tenx_files_in_chunks(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 1000
    cols = {k: rng.integers(0, 9, n) for k in ("barcode_idx", "feature_idx", "count")}
    with open(tmp_path / "mol.h5", "wb") as f:
        np.savez(f, **cols)
    spark.dataSource.register(readers.TenxSource)
    assert readers.tenx_kind(str(tmp_path / "mol.h5")) == "molecules"
    rows = spark.read.format("tenx_h5").option("chunk", 128).load(str(tmp_path / "mol.h5"))
    assert rows.rdd.getNumPartitions() == 8
    want = {}
    for b, g, c in zip(*(cols[k].tolist() for k in ("barcode_idx", "feature_idx", "count")), strict=True):
        want[b, g] = want.get((b, g), 0) + c
    assert {(r["barcode_idx"], r["feature_idx"]): r["count"] for r in readers.molecule_counts(rows).collect()} == want
    slices = {f"feature_slices/{k}/{c}": rng.integers(0, 5, 3) for k in ("10", "2", "1") for c in ("row", "col", "data")}
    with open(tmp_path / "slices.h5", "wb") as f:
        np.savez(f, **slices)
    assert readers.tenx_kind(str(tmp_path / "slices.h5")) == "slices"
    got = spark.read.format("tenx_h5").option("kind", "slices").load(str(tmp_path / "slices.h5")).collect()
    assert list(dict.fromkeys(r["slice"] for r in got)) == ["1", "10", "2"] and len(got) == 9  # names in string order
    with open(tmp_path / "bad.h5", "wb") as f:
        np.savez(f, **cols | {"count": np.zeros(3, int)})
    with pytest.raises(Exception, match="differ in length"):
        spark.read.format("tenx_h5").load(str(tmp_path / "bad.h5")).collect()
    with open(tmp_path / "other.h5", "wb") as f:
        np.savez(f, x=np.zeros(3))
    with pytest.raises(ValueError):
        readers.tenx_kind(str(tmp_path / "other.h5"))


def test_late_events_are_dropped_behind_the_watermark(spark, tmp_path):
    from tissueloom.streaming import calls

    kind = "event_id long, ts timestamp, event_type string, value double"
    files = [
        [(1, "10:05:00", 1.0), (2, "10:50:00", 2.0)],
        [(3, "10:59:00", 4.0), (4, "12:00:00", 8.0)],  # the watermark goes to 11:50 after this file
        [(5, "10:30:00", 16.0), (6, "11:55:00", 32.0)],  # the first one is too late
        [(7, "15:00:00", 64.0)],
        [(8, "15:10:00", 128.0)],
    ]
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(i, f"2024-01-01 {t}", "view", v) for i, t, v in rows], "event_id long, ts string, event_type string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).select(*(c.split()[0] for c in kind.split(", "))).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = calls.event_stream(spark, f"file://{tmp_path}/in", 1)
        calls.append_windows(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", late="10 minutes").awaitTermination()
    got = {r["start"].hour: (r["n"], r["total"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {10: (3, 7.0), 11: (1, 32.0), 12: (1, 8.0)}


def test_ransac_counts_every_candidate(spark):
    # 9000 candidates turned by a quarter and moved, and 1000 that are not
    x, y = F.col("id") % 100, F.floor(F.col("id") / 100)
    far = F.when(F.col("id") % 10 == 0, F.lit(500.0) + F.col("id") % 7).otherwise(0.0)
    pairs = spark.range(10_000).select("id", x.cast("double").alias("xa"), y.cast("double").alias("ya"), (3 - y + far).cast("double").alias("xb"), (x + 2.0).alias("yb")).repartition(5)
    assert align.ransac(pairs, 50, 0.01).first()["inliers"] == 9000


def test_model_queries_cover_all_components(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    n = len(spark.read.parquet(f"{sf}/embeddings.parquet").first()["embedding"])
    assert n > 16 and entry.queries()["cvae_reconstruction"](spark, sf).count() == n
    assert {len(r["vec"]) for r in entry.queries()["time_interpolation"](spark, sf).collect()} == {n}
    assert {len(r["mean"]) for r in entry.queries()["diffusion_states"](spark, sf).collect()} == {n}


def test_whitespace_line_is_split_once(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a b c\n g  1 2.5 x\n\nh 3 4\nk 5 6 7\n")
    got = readers.read_whitespace_matrix(spark, str(tmp_path / "m.txt"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("g", "a", 1.0), ("g", "b", 2.5), ("g", "c", None), ("k", "a", 5.0), ("k", "b", 6.0), ("k", "c", 7.0)], key=str)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "split(" not in above


def test_equal_profiles_go_to_the_first():
    rng = np.random.default_rng(4)
    for _ in range(50):
        p, b = rng.integers(400, 900, 25) / 7.0, rng.integers(100, 900, 25).astype(float)
        x = N.nnls(np.stack([p, p, p], 1), b)
        assert x[1] == 0 and x[2] == 0 and math.isclose(x[0], p @ b / (p @ p))


def test_range_pairs_are_not_broadcast(spark):
    at = spark.range(400).selectExpr("id", "cast(id % 20 as double) as px", "cast(id div 20 as double) as py", "cast(id % 7 as double) as ratio")
    for found in (cells.neighbourhood(at, 2.0, 10), cells.range_pairs(at, at, 2.0, keep=("ratio",))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan
    assert cells.range_pairs(at, at, 2.0, keep=("ratio",)).where("ratio <> id_b % 7").count() == 0


def test_cell_moran_joins_no_table_of_cells(spark, monkeypatch):
    at = spark.range(400).selectExpr("id", "cast(id % 20 as double) as px", "cast(id div 20 as double) as py", "cast(id % 7 as double) as ratio")
    plans = []
    monkeypatch.setattr(cells, "stored", lambda df, name="step": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert cells.cell_moran(at, 2.0, 10).count() == 400
    assert plans[0].count("Join ") == 1 and "strategy=merge" in plans[0]


def _many_spots(spark, n=3100):
    return spark.range(n).selectExpr("id as spot_id", "cast(id % 10 as double) as x", "cast(id div 10 as double) as y")


def test_all_pairs_of_many_spots(spark):
    spots = _many_spots(spark)
    pairs = spatial.spot_pairs(spots)
    assert pairs.count() == 3100 * 3099 // 2
    one = pairs.where("i = 7 and j = 3001").first()
    assert (one["d"], one["xi"], one["yj"]) == (math.hypot(6, 300), 7.0, 300.0)


def test_median_gap_is_exact(spark, monkeypatch):
    k = np.arange(3100)
    xy = np.c_[k % 10, k // 10].astype(float)
    upper = np.sort(np.linalg.norm(xy[:, None] - xy[None], axis=2)[np.triu_indices(3100, 1)])
    assert math.isclose(spatial.median_gap(_many_spots(spark)), upper[len(upper) // 2], rel_tol=1e-15)
    monkeypatch.setattr(spatial, "READ_OFF", 20), monkeypatch.setattr(spatial, "BINS", 7), monkeypatch.setattr(spatial, "PAIRS_A_TASK", 300)
    for n in (2, 3, 40, 120):
        xy = RNG.random((n, 2))
        spots = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "spot_id long, x double, y double")
        d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))[np.triu_indices(n, 1)])
        assert spatial.median_gap(spots) == d[len(d) // 2]
    assert spatial.median_gap(spots.limit(1)) is None


def test_dense_variogram_of_many_spots(spark, monkeypatch):
    spots = _many_spots(spark)
    m = spots.selectExpr("'g' as gene_id", "spot_id", "cast(spot_id % 13 as double) as value")
    got = spatial.dense_variogram(m, spots).orderBy("lag").toPandas()
    assert got["n_pairs"].sum() == 3100 * 3099 // 2 and len(got) == 10
    fits = spatial.fit_variogram(spatial.dense_variogram(m, spots)).first()
    assert fits["sill"] > fits["nugget"] >= 0
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 100)
    few = spots.where("spot_id < 90")
    some = m.where("spot_id < 90 and spot_id % 7 > 0").unionByName(m.where("spot_id < 90").withColumn("gene_id", F.lit("h")))
    key = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("gene_id", "lag", "distance", "gamma", "n_pairs").orderBy("gene_id", "lag").collect()]
    assert key(spatial.dense_variogram(some, few)) == key(spatial.variogram(some, spatial.spot_pairs(few)))


def test_dense_autocorrelation_is_that_of_weights(spark, monkeypatch):
    many = _many_spots(spark)
    got = spatial.spatial_statistics(many.selectExpr("'g' as gene_id", "spot_id", "cast(spot_id as double) as value"), many).first()
    assert 0 < got["moran"] < 1
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 100), monkeypatch.setattr(spatial, "GENES_A_TASK", 2)
    far = spark.createDataFrame([(90, 500.0, 500.0)], "spot_id long, x double, y double")
    spots = _many_spots(spark, 90).unionByName(far)
    value = F.pmod(F.xxhash64("spot_id", "g"), F.lit(50)).cast("double")
    m = spots.crossJoin(spark.range(5).selectExpr("id as g")).where("g > 0 or spot_id % 5 > 0").select(F.concat(F.lit("g"), "g").alias("gene_id"), "spot_id", value.alias("value"))
    a = spatial.dense_autocorrelation(m, spots, 3.5).orderBy("gene_id").toPandas()
    b = spatial.autocorrelation(m, spatial.distance_weights(spots, 3.5)).orderBy("gene_id").toPandas()
    assert list(a.columns) == list(b.columns) and len(a) == 5
    apart = (a.drop(columns="gene_id") - b.drop(columns="gene_id")).abs().max()
    assert (apart < 1e-9).all(), apart


def test_kriging_of_many_spots(spark):
    spots = _many_spots(spark)
    m = spots.selectExpr("'g' as gene_id", "spot_id", "cast(spot_id % 13 as double) as value")
    fits = spark.createDataFrame([("g", 1.5, 9.0, 40.0)], "gene_id string, nugget double, sill double, reach double")
    got = spatial.krige(m, spots, spots.where("spot_id % 500 = 0").withColumnRenamed("spot_id", "target_id"), fits).collect()
    assert len(got) == 7 and all(math.isclose(r["value"], r["target_id"] % 13, abs_tol=1e-6) and math.isclose(r["variance"], 1.5, abs_tol=1e-6) for r in got)


def test_clusters_of_many_spots(spark):
    spots = _many_spots(spark)
    m = spots.selectExpr("'g' as gene_id", "spot_id", "cast(spot_id div 1550 as double) as value")
    for method in ("ward", "medoids"):
        got = spatial.st_clusters(m, spots, 2, method=method).toPandas().sort_values("spot_id")["cluster"].to_numpy()
        assert len(got) == 3100 and len(set(got[:1550])) == len(set(got[1550:])) == 1 and got[0] != got[-1]


def test_matches_of_many_rows(spark):
    a = spark.range(3100).selectExpr("id", "cast(id as double) as px", "0.0d as py")
    b = spark.createDataFrame([(0, 10.2, 0.0), (1, 3050.1, 0.0)], "id long, px double, py double")
    assert sorted((r["id_a"], r["id_b"]) for r in align.optimal_matches(a, b).collect()) == [(10, 0), (3050, 1)]
    assert sorted((r["id_a"], r["id_b"]) for r in align.optimal_matches(b, a).collect()) == [(0, 10), (1, 3050)]


def test_leader_tree_of_many_rows(spark):
    v = spark.range(50_003).selectExpr("id", "array(cast(id % 3 = 0 as double), cast(id % 3 = 1 as double), cast(id % 3 = 2 as double)) as vec")
    got = neighbors.leader_tree(v)
    assert got.count() == 50_003 and got.where("leader <> id % 3").count() == 0


def test_kriging_shares_a_factor_of_one_reach(spark):
    spots = _many_spots(spark, 60)
    value = F.pmod(F.xxhash64("spot_id", "g"), F.lit(50)).cast("double")
    m = spots.crossJoin(spark.range(6).selectExpr("id as g")).where("g > 0 or spot_id % 5 > 0").select(F.concat(F.lit("g"), "g").alias("gene_id"), "spot_id", value.alias("value"))
    fits = spark.createDataFrame([(f"g{k}", 0.5 * k, 9.0 + k, 6.0 if k < 4 else 11.0) for k in range(6)], "gene_id string, nugget double, sill double, reach double")
    targets = spark.createDataFrame([(k, 1.3 * k, 0.7 * k) for k in range(5)], "target_id long, x double, y double")
    got = spatial.krige(m, spots, targets, fits).orderBy("gene_id", "target_id").toPandas()
    plain = spatial.krige(m, spots, targets, fits, variance=False).orderBy("gene_id", "target_id").toPandas()
    assert list(plain.columns) == ["gene_id", "target_id", "value"] and np.abs(plain["value"] - got["value"]).max() < 1e-9
    rows, place = m.join(spots, "spot_id").orderBy("spot_id").toPandas(), targets.toPandas()[["x", "y"]].to_numpy()
    for r in fits.collect():
        one = rows[rows["gene_id"] == r["gene_id"]]
        value, variance = spatial._least_squares(one[["x", "y"]].to_numpy(), one["value"].to_numpy(), place, "spherical", (r["nugget"], r["sill"], r["reach"]))
        own = got[got["gene_id"] == r["gene_id"]]
        assert np.abs(own["value"] - value).max() < 1e-8 and np.abs(own["variance"] - np.maximum(variance, 0)).max() < 1e-8


def test_spatial_genes_of_many_spots(spark):
    spots = _many_spots(spark)
    noise = (F.pmod(F.xxhash64("spot_id", "g"), F.lit(1000)) / 1000).alias("noise")
    m = spots.crossJoin(spark.range(3).selectExpr("id as g")).select("g", "spot_id", F.when(F.col("g") == 0, F.sin(F.col("x") / 20 + F.col("y") / 9)).otherwise(0.0).alias("wave"), noise)
    got = gp.spatial_genes(m.select(F.concat(F.lit("g"), "g").alias("gene_id"), "spot_id", (F.col("wave") + F.col("noise")).alias("value")), spots, n_lengths=3).orderBy("gene_id").collect()
    assert [r["gene_id"] for r in got] == ["g0", "g1", "g2"] and got[0]["p"] < 1e-9 < 1e-4 < min(got[1]["p"], got[2]["p"])


def test_kernel_sums_agree(monkeypatch):
    rng, k = np.random.default_rng(3), np.arange(420)
    xy = np.c_[k % 6, k // 6].astype(float)
    xy = xy[gp.swept(xy)]
    y = np.c_[rng.normal(size=420), np.sin(xy[:, 1] / 9) + 0.1 * rng.normal(size=420)].T
    y -= y.mean(1, keepdims=True)
    grid, d = gp.length_grid(xy, 4), np.linalg.norm(xy[:, None] - xy[None], axis=2)
    assert np.allclose(grid, np.geomspace(0.5, 2 * d.max(), 4))
    forms = set()
    for length in grid:
        whole = gp.kernel_sums(y, xy, length, "se", None)
        monkeypatch.setattr(gp, "EIGEN_SPOTS", 0), monkeypatch.setattr(gp, "FACTOR_BLOCK", 32), monkeypatch.setattr(N, "FACTOR_BLOCK", 32)
        low, trial = gp.kernel_sums(y, xy, length, "se", None), 20
        band = gp.kernel_sums(y, xy, length, "se", trial)[0]
        monkeypatch.undo()
        forms.add(low is None)
        like = lambda sums: np.array([gp.profile_likelihood(s, 420) for s in sums])
        assert np.abs(like(band) - like(whole[trial])).max() < 1e-5
        if low is not None:
            assert max(np.abs(like(a) - like(b)).max() for a, b in zip(low, whole, strict=True)) < 1e-4
        # between the trials: against the matrix itself
        t, scale = -3.21, np.array([0, 0.5, 0.5, 0.5])
        k_ = np.exp(-(d**2) / (2 * length**2)) + math.exp(t) * np.eye(420)
        one = np.ones(420)
        for i in range(2):
            sums = np.array([np.linalg.slogdet(k_)[1], one @ np.linalg.solve(k_, one), one @ np.linalg.solve(k_, y[i]), y[i] @ np.linalg.solve(k_, y[i])])
            got = gp.between(gp.trial_points(), whole[:, i] * np.exp(gp.trial_points()[:, None] * scale), t) * np.exp(-t * scale)
            assert math.isclose(gp.profile_likelihood(got, 420), gp.profile_likelihood(sums, 420), abs_tol=1e-5)
    assert forms == {True, False}


def test_patterns_of_many_spots(spark):
    spots = _many_spots(spark)
    m = spots.crossJoin(spark.range(6).selectExpr("id as g")).select(F.concat(F.lit("g"), "g").alias("gene_id"), "spot_id", (F.when(F.col("g") < 3, F.col("x")).otherwise(F.col("y")) + F.pmod(F.xxhash64("spot_id", "g"), F.lit(10)) / 50).alias("value"))
    got = {}
    for length in (None, 0.6):  # a kernel of low rank, and one factored in a band
        got = {r["gene_id"]: r["pattern"] for r in gp.pattern_clusters(m, spots, 2, length)[0].collect()}
        assert got["g0"] == got["g1"] == got["g2"] != got["g3"] == got["g4"] == got["g5"]
    # the values are smoothed by K (K + .01 I)^-1 either way
    k = np.arange(90)
    few = spark.createDataFrame([(int(i), float(i % 9), float(i // 9)) for i in k], "spot_id long, x double, y double")
    rows = np.random.default_rng(4).normal(size=90)
    one = spark.createDataFrame([("g", int(i), float(v)) for i, v in zip(k, rows, strict=True)], "gene_id string, spot_id long, value double")
    xy = np.c_[k % 9, k // 9].astype(float)
    for length in (0.6, 9.0):
        kernel = np.exp(-(np.linalg.norm(xy[:, None] - xy[None], axis=2) ** 2) / (2 * length**2))
        want = kernel @ np.linalg.solve(kernel + 0.01 * np.eye(90), rows - rows.mean()) + rows.mean()
        smooth = [r["value"] for r in gp.pattern_clusters(one, few, 1, length)[1].orderBy("spot_id").collect()]
        assert np.abs(np.array(smooth) - want).max() < 1e-6


def test_layout_of_many_rows(spark):
    angle = F.col("id") * (2 * math.pi / 20_100)
    v = spark.range(20_100).select("id", F.array(F.cos(angle), F.sin(angle), F.lit(0.5)).alias("vec"))
    got = neighbors.manifold_layout(v, 2, k=3, epochs=2)
    assert got.count() == 20_100 and got.select("id").distinct().count() == 20_100
    with pytest.raises(ValueError):
        neighbors.manifold_layout(v, 2, k=3, epochs=2, max_rows=20_000)


def test_clusters_of_a_large_patch(spark, monkeypatch):
    at = F.col("id") % 2 * 9 + F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    big = spark.range(100_200).select("id", F.array(at, F.lit(1.0)).alias("vec"), F.lit(4).alias("patch"))
    small = spark.range(12).select(F.col("id") + 500, F.array((F.col("id") % 3 * 7).cast("double"), F.lit(0.0)).alias("vec"), F.lit(2).alias("patch"))
    got = mapper.patch_clusters(big.unionByName(small.withColumnsRenamed({"(id + 500)": "id"})), 3).groupBy("patch", "node").agg(F.count("*").alias("n"), F.countDistinct(F.col("id") % 2).alias("kinds")).orderBy("node").collect()
    assert [(r["node"], r["n"]) for r in got] == [("2-0", 4), ("2-1", 4), ("2-2", 4), ("4-0", 50_100), ("4-1", 50_100)] and all(r["kinds"] == 1 for r in got if r["patch"] == 4)
    # in a file and in strips as in memory
    x = np.random.default_rng(5).normal(size=(500, 6)) + 4 * (np.arange(500) % 3 == 0)[:, None]

    def nodes():
        held = mapper._Patch()
        for k in range(0, 500, 60):
            held.add(np.arange(500)[k : k + 60], x[k : k + 60])
        return [n for f in held.clusters(1, 4) for n in f["node"]]

    whole = nodes()
    monkeypatch.setattr(mapper, "PATCH_BYTES", 5000), monkeypatch.setattr(mapper, "STRIP", 64)
    assert nodes() == whole and len(set(whole)) > 1
