"""Hand-computed cases, invariants and brute-force comparisons for the analytic operators."""

import math
import random

import numpy as np
import pytest
from algoscape.functions.geometry import Region, area, convex_hull, delaunay, tight_boundary
from algoscape.functions.quantiles import quantiles
from algoscape.functions.special import correlation_p_value
from algoscape.functions.tables import Tables
from algoscape.operators import bounds, footprint, labels, predict, prep, project, selection, subset
from algoscape.sources import export
from algoscape.sources import metadata as M
from algoscape.sources.model import Model
from algoscape.spec import FeatureSearch, Options, Performance, Prediction, Roles, Selection
from pyspark.sql import functions as F

A3 = ["algo_x", "algo_y", "algo_z"]


@pytest.fixture(scope="module")
def plane(spark):
    r = random.Random(1)
    rows = [(str(i), "s", *(r.gauss(0, 1) for _ in range(4)), *(r.random() * 10 if r.random() > 0.05 else None for _ in range(3))) for i in range(160)]
    return spark.createDataFrame(rows, "instances string, source string, feature_a double, feature_b double, feature_c double, feature_d double, algo_x double, algo_y double, algo_z double")


# ---- labels
def test_relative_goodness(spark):
    df = spark.createDataFrame([("1", 10.0, 10.4, 20.0), ("2", 5.0, 5.0, None), ("3", 0.0, 0.0, 3.0), ("4", None, 7.0, 9.0), ("5", None, None, None)], "instances string, algo_x double, algo_y double, algo_z double")
    got = labels.label(df, A3, absolute=False, epsilon=0.05).orderBy("instances").collect()
    assert [(r.best_algo, r.good_x, r.good_y, r.good_z, r.num_good, r.beta_easy) for r in got] == [
        (1, True, True, False, 2, True),
        (1, True, True, False, 2, True),
        (1, True, True, False, 2, True),
        (2, False, True, False, 1, False),
        (None, False, False, False, 0, False),
    ]
    assert [r.n_best for r in got][:4] == [1, 2, 2, 1]
    assert {r.best_algo for r in labels.label(df, A3, absolute=False, seed=4).where("instances = '2'").collect()} <= {1, 2}


def test_maximising_and_absolute(spark):
    df = spark.createDataFrame([("1", 10.0, 9.6, 5.0)], "instances string, algo_x double, algo_y double, algo_z double")
    r = labels.label(df, A3, maximise=True, absolute=False, epsilon=0.05).first()
    assert (r.best_algo, r.good_x, r.good_y, r.good_z) == (1, True, True, False)
    r = labels.label(df, A3, maximise=False, absolute=True, epsilon=9.6).first()
    assert (r.best_algo, r.good_x, r.good_y, r.good_z) == (3, False, True, True)
    with pytest.raises(ValueError):
        labels.drop_never_good(labels.label(df, A3, absolute=True, epsilon=1.0), A3)


# ---- metadata
def test_roles_and_cleaning(spark):
    df = spark.createDataFrame([("i1", None, 1.0, 2.0, 1.0), ("i2", 1.0, None, None, 2.0), ("i3", None, None, None, 3.0), ("i4", 3.0, 4.0, float("nan"), None), ("i5", 5.0, 1.0, 1.0, 1.0), ("i6", 5.0, 1.0, 1.0, 1.0)], "Instances string, FEATURE_a double, feature_b double, feature_c double, ALGO_x double")
    roles = Roles.of(df)
    assert (roles.instance, roles.source, roles.features, roles.algos) == ("Instances", None, ["FEATURE_a", "feature_b", "feature_c"], ["ALGO_x"])
    typed = M.typed(df)
    kept, own = M.clean(typed, Roles.of(typed))
    assert {r.instances for r in kept.collect()} == {"i1", "i2", "i5", "i6"}
    assert own.features == []  # a quarter or more of each is missing
    with pytest.raises(ValueError):
        Roles.of(spark.range(1))
    with pytest.raises(ValueError):
        roles.pick(["nothing"])
    with pytest.raises(M.MissingInput):
        M.read_table(spark, "/no/such/file.csv")


def test_row_numbers_follow_the_order(spark):
    df = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("instances"))
    got = M.with_row_id(df).collect()
    assert [r.instances for r in sorted(got, key=lambda r: r.row_id)] == sorted(r.instances for r in got)
    assert sorted(r.row_id for r in got) == list(range(1, 5001))


def test_row_numbers_hold_over_many_range_partitions(spark):
    """Bounds of range partitions come from a sample that differs between two readings."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.range(0, 60_000, 1, 4).select(F.sha1(F.col("id").cast("string")).alias("instances"))
        got = M.with_row_id(df).toPandas().sort_values("instances")
    finally:
        spark.conf.unset(key)
    assert got.row_id.tolist() == list(range(1, 60_001))


# ---- preparation
def test_quantiles_place_values_at_middles(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, None), (4.0, None)], "a double, b double")
    assert prep.bounds(df, ["a"])["a"] == (2.5, 2.0, -7.5, 12.5)
    assert quantiles(df, ["b"], [0.25, 0.5])["b"] == [5.0, 5.0]
    assert quantiles(df.where("a > 9"), ["a"], [0.5])["a"] == [None]


def test_quantiles_by_narrowing_equal_the_aggregate(spark):
    r = random.Random(2)
    rows = [(r.gauss(0, 1), float(r.randint(0, 3)), r.random() ** 20 * 1e9 if r.random() > 0.1 else None) for _ in range(20000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").cache()
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    few, many = quantiles(df, ["a", "b", "c"], p), quantiles(df, ["a", "b", "c"], p, small=0)
    for c in "abc":
        assert many[c] == pytest.approx(few[c], rel=1e-9)
    want = np.quantile([x[0] for x in rows], p, method="hazen")
    assert many["a"] == pytest.approx(want.tolist(), rel=1e-9)


def test_power_transform_finds_the_logarithm(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(math.exp(r.gauss(0, 1)), 7.0) for _ in range(3000)], "a double, b double")
    got = prep.fit_lambdas(df, {"a": F.col("a"), "b": F.col("b")})
    assert abs(got["a"]) < 0.1 and got["b"] == 1.0
    params = prep.fit(df.withColumnRenamed("a", "feature_a"), ["feature_a"], [])
    z = prep.apply(df.withColumnRenamed("a", "feature_a"), params).agg(F.avg("feature_a"), F.stddev_samp("feature_a")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9
    r = spark.createDataFrame([(None,), (5.0,), (-100.0,), (100.0,)], "x double").select(prep.clamp("x", -1.0, 10.0).alias("x")).collect()
    assert [v.x for v in r] == [None, 5.0, -1.0, 10.0]


# ---- correlation and selection
def test_likelihoods_equal_plain_ones(spark):
    r = random.Random(31)
    rows = [(math.exp(r.gauss(0, 1)), None if i % 3 else 5.0 + r.random(), 7.0, None) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    lambdas = {"a": [-1.0, 0.0, 0.5], "b": [2.0], "c": [0.5, 1.0], "d": [1.0]}
    got = prep.log_likelihoods(df, {c: F.col(c) for c in "abcd"}, lambdas)
    for k, c in enumerate("ab"):
        x = np.array([v[k] for v in rows if v[k] is not None])
        want = [-len(x) / 2 * math.log((np.log(x) if v == 0 else (x**v - 1) / v).var()) + (v - 1) * np.log(x).sum() for v in lambdas[c]]
        assert got[c] == pytest.approx(want, rel=1e-12)
    assert got["c"] == [None, None] and got["d"] == [None]


def test_nearest_rows_in_memory_keep_ties_by_number():
    r = np.random.default_rng(12)
    z, q = np.round(r.normal(size=(400, 2)), 1), np.round(r.normal(size=(700, 2)), 1)
    skip = r.random((700, 400)) < 0.995
    for skipped in (None, skip):
        d = ((q[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)
        if skipped is not None:
            d[skipped] = np.inf
        assert (predict._nearest(z, q, 9, skipped) == np.argsort(d, axis=1, kind="stable")[:, :9]).all()
    assert predict._nearest(z[:4], q, 9).shape == (700, 4)


def test_p_values():
    assert correlation_p_value(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert correlation_p_value(0.0, 10) == pytest.approx(1.0)
    assert correlation_p_value(1.0, 10) == 0.0 and correlation_p_value(0.4, 2) is None


def test_clusters_put_alike_features_together():
    r = np.random.default_rng(0)
    base = r.normal(size=(3, 500))
    x = np.vstack([base[i] + 0.1 * r.normal(size=500) for i in (0, 0, 1, 1, 2, 2)])
    corr = np.corrcoef(x)
    own = selection.cluster_features(corr, 3)
    assert own[0] == own[1] and own[2] == own[3] and own[4] == own[5] and len(set(own)) == 3
    scan = selection.silhouette_scan(corr)
    assert selection.first_good_k(scan) == 3 and scan[0][1] > 0.9


def test_selection_keeps_what_predicts(spark, plane):
    df = plane.withColumn("algo_x", F.col("feature_a") * 2 + 5).withColumn("algo_y", F.col("feature_b") + 5)
    table = selection.with_p_values(spark, selection.correlations(df, ["feature_a", "feature_b", "feature_c", "feature_d"], ["algo_x", "algo_y"]))
    assert selection.correlation_rule(table, ["feature_a", "feature_b", "feature_c", "feature_d"], 0.9) == ["feature_a", "feature_b"]
    assert len(selection.top_rule(table, ["feature_a", "feature_b", "feature_c", "feature_d"])) >= 3
    lab = labels.label(df.dropna(), ["algo_x", "algo_y"], absolute=False, epsilon=0.2)
    search = selection.Search(lab, ["feature_a", "feature_b", "feature_c", "feature_d"], ["algo_x", "algo_y"], ["good_x", "good_y"])
    best = search.brute_force([[0, 2], [1, 3]])
    assert search.known[best] == min(search.known.values()) and len(search.known) == 4
    assert search.genetic([[0, 2], [1, 3]], population=6, generations=2) in search.known
    with pytest.raises(ValueError):
        selection.select_features(lab, ["feature_a"], ["algo_x"], ["good_x"])


# ---- subsets
def brute_filter(rows, radius, kind, gamma):
    """rows: (id, features, performances, flags) in order."""
    n = len(rows)
    removed, dissimilar, violates = [False] * n, [True] * n, [False] * n
    for i in range(n):
        if removed[i]:
            continue
        for j in range(i + 1, n):
            if removed[j]:
                continue
            dx = math.dist(rows[i][1], rows[j][1])
            if dx > radius:
                continue
            dissimilar[j] = False
            ok = True
            if "AP" in kind:
                ok &= math.dist(rows[i][2], rows[j][2]) <= gamma
            if "Good" in kind:
                ok &= all(a and b for a, b in zip(rows[i][3], rows[j][3], strict=True))
            if ok:
                removed[j], violates[j] = True, False
            else:
                violates[j] = True
    return [(rows[i][0], removed[i], dissimilar[i], violates[i]) for i in range(n)]


@pytest.mark.parametrize("kind", subset.KINDS)
def test_greedy_filter_matches_brute_force(spark, kind):
    r = random.Random(7)
    rows = [(i, (r.random(), r.random()), (r.random() * 0.3, r.random() * 0.3), (r.random() < 0.7, r.random() < 0.7)) for i in range(1, 151)]
    df = spark.createDataFrame([(i, *f, *y, *g) for i, f, y, g in rows], "row_id long, f1 double, f2 double, y1 double, y2 double, g1 boolean, g2 boolean")
    got = subset.greedy_filter(df, ["f1", "f2"], ["y1", "y2"], ["g1", "g2"], 0.12, kind).collect()
    assert sorted((x.row_id, x.removed, x.dissimilar, x.violates) for x in got) == brute_filter(rows, 0.12, kind, 0.12)


def test_greedy_filter_hand_case_and_uniformity(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, True), (2, 0.05, 1.0, True), (3, 0.12, 1.0, True)], "row_id long, f double, y double, g boolean")
    got = {r.row_id: (r.removed, r.dissimilar) for r in subset.greedy_filter(df, ["f"], ["y"], ["g"], 0.1).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, True)}
    near = subset.nearest_distances(df.where("row_id <> 2").withColumn("instances", F.col("row_id").cast("string")), ["f"])
    assert subset.uniformity(near).first()["uniformity"] == pytest.approx(1.0)


def test_nearest_distances_match_brute_force(spark):
    r = random.Random(5)
    pts = [(str(i), r.gauss(0, 1) if i else 50.0, r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for i in range(200)] + [("twin", 0.0, 0.0, 0.0, 0.0), ("twin2", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "instances string, a double, b double, c double, d double")
    want = {p[0]: min(math.dist(p[1:], q[1:]) for q in pts if q is not p) for p in pts}
    got = {x.instances: x.nearest for x in subset.nearest_distances(df, ["a", "b", "c", "d"]).collect()}
    assert got == pytest.approx(want)


def test_holdout_and_index(spark, plane):
    assert subset.holdout(plane, 0.25).count() == 40
    index = spark.createDataFrame([(1,), (5,), (5,), (9999,)], "i int")
    assert sorted(r.row_id for r in subset.by_index(M.with_row_id(plane), index).collect()) == [1, 5]
    with pytest.raises(ValueError):
        Selection(min_distance=0.1)


# ---- projection
def test_gramian_loss_and_gradient(plane):
    feats, algos = ["feature_a", "feature_b", "feature_c"], ["algo_x", "algo_y"]
    g = project.Gramian.of(plane, feats, algos)
    pd = plane.toPandas()
    x = pd[feats].to_numpy(float)
    t = pd[[*feats, *algos]].to_numpy(float)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 3)), rng.normal(size=(5, 2))
    direct = np.nanmean(np.nanmean((t - x @ a.T @ b.T) ** 2, axis=0))
    loss, da, db = g.loss(a, b)
    assert loss == pytest.approx(direct)
    for m, d in ((a, da), (b, db)):
        for i in np.ndindex(m.shape):
            m[i] += 1e-6
            up = g.loss(a, b)[0]
            m[i] -= 2e-6
            down = g.loss(a, b)[0]
            m[i] += 1e-6
            assert d[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_numeric_projection_reaches_the_analytic_optimum(plane):
    df = plane.dropna()
    g = project.Gramian.of(df, ["feature_a", "feature_b", "feature_c", "feature_d"], ["algo_x"])
    exact, found = project.analytic(g), project.solve(g, tries=4)
    assert found.loss == pytest.approx(exact.loss, rel=1e-4)
    small = g.pick(["feature_b", "feature_d"])
    again = project.Gramian.of(df, ["feature_b", "feature_d"], ["algo_x"])
    assert np.allclose(small.xt, again.xt) and np.allclose(small.xx, again.xx)
    with pytest.raises(ValueError):
        project.fit(df, ["feature_a", "feature_b"], ["algo_x"], solution=[1.0])


def test_distance_correlation_takes_all_pairs(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2600, 3))
    x[:, 2] *= 0.2
    names = [f"i{i}" for i in range(len(x) - 1)] + ["i0"]  # one label stands on two rows
    df = spark.createDataFrame([(n, *map(float, v), float(v[0]), float(v[1] ** 3)) for n, v in zip(names, x, strict=True)], "instances string, a double, b double, c double, z_1 double, z_2 double")
    z = np.column_stack([x[:, 0], x[:, 1] ** 3])
    dx, dz = (np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)) for p in (x, z))
    once = np.triu(np.ones(dx.shape, dtype=bool), 1)
    once[0, -1] = False
    got = project.distance_correlation(df, ["a", "b", "c"]).first()
    assert got.n_pairs == 2600 * 2599 // 2 - 1
    assert got["corr"] == pytest.approx(np.corrcoef(dx[once], dz[once])[0, 1], abs=1e-9)


@pytest.mark.parametrize("labels", ["own", "repeated"])
def test_planes_take_all_pairs_and_places_once(spark, monkeypatch, labels):
    monkeypatch.setattr(project, "PLACES", 150)
    monkeypatch.setattr(project, "SHARD", 1_000)
    r = np.random.default_rng(6)
    # 400 places, half of them far from zero, on three rows each
    x = np.tile(np.vstack([r.normal(size=(200, 3)), 1e4 + r.normal(size=(200, 3))]), (3, 1))
    names = [f"i{i % 1100}" if labels == "repeated" else f"i{i}" for i in range(len(x))]
    df = spark.createDataFrame([(n, *map(float, v)) for n, v in zip(names, x, strict=True)], "instances string, a double, b double, c double")
    planes = [r.normal(size=(2, 3)) for _ in range(3)] + [np.zeros((2, 3))]
    once = np.triu(np.array(names)[:, None] != np.array(names)[None, :], 1)
    dx = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))[once]
    want = [np.corrcoef(dx, np.sqrt((((x @ a.T)[:, None, :] - (x @ a.T)[None, :, :]) ** 2).sum(axis=2))[once])[0, 1] for a in planes[:3]]
    got = project.plane_correlations(df, ["a", "b", "c"], planes)
    assert got[:3] == pytest.approx(want, abs=1e-9) and got[3] is None
    assert project.plane_correlations(df.limit(0), ["a", "b", "c"], planes) == [None] * 4
    # equal distances have no spread
    three = spark.createDataFrame([("x", 1.0, 0.0, 0.0), ("y", 0.0, 1.0, 0.0), ("z", 0.0, 0.0, 1.0)], df.schema)
    assert project.plane_correlations(three, ["a", "b", "c"], planes[:1]) == [None]


def test_projection_of_copies_measures_a_place_once(spark, monkeypatch):
    """Rows that repeat add no pairs to measure, and all trials share one pass."""
    monkeypatch.setattr(project, "distance_correlation", lambda *a: pytest.fail("a pass for each trial"))
    r = np.random.default_rng(8)
    x = r.normal(size=(100, 3))
    few, many = (spark.createDataFrame([(f"{k}-{i}", *map(float, v), float(v[0] + 2 * v[1])) for k in range(n) for i, v in enumerate(x)], "instances string, feature_a double, feature_b double, feature_c double, algo_x double") for n in (1, 30))
    names = ["feature_a", "feature_b", "feature_c"]
    solutions = [project.fit(df, names, ["algo_x"], tries=3)[0] for df in (few, many)]
    assert solutions[0].a == pytest.approx(solutions[1].a, abs=1e-5)
    one = np.ones(100)
    alone, copied = (project._plane_sums(x, x, w, w, [solutions[0].a], np.arange(100)) for w in (one, 30 * one))
    assert copied == pytest.approx(900 * alone)


# ---- boundary
def test_corners_prune_and_fall_back(spark):
    v = bounds.vertices(spark, ["f", "g"], [(-1.0, 1.0), (-2.0, 2.0)])
    corr = np.array([[0.0, 0.9], [0.9, 0.0]])
    assert v.count() == 4
    left = bounds.prune(v, ["f", "g"], corr, 0.7)
    assert {(r.f, r.g) for r in left.collect()} == {(-1.0, -2.0), (1.0, 2.0)}
    assert bounds.hull(project.project(left, ["f", "g"], [[1, 0], [0, 1]])).isEmpty()
    assert bounds.hull(project.project(v, ["f", "g"], [[1, 0], [0, 1]])).count() == 5
    with pytest.raises(ValueError):
        bounds.vertices(spark, [f"f{i}" for i in range(30)], [(0.0, 1.0)] * 30)


# ---- prediction
def test_confusion_and_ratios(spark):
    df = spark.createDataFrame([(False, False), (False, True), (True, False), (True, True), (True, True)], "t boolean, h boolean")
    r = predict.confusion(df, [("t", "h")]).first()
    assert (r.tn, r.fn, r.fp, r.tp) == (1, 1, 1, 2)
    assert (r.precision, r.recall, r.accuracy) == pytest.approx((2 / 3, 2 / 3, 3 / 5))
    r = predict.confusion(df.where("not h"), [("t", "h")]).first()
    assert r.precision is None and r.tp == 0


def test_selector(spark):
    df = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "i int, h1 boolean, h2 boolean")
    got = predict.select(df, ["h1", "h2"], [0.8, 0.9], 1).orderBy("i").collect()
    assert [(r.selection0, r.selection1) for r in got] == [(1, 1), (2, 2), (0, 1)]
    assert [r.selection0 for r in predict.select(df, ["h1"], [0.8], 1).orderBy("i").collect()] == [1, 1, 0]


def test_models_separate_classes(spark):
    r = random.Random(4)
    rows = [(str(i), r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "instances string, z_1 double, z_2 double").withColumn("good_x", F.col("z_1") * F.col("z_1") + F.col("z_2") * F.col("z_2") < 0.5).withColumn("good_y", F.lit(True))
    for options in ({"knn": True}, {"knn": False, "points": 5}, {"knn": False, "polynomial": True, "parameters": [[1.0, 0.5]] * 2}):
        model, oof = predict.train(df, ["good_x", "good_y"], folds=3, **options)
        both = df.join(oof, "instances")
        assert both.where("good_x = hat_good_x").count() > 250
        assert both.where("hat_good_y").count() == 300
        scored = predict.score(df.select("instances", "z_1", "z_2"), model)
        assert scored.join(df.select("instances", "good_x"), "instances").where("good_x = hat_good_x").count() > 250
        assert scored.where("prob_good_x < 0 or prob_good_x > 1").count() == 0


def test_models_and_losses_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(predict, "MODEL_ROWS", 60)
    r = random.Random(14)
    rows = [(str(i), r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(400)]
    df = spark.createDataFrame([*rows, ("none", None, 0.0)], "instances string, z_1 double, z_2 double").withColumn("good_x", F.coalesce(F.col("z_1") > 0, F.lit(False)))
    for options in ({"knn": True}, {"knn": False, "parameters": [[1.0, 0.5]]}):
        model, got = predict.train(df, ["good_x"], folds=3, **options)
        assert sorted(x.instances for x in got.collect()) == sorted([x[0] for x in rows] + ["none"])
        assert got.where("hat_good_x is null").collect()[0].instances == "none"
        assert df.join(got, "instances").where("good_x = hat_good_x").count() > 340
    # the loss of a fold's rows, each by its nearest rows of the sample in other folds
    placed, fold = df.dropna(), predict.fold_of(5, 1)
    found = predict.knn_losses(placed, {(0, 1): (["z_1", "z_2"], np.eye(2))}, ["good_x"], fold)[0, 1]
    kept = {x.instances for x in predict.bounded(placed, 60).collect()}
    every = sorted(placed.withColumn("f", fold).collect(), key=lambda x: x.instances)
    wrong = 0
    for x in every:
        near = sorted((y for y in every if y.instances in kept and y.f != x.f), key=lambda y: (y.z_1 - x.z_1) ** 2 + (y.z_2 - x.z_2) ** 2)[:3]
        wrong += (sum(y.good_x for y in near) > 1.5) != x.good_x
    assert found == pytest.approx(wrong / 400)


def _brute_shares(z, y, held, k):
    """Shares among the k nearest rows of other folds, ties by row."""
    d = np.sqrt((z[:, None, 0] - z[None, :, 0]) ** 2 + (z[:, None, 1] - z[None, :, 1]) ** 2)
    d[held[:, None] == held[None]] = np.inf
    return y[np.argsort(d, axis=1, kind="stable")[:, :k]].mean(axis=1)


def test_votes_of_copies_ties_and_folds_in_a_row():
    """Copies, equal distances, far rows, and a region whose rows are all of one fold, against brute force."""
    from algoscape.functions.neighbours import Voters

    r = np.random.default_rng(6)
    z = np.concatenate([r.integers(0, 4, (300, 2)).astype(float), np.zeros((150, 2)), r.normal(20, 1, (200, 2)), [[1e4, 0]]])
    y, held = r.random((len(z), 2)) < 0.4, r.integers(0, 3, (len(z), 2))
    held[450:650, 0] = 1
    got = Voters(z, y, held, 5).shares(z, held, [[1, 5], [3]])
    for j, k, share in ((0, 1, got[0][:, 0]), (0, 5, got[0][:, 1]), (1, 3, got[1][:, 0])):
        assert share.tolist() == pytest.approx(_brute_shares(z, y[:, j], held[:, j], k).tolist())
    # two rows vote where five are asked; none vote in a table without others
    assert Voters(z[:3], y[:3], np.array([[0], [1], [1]]), 5).shares(z[:1], np.array([[0]]), [[5], [5]])[0][0, 0] == y[1:3, 0].mean()
    assert Voters(z[:0], y[:0], held[:0], 5).shares(z[:1], held[:1], [[5], [5]])[0][0, 0] == 0
    assert Voters(z[:2], y[:2], np.zeros((2, 1)), 5).shares(z[:2], np.zeros((2, 1)), [[5], [5]])[0].tolist() == [[0], [0]]


@pytest.fixture(scope="module")
def many_placed(spark):
    """3,400 rows, more than models were fitted on before: noisy flags, copies and ties."""
    r = np.random.default_rng(12)
    z = np.round(np.concatenate([r.normal(0, 1, (3300, 2)), np.zeros((100, 2))]), 2)
    y = (z[:, 0] + r.normal(0, 1, len(z)) > 0)
    rows = [(f"{i:05d}", float(a), float(b), bool(g)) for i, ((a, b), g) in enumerate(zip(z, y, strict=True))]
    return z, y, spark.createDataFrame(rows, "instances string, z_1 double, z_2 double, good_x boolean")


def test_knn_models_take_all_rows(spark, many_placed, tmp_path):
    z, y, df = many_placed
    model, got = predict.train(df, ["good_x"], folds=3)
    held = predict._dealt(y[:, None], 3)[:, 0]
    shares = {k: _brute_shares(z, y, held, k) for k in (1, 3, 5, 7, 9)}
    k = min(shares, key=lambda k: (((shares[k] > 0.5) != y).mean(), k))
    assert model["models"][0]["k"] == k and model["rows"].count() == len(z)
    assert [(x.hat_good_x, x.prob_good_x) for x in got.orderBy("instances").collect()] == [(s > 0.5, pytest.approx(s)) for s in shares[k].tolist()]
    # a stored model votes with all rows too
    Model(Options(), ["algo_x"], [], [], [], [], [], prediction=model).save(spark, str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m")).prediction
    scored = predict.score(df.unionByName(spark.createDataFrame([("none", None, 0.0, False)], df.schema)), again).orderBy("instances").collect()
    want = _brute_shares(z, y, np.arange(len(z)) * 0 + np.nan, k)
    assert [x.prob_good_x for x in scored[:-1]] == pytest.approx(want.tolist()) and scored[-1].hat_good_x is None


def test_knn_losses_take_neighbours_from_all_rows(spark, many_placed):
    z, y, df = many_placed
    fold = predict.fold_of(5, 1)
    held = np.array([x.f for x in df.select("instances", fold.alias("f")).orderBy("instances").collect()])
    got = predict.knn_losses(df, {(0, 1): (["z_1", "z_2"], np.eye(2))}, ["good_x"], fold)[0, 1]
    assert got == pytest.approx(((_brute_shares(z, y, held, 3) > 0.5) != y).mean(), abs=1e-12)


def test_stream_is_scored_by_all_rows(spark, many_placed, tmp_path):
    z, y, df = many_placed
    model, _ = predict.train(df, ["good_x"], folds=3, parameters=[[5.0]])
    df.write.parquet(str(tmp_path / "in"))
    scored = predict.score(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model)
    scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("instances").collect()
    assert [x.prob_good_x for x in got] == pytest.approx(_brute_shares(z, y, np.full(len(z), np.nan), 5).tolist())


def test_run_counts_votes_of_all_rows(spark, many_placed):
    """The prediction step of a training run: chosen k and accuracy as by brute force over all rows."""
    from algoscape.plans import build

    z, y, df = many_placed
    rows = df.withColumns({"row_id": F.col("instances").cast("long"), "algo_x": F.when(F.col("good_x"), 1.0).otherwise(2.0), "best_perf": F.lit(1.0)})
    run = build.Run(Options(prediction=Prediction(folds=3)), rows, rows, [], ["algo_x"], rows, model=Model(Options(), ["algo_x"], [], [], [], [], []))
    build._predict(run, ["good_x"], Tables(spark, "t"))
    held = predict._dealt(y[:, None], 3)[:, 0]
    right = {k: ((_brute_shares(z, y, held, k) > 0.5) == y).mean() for k in (1, 3, 5, 7, 9)}
    k = max(right, key=lambda k: (right[k], -k))
    got = {r.algorithm: r for r in run.prediction.collect()}["x"]
    assert (got.parameter_1, got.accuracy) == (k, pytest.approx(100 * right[k], abs=0.0501))


def test_knn_relational_form_equals_memory_form(spark):
    r = random.Random(8)
    rows = [(f"{i:03d}", r.random(), r.random(), r.random() < 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "instances string, z_1 double, z_2 double, g boolean")
    got = {x.instances: x.share_g for x in predict.knn_predict(df, df, ["z_1", "z_2"], ["g"], 3).collect()}
    z, y = np.array([x[1:3] for x in rows]), np.array([[float(x[3])] for x in rows])
    assert got == pytest.approx({x[0]: v for x, v in zip(rows, predict._knn_vote(z, y, z, 3)[:, 0], strict=True)})
    for metric in ("cityblock", "chebychev"):
        assert predict.knn_predict(df, df, ["z_1", "z_2"], ["g"], 1, metric=metric).where("share_g not in (0, 1)").count() == 0


# ---- geometry
def square(x, y, w=1.0, h=1.0):
    return Region([np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]])])


def test_region_algebra():
    a, b = square(0, 0), square(0.5, 0)
    assert a.area() == 1 and a.subtract(b).area() == pytest.approx(0.5)
    assert a.intersect(b).area() == pytest.approx(0.5) and a.union(b).area() == pytest.approx(1.5)
    assert a.contains([[0, 0], [1, 0.5], [1.1, 0.5]]).tolist() == [True, True, False]
    r = np.random.default_rng(3)
    for _ in range(30):
        p, q = Region([convex_hull(r.random((6, 2)))]), Region([convex_hull(r.random((6, 2)))])
        both, rest = p.intersect(q), p.subtract(q)
        assert both.area() + rest.area() == pytest.approx(p.area(), abs=1e-9)
        assert p.union(q).area() == pytest.approx(p.area() + q.area() - both.area(), abs=1e-9)
    assert len(a.union(square(1, 0)).parts()) == 1 and len(a.union(square(3, 0)).parts()) == 2
    assert not square(0, 0, 1.0, 1e-6).without_slivers(1e-3)
    assert not Region().union(Region()) and Region().area() == 0


def test_triangulation_and_boundary():
    r = np.random.default_rng(5)
    pts = r.random((200, 2))
    tri = delaunay(pts)
    total = sum(area(pts[t]) for t in tri)
    assert total == pytest.approx(area(convex_hull(pts)), rel=1e-3)
    tight = tight_boundary(pts)
    assert tight.contains(pts).all() and tight.area() <= total + 1e-9 and len(tight.parts()) == 1
    ring = np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, 2 * math.pi * 0.8, 60)])
    ring = np.vstack([ring, 0.8 * ring])
    assert tight_boundary(ring).area() < 0.6 * area(convex_hull(ring))
    assert not tight_boundary(np.array([[0, 0], [1, 1], [2, 2]]))
    assert delaunay(np.array([[x, y] for x in range(5) for y in range(5)], dtype=float)).shape[0] == 32


# ---- footprints
def test_components_on_a_line(spark):
    xs = [0, 0.5, 1, 1.5, 2.2, 10]
    df = spark.createDataFrame([(f"p{i}", float(x), 0.0) for i, x in enumerate(xs)], "instances string, z_1 double, z_2 double")
    got = {r.instances: r["class"] for r in footprint.components(df, 1.0, 3).collect()}
    assert got == {"p0": 1, "p1": 1, "p2": 1, "p3": 1, "p4": 1, "p5": -1}
    assert footprint.cluster(np.array([[x, 0.0] for x in xs]), 1.0, 3).tolist() == [1, 1, 1, 1, 1, -1]


def test_components_equal_memory_form(spark):
    r = random.Random(6)
    pts = [(f"{i:03d}", r.gauss(r.choice([0, 4, 9]), 0.7), r.gauss(0, 0.7)) for i in range(200)]
    df = spark.createDataFrame(pts, "instances string, z_1 double, z_2 double")
    got = {x.instances: x["class"] for x in footprint.components(df, 0.5, 4).collect()}
    mem = footprint.cluster(np.array([p[1:] for p in pts]), 0.5, 4)
    assert got == {p[0]: c for p, c in zip(pts, mem.tolist(), strict=True)}


def test_purity_keeps_empty_triangles():
    t = Region([np.array([[0, 0], [1, 0], [0, 1]])]), Region([np.array([[5, 5], [6, 5], [5, 6]])])
    z = np.array([[0.1, 0.1], [0.2, 0.2], [0.3, 0.3], [0.2, 0.1]])
    assert not footprint.prune(t[0], z, np.array([True, True, False, False]), 0.55)
    assert footprint.prune(t[0], z[:3], np.array([True, True, False]), 0.55)
    assert footprint.prune(t[1], z, np.ones(4, dtype=bool), 0.55)


def test_contradictions_are_settled():
    a, b = square(0, 0, 2, 2), square(1, 0, 2, 2)
    r = np.random.default_rng(2)
    z = r.random((600, 2)) * [3, 2]
    one, two = z[:, 0] < 1.8, z[:, 0] >= 1.8
    x, y = footprint.contradict(a, b, z, one, two, 0.55)
    assert x.intersect(y).area() < 1e-6
    assert x.area() > 1.5
    same = footprint.contradict(a, b, z, np.ones(600, dtype=bool), np.ones(600, dtype=bool), 0.55)
    assert same[0].area() == a.area() and same[1].area() == b.area()


def test_footprints_cover_what_is_good(spark):
    r = random.Random(9)
    rows = [(str(i), r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "instances string, z_1 double, z_2 double")
    df = df.withColumns({"good_x": F.col("z_1") > 0, "good_y": F.col("z_1") <= 0.1, "best": F.when(F.col("z_1") > 0, 1).otherwise(2), "easy": F.lit(False)})
    t = footprint.footprints(df, ["algo_x", "algo_y"], ["good_x", "good_y"], "best", "easy")
    got = {(x.kind, x.algo): x for x in t.collect()}
    assert got["space", ""].purity == 1.0 and got["space", ""].elements > 480
    assert got["good", "algo_x"].purity > 0.9 and 1.5 < got["good", "algo_x"].area < 2.2
    assert got["hard", ""].good_elements == got["hard", ""].elements
    s = {x.algo: x for x in footprint.summary(t).collect()}
    assert 0.4 < s["algo_x"].area_normalized_good < 0.6
    again = {(x.kind, x.algo): x for x in footprint.assess(df, t, ["algo_x", "algo_y"], ["good_x", "good_y"], "best", "easy").collect()}
    assert again["good", "algo_x"].elements == got["good", "algo_x"].elements
    none = footprint.assess(df.withColumn("good_x", F.lit(False)), t, ["algo_x", "algo_y"], ["good_x", "good_y"], "best", "easy")
    assert none.where("kind = 'good' and algo = 'algo_x' and elements = 0 and purity = 0").count() == 1


def test_shapes_come_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(footprint, "SHAPE_POINTS", 100, raising=False)
    r = random.Random(21)
    rows = [(str(i), r.uniform(-1, 1), r.uniform(-1, 1), i < 60) for i in range(900)]
    rows = [(n, x / 20 + 0.5, y / 20 + 0.5, y_good) if y_good else (n, x, y, False) for n, x, y, y_good in rows]
    df = spark.createDataFrame(rows, "instances string, z_1 double, z_2 double, good_y boolean")
    df = df.withColumns({"good_x": F.col("z_1") > 0, "best": F.when(F.col("good_y"), 2).otherwise(1), "easy": F.lit(True)})
    got = {(x.kind, x.algo): x for x in footprint.footprints(df, ["algo_x", "algo_y"], ["good_x", "good_y"], "best", "easy").collect()}
    assert got["good", "algo_y"].good_elements >= 20 and got["good", "algo_y"].purity >= 0.55
    z = np.array([x[1:3] for x in rows])
    for algo, good in (("algo_x", z[:, 0] > 0), ("algo_y", np.array([x[3] for x in rows]))):
        own = np.unique(z[good], axis=0)
        k = footprint.least_neighbours(len(own))
        classes = footprint.cluster(own, footprint.neighbour_radius(len(own), tuple(np.ptp(own, axis=0)), k), k)
        shapes = [footprint.prune(footprint.outline(own[classes == c]), z, good, 0.55) for c in range(1, classes.max() + 1)]
        want = footprint._union(shapes).without_slivers(footprint.SLIVER / 5)
        x = got["good", algo]
        assert x.area == pytest.approx(want.area()) and x.elements == want.contains(z).sum() and x.good_elements == (want.contains(z) & good).sum()


def test_pieces_hold_the_same_points_as_one_by_one_tests():
    r = np.random.default_rng(3)
    pts = r.random((400, 2))
    region, z = tight_boundary(pts), np.vstack([r.random((2000, 2)) * 1.4 - 0.2, pts])
    want = np.zeros(len(z), dtype=bool)
    for p in region.pieces:
        side = [(b[0] - a[0]) * (z[:, 1] - a[1]) - (b[1] - a[1]) * (z[:, 0] - a[0]) >= -1e-12 for a, b in zip(p, np.roll(p, -1, axis=0), strict=True)]
        want |= np.all(side, axis=0)
    assert (region.contains(z) == want).all() and want[2000:].all()


# ---- exports, options, runs
def test_colour_scale_rounds_half_up(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 1.0), (6.0, 1.0)], "a double, b double")
    assert [(r.a, r.b) for r in export.colour_scale(df, ["a", "b"]).collect()] == [(0, 0), (128, 0), (255, 0)]
    assert [r.a for r in export.colour_scale_global(df, ["a", "b"]).collect()] == [51, 153, 255]
    assert export.colour_table(spark).count() == 256


def test_colour_scale_keeps_whole_halves(spark):
    """255 * (21.47 - 15.67) / (22.63 - 15.67) is 212.5; divided first, it falls short of it."""
    df = spark.createDataFrame([(15.67,), (21.47,), (22.63,)], "a double")
    assert sorted(r.a for r in export.colour_scale(df, ["a"]).collect()) == [0, 213, 255]
    assert sorted(r.a for r in export.colour_scale_global(df, ["a"]).collect()) == [0, 213, 255]


def test_options_round_trip_and_migration():
    o = Options(performance=Performance(True, False, 0.1, 0.6), search=FeatureSearch(clusters=4))
    assert Options.from_json(o.to_json()) == o
    old = '{"perf": {"MaxMin": true, "epsilon": 0.3}, "general": {"betaThreshold": 0.7}, "oracle": {"cvfolds": 7}, "footprint": {"PI": 0.6}, "selvars": {"smallscaleflag": true, "smallscale": 0.2}}'
    m = Options.from_json(old)
    assert (m.performance.maximise, m.performance.beta_threshold, m.prediction.folds, m.footprints.purity, m.selection.holdout) == (True, 0.7, 7, 0.6, 0.2)
    with pytest.raises(ValueError):
        Options.from_json('{"nonsense": 1}')


def test_run_model_and_exports(spark, plane, tmp_path):
    from algoscape.plans import build

    df = plane.withColumn("algo_x", 5 + F.col("feature_a")).withColumn("algo_y", 5 - F.col("feature_a")).withColumn("algo_z", F.lit(100.0))
    o = Options(performance=Performance(False, False, 0.05), search=FeatureSearch(enabled=False), prediction=Prediction(folds=3))
    run = build.train(df, o)
    assert run.algos == ["algo_x", "algo_y"]  # never good: dropped
    assert run.rows.count() == 160 and run.rows.where("best_algo > 2").count() == 0
    s = {r.algorithm: r for r in run.prediction.collect()}
    assert s["x"].accuracy > 85 and s["Selector"].avg_all < 5
    names = run.export(str(tmp_path / "csv"))
    assert {"coordinates", "portfolio", "svm_table", "footprint_performance"} <= set(names)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "coordinates.csv")).count() == 160
    run.model.save(spark, str(tmp_path / "model"))
    model = Model.load(spark, str(tmp_path / "model"))
    again = build.explore(df.drop("algo_y"), model)
    assert again.rows.count() == 160 and "hat_good_y" in again.rows.columns
    both = again.rows.alias("a").join(run.rows.alias("b"), "instances").select(F.abs(F.col("a.z_1") - F.col("b.z_1")).alias("d"))
    assert both.agg(F.max("d")).first()[0] < 1e-9
    with pytest.raises(M.MissingInput):
        Model.load(spark, str(tmp_path / "none"))
    t = Tables(spark, "t")
    t.save(M.typed(df), "in")
    from algoscape.streaming.scoring import score_stream, write_scores

    out = score_stream(spark, f"{t.base}/in", M.typed(df).schema, model)
    write_scores(out.select("instances", "z_1", "selection1"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 160


def test_purification_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 1.0, True), (2, 0.05, 1.0, True), (3, 0.05, 9.0, False)], "row_id long, f double, y double, g boolean")
    verdict = subset.greedy_filter(df, ["f"], ["y"], ["g"], 0.1, "Ftr&AP")
    export.purification(df, verdict, str(tmp_path), "x")
    sizes = {n: spark.read.option("header", True).csv(str(tmp_path / f"{n}_x.csv")).count() for n in ("Pur", "Prec", "ViSA")}
    assert sizes == {"Pur": 2, "Prec": 1, "ViSA": 1}
    both = subset.purify(df, ["f"], ["y"], ["g"], [0.01, 0.1], "Ftr")
    assert {(r.radius, r.n) for r in both.where("removed").groupBy("radius").agg(F.count("*").alias("n")).collect()} == {(0.1, 2), (0.01, 1)}


def test_older_costs(spark, plane):
    df = plane.dropna().withColumn("good_x", F.col("feature_a") > 0)
    losses = selection.forest_losses(df, ["feature_a", "feature_b", "feature_c"], ["good_x"], [(0, 1), (1, 2)], trees=10, folds=2)
    assert losses[0, 1] < losses[1, 2]


def test_weights_and_failures(spark):
    df = spark.createDataFrame([("1", 1.0, 3.0), ("2", 2.0, None), ("3", 2.0, 2.0)], "instances string, algo_x double, algo_y double")
    got = labels.cost_weights(df, ["algo_x", "algo_y"]).orderBy("instances").collect()
    assert [(r.w_x, r.w_y) for r in got] == [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]
    inf = spark.createDataFrame([(float("inf"), 1.0, None)], "a double, b double, c double")
    assert tuple(M.recode_failures(inf, ["a", "b", "c"]).first()) == (0.0, 1.0, None)
    assert M.align_algorithms(df, ["algo_z", "algo_x"]).columns == ["instances", "algo_z", "algo_x", "algo_y"]


def test_weighted_run_with_kernel_machines(spark, plane):
    from algoscape.plans import build

    df = plane.withColumn("algo_x", 5 + F.col("feature_a")).withColumn("algo_y", 5 - F.col("feature_a"))
    o = Options(performance=Performance(False, False, 0.05), selection=Selection(algos=["algo_x", "algo_y"], holdout=0.8), search=FeatureSearch(clusters=3, rho=0.1), prediction=Prediction(knn=False, folds=2, weights=True, parameters=[[1.0, 0.5], [1.0, 0.5]]))
    run = build.train(df, o, with_footprints=False)
    assert run.rows.count() == 128
    assert {r.algorithm for r in run.prediction.collect()} == {"x", "y", "Oracle", "Selector"}


def test_density_subset_run(spark, plane):
    from algoscape.plans import build

    o = Options(performance=Performance(False, True, 4.0), selection=Selection(min_distance=0.9, distance_type="Ftr"), search=FeatureSearch(enabled=False))
    run = build.train(plane, o, with_footprints=False, with_prediction=False)
    assert 20 < run.rows.count() < 160


def test_nearest_rows_match_brute_force(spark):
    """Clusters, far outliers, ties, rows without a place, and folds, by widening cells."""
    from algoscape.functions.tables import Tables

    rng = np.random.default_rng(5)
    z = np.round(np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(50, 0.1, (300, 2)), [[1e4, -1e4], [0, 3e3]], rng.normal(0, 1, (20, 2))[[0] * 10]]), 3)
    rows = [(f"r{i:04d}", float(a), float(b), bool(i % 3), i % 4) for i, (a, b) in enumerate(z)] + [("x", None, 1.0, True, 0)]
    df = spark.createDataFrame(rows, "instances string, z_1 double, z_2 double, g boolean, fold int")
    for metric, norm in (("euclidean", lambda x: np.sqrt((x**2).sum(-1))), ("cityblock", lambda x: np.abs(x).sum(-1)), ("chebychev", lambda x: np.abs(x).max(-1))):
        got = {}
        near = subset.nearest_rows(df, df, ["z_1", "z_2"], 3, F.col("a.fold") != F.col("b.fold"), Tables(spark, "t"), carry=["g"], metric=metric)
        for r in near.collect():
            got.setdefault(r.instances, []).append((r["rank"], r.other, r.distance, r.g))
        d = norm(z[:, None] - z[None])
        for i in range(len(z)):
            order = sorted((round(d[i, j], 9), f"r{j:04d}") for j in range(len(z)) if j % 4 != i % 4)[:3]
            assert [round(x[2], 9) for x in sorted(got[f"r{i:04d}"])] == [x[0] for x in order]
        assert "x" not in got and all(g == bool(int(o[1:]) % 3) for v in got.values() for _, o, _, g in v)
    assert subset.top_neighbours(df.limit(0), ["z_1", "z_2"], 2).count() == 0
    assert subset.top_neighbours(df.where("instances < 'r0002'"), ["z_1", "z_2"], 3).count() == 2


def test_neighbours_of_copies_ties_and_shards(spark, monkeypatch):
    """Brute force over copies, equal distances, a label met twice, and several shards."""
    monkeypatch.setattr(subset, "SHARD_VALUES", 200)
    r = np.random.default_rng(8)
    x = np.concatenate([r.integers(0, 3, (150, 3)).astype(float), r.normal(0, 1, (80, 3)), np.zeros((40, 3)), [[1e3, 0, 0]]])
    names = [f"v{i * 7 % 271}" for i in range(len(x) - 1)] + ["v1"]
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, x, strict=True)], "instances string, a double, b double, c double")
    d = np.sqrt(((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2) + (x[:, None, 2] - x[None, :, 2]) ** 2)
    want = sorted((n, *p, rank) for i, n in enumerate(names) for rank, p in enumerate(sorted(((names[j], float(d[i, j])) for j in range(len(x)) if names[j] != n), key=lambda p: (p[1], p[0]))[:3], 1))
    got = sorted((t.instances, t.other, t.distance, t["rank"]) for t in subset.top_neighbours(df, ["a", "b", "c"], 3).collect())
    assert got == want
    near = sorted((t.instances, t.nearest) for t in subset.nearest_distances(df, ["a", "b", "c"]).collect())
    assert near == sorted((n, d) for n, _, d, rank in want if rank == 1)


def test_regions_of_many_pieces_take_seconds():
    """Two shapes of 4,000 triangles each, cut, joined and parted; piece by piece this took 19 s of processor time."""
    import time

    r = np.random.default_rng(1)
    a, b = (tight_boundary(r.normal(x, 1, (2000, 2))) for x in (0, 0.5))
    began = time.process_time()
    both, rest = a.intersect(b), a.subtract(b)
    assert both.area() + rest.area() == pytest.approx(a.area()) and a.overlaps(b) and not rest.overlaps(b, 1e-9)
    assert len(a.parts()) == 1 and len(a.union(b).parts()) == 1
    assert time.process_time() - began < 15


def test_cluster_in_memory_equals_all_pairs():
    r = np.random.default_rng(4)
    z = np.concatenate([r.normal(0, 1, (300, 2)), r.normal(0, 0.05, (100, 2)), r.uniform(-9, 9, (60, 2))])
    for radius, k in ((0.3, 4), (0.05, 20), (1.5, 60)):
        near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= radius * radius
        reach = near.copy()
        while (more := (reach.astype(np.float32) @ reach.astype(np.float32) > 0)).sum() > reach.sum():
            reach = more
        want, seen = np.full(len(z), -1), {}
        for i in np.flatnonzero(near.sum(axis=1) >= k + 1):
            seen.setdefault(int(np.argmax(reach[i])), len(seen) + 1)
        for i in range(len(z)):
            want[i] = seen.get(int(np.argmax(reach[i])), -1)
        assert footprint.cluster(z, radius, k).tolist() == want.tolist()


def test_footprints_on_the_driver_equal_scans(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(str(i), float(x), float(y), bool(x + r.normal() > 0), int(1 + (x > 0))) for i, (x, y) in enumerate(r.normal(0, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "instances string, z_1 double, z_2 double, good_x boolean, best int").withColumns({"good_y": ~F.col("good_x"), "easy": F.lit(False)})
    got = []
    for most in (1_000, 10):
        monkeypatch.setattr(footprint, "MEMORY_ROWS", most)
        got.append(sorted((x.kind, x.algo, x.elements, x.good_elements, round(x.area, 9)) for x in footprint.footprints(df, ["algo_x", "algo_y"], ["good_x", "good_y"], "best", "easy").collect()))
    assert got[0] == got[1]


def test_purity_sweep_has_all_levels(spark, monkeypatch):
    """The registered query settles 20 levels, each as footprints does on its own, with rows on the driver and by scans."""
    from algoscape.plans import queries as q

    r = np.random.default_rng(7)
    rows = [(str(i), float(x), float(y), *(bool(v > 0) for v in (x, y, -x, -y, x + y)), int(1 + (x + r.normal() > 0)), bool(y > 1)) for i, (x, y) in enumerate(r.normal(0, 1, (80, 2)))]
    df = spark.createDataFrame(rows, ["instances", "z_1", "z_2", *q.UG, "best_algo", "beta_easy"])
    monkeypatch.setattr(q, "_placed", lambda s, d: df)
    got = {x.purity_level: x.asDict() for x in q.QUERIES["purity_sweep"](spark, "").collect()}
    assert sorted(got) == [round(0.05 * i, 2) for i in range(20)]
    monkeypatch.setattr(footprint, "MEMORY_ROWS", 10)
    scanned = {x.purity_level: x.asDict() for x in footprint.purity_sweep(df, q.UA, q.UG, "best_algo", "beta_easy", [0.3, 0.9]).collect()}
    for level in (0.3, 0.9):
        own = footprint.summary(footprint.footprints(df, q.UA, q.UG, "best_algo", "beta_easy", level)).toPandas().drop(columns="algo").mean().to_dict()
        assert {k: v for k, v in got[level].items() if k != "purity_level"} == pytest.approx(own)
        assert scanned[level] == pytest.approx(got[level])
