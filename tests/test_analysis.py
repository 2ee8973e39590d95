import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import series, special, text
from brightloom.functions import statistics as st
from brightloom.operators import evaluation as ev
from brightloom.operators import models as ml
from brightloom.operators import preprocessing as pp
from brightloom.operators import vectors as vec
from brightloom.sources import generators as gen


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.f_upper(4.0, 2, 20) == pytest.approx(0.0346, abs=1e-4)
    assert special.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)


def test_descriptive(spark):
    row = st.describe_column(column(spark, [1, 2, 2, 7, None]), "x").first()
    assert (row["count"], row.null_count, row.median, row.q25) == (4, 1, 2.0, 1.75)
    assert row.skewness == pytest.approx(0.6798, abs=1e-4) and row.kurtosis == pytest.approx(-1.7262, abs=1e-4)
    assert sorted(r.x for r in st.modes(column(spark, [1, 1, 2, 2, 3]), "x").collect()) == [1, 2]


def test_hypothesis_tests(spark):
    one = st.t_test(column(spark, [2.9, 3.0, 2.5, 2.8, 3.2, 3.0]), "x", 3.0)
    assert one["statistic"] == pytest.approx(-1.0351, abs=1e-3) and 0.3 < one["p_value"] < 0.4
    pairs = spark.createDataFrame([(5.0, 6.0), (6.0, 7.5), (7.0, 8.0), (4.0, 5.0), (8.0, 9.0)], "a double, b double")
    paired = st.t_test_paired(pairs, "a", "b")
    assert paired["statistic"] == pytest.approx(st.t_test(column(spark, [1, 1.5, 1, 1, 1]), "x")["statistic"])
    assert st.chi2_fit([10, 20, 30])["statistic"] == pytest.approx(10.0)
    assert 0 < st.shapiro_wilk(np.random.default_rng(0).normal(size=50))["p_value"] <= 1
    assert st.ks_normal(column(spark, np.random.default_rng(0).normal(size=200)), "x")["statistic"] < 0.1


def test_survival(spark):
    df = spark.createDataFrame(list(zip([5, 10, 15, 20, 25], [1, 0, 1, 1, 0], strict=True)), "d int, e int")
    got = [(r.time, r.at_risk, round(r.survival, 6)) for r in st.kaplan_meier(df, "d", "e").orderBy("time").collect()]
    assert got == [(5, 5, 0.8), (10, 4, 0.8), (15, 3, round(0.8 * 2 / 3, 6)), (20, 2, round(0.8 / 3, 6)), (25, 1, round(0.8 / 3, 6))]
    x = np.random.default_rng(1).normal(size=400)
    d = np.random.default_rng(2).exponential(np.exp(-0.7 * x))
    beta = st.cox_ph(spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(d, x, strict=True)], "d double, x double, e int"), "d", "e", ["x"])
    assert beta[0] == pytest.approx(0.7, abs=0.2)


def test_prefix_sums_cross_ranges(spark):
    rows = st.prefix_sums(spark.range(1000).withColumn("x", F.lit(2)), "id", {"s": F.col("x")}, partitions=7)
    assert all(r.s == 2 * (r.id + 1) for r in rows.collect())


def test_scalers_and_encoders(spark):
    df = spark.createDataFrame([(1.0, 10.0, "high"), (2.0, 20.0, "low"), (3.0, 30.0, "high")], "f1 double, f2 double, cat string")
    std = [r.f1 for r in pp.standard_scaler(df, ["f1"]).transform(df).orderBy("f2").collect()]
    assert std == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    model = pp.min_max_scaler(df, ["f1", "f2"])
    assert [r.f1 for r in model.inverse(model.transform(df)).orderBy("f2").collect()] == pytest.approx([1, 2, 3])
    codes = pp.fit_codes(df, ["cat"])
    assert [r.cat_code for r in codes.transform(df).orderBy("f2").collect()] == [0, 1, 0]
    assert [r.cat for r in codes.inverse(codes.transform(df).drop("cat"), "cat").orderBy("f2").collect()] == ["high", "low", "high"]
    other = df.withColumn("cat", F.lit("new"))
    with pytest.raises(Exception, match="unknown category"):
        codes.transform(other).collect()
    assert pp.fit_codes(df, ["cat"], unknown=-1).transform(other).first().cat_code == -1
    te = spark.createDataFrame(list(zip("AABBCA", [1.0, 1.0, 0.0, 0.0, 0.5, 1.0], strict=True)), "c string, y double")
    got = {r.c: r.c_target for r in pp.target_encode(te, "c", "y", 1.0).collect()}
    assert got["A"] == pytest.approx((3 + 3.5 / 6) / 4)


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, 3.0), (3.0, None)], "a double, b double")
    assert [pp.imputer(df, ["a"], s).values["a"] for s in ("mean", "median", "mostFrequent", "constant")] == pytest.approx([7 / 3, 3, 3, 0])
    filled = pp.knn_impute(df, ["a", "b"], df, k=1).where("b = 2").first()
    assert filled.a == 1.0  # both are as near: the smaller value
    # several tiles, against one row at a time
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 3)).round(1)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[0] = np.nan
    big = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "i int, a double, b double, c double")
    for weights in ("uniform", "distance"):
        got = {r.i: (r.a, r.b, r.c) for r in pp.knn_impute(big, ["a", "b", "c"], big, k=4, weights=weights).collect()}
        assert len(got) == 5000
        for i in np.flatnonzero(np.isnan(x).any(1)):
            n = (~np.isnan(x) & ~np.isnan(x[i])).sum(1)
            d = np.where(n > 0, np.sqrt(np.nansum((x - x[i]) ** 2, 1) * 2 / np.maximum(n, 1)), np.inf)
            for j in np.flatnonzero(np.isnan(x[i])):
                near = sorted((d[m], x[m, j]) for m in np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(d)))[:4]
                w = [1.0 if weights == "uniform" else 1 / (e + 1e-5) for e, _ in near]
                assert got[i][j] == pytest.approx(sum(a * v for a, (_, v) in zip(w, near, strict=True)) / sum(w) if near else 0.0)
    assert pp.knn_impute(big.limit(0), ["a", "b"], big, k=2).count() == 0
    assert pp.knn_impute(big.where("i = 0"), ["a", "b"], big.limit(0), k=2).first().a == 0.0
    bins = pp.kbins(df, ["b"], 2).transform(df).orderBy("b").select("b_bin").collect()
    assert [r[0] for r in bins] == [None, 0, 1, 1]
    lam = pp.power_transformer(spark.range(1, 200).select(F.exp(F.col("id") / 40).alias("x")), ["x"], "box-cox").params["x"][0]
    assert abs(lam) < 0.3


def test_resampling(spark):
    df = spark.range(90).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    assert {r.y: r["count"] for r in pp.undersample(df, "y", "id").groupBy("y").count().collect()} == {0: 9, 1: 9}
    assert {r.y: r["count"] for r in pp.smote(df, ["x"], "y").groupBy("y").count().collect()} == {0: 81, 1: 81}


def test_metrics_and_folds(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 0], strict=True)), "y int, p int")
    row = ev.classification_metrics(df, "y", "p").first()
    assert row.accuracy == 0.6 and row.precision == pytest.approx(2 / 3)
    ranked = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert ev.roc_auc(ranked, "y", "s").first()[0] == pytest.approx(0.75)
    folds = ev.k_fold(spark.range(10), "id", 3)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [3, 3, 4]
    train, test = next(iter(ev.time_series_split(spark.range(12), "id", 3)))
    assert max(r.id for r in train.collect()) < min(r.id for r in test.collect())
    out = ev.cross_validate(folds, lambda d: d.count(), lambda m, d: float(m))
    assert sum(out["scores"]) == 20


def test_text(spark):
    assert [text.porter_stem(w) for w in ("connecting", "connection", "connections", "relational", "hopping", "happy")] == ["connect", "connect", "connect", "relat", "hop", "happi"]
    assert text.sentiment_scores("I love this fantastic library!")[3] > 0.5 > 0 > text.sentiment_scores("Terrible awful broken")[3]
    assert text.sentiment_scores("This is a book")[3] == 0
    df = spark.createDataFrame([(1, "Hello world. It is me!"), (2, None), (3, "")], "id int, t string")
    got = df.select(text.sentences(F.col("t")).alias("s"), text.ngrams(text.alnum_tokens(F.col("t")), 1, 2).alias("g")).collect()
    assert got[0].s == ["Hello world.", "It is me!"] and got[1].s == [] and "hello world" in got[0].g
    two = spark.createDataFrame([(1, "hello world"), (2, "world brief")], "id int, t string")
    scores = {(r.id, r.token): r.tfidf for r in text.tfidf(two, "id", text.whitespace_tokens(F.col("t"))).collect()}
    assert scores[(1, "world")] == pytest.approx(0.5) and scores[(1, "hello")] == pytest.approx((math.log(1.5) + 1) / 2)
    train = spark.createDataFrame([("good", ["great", "fun"]), ("bad", ["awful", "dull"])], "y string, w array<string>")
    for complement in (False, True):
        model = text.naive_bayes(train, "y", "w", complement=complement)
        test = spark.createDataFrame([(1, ["great"]), (2, ["awful", "great", "awful"])], "k int, w array<string>")
        assert {r.k: r.y for r in text.naive_bayes_predict(test, "k", "w", model, "y", complement).collect()} == {1: "good", 2: "bad"}


def test_vector_store(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.7, 0.7])], "id string, vector array<double>")
    store = vec.VectorStore(rows)
    assert [r.id for r in store.search([1.0, 0.1], 2).collect()] == ["a", "c"]
    assert [r.id for r in store.search([0.0, 1.0], 1, "l2").collect()] == ["b"]
    more = store.add(spark.createDataFrame([("a", [0.0, 9.0])], "id string, vector array<double>"))
    assert more.get("a")["vector"] == [0.0, 9.0] and more.df.count() == 3
    assert not store.remove("a").contains("a") and store.clear().df.count() == 0


def test_clusters(spark):
    df = gen.make_clusters(spark, 150).select("id", F.array("f0", "f1").alias("v"), "label")
    centers = vec.kmeans(df, "v", 3)
    ari = vec.adjusted_rand(vec.assign(df, "v", centers), "label", "cluster").first()[0]
    assert ari > 0.95
    found = vec.dbscan(df, "id", "v", eps=1.5, min_samples=4).join(df, "id")
    assert vec.adjusted_rand(found, "label", "cluster").first()[0] > 0.9
    assert vec.silhouette(df, "id", "v", "label") > 0.5
    out = spark.createDataFrame([(999, [100.0, 100.0])], "id long, v array<double>")
    both = df.select("id", "v").union(out)
    assert vec.local_outlier_factor(both, "id", "v", k=10).orderBy(F.desc("lof")).first().id == 999
    assert vec.isolation_forest(both, "v", trees=30).orderBy(F.desc("anomaly")).first().id == 999
    model = vec.pca(df, "v", 2)
    x = np.array([r.v for r in df.collect()])
    assert model["variance"] == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    u, s, vt = vec.randomized_svd(x, 2)
    assert (u * s) @ vt == pytest.approx(x, abs=1e-8)


def test_series():
    t = np.arange(48)
    y = 10 + 0.5 * t + np.tile([1, -2, 3, -2], 12)
    d = series.decompose(y, 4)
    assert d["seasonal"][:4] == pytest.approx([1, -2, 3, -2]) and np.isnan(d["trend"][0])
    assert series.acf(y, 3)[0] == 1
    for bad in ([], [1.0, float("nan")] * 8, [1.0]):
        with pytest.raises(Exception, match="finite"):
            series.decompose(bad, 4)
    assert series.exponential_smoothing(y, 4, "holtWinters", 4)["forecast"] == pytest.approx(10 + 0.5 * np.arange(48, 52) + [1, -2, 3, -2], abs=0.5)
    line = 3.0 + 2 * t
    assert series.sarima(line, 3, (1, 1, 0))["forecast"] == pytest.approx(3 + 2 * np.arange(48, 51), abs=1e-6)
    assert series.piecewise_trend(line, 2)["forecast"] == pytest.approx([99, 101])
    assert series.koopman(line, 2)["forecast"] == pytest.approx([99, 101], abs=0.5)
    one = np.eye(1)
    assert series.kalman(np.full(50, 4.0), one, one, one * 1e-4, one, np.zeros(1), one, True)["smoothed"][-1][0] == pytest.approx(4, abs=0.2)
    assert series.fft_decompose(5 * np.sin(2 * np.pi * np.arange(64) / 8))["amplitudes"][0] == pytest.approx(5)


def test_models(spark, tmp_path):
    rows = gen.make_regression(spark, 300, noise=0.0)
    m = ml.linear_regression(rows, ["f0", "f1", "f2", "f3"], "target")
    assert m.weights == pytest.approx((1, 2, 3, 4)) and m.bias == pytest.approx(0, abs=1e-9)
    m.save(str(tmp_path / "m.json"))
    assert ml.LinearModel.load(str(tmp_path / "m.json")) == m
    data = gen.make_classification(spark, 300)
    for fit in (lambda: ml.logistic_regression(data, ["f0", "f1"], "label", rounds=20, rate=0.5), lambda: ml.linear_svc(data, ["f0", "f1"], "label", rounds=10)):
        assert ev.classification_metrics(fit().transform(data), "label", "prediction").first().accuracy > 0.8
    xs, ys = ml.isotonic(spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1)], "s double, y int"), "s", "y")
    assert list(ys) == sorted(ys)
    assert ml.kernel_shap(lambda x: x @ np.array([1.0, 2, 3]), np.ones(3), np.zeros((2, 3))) == pytest.approx([1, 2, 3])
    importances = ml.permutation_importance(rows, ["f0", "f3"], "target", m.transform)
    assert importances["f3"] > importances["f0"] > 0
    assert ml.explain_text(lambda t: float("good" in t), "a good day")[0] == ("good", 1.0)


@pytest.mark.parametrize("tile", [2048, 7])
def test_pairs_of_tiles_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vec, "TILE", tile)
    x = np.random.default_rng(0).integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)] + [(99, None, 0)], "id long, v array<double>, label int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    found = {}
    for i, j, gap in vec.neighbours(df, "id", "v", k=4).collect():
        found.setdefault(i, []).append((gap, j))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted((d[i, j], j) for j in range(60) if j != i)[:4] for i in range(60)}
    assert {(r[0], r[1]) for r in vec.neighbours(df, "id", "v", radius=1.0).collect()} == {(i, j) for i in range(60) for j in range(60) if i != j and d[i, j] <= 1}
    label, scores = np.arange(60) % 3, []
    for i in range(60):
        means = [d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        scores.append((b - a) / max(a, b))
    assert vec.silhouette(df, "id", "v", "label") == pytest.approx(np.mean(scores))
    assert vec.neighbours(df.limit(0), "id", "v", k=4).count() == 0
