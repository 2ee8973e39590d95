import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom import charts
from brightloom.__main__ import main
from brightloom.errors import InvalidParameter
from brightloom.functions import embeddings, text, wordnet
from brightloom.operators import joins, models, preprocessing
from brightloom.sources import files, generators


def test_sense_graph():
    g = wordnet.demo()
    assert g.synsets("dog") == ["dog"] and g.hypernyms("dog") == ("canine",) and g.hyponyms("animal") == ("canine", "feline")
    assert g.path_similarity("dog", "cat") == pytest.approx(0.2) and g.wu_palmer("dog", "cat") == pytest.approx(0.5) and g.wu_palmer("dog", "dog") == 1


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\nking 1.0 0.1\nqueen 0.9 0.2\napple 0.0 1.0\n")
    vectors = embeddings.read_word_vectors(spark, str(tmp_path / "v.txt"))
    assert [r.word for r in embeddings.most_similar(vectors, "king", 2).collect()] == ["queen", "apple"]
    assert embeddings.most_similar(vectors, "nothing").count() == 0


def test_subwords():
    codec = embeddings.SubwordCodec([("l", "o"), ("lo", "w</w>")], {"?": 0, "low</w>": 1, "lo": 2, "s</w>": 3})
    assert codec.encode("low los") == [1, 2, 3] and codec.decode([1, 2, 3]) == "low los"


def test_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0.9, "a"), (1, 1.0, 1.0, 10.0, 10.0, 0.8, "a"), (1, 50.0, 50.0, 5.0, 5.0, 0.7, "a")], "image int, x double, y double, width double, height double, score double, label string")
    assert embeddings.non_maximum_suppression(df, "image").count() == 2
    box = F.struct("x", "y", "width", "height")
    assert df.limit(1).select(embeddings.iou(box, box)).first()[0] == 1.0
    assert embeddings.dice(np.array([1, 1, 0]), np.array([1, 0, 0])) == pytest.approx(2 / 3)


def test_charts_and_cli(spark, tmp_path, capsys):
    assert "<svg" in charts.heat_map("m", ["a", "b"], np.eye(2)) and "polyline" in charts.line("roc", [0, 1], [0, 1]) and "0.5" in charts.bars("i", {"x": 0.5})
    (tmp_path / "a.csv").write_text("k,v\n2,x\n3,y\n")
    assert main(["summary", str(tmp_path / "a.csv")]) == 0 and "2 rows" in capsys.readouterr().out
    main(["convert", str(tmp_path / "a.csv"), str(tmp_path / "a.arrow")])
    main(["run", str(tmp_path / "a.arrow"), "filter k > 2 | select v"])
    assert "y" in capsys.readouterr().out


@pytest.mark.parametrize(("kind", "params"), [("decision_tree_regressor", {"maxDepth": 3}), ("random_forest_regressor", {"numTrees": 4, "maxDepth": 3, "seed": 1}), ("gbt_regressor", {"maxIter": 3, "maxDepth": 3, "seed": 1})])
def test_tree_shap(spark, kind, params):
    names = ["f0", "f1", "f2", "f3"]
    rows = generators.make_regression(spark, 60).select(*names, "target")
    model = models.estimator(kind, names, "target", **params).fit(rows).stages[-1]
    data = np.array(rows.select(*names).collect())
    trees = models.fitted_trees(model)

    def predict(x):
        inside = lambda box, r: all(low < r[j] <= high for j, (low, high) in box.items())
        return np.array([sum(w * v for w, leaves in trees for box, v in leaves if inside(box, r)) for r in x])

    # from the row's own columns, nulls and missing values included
    from pyspark.ml.linalg import Vectors

    assert predict(data[:5]) == pytest.approx([model.predict(Vectors.dense(r)) for r in data[:5]])
    found = np.array([r[0] for r in models.tree_shap_frame(rows.limit(5), names, model, data[10:20]).select("shap").collect()])
    some = np.array(rows.limit(5).select(*names).collect())
    assert found == pytest.approx(np.array([models.kernel_shap(predict, r, data[10:20]) for r in some]), abs=1e-6)  # all coalitions: exact
    empty = models.tree_shap_frame(rows.limit(0), names, model, data[:3])
    assert empty.count() == 0 and np.isfinite(models.tree_shap_frame(spark.createDataFrame([(None, 0.1, 0.2, 0.3)], "f0 double, f1 double, f2 double, f3 double"), names, model, data[:3]).first()["shap"]).all()


def test_recursive_elimination(spark):
    # b repeats a, so it matters only once a is gone: importances given once can't say that
    after = {("a", "b", "c"): {"a": 3.0, "b": 0.0, "c": 1.0}, ("a", "c"): {"a": 0.5, "c": 1.0}}
    assert preprocessing.recursive_elimination(["a", "b", "c"], 1, lambda left: after[tuple(left)]) == ["c"]
    rows = generators.make_regression(spark, 50)

    def fit(left):
        m = models.linear_regression(rows, left, "target")
        return {c: abs(w) for c, w in zip(m.columns, m.weights, strict=True)}

    assert len(preprocessing.recursive_elimination(["f0", "f1", "f2", "f3"], 2, fit)) == 2
    with pytest.raises(InvalidParameter):
        preprocessing.recursive_elimination(["a"], 0, fit)


def test_parse_csv(spark):
    df = files.parse_csv(spark, 'k,said,k\n1,"a ""b"",\nc",NA\n2,x\n\n')
    assert dict(df.dtypes) == {"k": "bigint", "said": "string", "k_1": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 'a "b",\nc', None), (2, "x", None)]
    assert files.parse_csv(spark, "").count() == 0 and files.parse_csv(spark, "a;b", delimiter=";").columns == ["a", "b"]
    with pytest.raises(InvalidParameter):
        files.parse_csv(spark, "a,b\n1\n", strict=True)


def test_csv_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("k,v\n" + "".join(f"{i},{i % 7}\n" for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = files.read_csv(spark, str(tmp_path / "big.csv"), quoted_newlines=False, kinds={"k": "bigint", "v": "bigint"}, infer=False)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 40_000 and df.agg({"k": "sum"}).first()[0] == 40_000 * 39_999 // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tensor_headers(spark, tmp_path):
    head = json.dumps({"__metadata__": {"format": "x"}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + bytes(24))
    assert [tuple(r)[1:] for r in files.tensor_headers(spark, str(tmp_path / "m.safetensors")).collect()] == [("w", "F32", [2, 3], 0, 24)]
    assert files.tensor_headers(spark, []).count() == 0


def test_tfidf_features(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, "b c"), (3, "c d")], "id int, t string")
    kept = text.tfidf(df, "id", text.whitespace_tokens(df.t), max_features=2).select("token").distinct()
    assert sorted(r[0] for r in kept.collect()) == ["b", "c"]


def test_tokens_counted_where_they_are(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(text, "ROWS", 3)
    rng = random.Random(4)
    rows = [(i % 40, " ".join(rng.choice(["the", "the", "a", "é", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 20)))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    want = Counter((i, w) for i, t in rows for w in (t or "").split())
    for frame in (df, df.dropDuplicates(["id"])):
        own = want if frame is df else Counter((r.id, w) for r in frame.collect() for w in (r.t or "").split())
        got = {(r.id, r.token): r.tf for r in text.count_vectors(frame, "id", text.whitespace_tokens(F.col("t"))).collect()}
        assert got == own
    words = {r.token: (r["count"], r.df) for r in text.vocabulary(df.select(text.whitespace_tokens(F.col("t")).alias("w")), "w").collect()}
    assert words["the"] == (sum(n for (_, w), n in want.items() if w == "the"), sum("the" in (t or "").split() for _, t in rows))


def test_joins_of_hot_keys(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i % 400}", i) for i in range(3000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "k string, i long").repartition(4)
    right = left.where("k is not null").groupBy("k").count().withColumn("x", F.length("k"))
    want = sorted((k, i, len(k)) for k, i in rows if k)
    for most in (100_000, 30, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        monkeypatch.setattr(joins.small, "__defaults__", (most, 1 << 20))
        assert sorted(map(tuple, joins.join_counted(left, right, ["k"], "count").select("k", "i", "x").collect())) == want
        assert sorted(map(tuple, joins.join_hot(left, right, "k").select("k", "i", "x").collect())) == want


@pytest.mark.parametrize("complement", [False, True])
def test_sparse_naive_bayes_equals_the_full_grid(spark, complement):
    rng = random.Random(6)
    rows = [(rng.choice("xyz"), [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    asked = [(i, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]) for i in range(40)] + [(None, ["a"])]
    model = text.naive_bayes(spark.createDataFrame(rows, "y string, w array<string>"), "y", "w", 0.5, complement)
    got = {r.k: r.y for r in text.naive_bayes_predict(spark.createDataFrame(asked, "k long, w array<string>"), "k", "w", model, "y", complement).collect()}
    n = {(t, c): sum(w.count(t) for y, w in rows if (y != c) == complement) for t in "abcdefgh" for c in "xyz"}
    total = {c: sum(n[t, c] for t in "abcdefgh") for c in "xyz"}
    weight = {(t, c): math.log((n[t, c] + 0.5) / (total[c] + 0.5 * 8)) for t, c in n}
    if complement:
        weight = {(t, c): v / sum(abs(weight[s, c]) for s in "abcdefgh") for (t, c), v in weight.items()}
    prior = {c: math.log(sum(y == c for y, _ in rows) / 60) for c in "xyz"}
    for k, w in asked:
        s = {c: sum(weight.get((t, c), 0) for t in w) for c in "xyz"}
        best = {c: -s[c] if complement else s[c] + prior[c] for c in "xyz"}
        top = max(best.values())
        assert got[k] in {c for c in best if best[c] >= top - 1e-9}
    pairs = sum(len(r.seen) for r in model.tokens.collect())
    assert pairs == len({(t, y) for y, w in rows for t in w}) and model.classes.count() == 3
