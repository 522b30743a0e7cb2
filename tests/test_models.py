import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blotter import ml
from blotter.ml import neighbours
from blotter.storage import materialize, shared_dir

FEATURES = ["a", "b", "c"]
FOUR = ["IUCR", "Primary_Type", "Domestic", "FBI_Code"]


def make_rows(n, seed, hot=0.0):
    """(id, a, b, c, label) rows; a share of `hot` is one single combination."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rng.uniform() < hot:
            a, b, c = "0", "0", "0"
        else:
            a, b, c = (str(rng.integers(0, k)) for k in (4, 7, 3))
        label = int((int(a) + int(b)) % 3 == 0) if rng.uniform() < 0.9 else int(rng.integers(0, 2))
        rows.append((i, a, b, c, label))
    return rows


def brute_neighbours(query, base, k):
    ranked = sorted((math.sqrt(2 * sum(x != y for x, y in zip(query, b[1:4]))), b[0], b[4]) for b in base)
    return ranked[:k]


@pytest.fixture(scope="module")
def rows(spark):
    data = make_rows(900, seed=3, hot=0.4)
    return data, spark.createDataFrame(data, "id long, a string, b string, c string, label int")


def test_split_and_folds_are_stable(rows):
    _, df = rows
    train, test = ml.split_by_hash(df, "id")
    assert train.count() + test.count() == 900
    assert abs(train.count() / 900 - 0.8) < 0.05
    assert train.join(test, "id").count() == 0
    folds = ml.folds_by_hash(df, "id", 5).groupBy("fold").count().collect()
    assert {r.fold for r in folds} == set(range(5)) and min(r["count"] for r in folds) > 100


def test_modes_take_the_lowest_of_equals(table):
    df = table([("b", "x"), ("a", None), (None, None), ("b", "y"), ("a", "y")], "p string, q string")
    modes = {r.column: r.value for r in ml.mode_values(df, ["p", "q"]).collect()}
    assert modes == {"p": "a", "q": "y"}
    filled = ml.apply_modes(df, ml.mode_values(df, ["p", "q"]), ["p", "q"])
    assert [r.p for r in filled.collect()] == ["b", "a", "a", "b", "a"]
    assert filled.filter("q IS NULL").count() == 0


def test_unseen_categories_are_all_zero(table):
    train = table([("a",), ("c",), ("b",)], "k string")
    df = table([("a",), ("b",), ("c",), ("z",), (None,)], "k string")
    got = [r.position for r in ml.one_hot_positions(train, df, "k").collect()]
    assert got == [0, 1, 2, None, None]


def test_metrics_against_numpy(table):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    score = np.where(rng.uniform(0, 1, 500) < 0.3, 0.5, (y * 0.3 + rng.uniform(0, 1, 500)).round(2))
    guess = (score > 0.6).astype(int)
    df = table(
        [(int(a), int(b), float(s)) for a, b, s in zip(y, guess, score)],
        "label int, prediction int, score double",
    )
    cells = {(r.label, r.prediction): r.n for r in ml.confusion_matrix(df).collect()}
    assert cells == {(a, b): int(((y == a) & (guess == b)).sum()) for a in (0, 1) for b in (0, 1)}
    report = {r["class"]: r for r in ml.classification_report(df).collect()}
    precision = cells[1, 1] / (cells[0, 1] + cells[1, 1])
    recall = cells[1, 1] / (cells[1, 0] + cells[1, 1])
    assert report["1"].precision == pytest.approx(precision)
    assert report["1"].f1 == pytest.approx(2 * precision * recall / (precision + recall))
    assert report["macro avg"].recall == pytest.approx((recall + report["0"].recall) / 2)
    head = ml.headline_scores(df).first()
    assert head.accuracy == pytest.approx((y == guess).mean())
    assert head.f1_positive == pytest.approx(report["1"].f1)

    pos, neg = score[y == 1], score[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    auc = ml.roc_auc(df).first().auc
    assert auc == pytest.approx(wins / (len(pos) * len(neg)))
    turned = df.withColumn("score", -F.col("score"))
    assert ml.roc_auc(turned).first().auc == pytest.approx(1 - auc)
    curve = ml.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert len(curve) == len(set(score)) + 1
    assert (curve[0].fpr, curve[0].tpr) == (0.0, 0.0) and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)
    for r in curve[1:]:
        assert r.tpr == pytest.approx((pos >= r.threshold).mean())


def test_absent_class_gives_zero_not_an_error(table):
    df = table([(0, 0), (0, 0)], "label int, prediction int")
    report = {r["class"]: r for r in ml.classification_report(df).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].support) == (0.0, 0.0, 0)


@pytest.mark.parametrize("k", [1, 4, 15])
def test_neighbours_match_brute_force(rows, k):
    data, df = rows
    base, asked = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    near = ml.knn_join(asked, base, FEATURES, "id", "label", k).collect()
    pool = [r for r in data if r[0] % 3]
    combos = {r[1:4] for r in data if r[0] % 3 == 0}
    assert len(near) == len(combos) * k
    got = {}
    for r in near:
        got.setdefault((r.a, r.b, r.c), []).append((r["rank"], r.distance, r.neighbour, r.label))
    for combo in combos:
        want = brute_neighbours(combo, pool, k)
        have = [(d, i, y) for _, d, i, y in sorted(got[combo])]
        assert [(i, y) for _, i, y in have] == [(i, y) for _, i, y in want]
        assert np.allclose([d for d, *_ in have], [d for d, *_ in want])


def test_neighbours_of_a_query_without_any_match(table):
    base = table([(i, "x", "y", i % 2) for i in range(4)], "id long, a string, b string, label int")
    asked = table([(9, "u", "v", 0)], "id long, a string, b string, label int")
    near = ml.knn_join(asked, base, ["a", "b"], "id", "label", 3).orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in near] == [
        (i, pytest.approx(2**0.5)) for i in range(3)
    ]


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_votes_match_brute_force(rows, weights):
    data, df = rows
    base, asked = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    pool = [r for r in data if r[0] % 3]
    found = {r.id: r for r in ml.knn_classify(asked, base, FEATURES, "id", "label", 8, weights).collect()}
    assert len(found) == sum(r[0] % 3 == 0 for r in data)
    for row in data:
        if row[0] % 3:
            continue
        near, votes = brute_neighbours(row[1:4], pool, 8), Counter()
        for distance, _, label in near:
            if weights == "uniform":
                votes[label] += 1.0
            elif near[0][0] == 0:
                votes[label] += distance == 0
            else:
                votes[label] += 1 / distance
        score = votes[1] / sum(votes.values())
        assert found[row[0]].score == pytest.approx(score)
        assert found[row[0]].prediction == int(votes[1] > votes[0])


def test_neighbour_grid_matches_single_runs(rows):
    _, df = rows
    grid = {"k": [1, 4], "weights": ["uniform", "distance"], "folds": 3}
    report = {(r.k, r.weights): r.accuracy for r in ml.knn_grid(df, FEATURES, "id", "label", grid).collect()}
    assert len(report) == 4
    folds = ml.folds_by_hash(df, "id", 3)
    scores = []
    for f in range(3):
        held = folds.filter(F.col("fold") == f)
        found = ml.knn_classify(held, folds.filter(F.col("fold") != f), FEATURES, "id", "label", 4, "distance")
        right = F.avg((F.col("prediction") == F.col("label")).cast("int"))
        scores.append(found.join(held.select("id", "label"), "id").agg(right).first()[0])
    assert report[4, "distance"] == pytest.approx(np.mean(scores))


def test_logistic_learns_the_label(rows):
    _, df = rows
    train, test = ml.split_by_hash(df, "id")
    search = ml.logistic_search(train, FEATURES, "label", "id", {"C": [0.1, 5.0], "folds": 3})
    assert search.report.count() == 2 and search.report.filter("is_best").count() == 1
    scored = ml.score(search, test, "id", "label")
    assert scored.count() == test.count()
    assert ml.headline_scores(scored).first().accuracy > 0.7


def test_a_search_fits_on_one_row_per_combination_without_names(rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from blotter.ml.models import _encoded

    _, df = rows
    cells = ml.compress(ml.folds_by_hash(df, "id", 3), [*FEATURES, "label", "fold"])
    encoding = ml.encoder(FEATURES).fit(cells)
    encoded = _encoded(cells, FEATURES, encoding, 3)
    assert encoded.count() == df.select(*FEATURES, "label").distinct().count() < cells.count()
    assert encoded.schema["features"].metadata == {}
    assert sum(encoded.agg(*[F.sum(f"fold_{i}") for i in range(3)]).first()) == df.count()

    search = ml.logistic_search(df, FEATURES, "label", "id", {"C": [0.5], "folds": 3})
    plain = LogisticRegression(
        regParam=1 / (0.5 * df.count() * 2 / 3), standardization=False, weightCol="weight", maxIter=1000
    )
    scorer = MulticlassClassificationEvaluator(metricName="accuracy", weightCol="weight")
    whole = encoding.transform(cells)
    accuracies = [
        scorer.evaluate(plain.fit(whole.filter(F.col("fold") != i)).transform(whole.filter(F.col("fold") == i)))
        for i in range(3)
    ]
    assert search.report.first().accuracy == pytest.approx(np.mean(accuracies))


def test_a_fold_without_rows_is_refused(table):
    few = table([(1, "x", 0)], "id long, a string, label int")
    with pytest.raises(ValueError, match="fold . is empty"):
        ml.logistic_search(few, ["a"], "label", "id", {"C": [1.0], "folds": 2})


def test_weights_give_the_same_logistic_model_as_rows(rows):
    from pyspark.ml.classification import LogisticRegression

    _, df = rows
    encoding = ml.encoder(FEATURES).fit(df)
    plain = LogisticRegression(regParam=0.01, standardization=False, tol=1e-9, maxIter=1000)
    by_row = plain.fit(encoding.transform(df))
    packed = encoding.transform(ml.compress(df, [*FEATURES, "label"]))
    by_weight = plain.copy({plain.weightCol: "weight"}).fit(packed)
    assert np.allclose(by_row.coefficients.toArray(), by_weight.coefficients.toArray(), atol=1e-4)


def test_shared_passes_end_at_the_optimum_of_the_single_fits(table, monkeypatch):
    from blotter.ml import logistic, models

    rng = np.random.default_rng(11)
    data = []
    for i in range(1500):
        a, b = (str(rng.integers(0, k)) for k in (9, 4))
        # Some values occur once, one of them with a missing neighbour, and one value decides the label.
        c = f"once{i}" if i % 50 == 0 else str(rng.integers(0, 5))
        label = 0 if a == "3" else int(rng.uniform() < 0.2 + 0.6 * ((int(a) + int(b)) % 3 == 0))
        data.append((i, a, None if i % 97 == 0 else b, c, label))
    df = table(data, "id long, a string, b string, c string, label int")
    grid = {"C": [0.1, 5.0], "folds": 3}
    single = ml.logistic_search(df, FEATURES, "label", "id", grid)
    # Several tasks and blocks, and requests in several jobs.
    monkeypatch.setattr(models, "FEW_ROWS", 0)
    monkeypatch.setattr(logistic, "TASK_ROWS", 60)
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 25)
    monkeypatch.setattr(logistic, "MOST_SUMS", 1500)
    passes = []
    answers = logistic._answers
    monkeypatch.setattr(logistic, "_answers", lambda d, asked: passes.append(len(asked)) or answers(d, asked))
    shared = ml.logistic_search(df, FEATURES, "label", "id", grid)
    # The fits share their passes, so there are far fewer of these than steps of all fits.
    assert max(passes) == 6 and len(passes) < 150
    assert shared.best == single.best and shared.features == single.features
    want, got = ({r.C: (r.accuracy, r.is_best) for r in s.report.collect()} for s in (single, shared))
    assert {c: b for c, (_, b) in want.items()} == {c: b for c, (_, b) in got.items()}
    for c, (accuracy, _) in want.items():
        assert got[c][0] == pytest.approx(accuracy, abs=2e-3)
    before, now = ({r.id: r for r in ml.score(s, df, "id", "label").collect()} for s in (single, shared))
    assert before.keys() == now.keys() and len(now) == 1500
    assert max(abs(before[i].score - now[i].score) for i in now) < 1e-4
    residuals = {(r.feature, r.value): r.residual for r in ml.logistic_optimality(shared, df, "label").collect()}
    assert max(map(abs, residuals.values())) < 1e-4


def test_shared_passes_take_one_class_and_refuse_an_empty_fold(table, monkeypatch):
    from blotter.ml import models

    monkeypatch.setattr(models, "FEW_ROWS", 0)
    same = table([(i, str(i % 3), 1) for i in range(40)], "id long, a string, label int")
    search = ml.logistic_search(same, ["a"], "label", "id", {"C": [1.0], "folds": 2})
    assert search.report.first().accuracy == 1.0
    assert {(r.prediction, r.score) for r in ml.score(search, same, "id", "label").collect()} == {(1, 1.0)}
    few = table([(1, "x", 0)], "id long, a string, label int")
    with pytest.raises(ValueError, match="fold . is empty"):
        ml.logistic_search(few, ["a"], "label", "id", {"C": [1.0], "folds": 2})


def test_a_search_reads_its_training_rows_once(rows, table, monkeypatch):
    from blotter.ml import models

    gappy = table(
        [(1, "x", "p", 1), (2, None, "q", 0), (3, "y", None, 1), (4, "y", "q", 1), (5, "x", None, 0), (6, "x", "p", 1)],
        "id long, a string, b string, label int",
    )
    features, modes, each = models._training_counts(gappy, ["a", "b"], "label", "id", 2)
    assert features == ["a", "b"] and {r["column"]: (r.value, r.n) for r in modes.collect()} == {
        r["column"]: (r.value, r.n) for r in ml.mode_values(gappy, ["a", "b"]).collect()
    }
    cells = models._cells(gappy, modes, features, "label", "id", 2).collect()
    got = {(r.a, r.b, r.label): (r.weight, r.fold_0, r.fold_1) for r in each.collect()}
    want = {}
    for r in cells:
        total = want.setdefault((r.a, r.b, r.label), [0.0, 0.0, 0.0])
        total[0] += r.weight
        total[1 + r.fold] += r.weight
    assert got == {k: tuple(v) for k, v in want.items()}
    # The larger search does not come back to the rows.
    monkeypatch.setattr(models, "FEW_ROWS", 0)
    monkeypatch.setattr(models, "_cells", None)
    ml.logistic_search(rows[1], FEATURES, "label", "id", {"C": [1.0], "folds": 2})


def test_tree_learns_and_scores_unseen_and_missing(rows, table):
    _, df = rows
    grid = {"max_depth": [1, 10], "min_leaf": [1], "folds": 3}
    search = ml.tree_search(df, FEATURES, "label", "id", grid)
    assert search.best["max_depth"] == 10
    odd = table([(1, "new", "1", None, 1)], "id long, a string, b string, c string, label int")
    row = ml.score(search, odd, "id", "label").first()
    assert row.prediction in (0, 1) and 0 <= row.score <= 1


def test_profiles_of_equal_shape_share_a_group(table):
    shapes = {"m": (9, 1, 1), "n": (10, 1, 1), "x": (1, 1, 9), "y": (1, 1, 10)}
    cells = table(
        [(k, c, float(v)) for k, row in shapes.items() for c, v in enumerate(row)],
        "row_key string, col_key int, z double",
    )
    group = {r.row_key: r.cluster for r in ml.group_profiles(cells, [0, 1, 2], "z", 2).collect()}
    assert group["m"] == group["n"] != group["x"] == group["y"]


def test_groups_match_brute_force(table):
    rng = np.random.default_rng(12)
    keys = [f"r{i:03d}" for i in range(60)]
    points = {k: rng.normal(rng.integers(0, 4) * 1.2, 1, 5) for k in keys}
    cells = table(
        [(k, c, float(v)) for k, row in points.items() for c, v in enumerate(row)],
        "row_key string, col_key int, z double",
    )
    found = {r.row_key: r for r in ml.group_profiles(cells, list(range(5)), "z", 4, rounds=30).collect()}
    centres = [points[keys[0]]]
    while len(centres) < 4:
        centres.append(points[max(keys, key=lambda k: min(((points[k] - c) ** 2).sum() for c in centres))])
    for _ in range(30):
        own = {k: int(np.argmin([((points[k] - c) ** 2).sum() for c in centres])) for k in keys}
        centres = [np.mean([points[k] for k in keys if own[k] == g], axis=0) for g in range(4)]
    for k in keys:
        apart = sorted(((points[k] - c) ** 2).sum() for c in centres)
        assert found[k].distance == pytest.approx(apart[0], abs=1e-8)
        assert found[k].next_distance == pytest.approx(apart[1], abs=1e-8)
    same = {(found[k].cluster, own[k]) for k in keys}
    assert len(same) == 4
    firsts = [min(k for k in keys if found[k].cluster == g) for g in range(4)]
    assert firsts == sorted(firsts)


def test_fewer_shapes_than_groups_and_no_rows(table):
    schema = "row_key string, col_key int, z double"
    cells = table([("a", 0, 1.0), ("b", 0, 1.0), ("c", 1, 5.0), ("d", 0, None)], schema)
    rows = {r.row_key: r.cluster for r in ml.group_profiles(cells, [0, 1], "z", 9).collect()}
    assert rows["a"] == rows["b"] == 0 and len(set(rows.values())) == 3
    assert ml.group_profiles(table([], schema), [0, 1], "z", 2).count() == 0


def test_materialized_tables_live_in_the_shared_folder(spark):
    folder = shared_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured
    assert materialize(spark.range(3)).count() == 3


def test_an_unseen_value_is_all_zeros(table):
    base = table([(1, "x", "y", 1), (2, "x", "z", 0)], "id long, a string, b string, label int")
    asked = table([(9, "u", "y", 0)], "id long, a string, b string, label int")
    near = ml.knn_join(asked, base, ["a", "b"], "id", "label", 2).orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in near] == [(1, 1.0), (2, pytest.approx(3**0.5))]


@pytest.mark.parametrize("share", [2, 5, 100_000])
def test_hot_groups_are_dealt_without_loss(rows, monkeypatch, share):
    """Nearly all queries share two values, so a few groups get nearly all requests."""
    monkeypatch.setattr(neighbours, "HOT_SHARE", share)
    data, df = rows
    base = df.filter("id % 3 <> 0")
    asked = base.sparkSession.range(400).selectExpr(
        "id + 5000 AS id", "IF(id % 50 = 0, 'x', 'hot') AS a", "IF(id % 80 = 0, 'y', '1') AS b",
        "CAST(id AS string) AS c", "0 AS label",
    )
    near = ml.knn_join(asked, base, FEATURES, "id", "label", 3).collect()
    assert len(near) == 1200
    pool = [r for r in data if r[0] % 3]
    seen = [{r[1 + i] for r in pool} for i in range(3)]
    for r in near:
        combo = (r.a, r.b, r.c)
        unseen = sum(v not in s for v, s in zip(combo, seen))
        order = sorted((sum(x != y for x, y in zip(combo, p[1:4])), p[0]) for p in pool)
        apart, neighbour = order[r["rank"] - 1]
        assert r.neighbour == neighbour and r.distance == pytest.approx((2 * apart - unseen) ** 0.5)


def test_too_many_features_are_refused(table):
    df = table([(1, *"abcdefghijklm", 1)], "id long, " + ", ".join(f"f{i} string" for i in range(13)) + ", label int")
    with pytest.raises(ValueError, match="groups"):
        ml.knn_join(df, df, [f"f{i}" for i in range(13)], "id", "label", 1)


def test_rows_with_missing_features_are_classified(table):
    schema = "id long, a string, b string, label int"
    base = table([(1, "x", "y", 1), (2, "x", None, 1), (3, "v", "z", 0)], schema)
    asked = table([(7, None, "y", 0), (8, "v", "z", 0), (9, None, None, 0)], schema)
    found = {r.id: r.prediction for r in ml.knn_classify(asked, base, ["a", "b"], "id", "label", 1).collect()}
    assert found == {7: 1, 8: 0, 9: 1}
    empty = table([(1, None, "y", 1)], schema)
    assert ml.knn_classify(asked, empty, ["a", "b"], "id", "label", 1).count() == 3


def grown(nodes):
    return {r.node: r for r in nodes.collect()}


def brute_tree(rows, depth, leaf, node=1):
    """Node -> (n, ones, feature, value) of (features..., label) rows."""
    n, ones = len(rows), sum(r[-1] for r in rows)

    def gini(part):
        p = sum(r[-1] for r in part) / len(part)
        return 2 * p * (1 - p)

    best = (0, None, None)
    for i in range(len(rows[0]) - 1) if depth else ():
        for v in sorted({r[i] for r in rows if r[i] is not None}):
            has = [r for r in rows if r[i] == v]
            rest = [r for r in rows if r[i] != v]
            if len(has) >= leaf and len(rest) >= max(leaf, 1):
                gain = round(gini(rows) - len(has) / n * gini(has) - len(rest) / n * gini(rest), 12)
                if gain > best[0]:
                    best = (gain, i, v)
    out = {node: (n, ones, best[1], best[2])}
    if best[1] is not None:
        for side in (0, 1):
            part = [r for r in rows if (r[best[1]] == best[2]) == bool(side)]
            out |= brute_tree(part, depth - 1, leaf, 2 * node + side)
    return out


@pytest.mark.parametrize("depth, leaf", [(1, 1), (4, 1), (6, 7)])
def test_trees_match_brute_force(rows, depth, leaf):
    data, df = rows
    cells = ml.compress(df, [*FEATURES, "label"])
    nodes = grown(ml.grow_trees(cells, FEATURES, max_depth=depth, min_leaf=leaf))
    want = brute_tree([r[1:] for r in data], depth, leaf)
    assert {
        i: (r.n, r.ones, None if r.feature is None else FEATURES.index(r.feature), r.value)
        for i, r in nodes.items()
    } == want
    assert all(r.parent == (i // 2 if i > 1 else None) for i, r in nodes.items())
    if leaf > 1:
        assert all(r.n >= leaf for r in nodes.values())


def test_a_stump_equals_the_one_of_mllib(rows):
    from pyspark.ml.classification import DecisionTreeClassifier

    _, df = rows
    cells = ml.compress(df, [*FEATURES, "label"])
    encoding = ml.encoder(FEATURES).fit(cells)
    stump = DecisionTreeClassifier(maxDepth=1, weightCol="weight", impurity="gini").fit(encoding.transform(cells))
    theirs = stump.transform(encoding.transform(cells)).select(*FEATURES, "label", "probability")
    mine = ml.apply_tree(ml.grow_trees(cells, FEATURES, max_depth=1), cells, FEATURES)
    both = theirs.join(mine, [*FEATURES, "label"]).collect()
    assert len(both) == cells.count()
    assert all(r.score == pytest.approx(r.probability[1]) for r in both)


def test_the_tree_grid_matches_single_trees(rows):
    from blotter.ml.trees import grid_accuracy

    data, df = rows
    folds = ml.folds_by_hash(df, "id", 3)
    fold_of = {r.id: r.fold for r in folds.collect()}
    cells = ml.compress(folds, [*FEATURES, "label", "fold"])
    settings = {"max_depth": [1, 3], "min_leaf": [1, 9]}
    found = {(r.max_depth, r.min_leaf): r.accuracy for r in grid_accuracy(cells, FEATURES, settings, 3).collect()}

    def accuracy(depth, leaf, f):
        tree = brute_tree([r[1:] for r in data if fold_of[r[0]] != f], depth, leaf)
        held = [r[1:] for r in data if fold_of[r[0]] == f]
        right = 0
        for r in held:
            node = 1
            while tree[node][2] is not None:
                node = 2 * node + (r[tree[node][2]] == tree[node][3])
            right += (2 * tree[node][1] > tree[node][0]) == r[-1]
        return right / len(held)

    for (depth, leaf), value in found.items():
        assert value == pytest.approx(np.mean([accuracy(depth, leaf, f) for f in range(3)])), (depth, leaf)
    assert len(found) == 4


def test_a_grid_writes_a_row_per_combination_and_tree_and_keeps_no_level(rows, spark, monkeypatch):
    from blotter import storage
    from blotter.ml.trees import grid_accuracy

    _, df = rows
    cells = ml.compress(ml.folds_by_hash(df, "id", 3), [*FEATURES, "label", "fold"])
    sizes, paths, write = [], [], storage.Stages.write

    def noted(self, table):
        out = write(self, table)
        sizes.append(out.count())
        paths.append(self.path)
        return out

    monkeypatch.setattr(storage.Stages, "write", noted)
    grid_accuracy(cells, FEATURES, {"max_depth": [2], "min_leaf": [1, 9]}, 3).collect()
    assert sizes[0] == df.select(*FEATURES).distinct().count() * 6 < cells.count() * 6
    assert len(paths) == 3
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_trees_of_a_grid_share_rows_and_are_those_grown_alone(table, monkeypatch):
    from blotter import storage
    from blotter.ml.models import _training_counts
    from blotter.ml.trees import accuracy_of_grid, grid_accuracy, grow_grid, tree_of_grid

    rng = np.random.default_rng(5)
    data = [
        (i, str(rng.integers(0, 6)), str(rng.integers(0, 4)) if i % 40 else f"once{i}", int(rng.uniform() < 0.4))
        for i in range(700)
    ]
    df = table(data, "id long, a string, b string, label int")
    features, settings = ["a", "b"], {"max_depth": [1, 3], "min_leaf": [1, 30]}
    names = ["node", "parent", "depth", "n", "ones", "impurity", "feature", "value", "gain", "held_n", "held_ones"]

    def listed(nodes):
        return sorted((tuple(r) for r in nodes.select(*names).collect()), key=lambda r: r[0])

    sizes, write = [], storage.Stages.write

    def noted(self, rows):
        out = write(self, rows)
        if self.label == "tree-rows":
            sizes.append(out.count())
        return out

    _, _, each = _training_counts(df, features, "label", "id", 2)
    y = F.col("label")
    combos = each.groupBy(*features).agg(
        F.sum("weight").alias("_all"), F.sum(F.col("weight") * y).alias("_all_ones"),
        F.array(*[F.sum(f"fold_{i}") for i in range(2)]).alias("_in"),
        F.array(*[F.sum(F.col(f"fold_{i}") * y) for i in range(2)]).alias("_in_ones"),
    )
    monkeypatch.setattr(storage.Stages, "write", noted)
    grown = grow_grid(combos, features, settings, 2)
    # A row per combination and fold, and one for the tree of all rows.
    assert sizes[0] == combos.count() * 3
    monkeypatch.setattr(storage.Stages, "write", write)
    rest = each.withColumn("rest", F.col("weight") - F.col("fold_1"))
    alone = [
        listed(ml.grow_trees(rest, features, weight="rest", max_depth=3, min_leaf=leaf, held="fold_1"))
        for leaf in settings["min_leaf"]
    ]
    for leaf, tree in zip(settings["min_leaf"], alone):
        assert listed(grown.filter((F.col("held_fold") == 1) & (F.col("min_leaf") == leaf))) == tree
    whole = ml.grow_trees(each, features, max_depth=2, min_leaf=1)
    assert listed(tree_of_grid(grown, 2, 1)) == listed(whole)
    # The smallest leaf does matter here.
    assert alone[0] != alone[1]
    long = ml.compress(ml.folds_by_hash(df, "id", 2), [*features, "label", "fold"])
    want, got = (
        {(r.max_depth, r.min_leaf): r.accuracy for r in x.collect()}
        for x in (grid_accuracy(long, features, settings, 2), accuracy_of_grid(grown, settings))
    )
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 4


def test_rows_of_nodes_that_cannot_split_are_not_written_again(table, monkeypatch):
    from blotter import storage

    data = [(a, b, int(a == "x"), 2.0) for a in "xyz" for b in "uvw"]
    sizes, write = [], storage.Stages.write

    def noted(self, df):
        out = write(self, df)
        if self.label == "tree-rows":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(storage.Stages, "write", noted)
    nodes = grown(ml.grow_trees(table(data, "a string, b string, label int, weight double"), ["a", "b"]))
    assert sizes == [9, 0]
    assert {i: (r.n, r.ones, r.value) for i, r in nodes.items()} == {
        1: (18.0, 6.0, "x"), 2: (12.0, 0.0, None), 3: (6.0, 6.0, None)
    }


def test_trees_of_one_class_missing_values_and_no_rows(table):
    schema = "a string, b string, label int, weight double"
    pure = grown(ml.grow_trees(table([("x", "y", 1, 2.0), ("z", None, 1, 3.0)], schema), ["a", "b"]))
    assert [(r.n, r.ones, r.feature) for r in pure.values()] == [(5.0, 5.0, None)]
    gaps = table([(None, "y", 1, 2.0), (None, None, 0, 3.0), ("x", None, 0, 1.0)], schema)
    tree = ml.grow_trees(gaps, ["a", "b"])
    assert {(r.feature, r.value) for r in grown(tree).values() if r.depth == 0} == {("b", "y")}
    assert {(r.label, r.prediction) for r in ml.apply_tree(tree, gaps, ["a", "b"]).collect()} == {(0, 0), (1, 1)}
    assert ml.grow_trees(table([], schema), ["a", "b"]).count() == 0


def test_a_logistic_fit_is_the_optimum(rows):
    _, df = rows
    search = ml.logistic_search(df, FEATURES, "label", "id", {"C": [0.5], "folds": 3})
    slopes = ml.logistic_optimality(search, df, "label").collect()
    values = {(f, r[f]) for f in FEATURES for r in df.select(f).distinct().collect()}
    assert {(r.feature, r.value) for r in slopes} >= {v for v in values if v[1] is not None}
    total = df.count()
    assert [r.n for r in slopes if r.feature is None] == [total]
    assert all(abs(r.residual) < 1e-4 * total for r in slopes)
    away = search.model.coefficients.toArray()
    search.best = {"C": 0.05}
    assert max(abs(r.residual) for r in ml.logistic_optimality(search, df, "label").collect()) > 1 and len(away)


@pytest.mark.parametrize("search", [
    lambda df: ml.logistic_search(df, ["a", "gone"], "label", "id", {"C": [1.0], "folds": 2}),
    lambda df: ml.tree_search(df, ["a", "gone"], "label", "id", {"max_depth": [2], "min_leaf": [1], "folds": 2}),
])
def test_a_feature_without_values_is_left_out(table, search):
    df = table([(i, "xy"[i % 2], None, i % 2) for i in range(40)], "id long, a string, gone string, label int")
    found = search(df)
    assert list(found.features) == ["a"]
    scored = ml.score(found, df, "id", "label").collect()
    assert len(scored) == 40 and all(r.label == r.prediction for r in scored)
    with pytest.raises(ValueError, match="no feature"):
        search(df.withColumn("a", F.lit(None).cast("string")))


def test_every_row_is_in_the_confusion_matrix(table):
    df = table([(1, 1), (None, 1), (0, None), (2, 0)], "label int, prediction int")
    cells = {(r.label, r.prediction): r.n for r in ml.confusion_matrix(df).collect()}
    assert sum(cells.values()) == 4
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1, (None, 1): 1, (0, None): 1, (None, 0): 1}
    lines = {r["class"]: r for r in ml.classification_report(df).collect()}
    assert lines["0"].support == 1 and lines["0"].recall == 0.0 and lines["accuracy"].f1 == 0.5


def test_models_are_compared_side_by_side(table):
    rng = np.random.default_rng(4)
    data = []
    for model, side in (("a", "train"), ("a", "test"), ("b", "test")):
        for _ in range(300):
            y, s = int(rng.random() < 0.4), round(float(rng.random()), 2)
            data.append((model, side, y, int(s + y / 3 > 0.6), min(s + y / 3, 1.0)))
    scores = table(data, "model string, side string, label int, prediction int, score double")
    found = {(r.model, r.side): r for r in ml.compare_models(scores).collect()}
    assert len(found) == 3
    for (model, side), r in found.items():
        alone = scores.filter((F.col("model") == model) & (F.col("side") == side))
        head = ml.headline_scores(alone).first()
        for measure in ("accuracy", "precision_macro", "recall_macro", "f1_positive"):
            assert r[measure] == pytest.approx(head[measure])
        assert r.auc == pytest.approx(ml.roc_auc(alone).first().auc) and r.rows == 300
        curve = ml.roc_curve(scores, by=["model", "side"]).filter(
            (F.col("model") == model) & (F.col("side") == side)
        )
        assert sorted(tuple(p)[2:] for p in curve.collect()) == sorted(map(tuple, ml.roc_curve(alone).collect()))


def test_the_scores_of_all_models_are_written_once(spark, tmp_path, monkeypatch):
    from checks import models
    from checks.registry import Tables

    status, priority = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    data = [(i, i * 7 % 60, status[i % 3], float(i % 5 * 90_000), priority[i % 4]) for i in range(300)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    orders = spark.createDataFrame(data, schema).withColumn("o_orderdate", F.lit("2020-01-02").cast("timestamp"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    train, _, both = models._sides(t)
    searches = {
        "logistic": ml.logistic_search(train, FOUR, "label", "ID", {"C": [1.0], "folds": 2}),
        "tree": ml.tree_search(train, FOUR, "label", "ID", {"max_depth": [2], "min_leaf": [1], "folds": 2}),
    }
    monkeypatch.setattr(models, "_logistic", lambda t: searches["logistic"])
    monkeypatch.setattr(models, "_tree", lambda t: searches["tree"])
    scores = models._all_scores(t)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "o_orderkey" not in plan
    counts = {(r.model, r.side): r["count"] for r in scores.groupBy("model", "side").count().collect()}
    sides = {r.side: r["count"] for r in both.groupBy("side").count().collect()}
    assert counts == {(m, s): n for m in ("neighbours", "logistic", "tree") for s, n in sides.items()}
    for model, search in searches.items():
        want = sorted(round(r.score, 9) for r in ml.score(search, both, "ID", "label").collect())
        assert sorted(round(r.score, 9) for r in scores.filter(F.col("model") == model).collect()) == want
