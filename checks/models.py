"""Splits, encodings, scores, neighbours and classifiers."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter import ml, plans
from blotter import operators as op
from blotter.operators.crosstab import HOURS
from blotter.storage import Stages
from checks.incidents import groups_sql
from checks.registry import Tables, query, rounded
from checks.standin import RAW_CTE, raw_incidents

# ---- splits and features -----------------------------------------------------


def _unit_sql(key: str, seed: int) -> str:
    return (
        f"CAST(concat('0x', substr(md5(concat('{seed}:', CAST({key} AS VARCHAR))), 1, 8)) "
        "AS BIGINT) / 4294967296.0::DOUBLE"
    )


@query(f"SELECT event_id, {_unit_sql('event_id', 100)} < 0.8 AS in_train FROM events")
def hash_split(t: Tables) -> DataFrame:
    train, test = ml.split_by_hash(t.events.select("event_id"), "event_id", 0.8, 100)
    return train.withColumn("in_train", F.lit(True)).unionByName(
        test.withColumn("in_train", F.lit(False))
    )


@query(f"SELECT event_id, CAST(floor({_unit_sql('event_id', 7)} * 5) AS INTEGER) AS fold FROM events")
def hash_folds(t: Tables) -> DataFrame:
    return ml.folds_by_hash(t.events.select("event_id"), "event_id", 5)


_GAPPY = (
    "WITH gaps AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS brand, "
    "nullif(p_type, 'SMALL') AS kind FROM part), "
    "m AS (SELECT (SELECT brand FROM gaps WHERE brand IS NOT NULL GROUP BY brand "
    "ORDER BY count(*) DESC, brand LIMIT 1) AS brand_mode, "
    "(SELECT kind FROM gaps WHERE kind IS NOT NULL GROUP BY kind "
    "ORDER BY count(*) DESC, kind LIMIT 1) AS kind_mode) "
)


def _gappy_part(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#7")).alias("brand"),
        F.nullif("p_type", F.lit("SMALL")).alias("kind"),
    )


@query(
    _GAPPY + "SELECT p_partkey, coalesce(brand, brand_mode) AS brand, "
    "coalesce(kind, kind_mode) AS kind FROM gaps, m"
)
def mode_impute(t: Tables) -> DataFrame:
    gaps = _gappy_part(t)
    return ml.apply_modes(gaps, ml.mode_values(gaps, ["brand", "kind"]), ["brand", "kind"])


@query(
    _GAPPY + ", seen AS (SELECT brand, CAST(row_number() OVER (ORDER BY brand) - 1 AS INTEGER) "
    "AS position FROM (SELECT DISTINCT brand FROM gaps "
    "WHERE brand IS NOT NULL AND brand <> 'Brand#12') x) "
    "SELECT p_partkey, gaps.brand, coalesce(position, -1) AS position FROM gaps LEFT JOIN seen ON gaps.brand = seen.brand"
)
def one_hot_index(t: Tables) -> DataFrame:
    gaps = _gappy_part(t).drop("kind")
    train = gaps.filter(F.col("brand") != "Brand#12")
    return ml.one_hot_positions(train, gaps, "brand").fillna(-1, ["position"])


_MODEL_ROWS = (
    RAW_CTE + ", rows AS (SELECT CAST(ID AS BIGINT) AS ID, IUCR, Primary_Type, Domestic, "
    "FBI_Code, CAST(Arrest = 'true' AS INTEGER) AS label, "
    f"{_unit_sql('ID', 100)} < 0.8 AS in_train FROM raw) "
)


def _filled_sql(train: str) -> str:
    """`rows` whose missing features have the commonest value of the rows in `train`."""
    mode = (
        "(SELECT {0} FROM found WHERE " + train + " AND {0} IS NOT NULL GROUP BY {0} "
        "ORDER BY count(*) DESC, {0} LIMIT 1)"
    )
    filled = ", ".join(f"coalesce({f}, {mode.format(f)}) AS {f}" for f in plans.MODEL_FEATURES)
    return (
        _MODEL_ROWS.replace(", rows AS (", ", found AS (")
        + f", rows AS (SELECT ID, {filled}, label, in_train FROM found) "
    )


@query(
    _MODEL_ROWS + "SELECT Primary_Type, Domestic, label, CAST(count(*) AS DOUBLE) AS weight "
    "FROM rows GROUP BY 1, 2, 3"
)
def compressed_rows(t: Tables) -> DataFrame:
    rows = plans.model_table(raw_incidents(t))
    return ml.compress(rows, ["Primary_Type", "Domestic", "label"])


# ---- scores of a given prediction -----------------------------------------------


def _scored(t: Tables) -> DataFrame:
    score = F.floor(F.col("o_totalprice") / 100) / F.lit(10000.0)
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (score > 0.3).cast("int").alias("prediction"),
        score.alias("score"),
    )


_SCORED = (
    "WITH s AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label, "
    "floor(o_totalprice / 100) / 10000.0::DOUBLE AS score, "
    "CAST(floor(o_totalprice / 100) / 10000.0::DOUBLE > 0.3 AS INTEGER) AS prediction FROM orders) "
)


@query(
    _SCORED + "SELECT CAST(a.v AS INTEGER) AS label, CAST(b.v AS INTEGER) AS prediction, "
    "count(s.id) AS n FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v) "
    "LEFT JOIN s ON s.label = a.v AND s.prediction = b.v GROUP BY 1, 2"
)
def confusion_matrix(t: Tables) -> DataFrame:
    return ml.confusion_matrix(_scored(t))


_REPORT = (
    ", k AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS hits, "
    "count(*) FILTER (WHERE prediction = c) AS given, count(*) FILTER (WHERE label = c) AS support "
    "FROM s, (VALUES (0), (1)) v(c) GROUP BY c), "
    "p AS (SELECT c, support, hits, coalesce(hits / nullif(given, 0)::DOUBLE, 0.0) AS precision, "
    "coalesce(hits / nullif(support, 0)::DOUBLE, 0.0) AS recall FROM k), "
    "f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 "
    "FROM p), lines AS ("
    "SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM f UNION ALL "
    "SELECT 'accuracy', sum(hits) / sum(support)::DOUBLE, sum(hits) / sum(support)::DOUBLE, "
    "sum(hits) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM f UNION ALL "
    "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), "
    "sum(recall * support) / sum(support), sum(f1 * support) / sum(support), "
    "CAST(sum(support) AS BIGINT) FROM f) "
)
_ROUNDED_LINES = (
    "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, support FROM lines"
)
_HEADLINES = (
    "SELECT round(max(f1) FILTER (WHERE class = 'accuracy'), 6) AS accuracy, "
    "round(max(precision) FILTER (WHERE class = 'macro avg'), 6) AS precision_macro, "
    "round(max(recall) FILTER (WHERE class = 'macro avg'), 6) AS recall_macro, "
    "round(max(f1) FILTER (WHERE class = '1'), 6) AS f1_positive FROM lines"
)
_HEADLINE_COLS = ["accuracy", "precision_macro", "recall_macro", "f1_positive"]


@query(_SCORED + _REPORT + _ROUNDED_LINES)
def classification_report(t: Tables) -> DataFrame:
    return rounded(ml.classification_report(_scored(t)), "precision", "recall", "f1")


@query(_SCORED + _REPORT + _HEADLINES)
def headline_scores(t: Tables) -> DataFrame:
    return rounded(ml.headline_scores(_scored(t)), *_HEADLINE_COLS)


_ROC = (
    ", g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, "
    "count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY score), "
    "r AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, "
    "sum(neg) OVER (ORDER BY score DESC) AS fp FROM g) "
)


@query(
    _SCORED + _ROC + "SELECT round(score, 6) AS threshold, "
    "round(fp / (SELECT sum(neg) FROM g)::DOUBLE, 6) AS fpr, "
    "round(tp / (SELECT sum(pos) FROM g)::DOUBLE, 6) AS tpr FROM r "
    "UNION ALL SELECT NULL, 0.0, 0.0"
)
def roc_curve(t: Tables) -> DataFrame:
    curve = ml.roc_curve(_scored(t))
    start = F.col("threshold") == float("inf")
    curve = curve.withColumn("threshold", F.when(~start, F.col("threshold")))
    return rounded(curve, "threshold", "fpr", "tpr")


@query(
    _SCORED + _ROC + "SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / "
    "(sum(neg)::DOUBLE * sum(pos)::DOUBLE), 6) AS auc FROM r"
)
def roc_auc(t: Tables) -> DataFrame:
    return rounded(ml.roc_auc(_scored(t)), "auc")


# ---- nearest neighbours --------------------------------------------------------------


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    return ml.split_by_hash(plans.model_table(raw_incidents(t)), "ID", 0.8, 100)


_FEATURES = ", ".join(plans.MODEL_FEATURES)
_DIFFERING = " + ".join(f"(q.{f} <> b.{f})::INTEGER" for f in plans.MODEL_FEATURES)
_UNSEEN = " + ".join(
    f"(q.{f} NOT IN (SELECT {f} FROM rows WHERE in_train))::INTEGER" for f in plans.MODEL_FEATURES
)


def _nearest_sql(k: int) -> str:
    """A CTE `near`: the k nearest training rows of every combination of test features."""
    return (
        _filled_sql("in_train")
        + f", q AS (SELECT DISTINCT {_FEATURES} FROM rows WHERE NOT in_train), "
        + f"pairs AS (SELECT {', '.join('q.' + f for f in plans.MODEL_FEATURES)}, "
        + f"b.ID AS neighbour, b.label, sqrt(2.0::DOUBLE * ({_DIFFERING}) - ({_UNSEEN})) AS distance "
        + "FROM q, rows b WHERE b.in_train), near AS (SELECT * FROM (SELECT *, "
        + f"CAST(row_number() OVER (PARTITION BY {_FEATURES} ORDER BY distance, neighbour) "
        + f"AS INTEGER) AS rank FROM pairs) x WHERE rank <= {k}) "
    )


def _vote_sql(weights: str) -> str:
    """CTEs on top of `near`: `decided` holds prediction and score per combination."""
    weight = (
        "1.0::DOUBLE"
        if weights == "uniform"
        else "CASE WHEN closest = 0 THEN (distance = 0)::INTEGER::DOUBLE ELSE 1.0 / distance END"
    )
    return (
        f", v AS (SELECT {_FEATURES}, label, sum({weight}) AS votes FROM (SELECT *, "
        f"min(distance) OVER (PARTITION BY {_FEATURES}) AS closest FROM near) x "
        f"GROUP BY {_FEATURES}, label), decided AS (SELECT {_FEATURES}, "
        "CASE WHEN coalesce(sum(votes) FILTER (WHERE label = 1), 0) > "
        "coalesce(sum(votes) FILTER (WHERE label = 0), 0) THEN 1 ELSE 0 END AS prediction, "
        "coalesce(sum(votes) FILTER (WHERE label = 1), 0) / sum(votes) AS score "
        f"FROM v GROUP BY {_FEATURES}) "
    )


@query(
    _nearest_sql(10)
    + f"SELECT {_FEATURES}, rank, neighbour, label, round(distance, 6) AS distance FROM near"
)
def knn_topk(t: Tables) -> DataFrame:
    train, test = _split(t)
    modes = ml.mode_values(train, plans.MODEL_FEATURES)
    train, test = (ml.complete_features(x, modes, plans.MODEL_FEATURES) for x in (train, test))
    near = ml.knn_join(test, train, plans.MODEL_FEATURES, "ID", "label", 10)
    return rounded(near, "distance")


_JOINED = f" FROM rows JOIN decided USING ({_FEATURES}) WHERE NOT in_train"


@query(
    _nearest_sql(8) + _vote_sql("uniform")
    + "SELECT ID, CAST(prediction AS INTEGER) AS prediction, round(score, 6) AS score" + _JOINED
)
def knn_uniform(t: Tables) -> DataFrame:
    train, test = _split(t)
    return rounded(
        ml.knn_classify(test, train, plans.MODEL_FEATURES, "ID", "label", 8), "score"
    )


@query(
    _nearest_sql(15) + _vote_sql("distance")
    + "SELECT ID, CAST(prediction AS INTEGER) AS prediction, round(score, 6) AS score" + _JOINED
)
def knn_distance(t: Tables) -> DataFrame:
    train, test = _split(t)
    return rounded(
        ml.knn_classify(test, train, plans.MODEL_FEATURES, "ID", "label", 15, "distance"),
        "score",
    )


def _with_labels(predictions: DataFrame, rows: DataFrame) -> DataFrame:
    return predictions.join(rows.select("ID", "label"), "ID")


@query(
    _nearest_sql(8) + _vote_sql("uniform") + ", s AS (SELECT ID AS id, label, prediction, score"
    + _JOINED + ") " + _REPORT + _HEADLINES
)
def knn_scores(t: Tables) -> DataFrame:
    train, test = _split(t)
    found = ml.knn_classify(test, train, plans.MODEL_FEATURES, "ID", "label", 8)
    return rounded(ml.headline_scores(_with_labels(found, test)), *_HEADLINE_COLS)


@query(
    _nearest_sql(8) + _vote_sql("uniform") + ", s AS (SELECT ID AS id, label, prediction, score"
    + _JOINED + ") " + _ROC + "SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / "
    "(sum(neg)::DOUBLE * sum(pos)::DOUBLE), 6) AS auc FROM r"
)
def knn_auc(t: Tables) -> DataFrame:
    train, test = _split(t)
    found = ml.knn_classify(test, train, plans.MODEL_FEATURES, "ID", "label", 8)
    return rounded(ml.roc_auc(_with_labels(found, test)), "auc")


def _knn_grid_sql() -> str:
    """Fold accuracies of all settings, from the 15 nearest rows of the other folds."""
    differing = _DIFFERING
    unseen = " + ".join(
        f"(NOT EXISTS (SELECT 1 FROM seen s WHERE s.fold = q.fold AND s.f = '{f}' AND s.v = q.{f}))::INTEGER"
        for f in plans.MODEL_FEATURES
    )
    seen = " UNION ".join(
        f"SELECT DISTINCT g.fold, '{f}' AS f, {f} AS v FROM known b, (SELECT range AS fold FROM range(5)) g "
        "WHERE b.fold <> g.fold"
        for f in plans.MODEL_FEATURES
    )
    asked = ", ".join("q." + f for f in plans.MODEL_FEATURES)
    settings = ", ".join(
        f"({k}, '{w}')" for k in ml.KNN_GRID["k"] for w in ml.KNN_GRID["weights"]
    )
    weight = (
        "CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE WHEN closest = 0 "
        "THEN (distance = 0)::INTEGER::DOUBLE ELSE 1.0 / distance END"
    )
    return (
        _filled_sql("in_train")
        + f", known AS (SELECT *, CAST(floor({_unit_sql('ID', 7)} * 5) AS INTEGER) AS fold "
        "FROM rows WHERE in_train), "
        f"seen AS ({seen}), q AS (SELECT DISTINCT fold, {_FEATURES} FROM known), "
        f"u AS (SELECT q.*, {unseen} AS unseen FROM q), "
        f"pairs AS (SELECT q.fold, {asked}, min({{'d': ({differing}), 'id': b.ID, 'y': b.label}}, 15) AS near "
        f"FROM q JOIN known b ON b.fold <> q.fold GROUP BY q.fold, {asked}), "
        f"near AS (SELECT fold, {_FEATURES}, unnest(near) AS m, "
        "unnest(range(1, len(near) + 1)) AS rank FROM pairs), "
        f"dist AS (SELECT near.fold, {', '.join('near.' + f for f in plans.MODEL_FEATURES)}, rank, "
        "m.y AS label, sqrt(2.0::DOUBLE * m.d - unseen) AS distance FROM near JOIN u USING "
        f"(fold, {_FEATURES})), "
        f"votes AS (SELECT fold, {_FEATURES}, k, weights, "
        f"coalesce(sum({weight}) FILTER (WHERE label = 1), 0) AS ones, "
        f"coalesce(sum({weight}) FILTER (WHERE label = 0), 0) AS zeros FROM (SELECT *, "
        f"min(distance) OVER (PARTITION BY fold, {_FEATURES}) AS closest FROM dist) x, "
        f"(VALUES {settings}) v(k, weights) WHERE rank <= k GROUP BY ALL), "
        "folds AS (SELECT fold, k, weights, avg((label = (ones > zeros)::INTEGER)::INTEGER) AS accuracy "
        f"FROM known JOIN votes USING (fold, {_FEATURES}) GROUP BY ALL), "
        "report AS (SELECT CAST(k AS INTEGER) AS k, weights, avg(accuracy) AS accuracy FROM folds GROUP BY ALL) "
        "SELECT k, weights, round(accuracy, 6) AS accuracy, row_number() OVER "
        "(ORDER BY accuracy DESC, k, weights DESC) = 1 AS is_best FROM report"
    )


@query(_knn_grid_sql())
def knn_grid(t: Tables) -> DataFrame:
    train, _ = _split(t)
    return rounded(ml.knn_grid(train, plans.MODEL_FEATURES, "ID", "label"), "accuracy")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, test rows, and both with their side."""
    train, test = _split(t)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return train, test, both


def _knn_both_sides(t: Tables) -> DataFrame:
    """(model, side, label, prediction, score) of training and test rows."""
    train, _, both = _sides(t)
    return _neighbour_scores(both, train)


def _neighbour_scores(both: DataFrame, train: DataFrame) -> DataFrame:
    found = ml.knn_classify(both, train, plans.MODEL_FEATURES, "ID", "label", 8)
    return both.select("ID", "side", "label").join(found, "ID").select(
        F.lit("neighbours").alias("model"), "side", "label", "prediction", "score"
    )


def _listed_sql(k: int) -> str:
    """`near` for the features of all rows, from the k least of each combination at once."""
    asked = ", ".join("q." + f for f in plans.MODEL_FEATURES)
    return (
        _filled_sql("in_train")
        + f", q AS (SELECT DISTINCT {_FEATURES} FROM rows), "
        f"u AS (SELECT q.*, {_UNSEEN} AS unseen FROM q), "
        f"pairs AS (SELECT {asked}, min({{'d': {_DIFFERING}, 'id': b.ID, 'y': b.label}}, {k}) AS found "
        f"FROM q, rows b WHERE b.in_train GROUP BY {asked}), "
        f"listed AS (SELECT {_FEATURES}, unnest(found) AS m FROM pairs), "
        f"near AS (SELECT {_FEATURES}, m.id AS neighbour, m.y AS label, "
        f"sqrt(2.0::DOUBLE * m.d - unseen) AS distance FROM listed JOIN u USING ({_FEATURES})) "
    )


_BOTH_SIDES = (
    _listed_sql(8) + _vote_sql("uniform")
    + ", s AS (SELECT 'neighbours' AS model, CASE WHEN in_train THEN 'train' ELSE 'test' END AS side, "
    f"label, prediction, score FROM rows JOIN decided USING ({_FEATURES})), "
    "g AS (SELECT model, side, score, count(*) FILTER (WHERE label = 1) AS pos, "
    "count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY ALL), "
    "r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g "
    "WINDOW w AS (PARTITION BY model, side ORDER BY score DESC)) "
)
_COMPARED = ["accuracy", "precision_macro", "recall_macro", "f1_positive", "auc"]


@query(
    _BOTH_SIDES + ", c AS (SELECT model, side, count(*) AS n, "
    + ", ".join(
        f"count(*) FILTER (WHERE label = {c} AND prediction = {c})::DOUBLE AS h{c}, "
        f"count(*) FILTER (WHERE prediction = {c}) AS g{c}, count(*) FILTER (WHERE label = {c}) AS s{c}"
        for c in (0, 1)
    )
    + " FROM s GROUP BY ALL), p AS (SELECT *, coalesce(h0 / nullif(g0, 0), 0) AS p0, "
    "coalesce(h1 / nullif(g1, 0), 0) AS p1, coalesce(h0 / nullif(s0, 0), 0) AS r0, "
    "coalesce(h1 / nullif(s1, 0), 0) AS r1 FROM c), "
    "a AS (SELECT model, side, sum(neg * (tp - pos / 2.0::DOUBLE)) / "
    "(sum(neg)::DOUBLE * sum(pos)::DOUBLE) AS auc FROM r GROUP BY ALL) "
    "SELECT model, side, n AS rows, round((h0 + h1) / n, 6) AS accuracy, "
    "round((p0 + p1) / 2, 6) AS precision_macro, round((r0 + r1) / 2, 6) AS recall_macro, "
    "round(coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 6) AS f1_positive, round(auc, 6) AS auc "
    "FROM p JOIN a USING (model, side)"
)
def knn_comparison(t: Tables) -> DataFrame:
    return rounded(ml.compare_models(_knn_both_sides(t)), *_COMPARED)


@query(
    _BOTH_SIDES + ", t AS (SELECT model, side, sum(pos) AS pos, sum(neg) AS neg FROM g GROUP BY ALL) "
    "SELECT model, side, round(score, 6) AS threshold, round(fp / t.neg::DOUBLE, 6) AS fpr, "
    "round(tp / t.pos::DOUBLE, 6) AS tpr FROM r JOIN t USING (model, side) "
    "UNION ALL SELECT model, side, NULL, 0.0, 0.0 FROM t"
)
def knn_curves(t: Tables) -> DataFrame:
    curve = ml.roc_curve(_knn_both_sides(t), by=["model", "side"])
    start = F.col("threshold") == float("inf")
    curve = curve.withColumn("threshold", F.when(~start, F.col("threshold")))
    return rounded(curve, "threshold", "fpr", "tpr")


# ---- classifiers -----------------------------------------------------------------------


_SEARCHES: dict[tuple, object] = {}


def _fitted(t: Tables, search, grid: dict):
    """The result of a search, kept for the queries of one session on one folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, search.__name__, repr(grid))
    if key not in _SEARCHES:
        train, _ = _split(t)
        _SEARCHES[key] = search(train, plans.MODEL_FEATURES, "label", "ID", grid)
    return _SEARCHES[key]


def _logistic(t: Tables) -> ml.GridSearch:
    return _fitted(t, ml.logistic_search, ml.LOGISTIC_GRIDS[0])


def _tree(t: Tables) -> ml.TreeSearch:
    return _fitted(t, ml.tree_search, ml.TREE_GRIDS[0])


@query()
def logistic_grid(t: Tables) -> DataFrame:
    return _logistic(t).report


@query()
def logistic_grid_fine(t: Tables) -> DataFrame:
    return _fitted(t, ml.logistic_search, ml.LOGISTIC_GRIDS[1]).report


@query()
def tree_grid(t: Tables) -> DataFrame:
    return _tree(t).report


@query()
def tree_grid_fine(t: Tables) -> DataFrame:
    return _fitted(t, ml.tree_search, ml.TREE_GRIDS[1]).report


@query()
def logistic_scores(t: Tables) -> DataFrame:
    return ml.score(_logistic(t), _split(t)[1], "ID", "label")


@query()
def tree_scores(t: Tables) -> DataFrame:
    return ml.score(_tree(t), _split(t)[1], "ID", "label")


@query()
def model_comparison(t: Tables) -> DataFrame:
    return rounded(ml.compare_models(_all_scores(t)), *_COMPARED)


@query()
def model_curves(t: Tables) -> DataFrame:
    return ml.roc_curve(_all_scores(t), by=["model", "side"])


def _all_scores(t: Tables) -> DataFrame:
    """(model, side, label, prediction, score) of all models, written once for all that read it.

    The rows of both sides are written once too, and the searches and the neighbours, which need
    nothing of each other, run at the same time.
    """
    both = Stages(t.spark, "model-rows").write(_sides(t)[2])
    train = both.filter("side = 'train'").drop("side")

    def part(label: str, scores: DataFrame) -> DataFrame:
        return Stages(t.spark, f"scores-{label}").write(scores)

    def searched(model: str, search) -> DataFrame:
        found = ml.score(search(t), both, "ID", "label").join(both.select("ID", "side"), "ID")
        return part(
            model, found.select(F.lit(model).alias("model"), "side", "label", "prediction", "score")
        )

    jobs = [
        lambda: searched("tree", _tree),
        lambda: searched("logistic", _logistic),
        lambda: part("neighbours", _neighbour_scores(both, train)),
    ]
    with ThreadPool(len(jobs)) as pool:
        tree, logistic, near = pool.map(inheritable_thread_target(t.spark)(lambda job: job()), jobs, chunksize=1)
    return near.unionByName(logistic).unionByName(tree)


# A fit is the optimum where every residual is 0: the SQL lists the coefficients and 0.
@query(
    _filled_sql("in_train")
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS value, count(*) AS n, 0.0::DOUBLE AS residual "
        f"FROM rows WHERE in_train GROUP BY {f}"
        for f in plans.MODEL_FEATURES
    )
    + " UNION ALL SELECT NULL, NULL, count(*), 0.0 FROM rows WHERE in_train"
)
def logistic_optimality(t: Tables) -> DataFrame:
    train, _ = _split(t)
    slopes = ml.logistic_optimality(_logistic(t), train, "label")
    total = F.max(F.when(F.col("feature").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    mean = F.round(F.col("residual") / total, 4) + 0.0
    return slopes.withColumn("residual", mean)


def _tree_sql(depth: int) -> str:
    """Nodes of the tree, one pair of CTEs a level."""
    gini = "2 * ({0} / {1}) * (1.0::DOUBLE - {0} / {1})"
    kinds = " UNION ALL ".join(
        f"SELECT node, {i} AS f, {name} AS v, label FROM live{{0}}"
        for i, name in enumerate(plans.MODEL_FEATURES)
    )
    own = "CASE f " + " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(plans.MODEL_FEATURES)) + " END"
    ctes = [
        f"live0 AS (SELECT CAST(1 AS BIGINT) AS node, {_FEATURES}, label FROM rows WHERE in_train)"
    ]
    for level in range(depth + 1):
        whole = (
            f"SELECT node, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS ones FROM live{level} GROUP BY node"
        )
        ctes.append(f"whole{level} AS (SELECT *, {gini.format('ones', 'n')} AS impurity FROM ({whole}) w)")
        if level == depth:
            break
        after = (
            f"(h / n * ({gini.format('ho', 'h')}) + (n - h) / n * "
            f"({gini.format('(ones - ho)', '(n - h)')}))"
        )
        ctes.append(
            f"split{level} AS (SELECT node, f, v, gain FROM (SELECT *, row_number() OVER "
            "(PARTITION BY node ORDER BY gain DESC, f, v) AS place FROM (SELECT node, f, v, "
            f"round(impurity - {after}, 12) AS gain FROM (SELECT node, f, v, count(*)::DOUBLE AS h, "
            f"sum(label)::DOUBLE AS ho FROM ({kinds.format(level)}) k GROUP BY node, f, v) c "
            f"JOIN whole{level} USING (node) WHERE h < n) g WHERE gain > 0) p WHERE place = 1)"
        )
        ctes.append(
            f"live{level + 1} AS (SELECT node * 2 + ({own} = v)::INTEGER AS node, {_FEATURES}, label "
            f"FROM live{level} JOIN split{level} USING (node))"
        )
    names = "CASE f " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(plans.MODEL_FEATURES)) + " END"
    levels = [
        f"SELECT node, {level} AS depth, n, ones, impurity, "
        + (f"{names} AS feature, v AS value, gain " if level < depth else "NULL, NULL, NULL ")
        + f"FROM whole{level}" + (f" LEFT JOIN split{level} USING (node)" if level < depth else "")
        for level in range(depth + 1)
    ]
    return (
        _filled_sql("in_train") + ", " + ", ".join(ctes)
        + " SELECT CAST(node AS BIGINT) AS node, CASE WHEN node > 1 THEN CAST(node // 2 AS BIGINT) END "
        "AS parent, depth, n, ones, round(impurity, 9) AS impurity, feature, value, "
        f"round(gain, 9) AS gain FROM ({' UNION ALL '.join(levels)}) x"
    )


@query(_tree_sql(3))
def tree_nodes(t: Tables) -> DataFrame:
    train, _ = _split(t)
    train = ml.apply_modes(train, ml.mode_values(train, plans.MODEL_FEATURES), plans.MODEL_FEATURES)
    cells = ml.compress(train, [*plans.MODEL_FEATURES, "label"])
    nodes = ml.grow_trees(cells, plans.MODEL_FEATURES, max_depth=3)
    return rounded(nodes.drop("held_n", "held_ones"), "impurity", "gain", digits=9)


@query(
    groups_sql(
        "WITH c AS (SELECT user_id AS row_key, hour(ts) AS col_key, count(*) AS n FROM events "
        "WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), "
        "dense AS (SELECT r.row_key, k.range AS col_key, coalesce(n, 0) AS n "
        "FROM (SELECT DISTINCT row_key FROM c) r, range(24) k LEFT JOIN c "
        "ON c.row_key = r.row_key AND c.col_key = k.range), "
        "cells AS (SELECT row_key, col_key, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS v "
        "FROM dense WINDOW w AS (PARTITION BY row_key))",
        4,
    )
)
def group_profiles(t: Tables) -> DataFrame:
    cells = op.zscore_within(op.hour_by(t.events, "ts", "user_id"))
    return rounded(ml.group_profiles(cells, HOURS, "z", 4), "distance", "next_distance")
