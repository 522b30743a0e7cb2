"""Predicting the flag: features, classifiers, nearest neighbours, scores."""

from blotter.ml.clusters import group_profiles
from blotter.ml.features import (
    apply_modes,
    compress,
    encoder,
    folds_by_hash,
    mode_values,
    one_hot_positions,
    split_by_hash,
)
from blotter.ml.metrics import (
    classification_report,
    compare_models,
    confusion_matrix,
    headline_scores,
    roc_auc,
    roc_curve,
)
from blotter.ml.models import (
    LOGISTIC_GRIDS,
    TREE_GRIDS,
    GridSearch,
    TreeSearch,
    logistic_optimality,
    logistic_search,
    score,
    tree_search,
)
from blotter.ml.neighbours import KNN_GRID, complete_features, knn_classify, knn_grid, knn_join
from blotter.ml.trees import apply_tree, grow_trees

__all__ = [name for name in dir() if not name.startswith("_")]
