"""Static test-flakiness analytics on Spark.

Predicts from source text alone which tests are flaky, and measures how well:
every step is a DataFrame operator, the enhanced classifier a ``pyspark.ml``
estimator.
"""

from .operators.evaluation import average_over_splits, evaluate
from .operators.imbalance import class_prior, class_weights, smote
from .operators.neighbors import knn_join, predict_nearest
from .operators.patterns import categories, pattern_counts_long, with_pattern_counts
from .operators.splits import shuffle_splits, stratified_splits
from .functions.structural import with_structural_features
from .plans.base import classify, vectorize, vectorize_split
from .plans.estimator import NeighborVoteClassifier, NeighborVoteModel
from .sources.results import read_results, write_results
from .sources.text_folders import read_projects, read_samples, read_texts

__all__ = [
    "NeighborVoteClassifier",
    "NeighborVoteModel",
    "average_over_splits",
    "categories",
    "class_prior",
    "class_weights",
    "classify",
    "evaluate",
    "knn_join",
    "pattern_counts_long",
    "predict_nearest",
    "read_projects",
    "read_results",
    "read_samples",
    "read_texts",
    "shuffle_splits",
    "smote",
    "stratified_splits",
    "vectorize",
    "vectorize_split",
    "with_pattern_counts",
    "with_structural_features",
    "write_results",
]
