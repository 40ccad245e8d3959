"""docsift: corpus deduplication and provenance on Spark.

The main entry points::

    from docsift import classify, compare_stats, index_scope
    result = classify(new_docs, index_scope(history), fuzzy="small")

Everything returns lazy DataFrames; see README.md for the operator map.
"""

from .functions.threshold import FuzzyPolicy, ThresholdCurve, curve_from_conf
from .operators.index import hash_index, index_scope, index_stats, pick_canonical, with_fingerprint
from .operators.matching import classify, compare_stats, history_index
from .operators.nearjoin import candidate_pairs, funnel_observations, near_matches

__version__ = "0.1.0"

__all__ = [
    "FuzzyPolicy", "ThresholdCurve", "curve_from_conf",
    "hash_index", "index_scope", "index_stats", "pick_canonical", "with_fingerprint",
    "classify", "compare_stats", "history_index",
    "candidate_pairs", "funnel_observations", "near_matches",
]
