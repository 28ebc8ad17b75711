"""Importing this module registers every query."""

from exposura.plans import (  # noqa: F401
    queries_evaluation, queries_features, queries_logs, queries_retrieval, queries_training,
)
