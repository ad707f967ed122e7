"""Registries of detectors. One of edges takes candidate edges and active nodes and gives predictions; one of nodes takes the
edges of whole cases and gives nodes with a probability.

Candidates have case_id, src, edge_id, amount and what a detector's features need; active nodes have case_id and node.
Predictions are the candidates with ``active``, a score or probabilities, and ``action``. Fitted models join under a name of
their own by ``learned``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning, policies, ranking

Detector = Callable[[DataFrame, DataFrame], DataFrame]
DETECTORS: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Registers a detector; a name stands once."""

    def register(f: Detector) -> Detector:
        if name in DETECTORS:
            raise ValueError(f"{name} is registered already")
        DETECTORS[name] = f
        return f

    return register


def detect(name: str, candidates: DataFrame, active: DataFrame) -> DataFrame:
    try:
        return DETECTORS[name](candidates, active)
    except KeyError:
        raise ValueError(f"no detector {name}; there are {sorted(DETECTORS)}") from None


def learned(name: str, model: PipelineModel, features: Callable[[DataFrame], DataFrame]) -> Detector:
    """Registers a fitted model with the features it was fitted on."""
    return detector(name)(lambda candidates, active: learning.predict(model, policies.mark_active(features(candidates), active)))


for _order in ("fifo", "lifo", "tiho"):
    detector(_order)(lambda candidates, active, order=_order: policies.binary_actions(policies.taint(candidates, active, order)))
for _name, _ratio in (("haircut", 0.5), ("poison", 1.0)):
    detector(_name)(lambda candidates, active, ratio=_ratio: policies.binary_actions(policies.constant(candidates, active, ratio)))


@detector("rank_community")
def _rank_community(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """Edges within the community that ranks from the active nodes make; candidates need dst."""
    community = ranking.rank_community(candidates, ranking.best_first_rank(candidates, active, at_once=8), active)
    return ranking.community_actions(policies.mark_active(candidates, active), community)


NodeDetector = Callable[[DataFrame], DataFrame]
NODE_DETECTORS: dict[str, NodeDetector] = {}


def node_detector(name: str) -> Callable[[NodeDetector], NodeDetector]:
    """Registers a detector of nodes; a name stands once."""

    def register(f: NodeDetector) -> NodeDetector:
        if name in NODE_DETECTORS:
            raise ValueError(f"{name} is registered already")
        NODE_DETECTORS[name] = f
        return f

    return register


def detect_nodes(name: str, edges: DataFrame) -> DataFrame:
    """case_id, node, probability of all nodes that the detector knows."""
    try:
        return NODE_DETECTORS[name](edges)
    except KeyError:
        raise ValueError(f"no node detector {name}; there are {sorted(NODE_DETECTORS)}") from None


def learned_nodes(name: str, model: PipelineModel, features: Callable[[DataFrame], DataFrame]) -> NodeDetector:
    """Registers a fitted two-class model of nodes with the features (case_id, node, ...) it was fitted on."""
    from pyspark.ml.functions import vector_to_array

    return node_detector(name)(lambda edges: model.transform(features(edges)).select("case_id", "node", vector_to_array("probability")[1].alias("probability")))


@node_detector("max_outflow")
def _max_outflow(edges: DataFrame) -> DataFrame:
    """Sources by their largest transfer, as a share of the case's largest."""
    return policies.max_outflow_scores(edges).select("case_id", F.col("src").alias("node"), "probability")


@node_detector("suspicious")
def _suspicious(edges: DataFrame) -> DataFrame:
    """Receivers of the most suspicious set, by their share of the greatest score."""
    return ranking.suspicious_set(ranking.rated_transfers(edges, plus=True)).select("case_id", "node", F.col("share").alias("probability"))
