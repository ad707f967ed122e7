"""Queries that make questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import questions as Q
from ..operators.relational import dropped, kept
from ..registry import query
from ..views import Tables
from .labels import _REC, recommended_action

_HEAD = "SELECT case_id, '{}' AS question_type, {} AS subject, {} AS predicate, CAST({} AS VARCHAR) AS object FROM {}"
PARTS: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


def part(name: str, sql: str):
    """Registers a generator, which is also a part of ``qa_all``."""

    def register(f: Callable[[Tables], DataFrame]):
        PARTS[name] = (f, sql)
        return query(name, sql)(f)

    return register


def _unpivot(kind: str, subject: str, columns: list[str], table: str) -> str:
    return " UNION ALL ".join(_HEAD.format(kind, subject, f"'{c}'", c, table) for c in columns)


@part("qa_case", _unpivot("case", "case_id", ["n_edges", "stages", "first_ts", "last_ts"], "(SELECT case_id, count(*) AS n_edges, array_to_string(list(DISTINCT stage ORDER BY stage), ', ') AS stages, min(ts) AS first_ts, max(ts) AS last_ts FROM ev_edges GROUP BY 1) x"))
def qa_case(t: Tables) -> DataFrame:
    return Q.case_questions(t.ev_edges)


@part("qa_entity", _unpivot("entity", "entity_id", ["role", "chain", "address", "confidence"], "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY role, entity_id) AS rn FROM ev_entities) y WHERE rn <= 80) x"))
def qa_entity(t: Tables) -> DataFrame:
    return Q.entity_questions(t.ev_entities)


@part("qa_edge", _unpivot("edge", "reported_id", ["src", "dst", "asset", "stage", "pattern"], "ev_edges") + " UNION ALL " + _HEAD.format("edge_verification", "reported_id", "'is ' || stage", "'true'", "ev_edges") + " UNION ALL " + _HEAD.format("edge_verification", "reported_id", "'chain verified'", "'false'", "ev_edges WHERE verification_status <> 'chain_verified'"))
def qa_edge(t: Tables) -> DataFrame:
    return Q.edge_questions(t.ev_edges)


@part("qa_source_reliability", _HEAD.format("source_reliability", "reported_id", "'highest grade'", "confidence", "ev_edges"))
def qa_source_reliability(t: Tables) -> DataFrame:
    return Q.rows(t.ev_edges, "source_reliability", "reported_id", "highest grade", "confidence")


@part("qa_agent_action", f"SELECT e.case_id, 'agent_action' AS question_type, r.reported_id AS subject, 'recommended' AS predicate, r.recommended AS object FROM ({_REC}) r JOIN ev_edges e USING (reported_id)")
def qa_agent_action(t: Tables) -> DataFrame:
    rows = recommended_action(t).join(t.ev_edges.select("case_id", "reported_id"), "reported_id")
    return Q.rows(rows, "agent_action", "reported_id", "recommended", "recommended")


@part("qa_constraint_application", "SELECT e.case_id, 'constraint' AS question_type, reported_id AS subject, 'boundary at ' || role AS predicate, 'true' AS object FROM ev_edges e JOIN (SELECT DISTINCT case_id, address, role FROM ev_entities WHERE role IN ('mixer', 'exchange_deposit')) w ON w.case_id = e.case_id AND w.address = e.dst")
def qa_constraint_application(t: Tables) -> DataFrame:
    service = t.ev_entities.where("role in ('mixer', 'exchange_deposit')").select("case_id", F.col("address").alias("dst"), "role").distinct()
    rows = t.ev_edges.join(service, ["case_id", "dst"]).withColumn("yes", F.lit("true"))
    return Q.rows(rows, "constraint", "reported_id", F.concat(F.lit("boundary at "), "role"), "yes")


@part("qa_negative_triples", _HEAD.format("negative", "reported_id", "'not stage'", "CASE WHEN stage <> 'theft' THEN 'theft' ELSE 'layering' END", "ev_edges"))
def qa_negative_triples(t: Tables) -> DataFrame:
    return Q.negative_questions(t.ev_edges, "stage", ["theft", "layering", "cash_out"])


@part("qa_direct_link", "SELECT case_id, 'direct_link' AS question_type, src AS subject, 'linked to ' || dst AS predicate, 'true' AS object FROM (SELECT DISTINCT case_id, src, dst FROM ev_edges) x UNION ALL SELECT s.case_id, 'direct_link', s.src, 'linked to ' || min(n.node), 'false' FROM (SELECT DISTINCT case_id, src FROM ev_edges) s JOIN (SELECT case_id, src AS node FROM ev_edges UNION SELECT case_id, dst FROM ev_edges) n ON n.case_id = s.case_id AND n.node <> s.src WHERE (s.case_id, s.src, n.node) NOT IN (SELECT (case_id, src, dst) FROM ev_edges) GROUP BY s.case_id, s.src")
def qa_direct_link(t: Tables) -> DataFrame:
    return Q.direct_link_questions(t.ev_edges)


def _hop(by: str) -> str:
    return f"SELECT case_id, 'single_hop_{by}' AS question_type, src AS subject, {by} AS predicate, answer AS object FROM (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY {by}) AS rn FROM (SELECT case_id, src, {by}, array_to_string(list(DISTINCT dst ORDER BY dst), ', ') AS answer FROM ev_edges GROUP BY ALL) y) x WHERE rn <= 4"


@part("qa_single_hop", f"{_hop('stage')} UNION ALL {_hop('pattern')}")
def qa_single_hop(t: Tables) -> DataFrame:
    return Q.single_hop_questions(t.ev_edges, "stage").unionByName(Q.single_hop_questions(t.ev_edges, "pattern"))


@part("qa_path", "SELECT case_id, 'path' AS question_type, e1 AS subject, 'followed by' AS predicate, e2 AS object FROM (SELECT a.case_id, a.reported_id AS e1, b.reported_id AS e2, row_number() OVER (PARTITION BY a.case_id ORDER BY a.src, a.i, b.i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY ts, reported_id) AS i FROM ev_edges) a JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY ts, reported_id) AS i FROM ev_edges) b ON a.case_id = b.case_id AND a.src = b.src AND a.i < b.i AND a.stage <> b.stage) x WHERE n <= 24")
def qa_path(t: Tables) -> DataFrame:
    return Q.rows(E.stage_sequences(t.ev_edges), "path", "e1", "followed by", "e2")


@part("qa_multi_hop", "SELECT case_id, 'multi_hop' AS question_type, e1 AS subject, 'leads to' AS predicate, e2 AS object FROM (SELECT a.case_id, a.reported_id AS e1, b.reported_id AS e2, row_number() OVER (PARTITION BY a.case_id, a.reported_id ORDER BY b.ts, b.reported_id) AS rn FROM ev_edges a JOIN ev_edges b ON a.case_id = b.case_id AND a.dst = b.src AND b.ts >= a.ts AND a.reported_id <> b.reported_id) x WHERE rn = 1")
def qa_multi_hop(t: Tables) -> DataFrame:
    return Q.rows(E.two_hop_paths(t.ev_edges.withColumnRenamed("reported_id", "edge_id")), "multi_hop", "first_edge", "leads to", "second_edge")


@part("qa_constraints", _HEAD.format("constraint_lookup", "entity_id", "'is attacker wallet'", "'false'", "ev_entities WHERE role IN ('mixer', 'exchange_deposit', 'router')"))
def qa_constraints(t: Tables) -> DataFrame:
    return Q.rows(t.ev_entities.where("role in ('mixer', 'exchange_deposit', 'router')").withColumn("no", F.lit("false")), "constraint_lookup", "entity_id", "is attacker wallet", "no")


@part("qa_transactions", _unpivot("transaction", "tx_hash", ["src", "dst", "asset"], "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, reported_id) AS rn FROM ev_edges) y WHERE rn <= 40) x"))
def qa_transactions(t: Tables) -> DataFrame:
    from ..operators.relational import top_n_per_group

    first = top_n_per_group(t.ev_edges, ["case_id"], [F.col("ts"), F.col("reported_id")], 40)
    return Q.unpivoted(first, "transaction", "tx_hash", ["src", "dst", "asset"])


_ALL = " UNION ALL ".join(f"SELECT case_id, question_type, subject, predicate, object FROM ({s}) p{i}" for i, (_, s) in enumerate(PARTS.values()))


@query("qa_all", f"WITH u AS (SELECT DISTINCT * FROM ({_ALL}) z) SELECT case_id, question_type, subject, predicate, object, case_id || ':' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY question_type, subject, predicate, object) AS VARCHAR), 5, '0') || ':' || question_type AS qa_id FROM u")
def qa_all(t: Tables) -> DataFrame:
    """All parts; the views that most of them read are written once, and deleted when all rows are numbered and written."""
    views = {name: kept(getattr(t, name)) for name in ("ev_edges", "ev_entities")}
    t.__dict__.update(views)
    out = Q.numbered(reduce(DataFrame.unionByName, (f(t) for f, _ in PARTS.values())))
    dropped(*views.values())
    return out
