"""Rules that tasks and tool calls must keep to, as operators over typed rows.

A task's rules are worked out in one pass over its columns; what has to be counted anew comes from joins with the transfers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .relational import kept
from .reports import flags

#: A source with more transfers of a type in the window than this is not looked up in full.
LOOKUP_LIMIT = 500_000


def _broken(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """(rule, id) of all rules that a task breaks; a rule that cannot be told, as something is null, is not broken."""
    return rows.select(F.explode(flags(rules)).alias("rule"), F.col("task_id").cast("string").alias("id"))


def _is(c: str, value) -> Column:
    return F.coalesce(F.col(c) == F.lit(value), F.lit(False))


def _empty(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def existence_violations(tasks: DataFrame, transfers: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """(rule, id) of tasks that ask whether a transfer exists.

    ``tasks``: task_id, case_id, src, dst, chain, direction, block_min, block_max, edge_types, n_shown (edges that the task
    shows), profile, tool_requirement, required_tools, public_profile and the stored oracle: found, n_tx, n_edges, edge_ids,
    tx_hashes, verified_absent. Beside the rules of form, the oracle is counted anew from ``transfers`` (case_id, edge_id,
    src, dst, tx_hash, block_number, edge_type) and must be the same.

    A task without two addresses and one type cannot be counted (invalid_query); one whose source has more than ``limit``
    transfers of the type in its window is not (incomplete).
    """
    lower = lambda c: F.coalesce(F.col(c) != F.lower(c), F.lit(False))
    context = ("src", "dst", "chain", "direction", "block_min", "block_max", "edge_types")
    there = F.coalesce("found", F.lit(False))
    askable = C.is_evm_address(F.lower("src")) & C.is_evm_address(F.lower("dst")) & (F.size("edge_types") == 1)
    form = [
        (F.exists(F.array(*(F.col(c).isNull() for c in context)), lambda x: x), "missing_context"),
        (~_is("chain", "ethereum") | ~_is("direction", "out"), "chain_or_direction"),
        (lower("src"), "src_not_lower"),
        (lower("dst"), "dst_not_lower"),
        (F.col("block_min").isNull() | F.col("block_max").isNull(), "no_window"),
        (_empty("edge_types"), "no_edge_types"),
        (F.col("n_shown") > 0, "shows_edges"),
        (~_is("profile", "tool_grounded"), "not_tool_grounded"),
        (~_is("tool_requirement", "required") | ~F.coalesce(F.array_contains("required_tools", "neighbors"), F.lit(False)), "lookup_not_required"),
        (~_is("public_profile", "query_only"), "not_query_only"),
        (F.col("found").isNull(), "found_not_boolean"),
        (there & (_empty("edge_ids") | _empty("tx_hashes")), "positive_without_oracle"),
        (~there & ~F.coalesce("verified_absent", F.lit(False)), "not_verified_absent"),
        (~F.coalesce(askable, F.lit(False)), "invalid_query"),
    ]
    oracle_columns = ("found", "n_tx", "n_edges", "edge_ids", "tx_hashes")
    asked = tasks.where(askable).select("task_id", "case_id", F.lower("src").alias("src"), F.lower("dst").alias("dst"), "block_min", "block_max", F.col("edge_types")[0].alias("edge_type"), F.struct(*oracle_columns).alias("__stored"))
    found = transfers.select("case_id", "src", "edge_type", F.col("dst").alias("to"), "block_number", "edge_id", "tx_hash")
    within = F.col("block_number").between(F.col("block_min"), F.col("block_max"))
    # How much a source has is counted once for each window, not for each task; only the few windows beyond the limit are held.
    windows = asked.select("case_id", "src", "edge_type", "block_min", "block_max").distinct()
    sizes = windows.join(found, ["case_id", "src", "edge_type"]).where(within).groupBy(*windows.columns).agg(F.count("*").alias("__size"))
    large = kept(sizes.where(F.col("__size") > limit))
    # Tasks and transfers meet once; what a task found is gathered where they met.
    keys = ["case_id", "src", "dst", "edge_type"]
    by_pair = found.withColumnRenamed("to", "dst").withColumn("__at", F.col("block_number"))
    seen = F.col("__at").between(F.col("block_min"), F.col("block_max"))
    both = asked.join(by_pair.drop("block_number"), keys, "left")
    known = both.groupBy(*keys, "task_id", "block_min", "block_max").agg(F.sort_array(F.collect_set(F.when(seen, F.col("edge_id")))).alias("__edges"), F.sort_array(F.collect_set(F.when(seen, F.lower("tx_hash")))).alias("__hashes"), F.first("__stored").alias("__stored"))
    rows = known.join(large, windows.columns, "left").withColumn("__size", F.coalesce("__size", F.lit(0))).select("task_id", "__size", "__edges", "__hashes", "__stored.*")
    whole = F.col("__size") <= limit
    same = lambda c, v: F.coalesce(c == v, F.lit(False))
    listed = lambda c: F.coalesce(F.sort_array(c), F.array().cast("array<string>"))
    oracle = [
        (~whole, "incomplete"),
        (whole & ~same(F.col("found"), F.size("__edges") > 0), "oracle_found"),
        (whole & ~same(F.col("n_tx"), F.size("__hashes").cast("long")), "oracle_n_tx"),
        (whole & ~same(F.col("n_edges"), F.size("__edges").cast("long")), "oracle_n_edges"),
        (whole & ~same(listed("edge_ids"), F.col("__edges")), "oracle_edge_ids"),
        (whole & ~same(listed("tx_hashes"), F.col("__hashes")), "oracle_tx_hashes"),
    ]
    return _broken(tasks, form).unionByName(_broken(rows, oracle))


def profile_violations(tasks: DataFrame) -> DataFrame:
    """(rule, id) of tracing tasks whose tools do not fit their profile.

    ``tasks``: task_id, profile, required_tools, allowed_tools, tool_requirement, public_profile, candidates and groups
    (arrays of ids) and contract (tool, with_raw, per_candidate, candidate_count, max_calls; may be null).
    """
    only = F.array(F.lit("edge"))
    grounded, context = _is("profile", "tool_grounded"), _is("profile", "context_only")
    listed = lambda c: F.coalesce(F.array_sort(F.array_distinct(c)), F.array().cast("array<string>"))
    n = F.size(listed("groups"))
    is_ = lambda f, v: F.coalesce(F.col(f"contract.{f}") == v, F.lit(False))
    tools = lambda c: F.coalesce(F.col(c) == only, F.lit(False))
    rules = [
        (~grounded & ~context, "unknown_profile"),
        (grounded & ~(tools("required_tools") & tools("allowed_tools")), "grounded_tools"),
        (grounded & ~_is("tool_requirement", "required"), "grounded_not_required"),
        (grounded & ~_is("public_profile", "candidate_tool_query"), "grounded_public_profile"),
        (grounded & ((n == 0) | (listed("groups") != listed("candidates"))), "groups_not_candidates"),
        (grounded & ~(is_("tool", F.lit("edge")) & is_("with_raw", F.lit(True)) & is_("per_candidate", F.lit(1)) & is_("candidate_count", n)), "contract"),
        (grounded & ~is_("max_calls", n), "budget"),
        (context & ~(_empty("required_tools") & _empty("allowed_tools")), "context_tools"),
        (context & ~_is("tool_requirement", "disabled"), "context_requirement"),
        (context & ~_is("public_profile", "graph_context"), "context_public_profile"),
    ]
    return _broken(tasks, rules)


def tracing_protocol(tasks: DataFrame, groups: DataFrame, calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether tool calls of tracing tasks kept to the rules: task_id, errors, n_calls, n_valid, covered, uncovered (numbers of
    candidates), coverage, required_share, parameter_accuracy, unnecessary_share, error_share, n_detector.

    ``tasks``: task_id, required, allowed (arrays), max_calls (null: no budget). ``groups``: task_id, candidate_id, edge_id of
    a candidate's members. ``calls``: task_id, turn, tool, edge_id, with_raw, status. ``answers``: task_id of those that are
    right in form. Calls of the detector are counted apart and are no evidence. A look-up of an edge is valid if it asks for
    the raw edge, names a member that no turn before has named, and succeeds; it covers all candidates with that member.
    """
    keyed = groups.select("task_id", "candidate_id", C.canonical_edge_id("edge_id").alias("key")).where("key IS NOT NULL").distinct()
    evidence = calls.where(F.col("tool") != "detector").withColumn("key", F.when(F.col("tool") == "edge", C.canonical_edge_id("edge_id")))
    again = Window.partitionBy("task_id", "key").orderBy("turn")
    members = keyed.select("task_id", "key").distinct().withColumn("__member", F.lit(True))
    # Only calls that name an edge can repeat one; those without stand each for itself.
    named = evidence.where("key IS NOT NULL").withColumn("__turn", F.row_number().over(again)).join(members, ["task_id", "key"], "left")
    other = evidence.where("key IS NULL").withColumn("__turn", F.lit(1)).withColumn("__member", F.lit(None).cast("boolean"))
    done = F.coalesce(F.col("status") == "ok", F.lit(False))
    wrong = flags([
        (~F.coalesce(C.is_true("with_raw"), F.lit(False)), "call_without_raw"),
        (F.col("key").isNull(), "call_invalid_edge"),
        (F.col("key").isNotNull() & F.col("__member").isNull(), "call_outside"),
        (~done, "call_failed"),
        (F.col("__turn") > 1, "call_repeated"),
    ])
    lookup = F.col("tool") == "edge"
    met = named.unionByName(other).withColumn("wrong", F.when(lookup, wrong).otherwise(F.array().cast("array<string>"))).withColumns({"done": done, "valid": lookup & (F.size("wrong") == 0)})
    sums = met.groupBy("task_id").agg(
        F.count("*").alias("n_calls"),
        F.count_if(lookup).alias("n_lookups"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("done")).alias("n_failed"),
        F.array_distinct(F.flatten(F.collect_set("wrong"))).alias("wrong"),
        F.collect_set(F.when(F.col("done"), F.col("tool"))).alias("succeeded"),
        F.collect_set("tool").alias("called"),
    )
    seen = met.where("valid").select("task_id", "key").distinct().join(keyed, ["task_id", "key"]).groupBy("task_id").agg(F.count_distinct("candidate_id").alias("covered"))
    all_ = groups.groupBy("task_id").agg(F.count_distinct("candidate_id").alias("candidates"))
    detector = calls.where(F.col("tool") == "detector").groupBy("task_id").agg(F.count("*").alias("n_detector"))
    rows = tasks.select("task_id", "required", "allowed", "max_calls").join(answers.select("task_id").distinct().withColumn("__answered", F.lit(True)), "task_id", "left")
    for more in (sums, seen, all_, detector):
        rows = rows.join(more, "task_id", "left")
    rows = rows.na.fill(0, ["n_calls", "n_lookups", "n_valid", "n_failed", "covered", "candidates", "n_detector"])
    for c in ("wrong", "succeeded", "called", "required", "allowed"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    rules = [
        (F.size(F.array_except("required", "succeeded")) > 0, "required_missing"),
        (F.size(F.array_except("called", "allowed")) > 0, "disallowed"),
        (F.col("covered") < F.col("candidates"), "uncovered"),
        (F.col("n_calls") > F.col("max_calls"), "over_budget"),
        (F.col("__answered").isNull(), "invalid_answer"),
    ]
    part = lambda a, b, empty=0.0: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(empty))
    required = F.size(F.array_distinct("required"))
    share = F.when(required == 0, 1.0).otherwise(F.size(F.array_intersect("required", "succeeded")) / required)
    rows = rows.withColumn("n_unnecessary", F.col("n_lookups") - F.col("n_valid"))
    return rows.select("task_id", F.array_sort(F.concat(flags(rules), "wrong")).alias("errors"), "n_calls", "n_valid", "covered", (F.col("candidates") - F.col("covered")).alias("uncovered"), part("covered", "candidates").alias("coverage"), share.alias("required_share"), part("n_valid", "n_lookups").alias("parameter_accuracy"), part("n_unnecessary", "n_calls").alias("unnecessary_share"), part("n_failed", "n_calls").alias("error_share"), "n_detector")
