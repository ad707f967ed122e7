"""Checks and scores of stored answers, tool calls and policies, as joins of typed tables.

Lists of errors are sorted names; an answer is right in form where its list is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .reports import flags
from .scoring import ACTIONS, brier, ece, edge_answer_errors, macro_f1, precision_recall

EXISTENCE_FIELDS = ("exists", "matching_edge_ids", "matching_tx_hashes", "transaction_count")


def none() -> Column:
    return F.array().cast("array<string>")


def existence_answer(answers: DataFrame, text: str = "answer") -> DataFrame:
    """An answer to whether transactions exist, by strict rules: task_id, found, n, edge_ids, tx_hashes, errors.

    The JSON object must have four fields of the right types and no others; ids must not repeat, hashes must be hashes,
    and flag, count and lists must agree.
    """
    bare = F.regexp_extract(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "```(?:json)?", ""), "(?s)([{].*[}])", 1)
    rows = answers.withColumn("v", F.try_parse_json(F.when(bare != "", bare)))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    ids = lambda f: F.when(_is_list(kind(f)), F.transform(F.coalesce(F.try_variant_get("v", f"$.{f}", "array<string>"), none()), F.lower)).otherwise(none())
    rows = rows.withColumns(
        {
            "keys": F.coalesce(F.json_object_keys(bare), none()),
            "found": F.when(kind("exists") == "BOOLEAN", F.try_variant_get("v", "$.exists", "boolean")),
            "whole": F.when(kind("transaction_count") == "BIGINT", F.try_variant_get("v", "$.transaction_count", "long")),
            "edge_ids": ids("matching_edge_ids"),
            "tx_hashes": ids("matching_tx_hashes"),
            "listed_edges": F.coalesce(_is_list(kind("matching_edge_ids")), F.lit(False)),
            "listed_hashes": F.coalesce(_is_list(kind("matching_tx_hashes")), F.lit(False)),
        }
    )
    n = F.when(F.col("whole") >= 0, F.col("whole")).otherwise(0)
    repeats = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    fields = F.array(*map(F.lit, EXISTENCE_FIELDS))
    yes, no = F.coalesce(F.col("found"), F.lit(False)), ~F.coalesce(F.col("found"), F.lit(True))
    object_ = F.col("v").isNotNull()
    rules = [
        (F.size(F.array_except(fields, "keys")) > 0, "missing_fields"),
        (F.size(F.array_except("keys", fields)) > 0, "unexpected_fields"),
        (F.col("found").isNull(), "exists_not_boolean"),
        (~F.coalesce(F.col("whole") >= 0, F.lit(False)), "count_not_whole"),
        (~F.col("listed_edges"), "edge_ids_not_list"),
        (~F.col("listed_hashes"), "tx_hashes_not_list"),
        (repeats("edge_ids"), "edge_ids_repeat"),
        (repeats("tx_hashes"), "tx_hashes_repeat"),
        (F.exists("tx_hashes", lambda h: ~h.rlike(f"^{C.TX_HASH}$")), "invalid_hashes"),
        (F.col("found").isNotNull() & (F.col("found") != (n > 0)), "exists_against_count"),
        (n != F.size(F.array_distinct("tx_hashes")), "count_against_hashes"),
        (yes & (F.size("edge_ids") == 0), "exists_without_edges"),
        (no & ((F.size("edge_ids") > 0) | (F.size("tx_hashes") > 0)), "absent_with_ids"),
    ]
    errors = F.when(object_, F.array_sort(flags(rules))).otherwise(F.array(F.lit("no_object")))
    return rows.select("task_id", "found", n.alias("n"), "edge_ids", "tx_hashes", errors.alias("errors"))


def _is_list(kind: Column) -> Column:
    return kind.rlike("^ARRAY<(?:STRING|BIGINT|VOID|VARIANT)>$")


def existence_protocol(tasks: DataFrame, calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether tool calls kept to a task and its answer says what they gave: task_id, errors, n_calls, n_valid, grounded and the share of required tools.

    ``tasks``: task_id, src, direction, block_min, block_max, edge_types, with_hashes, required, allowed (arrays).
    ``calls``: task_id, tool, status, address, direction, block_min, block_max, edge_type, with_raw, complete, edge_ids,
    tx_hashes. ``answers``: as ``existence_answer`` gives them. Only look-ups that break no rule count as seen.
    """
    given = tasks.select("task_id", F.lower("src").alias("t_src"), F.col("direction").alias("t_direction"), F.col("block_min").alias("t_min"), F.col("block_max").alias("t_max"), "edge_types", "with_hashes", "required", "allowed")
    met = calls.join(given, "task_id")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    wrong = F.array_compact(
        F.array(
            *(
                F.when(~F.coalesce(c, F.lit(False)), F.lit(n))
                for c, n in (
                    (same(F.lower("address"), F.col("t_src")), "address"),
                    (same(F.col("direction"), F.col("t_direction")), "direction"),
                    (same(F.col("block_min"), F.col("t_min")) & same(F.col("block_max"), F.col("t_max")), "window"),
                    (F.array_contains("edge_types", F.col("edge_type")), "edge_type"),
                    (~F.col("with_hashes") | F.col("with_raw"), "with_raw"),
                    ((F.col("status") == "ok") & F.col("complete"), "incomplete"),
                )
            )
        )
    )
    lookup = F.col("tool") == "neighbors"
    met = met.withColumn("wrong", F.when(lookup, wrong).otherwise(none())).withColumn("valid", lookup & (F.size("wrong") == 0))
    # Ids of a task's valid calls: a set a task, no larger than what its calls gave.
    sets = met.groupBy("task_id").agg(
        F.count("*").alias("n_calls"),
        F.count_if(lookup).alias("n_lookups"),
        F.count_if("valid").alias("n_valid"),
        F.array_distinct(F.flatten(F.collect_list("wrong"))).alias("wrong"),
        F.collect_set(F.when(F.col("status") == "ok", F.col("tool"))).alias("done"),
        F.collect_set("tool").alias("called"),
        F.collect_set(F.when(F.col("valid"), F.col("edge_type"))).alias("types_seen"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("valid"), F.transform("edge_ids", F.lower))))).alias("seen_edges"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("valid"), F.transform("tx_hashes", F.lower))))).alias("seen_hashes"),
    )
    rows = given.join(sets, "task_id", "left").join(answers.select("task_id", "found", "n", F.col("edge_ids").alias("said_edges"), F.col("tx_hashes").alias("said_hashes"), F.size("errors").alias("n_wrong")), "task_id", "left")
    for c in ("wrong", "done", "called", "seen_edges", "seen_hashes", "said_edges", "said_hashes"):
        rows = rows.withColumn(c, F.coalesce(c, none()))
    rows = rows.withColumn("types_seen", F.coalesce("types_seen", F.array().cast(rows.schema["edge_types"].dataType))).na.fill(0, ["n_calls", "n_lookups", "n_valid"])
    equal = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    valid_answer = F.coalesce(F.col("n_wrong") == 0, F.lit(False))
    grounded = valid_answer & equal("said_edges", "seen_edges") & equal("said_hashes", "seen_hashes") & (F.col("n") == F.size("seen_hashes")) & (F.col("found") == (F.size("seen_hashes") > 0))
    rules = [
        (F.size(F.array_except("required", "done")) > 0, "required_missing"),
        (F.size(F.array_except("called", "allowed")) > 0, "disallowed"),
        (F.size(F.array_except("edge_types", "types_seen")) > 0, "types_not_queried"),
        (~valid_answer, "invalid_answer"),
        (valid_answer & ~grounded, "not_grounded"),
    ]
    errors = F.array_sort(F.concat(flags(rules), F.transform("wrong", lambda w: F.concat(F.lit("call_"), w))))
    share = F.when(F.size("required") == 0, 1.0).otherwise(F.size(F.array_intersect("required", "done")) / F.size("required"))
    return rows.select("task_id", errors.alias("errors"), "n_calls", "n_valid", F.coalesce(grounded, F.lit(False)).alias("grounded"), share.alias("required_share"), F.coalesce(F.try_divide(F.col("n_valid"), F.col("n_lookups")), F.lit(0.0)).alias("parameter_accuracy"))


def existence_scores(answers: DataFrame, gold: DataFrame, protocol: DataFrame) -> DataFrame:
    """Answers (as ``existence_answer`` gives them) against gold (task_id, found, n, edge_ids, tx_hashes, negative_type): flags,
    precision and recall of both lists, and what the task and its protocol make of it. A task without an answer fails."""
    g = gold.select("task_id", F.col("found").alias("g_found"), F.col("n").alias("g_n"), F.transform("edge_ids", F.lower).alias("g_edges"), F.transform("tx_hashes", F.lower).alias("g_hashes"), "negative_type")
    rows = g.join(answers, "task_id", "left").join(protocol.select("task_id", F.col("errors").alias("p_errors")), "task_id", "left")
    form = F.coalesce(F.size("errors") == 0, F.lit(False))
    rows = rows.withColumns({"edge_ids": F.when(form, F.col("edge_ids")).otherwise(none()), "tx_hashes": F.when(form, F.col("tx_hashes")).otherwise(none())})
    right = form & F.coalesce(F.col("found") == F.col("g_found"), F.lit(False))
    counted = form & F.coalesce(F.col("n") == F.col("g_n"), F.lit(False))

    def lists(own: str, gold_: str):
        size = lambda c: F.size(F.array_distinct(c)).cast("long")
        both = F.size(F.array_intersect(own, gold_)).cast("long")
        precision, recall = precision_recall(both, size(own), size(gold_), 1.0)
        return precision, recall, (both == size(own)) & (both == size(gold_))

    ep, er, same_edges = lists("edge_ids", "g_edges")
    hp, hr, same_hashes = lists("tx_hashes", "g_hashes")
    task = right & counted & same_edges & same_hashes
    protocol_pass = F.coalesce(F.size("p_errors") == 0, F.lit(False))
    sign = lambda c: F.when(c, right.cast("double"))
    return rows.select(
        "task_id",
        right.cast("double").alias("existence_accuracy"),
        counted.cast("double").alias("count_accuracy"),
        ep.alias("edge_precision"),
        er.alias("edge_recall"),
        hp.alias("hash_precision"),
        hr.alias("hash_recall"),
        sign(F.col("g_found")).alias("positive_accuracy"),
        sign(~F.col("g_found")).alias("negative_accuracy"),
        sign(F.col("negative_type") == "reversed_direction").alias("reversal_accuracy"),
        task.alias("task_pass"),
        protocol_pass.alias("protocol_pass"),
        (task & protocol_pass).alias("passed"),
    )


def with_protocol(judgements: DataFrame, protocol: DataFrame) -> DataFrame:
    """Judgements (task_id, profile, task_pass) with their protocol: those that tools must ground pass only with it, and
    their groundedness is five times what the protocol found. Others stay as they are."""
    rows = judgements.join(protocol.select("task_id", F.size("errors").alias("n_errors"), "grounded"), "task_id", "left")
    tool = F.col("profile") == "tool_grounded"
    kept = F.coalesce(F.col("n_errors") == 0, F.lit(False))
    passed = F.when(tool, F.col("task_pass") & kept).otherwise(F.col("task_pass"))
    return rows.select("task_id", "profile", "task_pass", F.when(tool, kept).alias("protocol_pass"), passed.alias("passed"), F.when(tool, F.round(5.0 * F.coalesce("grounded", F.lit(False)).cast("double"), 6)).alias("groundedness"))


#: The one error that a repair may mend.
REPAIRABLE = "selected"


def accepted_repairs(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """task_id and whether its repaired answer stands in: only if the list of selected edges was the sole fault and no
    decision changed. Both: task_id, task_type, decisions (any type), errors. Questions of other types are never repaired."""
    a = original.select("task_id", "task_type", F.to_json(F.struct("decisions")).alias("old"), F.col("errors").alias("was"))
    b = repaired.select("task_id", F.to_json(F.struct("decisions")).alias("new"), F.col("errors").alias("left"))
    known = F.col("task_type").isin("edge_action_classification", "path_completion", "subgraph_noise_filtering")
    only = (F.size("was") > 0) & F.forall("was", lambda e: e.startswith(REPAIRABLE))
    good = known & only & (F.col("old") == F.col("new")) & (F.size("left") == 0)
    return a.join(b, "task_id", "left").select("task_id", F.coalesce(good, F.lit(False)).alias("accepted"))


def reached_steps(steps: DataFrame, candidates: DataFrame, seeds: DataFrame, kept) -> DataFrame:
    """Steps (task_id, state_id) that the seeds (task_id, node) reach by the edges that reached steps select.

    ``steps``: task_id, state_id, node, selected. ``candidates``: task_id, edge_id, dst. Goes on until no state is new.
    """
    # Both are read by each round: written once.
    moves = kept(steps.select("task_id", "state_id", F.explode("selected").alias("edge_id")).join(candidates, ["task_id", "edge_id"]).select("task_id", "state_id", F.lower("dst").alias("node")).distinct())
    states = kept(steps.select("task_id", "state_id", F.lower("node").alias("node")).distinct())
    frontier = seen = kept(states.join(seeds.select("task_id", F.lower("node").alias("node")).distinct(), ["task_id", "node"], "left_semi").select("task_id", "state_id").distinct())
    while not frontier.isEmpty():
        to = moves.join(frontier, ["task_id", "state_id"]).select("task_id", "node").distinct()
        frontier = kept(states.join(to, ["task_id", "node"], "left_semi").select("task_id", "state_id").distinct().join(seen, ["task_id", "state_id"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def sequential_errors(tasks: DataFrame, states: DataFrame, candidates: DataFrame, steps: DataFrame, decisions: DataFrame, kept) -> DataFrame:
    """Errors of policies by task: task_id, errors, n_steps, n_unreached.

    ``tasks``: task_id, start_node, max_steps, max_edges, seeds (array), top_k, selected_seeds (array). ``states``: task_id, state_id,
    node. ``candidates``: task_id, state_id, edge_id, dst. ``steps``: task_id, state_id, node, selected. ``decisions``:
    task_id, state_id, edge_id, action and probabilities. Every state must be met once, at its node, with each candidate
    decided once; selected edges must be those to follow; steps must be reached from the start; budgets hold.
    """
    key = F.struct("task_id", "state_id")
    known = states.select("task_id", "state_id", F.lower("node").alias("at"))
    once = steps.groupBy("task_id", "state_id").agg(F.count("*").alias("times"), F.min(F.lower("node")).alias("node"), F.flatten(F.collect_list("selected")).alias("selected"))
    both = known.join(once, ["task_id", "state_id"], "full_outer")
    rules = [(F.col("at").isNull(), "unknown_state"), (F.col("times") > 1, "state_twice"), (F.col("times").isNull(), "state_missing"), (F.col("node") != F.col("at"), "wrong_node")]
    by_state = both.select("task_id", F.explode(flags(rules)).alias("e"))
    asked = candidates.select(key.alias("task_id"), "edge_id")
    given = decisions.select(key.alias("task_id"), "edge_id", "action", *(f"p_{a}" for a in ACTIONS))
    by_edge = edge_answer_errors(given, asked).select("task_id.task_id", F.explode("errors").alias("e")).select("task_id", F.concat(F.lit("edge_"), "e").alias("e"))
    follow = decisions.where("action = 'follow' and p_follow >= 0.5").groupBy("task_id", "state_id").agg(F.array_sort(F.collect_set("edge_id")).alias("follow"))
    chosen = once.join(follow, ["task_id", "state_id"], "left").where(F.array_sort(F.array_distinct("selected")) != F.coalesce("follow", none())).select("task_id", F.lit(REPAIRABLE).alias("e"))
    seen = reached_steps(steps.join(known, ["task_id", "state_id"], "left_semi"), candidates.select("task_id", "edge_id", "dst").distinct(), tasks.select("task_id", F.col("start_node").alias("node")), kept)
    lost = once.join(known, ["task_id", "state_id"], "left_semi").join(seen, ["task_id", "state_id"], "left_anti")
    used = once.groupBy("task_id").agg(F.count("*").alias("n_steps")).join(decisions.groupBy("task_id").agg(F.count("*").alias("n_edges")), "task_id", "full_outer")
    by_task = tasks.join(used, "task_id", "left").na.fill(0, ["n_steps", "n_edges"])
    limits = [
        (F.col("n_steps") > F.col("max_steps"), "too_many_steps"),
        (F.col("n_edges") > F.col("max_edges"), "too_many_edges"),
        (F.size(F.array_except("selected_seeds", "seeds")) > 0, "unknown_seed"),
        (F.size(F.array_distinct("selected_seeds")) != F.size("selected_seeds"), "seed_twice"),
        (F.size("selected_seeds") > F.greatest(F.lit(1), "top_k"), "too_many_seeds"),
    ]
    errors = by_state.unionByName(by_edge).unionByName(chosen).unionByName(lost.select("task_id", F.lit("not_reached").alias("e"))).unionByName(by_task.select("task_id", F.explode(flags(limits)).alias("e")))
    listed = errors.groupBy("task_id").agg(F.array_sort(F.collect_set("e")).alias("errors"))
    missed = lost.groupBy("task_id").agg(F.count("*").alias("n_unreached"))
    out = by_task.select("task_id", "n_steps").join(listed, "task_id", "left").join(missed, "task_id", "left").na.fill(0, ["n_unreached"])
    return out.select("task_id", F.coalesce("errors", none()).alias("errors"), "n_steps", "n_unreached")


def sequential_scores(decisions: DataFrame, paths: DataFrame, gold_paths: DataFrame, keys: tuple[str, ...] = ("task_id", "mode")) -> DataFrame:
    """Scores of policies by task and mode: sets of followed edges, action accuracy, macro F1, Brier score, calibration, coverage,
    whether a whole gold path was found, and what it took.

    ``decisions``: keys, state_id, edge_id, action, probabilities, gold (null where none is known). ``paths``: keys, path.
    ``gold_paths``: task_id, path.
    """
    known, follow, gold = F.col("gold").isNotNull(), (F.col("action") == "follow") & (F.col("p_follow") >= 0.5), F.col("gold") == "follow"
    sums = decisions.groupBy(*keys).agg(
        F.count_if(follow).alias("n_follow"),
        F.count_if(F.coalesce(gold, F.lit(False))).alias("n_gold"),
        F.count_if(follow & F.coalesce(gold, F.lit(False))).alias("n_both"),
        F.avg(F.when(known, (F.col("action") == F.col("gold")).cast("double"))).alias("accuracy"),
        F.avg(F.when(known, brier("gold"))).alias("brier"),
        F.count_distinct("state_id").alias("n_steps"),
        F.count("*").alias("n_edges"),
    )
    with_gold = decisions.where(known)
    f1 = macro_f1(with_gold, list(keys), "action", "gold")
    calibration = ece(with_gold.withColumn("hit", gold.cast("int")), list(keys), "p_follow", "hit")
    whole = paths.join(gold_paths, ["task_id", "path"], "left_semi").select(*keys).distinct().withColumn("complete", F.lit(True))
    rows = sums.join(f1, list(keys), "left").join(calibration, list(keys), "left").join(whole, list(keys), "left")
    precision, recall = precision_recall(F.col("n_both"), F.col("n_follow"), F.col("n_gold"), 0.0)
    rows = rows.withColumns({"prec": precision, "recall": recall})
    f = F.coalesce(F.try_divide(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall")), F.lit(0.0))
    coverage = F.when(F.col("n_gold") > 0, F.col("n_both") / F.col("n_gold")).otherwise((F.col("n_follow") == 0).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(*keys, "prec", "recall", f.alias("f1"), zero("accuracy").alias("accuracy"), zero("macro_f1").alias("macro_f1"), zero("brier").alias("brier"), zero("ece").alias("ece"), coverage.alias("coverage"), F.coalesce("complete", F.lit(False)).alias("complete"), "n_steps", "n_edges")
