"""Entities, flows, rules and address mappings that case reports state.

A report has report_id, case_id, protocol_type, vulnerability_type, root_cause, fund_flow, incident_date, victims,
attackers and loss_assets (arrays of texts). Sources have source_id, pos, grade, entity and finding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .evidence import merge_mappings


def holds(text: Column, *words: str) -> Column:
    """Whether a lower-cased text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w.lower()))
    return out


def chosen(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Value of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def flags(rules: Sequence[tuple[Column, str]]) -> Column:
    """Values of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in rules)))


# Kinds of incidents and the words that call for them.
def incident_type(protocol: Column, vulnerability: Column, cause: Column) -> Column:
    return chosen(
        [
            (holds(protocol, "bridge"), "bridge_exploit"),
            (holds(vulnerability, "validator") | holds(cause, "private key"), "key_compromise"),
            (holds(vulnerability, "oracle") | holds(cause, "price"), "oracle_or_market_manipulation"),
            (holds(vulnerability, "reentr"), "smart_contract_exploit"),
        ],
        "security_incident",
    )


# Names of constraints and skills, and the words that call for them.
ALWAYS_FORBIDDEN = (
    "do_not_treat_reported_edges_as_chain_verified_without_tx_hash_or_index_match",
    "do_not_infer_cex_account_owner_without_external_evidence",
    "do_not_merge_all_attacker_mentioned_addresses_without_source_support",
)
FORBIDDEN = (
    ("do_not_label_all_tornado_withdrawals_as_same_actor", ("tornado",)),
    ("do_not_expand_sanctioned_entity_scope_beyond_listed_addresses_without_evidence", ("sanction", "ofac")),
)
ALWAYS_SKILLS = (
    "extract_seed_addresses_from_multi_source_reports",
    "separate_reported_edges_from_chain_verified_edges",
    "assign_confidence_from_source_grade_and_cross_source_support",
)


def constraints(text: Column) -> Column:
    """What must not be concluded from a case, by the words of its report."""
    return flags([(F.lit(True), n) for n in ALWAYS_FORBIDDEN] + [(holds(text, *words), n) for n, words in FORBIDDEN])


def skills(text: Column, has_exchange_flow: Column) -> Column:
    """What a case asks for, by the words of its report and whether a flow goes to an exchange."""
    rules = [
        (holds(text, "bridge"), "identify_bridge_exit_path"),
        (holds(text, "validator", "private key"), "recognize_validator_key_compromise_as_root_cause"),
        (holds(text, "usdc") & holds(text, "swap"), "trace_stablecoin_swap_to_native_asset_after_theft"),
        (has_exchange_flow, "detect_cex_deposit_layering_from_reported_amounts"),
        (holds(text, "tornado"), "stop_at_censored_mixer_boundary_unless_withdrawal_linkage_evidence"),
        (holds(text, "chain-hopping", "bnb"), "identify_bridge_swap_bridge_chain_hopping_route"),
        (holds(text, "12,000", "12000"), "detect_large_address_fanout_laundering_pattern"),
    ]
    return flags([(F.lit(True), n) for n in ALWAYS_SKILLS] + rules)


# Roles of addresses and the words that call for them.
def address_role(role: Column, kind: Column, pattern: Column | None = None) -> Column:
    """Role of an address by its entity and, if given, the pattern of a flow; never more than they say."""
    pattern = F.lit("") if pattern is None else pattern
    return chosen(
        [
            (holds(pattern, "cex_deposit"), "cex_deposit_address"),
            (holds(pattern, "mixer_deposit"), "mixer_deposit_contract"),
            (holds(pattern, "bridge") | holds(role, "bridge"), "bridge_contract"),
            (holds(pattern, "dex", "swap", "router") | holds(role, "dex", "swap", "router"), "dex_router"),
            (holds(role, "exchange", "cex"), "cex_labeled_address"),
            (holds(role, "mixer"), "mixer_deposit_contract"),
            (holds(role, "contract") | (kind == "contract_or_protocol"), "protocol_contract"),
        ],
        "service_address",
    )


# Reasons that make a question one about the chain.
CHAIN_REASONS = (
    "agent_action_policy",
    "boundary_decision",
    "chain_report_alignment",
    "constraint_check",
    "constraint_lookup",
    "direct_link_verification",
    "edge_metadata_lookup",
    "edge_profile_lookup",
    "false_positive_check",
    "ground_truth_usability_check",
    "infrastructure_boundary_check",
    "multi_hop_path_prediction",
    "multi_hop_stage_reasoning",
    "negative_link_verification",
    "path_completion",
    "relation_inference",
    "single_hop_prediction",
    "source_reliability_check",
    "transaction_metadata_lookup",
    "transaction_profile_lookup",
)
#: These need a fact from the chain among their support.
NEED_CHAIN_FACT = ("false_positive_check", "source_reliability_check")


def qa_domain(given: Column, link_semantics: Column, subject: Column, edge: Column, reason: Column, origins: Column) -> Column:
    """general or chain; ``origins`` are those of the supporting facts."""
    set_ = lambda c: F.coalesce(c, F.lit("")) != ""
    from_chain = F.exists(F.coalesce(origins, F.array().cast("array<string>")), lambda o: o.startswith("chain_evidence.edges") | o.startswith("chain_evidence.transaction_evidence"))
    about = set_(link_semantics) | subject.startswith("edge:") | subject.rlike(f"^{C.TX_HASH}$") | set_(edge) | (reason.isin(*CHAIN_REASONS) & (~reason.isin(*NEED_CHAIN_FACT) | from_chain))
    return F.when(given.isin("general", "chain"), given).when(about, "chain").otherwise("general")


#: Grades from best to worst; anything else is unknown.
GRADES = "ABCD"


def tier(keywords: Column | list[str], grades: str | None = None, most: int = 5) -> Column:
    """One way to find evidence: sources of these grades (null: all) that hold a keyword, the first ``most``."""
    words = keywords if isinstance(keywords, Column) else F.array(*map(F.lit, keywords))
    return F.struct(words.alias("keywords"), F.lit(grades).cast("string").alias("grades"), F.lit(most).alias("most"))


def with_evidence(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence and confidence of rows by their ``tiers``, which are dropped: the first of them that finds a source counts.

    Sources are the short list of a study, gathered into one row that all tasks get; they stand in the order of position.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("pos", "source_id", "grade", F.lower(F.concat_ws(" ", "entity", "finding")).alias("text")))).alias("__sources"))

    def found(t: Column) -> Column:
        fits = lambda s: (t["grades"].isNull() | F.contains(t["grades"], s["grade"])) & F.exists(t["keywords"], lambda k: (k != "") & F.contains(s["text"], F.lower(k)))
        return F.slice(F.filter("__sources", fits), 1, t["most"])

    out = rows.join(F.broadcast(one)).withColumn("__found", F.filter(F.transform("tiers", found), lambda h: F.size(h) > 0))
    out = out.withColumn("__hits", F.coalesce(F.get("__found", F.lit(0)), F.slice("__sources", 1, 0)))
    best = F.array_min(F.filter(F.transform("__hits", lambda s: s["grade"]), lambda g: F.contains(F.lit(GRADES), g)))
    return out.withColumns({"evidence": F.transform("__hits", lambda s: s["source_id"]), "confidence": F.coalesce(best, F.lit("U"))}).drop("tiers", "__sources", "__found", "__hits")


# Services by the words that name them: id, name, role, words, and the words and grades of their evidence.
SERVICES = (
    ("entity:tornado_cash", "Tornado Cash", "mixer_contract_set", ("tornado",), ("Tornado Cash", "mixer"), "ABC"),
    ("entity:dex_route", "DEX route", "dex_or_swap_route", ("DEX", "swap", "1inch", "Uniswap", "Curve"), ("DEX", "swap", "1inch", "Uniswap", "Curve"), "BCD"),
    ("entity:maker", "Maker", "lending_protocol", ("Maker", "borrow", "DAI"), ("Maker", "borrow", "DAI"), "BCD"),
    ("entity:curve", "Curve", "dex_or_swap_route", ("Curve", "SynthSwap"), ("Curve", "SynthSwap"), "BCD"),
    ("entity:oneinch", "1inch", "dex_or_swap_route", ("1inch",), ("1inch",), "BCD"),
    ("entity:ftx", "FTX", "centralized_exchange", ("FTX",), ("FTX",), "BCD"),
    ("entity:cryptocom", "Crypto.com", "centralized_exchange", ("Crypto.com",), ("Crypto.com",), "BCD"),
    ("entity:huobi", "Huobi", "centralized_exchange", ("Huobi",), ("Huobi",), "BCD"),
    ("entity:blender_io", "Blender.io", "bitcoin_mixer", ("blender",), ("Blender", "mixer"), "ABC"),
)
# Words of sources about attackers in general, and about sanctions, with the grades that count.
ATTACKER_WORDS, ATTACKER_GRADES = ("attacker address", "hacker address", "Lazarus", "OFAC"), "ABCD"
SANCTION_WORDS, SANCTION_GRADES = ("OFAC", "sanction", "SDN"), "AB"
#: Attackers up to this place may be backed by sources about sanctions alone.
SANCTION_PLACES = 4


def report_text(rows: DataFrame) -> Column:
    """All that a report says, as one text."""
    return F.concat_ws(" ", "protocol_type", "vulnerability_type", "root_cause", "fund_flow", *(F.array_join(c, " ") for c in ("victims", "attackers", "loss_assets")))


def entity_id(label: Column) -> Column:
    return F.concat(F.lit("entity:"), C.slug(label))


def attackers(reports: DataFrame) -> DataFrame:
    """Each address that a report gives for the attacker, once: report_id, place (from 0), address, format, said."""
    rows = reports.select("report_id", F.posexplode("attackers").alias("entry", "said"))
    evm = rows.withColumn("found", F.explode(C.mentions("said", C.ADDRESS))).withColumn("format", F.lit("evm"))
    rest = F.regexp_extract_all(F.regexp_replace("said", C.ADDRESS, " "), F.lit(f"\\b([{C.BASE58}]{{32,44}})\\b"), F.lit(1))
    solana = rows.withColumn("found", F.explode(F.array_distinct(rest))).withColumn("format", F.lit("solana"))
    # A report's list is short: it is put in order within its row.
    each = evm.unionByName(solana).groupBy("report_id", "found", "format").agg(F.min("entry").alias("entry"), F.min_by("said", "entry").alias("said"))
    listed = each.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("entry", "format", "found", "said"))).alias("all"))
    return listed.select("report_id", F.posexplode("all").alias("place", "x")).select("report_id", "place", F.col("x.found").alias("address"), "x.format", "x.said")


def entities(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Victims, attackers, addresses that are merely mentioned, and services: report_id, entity_id, type, role, address, evidence, confidence.

    An attacker's evidence is what names the address; else, for the first one, what tells of attackers; else, for the first
    few, what tells of sanctions.
    """
    base = reports.withColumn("text", report_text(reports))
    none = F.lit(None).cast("string")

    def entity(rows: DataFrame, id_: Column, kind: str, role: Column, address: Column, *tiers: Column) -> DataFrame:
        ways = F.array_compact(F.array(*tiers))
        return rows.select("report_id", id_.alias("entity_id"), F.lit(kind).alias("type"), role.alias("role"), address.alias("address"), ways.alias("tiers"))

    victims = base.select("report_id", F.explode(F.array_distinct("victims")).alias("label"))
    victims = entity(victims, entity_id(F.col("label")), "contract_or_protocol", F.lit("victim"), none, tier(F.array("label", F.lit("bridge"), F.lit("victim"))))
    named, address = attackers(reports), F.col("address")
    fake = (F.col("format") != "evm") & holds(F.col("said"), "fake sysvar")
    role = F.when(fake, "fake_sysvar_account").when(F.col("place") == 0, "attacker_initial").when(F.col("format") == "evm", "attacker_ethereum_wallet").otherwise("attacker_solana_wallet")
    about = F.when(F.col("place") == 0, tier(list(ATTACKER_WORDS), ATTACKER_GRADES))
    sanctions = F.when(F.col("place") < SANCTION_PLACES, tier(list(SANCTION_WORDS), SANCTION_GRADES))
    found = entity(named, address, "address", role, address, tier(F.array("address")), about, sanctions)
    said = base.select("report_id", F.explode(C.mentions("text", C.ADDRESS)).alias("address")).join(named.select("report_id", "address"), ["report_id", "address"], "left_anti")
    found = found.unionByName(entity(said, address, "address", F.lit("mentioned_address"), address, tier(F.array("address"), most=3)))
    for id_, _, kind, words, evidence, grades in SERVICES:
        found = found.unionByName(entity(base.where(holds(F.col("text"), *words)), F.lit(id_), "service", F.lit(kind), none, tier(list(evidence), grades)))
    return with_evidence(victims.unionByName(found), sources)


_AMOUNT = "([0-9][0-9,.]*)"
#: Exchanges whose amounts a report may give.
EXCHANGES = (("ftx", "FTX"), ("cryptocom", "Crypto[.]com"), ("huobi", "Huobi"))


def report_edges(reports: DataFrame) -> DataFrame:
    """Flows that a report states: report_id, edge_id, src, dst, stage, pattern, asset, amount.

    Thefts by lost asset, a swap of stable coins, deposits at exchanges, a mixer in either direction, chain hops, the exit
    of a bridge and restaking. Constants of single incidents are data and are not part of it.
    """
    named = attackers(reports)
    real = ~((F.col("format") == "solana") & holds(F.col("said"), "fake sysvar"))
    first = named.where(real).groupBy("report_id").agg(F.min_by(F.when(F.col("format") == "evm", F.col("address")), F.when(F.col("format") == "evm", F.col("place"))).alias("evm"), F.min_by(F.when(F.col("format") == "solana", F.col("address")), F.when(F.col("format") == "solana", F.col("place"))).alias("solana"))
    rows = reports.withColumn("text", report_text(reports)).join(first, "report_id", "left")
    flow = F.coalesce("fund_flow", F.lit(""))
    primary = F.coalesce("evm", "solana", F.lit("entity:attacker_unknown"))
    rows = rows.withColumns({"primary": primary, "primary_solana": F.coalesce("solana", primary), "victim": entity_id(F.coalesce(F.get("victims", F.lit(0)), "protocol_type", F.lit("Victim protocol")))})
    null = F.lit(None).cast("string")

    def edge(condition, id_, src, dst, stage, pattern, asset=null, amount=null):
        text = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.when(condition, F.struct(text(id_).alias("edge_id"), text(src).alias("src"), text(dst).alias("dst"), text(stage).alias("stage"), text(pattern).alias("pattern"), text(asset).alias("asset"), text(amount).alias("amount")))

    def number(pattern: str) -> Column:
        found = F.regexp_extract(flow, f"(?i){pattern}", 1)
        return F.when(found != "", found)

    minted = holds(F.col("text"), "mint") & holds(F.col("text"), "without collateral")
    losses = F.filter(F.transform("loss_assets", lambda a: F.struct(F.regexp_extract(a, "^\\s*([0-9,.]+)\\s+[A-Za-z0-9]+\\s*$", 1).alias("amount"), F.upper(F.regexp_extract(a, "^\\s*[0-9,.]+\\s+([A-Za-z0-9]+)\\s*$", 1)).alias("asset"))), lambda x: x["asset"] != "")
    theft = F.transform(losses, lambda x: edge(F.lit(True), F.concat(F.lit("edge:theft:"), F.lower(x["asset"])), F.col("victim"), F.when(minted, F.col("primary_solana")).otherwise(F.col("primary")), "theft", F.when(minted, "fraudulent_uncollateralized_mint").otherwise("fraudulent_bridge_withdrawal"), F.when(x["asset"] == "ETH", "WETH").otherwise(x["asset"]), x["amount"]))
    me = F.col("primary")
    funding = holds(flow, "from tornado", "received")
    bridged = number(f"bridged\\s+{_AMOUNT}\\s+W?ETH")
    single = [
        edge(F.contains(flow, F.lit("USDC")) & (holds(flow, "swap") | F.contains(flow, F.lit("DEX"))), "edge:conversion:usdc_to_eth", me, "entity:dex_route", "conversion", "stablecoin_to_native_asset_swap", "USDC", number(f"{_AMOUNT}\\s*USDC")),
        *(edge(number(f"{name}:?\\s*{_AMOUNT}\\s*ETH").isNotNull(), f"edge:cex:{id_}", me, f"entity:{id_}", "layering", "cex_deposit", "ETH", number(f"{name}:?\\s*{_AMOUNT}\\s*ETH")) for id_, name in EXCHANGES),
        edge(holds(flow, "tornado"), "edge:funding_or_mixing:tornado_cash", F.when(funding, "entity:tornado_cash").otherwise(me), F.when(funding, me).otherwise(F.lit("entity:tornado_cash")), F.when(funding, "funding").otherwise("mixing"), F.when(funding, "mixer_withdrawal_to_attacker").otherwise("mixer_deposit"), null, number("Tornado Cash.*?([$]?[0-9,.]+M[+]?|[0-9][0-9,.]*\\s*ETH)")),
        edge(F.contains(flow, F.lit("BNB")) & F.contains(flow, F.lit("BitTorrent")), "edge:chain_hop:eth_bnb_bittorrent", "Ethereum", "BitTorrent Chain", "chain_hopping", "bridge_swap_bridge"),
        edge(bridged.isNotNull() & F.col("evm").isNotNull(), "edge:bridge_exit:to_ethereum", F.col("primary_solana"), F.col("evm"), "bridge_exit", "cross_chain_exit_to_ethereum", "ETH", bridged),
        edge(holds(flow, "steth"), "edge:defi_reinvestment:eth_to_steth_maker", me, "entity:maker", "post_dormancy_reinvestment", "swap_stake_collateralize_borrow"),
    ]
    return rows.select("report_id", F.explode(F.concat(theft, F.array_compact(F.array(*single)))).alias("e")).select("report_id", "e.*").distinct()


#: What may be claimed of a mapping.
STATUSES = ("chain_verified", "source_verified", "reported")


def judged_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings (entity_id, chain, address, address_role, status, confidence, evidence, from_block, to_block), normalised,
    with their outcome: ok, invalid (another chain, no address, another status) or missing_evidence."""
    evidence = F.array_sort(F.array_distinct(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.trim(e) != "")))
    rows = mappings.withColumns({"chain": F.lower(F.coalesce("chain", F.lit(""))), "address": F.lower(F.coalesce("address", F.lit(""))), "status": F.coalesce("status", F.lit("reported")), "confidence": F.coalesce("confidence", F.lit("U")), "evidence": evidence})
    valid = (F.col("chain") == "ethereum") & C.is_evm_address("address") & F.col("status").isin(*STATUSES)
    return rows.withColumn("outcome", F.when(~valid, "invalid").when(F.size("evidence") == 0, "missing_evidence").otherwise("ok"))


_MAPPING = ("entity_id", "chain", "address", "address_role", "status", "confidence", "evidence", "from_block", "to_block")


def collected_mappings(entities: DataFrame, declared: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """Mappings of services and contracts from three sides, not yet judged.

    ``entities``: entity_id, type, role, name. ``declared``: mappings that reports give. ``labels``: address, label and
    source_id of a scanner, met by name. ``matches``: entity_id, address, pattern, confidence, evidence, tx_hash and
    block_number of transfers that a reported flow was matched with.
    """
    eligible = entities.where(F.col("type").isin("service", "contract_or_protocol") | F.col("entity_id").startswith("entity:"))
    own = declared.join(eligible.select("entity_id", F.col("role").alias("__role"), F.col("type").alias("__type")), "entity_id").withColumn("address_role", F.coalesce("address_role", address_role(F.col("__role"), F.col("__type"))))
    null = F.lit(None).cast("long")
    seen = eligible.withColumn("key", C.slug("name")).join(labels.withColumn("key", C.slug("label")), "key")
    seen = seen.select("entity_id", F.lit("ethereum").alias("chain"), "address", address_role(F.col("role"), F.col("type")).alias("address_role"), F.lit("source_verified").alias("status"), F.lit("B").alias("confidence"), F.array("source_id").alias("evidence"), null.alias("from_block"), null.alias("to_block"))
    met = matches.join(eligible.select("entity_id", "role", "type"), "entity_id").where(C.is_evm_address("address"))
    evidence = F.concat("evidence", F.array(F.concat(F.lit("local_index:tx:"), F.lower("tx_hash"))))
    met = met.select("entity_id", F.lit("ethereum").alias("chain"), "address", address_role(F.col("role"), F.col("type"), F.col("pattern")).alias("address_role"), F.lit("reported").alias("status"), "confidence", evidence.alias("evidence"), F.col("block_number").alias("from_block"), F.col("block_number").alias("to_block"))
    return own.select(*_MAPPING).unionByName(seen).unionByName(met)


def merged_mappings(judged: DataFrame) -> DataFrame:
    """One row for (entity, chain, address, role, status): united evidence, best confidence, widest span of blocks."""
    rows = judged.where("outcome = 'ok'").select(F.struct("entity_id", "status").alias("case_id"), "chain", "address", F.col("address_role").alias("role"), "confidence", "evidence", "from_block", "to_block")
    return merge_mappings(rows).select("case_id.entity_id", "chain", "address", F.col("role").alias("address_role"), "case_id.status", "confidence", "evidence", "from_block", "to_block")


def flow_stage(src_role: Column, dst_role: Column, place: Column, length: Column) -> Column:
    """Stage of a step of a chain: by the roles of its ends, then by its place (from 0) among ``length`` steps."""
    return chosen(
        [
            (src_role.isin("attacker", "source_or_attacker") & (place == 0), "theft"),
            (dst_role == "cex", "layering"),
            (dst_role == "mixer", "mixing"),
            (dst_role == "dex", "conversion"),
            (dst_role == "bridge", "chain_hopping"),
            (place == length - 1, "destination"),
            (place > 0, "layering"),
        ],
        "transfer",
    )


def flow_pattern(src_role: Column, dst_role: Column) -> Column:
    return chosen(
        [
            (dst_role == "cex", "cex_deposit"),
            (dst_role == "mixer", "mixer_deposit"),
            (dst_role == "dex", "dex_swap"),
            (dst_role == "bridge", "cross_chain_bridge"),
            (src_role.isin("attacker", "source_or_attacker"), "attacker_outflow"),
        ],
        "transfer",
    )


def merged_runs(documents: DataFrame) -> DataFrame:
    """Documents (run, pos, url, filename, source_type, grade) of several runs as one by normalised URL: those of the best
    grade give its fields, of these the longest file name stands and otherwise the first; runs and all spellings of the URL are kept."""
    rows = documents.withColumn("site", C.normalize_url("url")).where("site is not null and site != ''").withColumn("rank", C.grade_rank("grade", "ABCDE"))
    first = F.struct("rank", "run", "pos")
    out = rows.groupBy("site").agg(
        F.array_sort(F.collect_set("run")).alias("runs"),
        F.array_sort(F.collect_set("url")).alias("variants"),
        F.min("rank").alias("rank"),
        F.min_by("url", first).alias("url"),
        F.min_by("source_type", first).alias("source_type"),
        F.min_by("grade", first).alias("grade"),
        F.max_by("filename", F.struct(-F.col("rank"), F.length("filename"), F.col("filename"))).alias("filename"),
    )
    return out.withColumn("n_runs", F.size("runs"))


def compact_text(value: Column, kind, most_items: int = 20, most_chars: int = 500) -> Column:
    """A nested value as text: items by ", ", fields by "; " without empty ones; long lists and texts are cut at the bounds."""
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        items = F.transform(F.slice(value, 1, most_items), lambda x: compact_text(x, kind.elementType, most_items, most_chars))
        text = F.array_join(items, ", ")
    elif isinstance(kind, (T.StructType, T.MapType)):
        if isinstance(kind, T.StructType):
            pairs = F.array(*(F.struct(F.lit(f.name).alias("k"), compact_text(value[f.name], f.dataType, most_items, most_chars).alias("v")) for f in kind.fields))
        else:
            pairs = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), compact_text(e["value"], kind.valueType, most_items, most_chars).alias("v")))
        full = F.filter(pairs, lambda p: ~F.coalesce(p["v"], F.lit("")).isin("", "null"))
        text = F.array_join(F.transform(F.slice(full, 1, most_items), lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "; ")
    else:
        text = value.cast("string")
    return F.substring(F.coalesce(text, F.lit("null")), 1, most_chars)


def answer_format(kind) -> str:
    """Name of the form of an answer, by its type."""
    from pyspark.sql import types as T

    for types, name in (((T.BooleanType,), "boolean"), ((T.ArrayType,), "list"), ((T.StructType, T.MapType), "object"), ((T.NumericType,), "number")):
        if isinstance(kind, types):
            return name
    return "string"


def annotated_entities(entities: DataFrame, tags: DataFrame) -> DataFrame:
    """Entities with a scanner's tags by address (address, red_tag, blue_tag, name): a red tag flags, a blue one confirms."""
    rows = entities.join(tags, "address", "left")
    red, blue = F.coalesce("red_tag", F.lit("")) != "", F.coalesce("blue_tag", F.lit("")) != ""
    evidence = F.coalesce("evidence", F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "role": F.when(red, "flagged_address").otherwise(F.col("role")),
            "confidence": F.when(red, "A").when(blue, "B").otherwise(F.col("confidence")),
            "evidence": F.when(red, F.array_append(evidence, F.lit("scanner_red_tag"))).when(blue, F.array_append(evidence, F.lit("scanner_blue_tag"))).otherwise(evidence),
            "entity": C.first_non_empty("entity", "name"),
        }
    ).drop("red_tag", "blue_tag", "name")


def annotated_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Flows with a scanner's notes by transaction (tx_hash, risk, revert, trc20, trc10): risk gives confidence A, the status is
    reverted or confirmed, token transfers override the asset."""
    rows = edges.join(notes.withColumn("__noted", F.lit(True)), "tx_hash", "left")
    noted = F.col("__noted").isNotNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumns(
        {
            "confidence": F.when(yes("risk"), "A").otherwise(F.col("confidence")),
            "verification_status": F.when(noted & yes("revert"), "scanner_reverted").when(noted, "scanner_confirmed").otherwise(F.col("verification_status")),
            "asset": F.when(yes("trc10"), "TRC10").when(yes("trc20"), "TRC20").otherwise(F.col("asset")),
        }
    ).drop("risk", "revert", "trc20", "trc10", "__noted")
