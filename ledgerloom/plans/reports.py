"""Queries of the rules over case reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evidence as E
from ..operators import reports as R
from ..registry import query
from ..views import Tables

_TEXT = "concat_ws(' ', protocol_type, vulnerability_type, root_cause, fund_flow, array_to_string(victims, ' '), array_to_string(attackers, ' '), array_to_string(loss_assets, ' '))"


@query(
    "incident_type",
    """SELECT report_id, CASE WHEN protocol_type ILIKE '%bridge%' THEN 'bridge_exploit' WHEN vulnerability_type ILIKE '%validator%' OR root_cause ILIKE '%private key%' THEN 'key_compromise'
 WHEN vulnerability_type ILIKE '%oracle%' OR root_cause ILIKE '%price%' THEN 'oracle_or_market_manipulation' WHEN vulnerability_type ILIKE '%reentr%' THEN 'smart_contract_exploit' ELSE 'security_incident' END AS incident FROM reports""",
)
def incident_type(t: Tables) -> DataFrame:
    return t.reports.select("report_id", R.incident_type(F.col("protocol_type"), F.col("vulnerability_type"), F.col("root_cause")).alias("incident"))


def _sql_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    "policy_flags",
    f"""SELECT report_id, list_filter([{_sql_list(R.ALWAYS_FORBIDDEN)}, CASE WHEN x ILIKE '%tornado%' THEN '{R.FORBIDDEN[0][0]}' END, CASE WHEN x ILIKE '%sanction%' OR x ILIKE '%ofac%' THEN '{R.FORBIDDEN[1][0]}' END], lambda f: f IS NOT NULL) AS constraints,
 list_filter([{_sql_list(R.ALWAYS_SKILLS)}, CASE WHEN x ILIKE '%bridge%' THEN 'identify_bridge_exit_path' END, CASE WHEN x ILIKE '%validator%' OR x ILIKE '%private key%' THEN 'recognize_validator_key_compromise_as_root_cause' END,
 CASE WHEN x ILIKE '%usdc%' AND x ILIKE '%swap%' THEN 'trace_stablecoin_swap_to_native_asset_after_theft' END, CASE WHEN regexp_matches(fund_flow, '(FTX|Huobi): [0-9.]+ ETH') THEN 'detect_cex_deposit_layering_from_reported_amounts' END,
 CASE WHEN x ILIKE '%tornado%' THEN 'stop_at_censored_mixer_boundary_unless_withdrawal_linkage_evidence' END, CASE WHEN x ILIKE '%bnb%' THEN 'identify_bridge_swap_bridge_chain_hopping_route' END,
 CASE WHEN contains(x, '12,000') OR contains(x, '12000') THEN 'detect_large_address_fanout_laundering_pattern' END], lambda f: f IS NOT NULL) AS skills FROM (SELECT *, {_TEXT} AS x FROM reports) r""",
)
def policy_flags(t: Tables) -> DataFrame:
    to_exchange = R.report_edges(t.reports).where("pattern = 'cex_deposit'").select("report_id").distinct().withColumn("exchange", F.lit(True))
    rows = t.reports.withColumn("text", R.report_text(t.reports)).join(to_exchange, "report_id", "left")
    return rows.select("report_id", R.constraints(F.col("text")).alias("constraints"), R.skills(F.col("text"), F.col("exchange").isNotNull()).alias("skills"))


_KINDS = "CASE WHEN pos % 2 = 0 THEN 'service' ELSE 'contract_or_protocol' END"
_PATTERNS = "CASE WHEN pos % 7 = 0 THEN 'cex_deposit' WHEN pos % 7 = 1 THEN 'mixer_deposit' WHEN pos % 7 = 2 THEN 'bridge_swap_bridge' WHEN pos % 7 = 3 THEN 'dex_swap' ELSE '' END"


@query(
    "address_role",
    f"""SELECT entity_id, CASE WHEN p = 'cex_deposit' THEN 'cex_deposit_address' WHEN p = 'mixer_deposit' THEN 'mixer_deposit_contract' WHEN p LIKE '%bridge%' THEN 'bridge_contract' WHEN p = 'dex_swap' OR role = 'router' THEN 'dex_router'
 WHEN role = 'exchange_deposit' THEN 'cex_labeled_address' WHEN role = 'mixer' THEN 'mixer_deposit_contract' WHEN k = 'contract_or_protocol' THEN 'protocol_contract' ELSE 'service_address' END AS role FROM (SELECT *, {_KINDS} AS k, {_PATTERNS} AS p FROM ev_entities) e""",
)
def address_role(t: Tables) -> DataFrame:
    rows = t.ev_entities.withColumns({"kind": F.expr(_KINDS), "pattern": F.expr(_PATTERNS)})
    return rows.select("entity_id", R.address_role(F.col("role"), F.col("kind"), F.col("pattern")).alias("role"))


@query(
    "qa_domain",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'general' WHEN o_orderkey % 11 = 1 THEN 'chain' WHEN o_orderkey % 7 = 0 THEN 'chain' WHEN o_orderkey % 7 = 1 THEN 'chain' WHEN o_orderkey % 5 = 0 THEN 'chain' WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 THEN 'chain' ELSE 'general' END AS domain FROM orders""",
)
def qa_domain(t: Tables) -> DataFrame:
    case = lambda body: F.expr(f"case {body} end")
    rows = t.orders.select(
        "o_orderkey",
        case("o_orderkey % 11 when 0 then 'general' when 1 then 'chain' when 2 then 'other'").alias("given"),
        F.lit(None).cast("string").alias("link"),
        case("o_orderkey % 7 when 0 then concat('edge:', cast(o_orderkey as string)) when 1 then concat('0x', lpad(hex(o_orderkey), 64, '0')) else 'case'").alias("subject"),
        case("o_orderkey % 5 when 0 then 'path_completion' when 1 then 'false_positive_check' else 'summary'").alias("reason"),
        case("when o_orderkey % 2 = 0 then array('case', 'chain_evidence.edges[3]') else array('chain_evidence.sources')").alias("origins"),
    )
    return rows.select("o_orderkey", R.qa_domain(F.col("given"), F.col("link"), F.col("subject"), F.lit(""), F.col("reason"), F.col("origins")).alias("domain"))


def _tier_sql(words: str, grades: str | None = None, most: int = 5) -> str:
    return f"{{'k': {words}, 'g': {'NULL' if grades is None else repr(grades)}::VARCHAR, 'most': {most}}}"


_SERVICE_SQL = " UNION ALL ".join(
    f"SELECT report_id, '{id_}', 'service', '{role}', CAST(NULL AS VARCHAR), [{_tier_sql(f'[{_sql_list(evidence)}]', grades)}] FROM r WHERE " + " OR ".join(f"contains(lower(x), '{w.lower()}')" for w in words) for id_, _, role, words, evidence, grades in R.SERVICES
)
_ATTACKER_TIERS = f"list_filter([{_tier_sql('[addr]')}, CASE WHEN place = 0 THEN {_tier_sql(f'[{_sql_list(R.ATTACKER_WORDS)}]', R.ATTACKER_GRADES)} END, CASE WHEN place < 4 THEN {_tier_sql(f'[{_sql_list(R.SANCTION_WORDS)}]', R.SANCTION_GRADES)} END], lambda t: t IS NOT NULL)"


@query(
    "build_entities",
    f"""WITH r AS (SELECT *, {_TEXT} AS x FROM reports),
 a AS (SELECT report_id, addr, fake, CAST(row_number() OVER (PARTITION BY report_id ORDER BY entry) - 1 AS INTEGER) AS place FROM (SELECT report_id, unnest(range(len(attackers))) AS entry, unnest(list_transform(attackers, lambda s: regexp_extract(s, '(0x[0-9a-f]{{40}}|So1+[0-9])', 1))) AS addr, unnest(list_transform(attackers, lambda s: contains(s, 'fake sysvar'))) AS fake FROM reports) q),
 e(report_id, entity_id, type, role, address, tiers) AS (SELECT report_id, 'entity:' || regexp_replace(lower(victims[1]), '[^a-z0-9]+', '_', 'g'), 'contract_or_protocol', 'victim', CAST(NULL AS VARCHAR), [{_tier_sql("[victims[1], 'bridge', 'victim']")}] FROM reports
 UNION ALL SELECT report_id, addr, 'address', CASE WHEN addr LIKE 'So%' AND fake THEN 'fake_sysvar_account' WHEN place = 0 THEN 'attacker_initial' WHEN addr LIKE '0x%' THEN 'attacker_ethereum_wallet' ELSE 'attacker_solana_wallet' END, addr, {_ATTACKER_TIERS} FROM a
 UNION ALL SELECT report_id, m, 'address', 'mentioned_address', m, [{_tier_sql('[m]', most=3)}] FROM (SELECT report_id, unnest(list_distinct(regexp_extract_all(fund_flow, '0x[0-9a-f]{{40}}'))) AS m FROM reports) y UNION ALL {_SERVICE_SQL}),
 w AS (SELECT report_id, entity_id, role, unnest(range(len(tiers))) AS n, unnest(tiers) AS t FROM e),
 k AS (SELECT report_id, entity_id, role, n, t.g AS g, t.most AS most, unnest(t.k) AS word FROM w),
 hit AS (SELECT word, s.pos, s.source_id, s.grade FROM (SELECT DISTINCT word FROM k) d JOIN ev_sources s ON contains(lower(s.entity || ' ' || s.finding), lower(d.word))),
 h AS (SELECT *, row_number() OVER (PARTITION BY report_id, entity_id, role, n ORDER BY pos) AS rn FROM (SELECT DISTINCT report_id, entity_id, role, n, most, pos, source_id, grade FROM k JOIN hit USING (word) WHERE g IS NULL OR contains(g, grade)) u),
 g AS (SELECT report_id, entity_id, role, n, list(source_id ORDER BY rn) AS evidence, min(CASE WHEN contains('ABCD', grade) THEN grade END) AS best FROM h WHERE rn <= most GROUP BY ALL),
 f AS (SELECT report_id, entity_id, role, arg_min(evidence, n) AS evidence, arg_min(coalesce(best, 'U'), n) AS best FROM g GROUP BY ALL)
 SELECT e.report_id, e.entity_id, e.type, e.role, e.address, coalesce(f.evidence, []) AS evidence, coalesce(f.best, 'U') AS confidence FROM e LEFT JOIN f ON f.report_id = e.report_id AND f.entity_id = e.entity_id AND f.role = e.role""",
)
def build_entities(t: Tables) -> DataFrame:
    return R.entities(t.reports, t.ev_sources).select("report_id", "entity_id", "type", "role", "address", "evidence", "confidence")


_EDGE_SQL = """WITH r AS (SELECT *, regexp_extract(fund_flow, '([0-9]+) ETH', 1) AS n, 'entity:' || regexp_replace(lower(victims[1]), '[^a-z0-9]+', '_', 'g') AS victim, '0x' || regexp_extract(array_to_string(attackers, ' '), '0x([0-9a-f]{40})', 1) AS me, CASE WHEN report_id % 3 = 0 THEN attackers[2] END AS sol FROM reports)
 SELECT report_id, 'edge:theft:eth' AS edge_id, victim AS src, CASE WHEN root_cause LIKE 'Mint%' THEN coalesce(sol, me) ELSE me END AS dst, 'theft' AS stage, CASE WHEN root_cause LIKE 'Mint%' THEN 'fraudulent_uncollateralized_mint' ELSE 'fraudulent_bridge_withdrawal' END AS pattern, 'WETH' AS asset, n AS amount FROM r
 UNION ALL SELECT report_id, 'edge:theft:usdc', victim, CASE WHEN root_cause LIKE 'Mint%' THEN coalesce(sol, me) ELSE me END, 'theft', CASE WHEN root_cause LIKE 'Mint%' THEN 'fraudulent_uncollateralized_mint' ELSE 'fraudulent_bridge_withdrawal' END, 'USDC', '1,200' FROM r
 UNION ALL SELECT report_id, 'edge:conversion:usdc_to_eth', me, 'entity:dex_route', 'conversion', 'stablecoin_to_native_asset_swap', 'USDC', NULL FROM r WHERE fund_flow LIKE 'USDC%'
 UNION ALL SELECT report_id, 'edge:cex:ftx', me, 'entity:ftx', 'layering', 'cex_deposit', 'ETH', n FROM r WHERE fund_flow LIKE '%FTX%'
 UNION ALL SELECT report_id, 'edge:cex:huobi', me, 'entity:huobi', 'layering', 'cex_deposit', 'ETH', '7.5' FROM r WHERE fund_flow LIKE '%Huobi%'
 UNION ALL SELECT report_id, 'edge:funding_or_mixing:tornado_cash', 'entity:tornado_cash', me, 'funding', 'mixer_withdrawal_to_attacker', NULL, n || ' ETH' FROM r WHERE fund_flow LIKE '%Tornado%'
 UNION ALL SELECT report_id, 'edge:chain_hop:eth_bnb_bittorrent', 'Ethereum', 'BitTorrent Chain', 'chain_hopping', 'bridge_swap_bridge', NULL, NULL FROM r WHERE fund_flow LIKE '%BNB%'
 UNION ALL SELECT report_id, 'edge:bridge_exit:to_ethereum', coalesce(sol, me), me, 'bridge_exit', 'cross_chain_exit_to_ethereum', 'ETH', n FROM r WHERE fund_flow LIKE 'Bridged%'
 UNION ALL SELECT report_id, 'edge:defi_reinvestment:eth_to_steth_maker', me, 'entity:maker', 'post_dormancy_reinvestment', 'swap_stake_collateralize_borrow', NULL, NULL FROM r WHERE fund_flow LIKE '%stETH%'"""


@query("build_report_edges", _EDGE_SQL)
def build_report_edges(t: Tables) -> DataFrame:
    return R.report_edges(t.reports)


_MAP_SQL = f"""en AS (SELECT entity_id, {_KINDS} AS type, role, 'NATION_' || CAST(pos % 25 AS VARCHAR) AS name FROM ev_entities),
 ro AS (SELECT *, CASE WHEN role LIKE '%router%' THEN 'dex_router' WHEN role LIKE '%exchange%' THEN 'cex_labeled_address' WHEN role LIKE '%mixer%' THEN 'mixer_deposit_contract' WHEN type = 'contract_or_protocol' THEN 'protocol_contract' ELSE 'service_address' END AS r FROM en),
 m(entity_id, chain, address, address_role, status, confidence, evidence, b0, b1) AS (SELECT e.entity_id, chain, address, r, CASE WHEN pos % 10 = 9 THEN 'guessed' ELSE 'reported' END, confidence, CASE WHEN confidence = 'C' THEN [] ELSE ['S' || lpad(CAST(pos % 25 AS VARCHAR), 2, '0')] END, pos, pos + 10 FROM ev_entities e JOIN ro ON ro.entity_id = e.entity_id
 UNION ALL SELECT ro.entity_id, 'ethereum', {{labels}}, r, 'source_verified', 'B', [s.source_id], CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ro JOIN ev_sources s ON s.entity = ro.name
 UNION ALL SELECT x.entity_id, 'ethereum', d.dst, CASE WHEN d.stage = 'cash_out' THEN 'cex_deposit_address' ELSE ro.r END, 'reported', d.confidence, ['local_index:tx:' || d.tx_hash], CAST(ts // 86400 AS BIGINT), CAST(ts // 86400 AS BIGINT) FROM ev_edges d JOIN ev_entities x ON x.case_id = d.case_id AND x.address = d.dst JOIN ro ON ro.entity_id = x.entity_id WHERE d.verification_status = 'chain_verified'),
 j AS (SELECT *, CASE WHEN chain <> 'ethereum' OR status = 'guessed' THEN 'invalid' WHEN len(evidence) = 0 THEN 'missing_evidence' ELSE 'ok' END AS outcome FROM m)""".replace("{labels}", "('0x' || lpad(lower(to_hex(CAST(s.pos AS BIGINT))), 40, 'e'))")


def _judged(t: Tables) -> DataFrame:
    entities = t.ev_entities.select("entity_id", F.expr(_KINDS).alias("type"), "role", F.concat(F.lit("NATION_"), (F.col("pos") % 25).cast("string")).alias("name"))
    evidence = F.when(F.col("confidence") == "C", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("S"), F.lpad((F.col("pos") % 25).cast("string"), 2, "0"))))
    declared = t.ev_entities.select("entity_id", "chain", "address", F.lit(None).cast("string").alias("address_role"), F.when(F.col("pos") % 10 == 9, "guessed").otherwise("reported").alias("status"), "confidence", evidence.alias("evidence"), F.col("pos").alias("from_block"), (F.col("pos") + 10).alias("to_block"))
    labels = t.ev_sources.select(F.expr("concat('0x', lpad(lower(hex(pos)), 40, 'e'))").alias("address"), F.col("entity").alias("label"), "source_id")
    met = t.ev_edges.where("verification_status = 'chain_verified'").withColumn("address", F.col("dst"))
    met = met.join(t.ev_entities.select("case_id", "address", "entity_id"), ["case_id", "address"])
    matches = met.select("entity_id", "address", F.when(F.col("stage") == "cash_out", "cex_deposit").otherwise("").alias("pattern"), "confidence", F.array().cast("array<string>").alias("evidence"), "tx_hash", F.floor(F.col("ts") / 86400).alias("block_number"))
    return R.judged_mappings(R.collected_mappings(entities, declared, labels, matches))


@query(
    "attach_address_mappings",
    f"""WITH {_MAP_SQL} SELECT entity_id, chain, address, address_role, status, list_sort(list_distinct(flatten(list(evidence)))) AS evidence, min(confidence) AS confidence, min(b0) AS from_block, max(b1) AS to_block FROM j WHERE outcome = 'ok' GROUP BY ALL""",
)
def attach_address_mappings(t: Tables) -> DataFrame:
    return R.merged_mappings(_judged(t))


@query(
    "evidence_quality",
    f"""WITH {_MAP_SQL}, n AS (SELECT case_id, count(*) AS n_edges FROM ev_edges GROUP BY 1), l AS (SELECT case_id, count(*) AS n_missing FROM (SELECT DISTINCT case_id, x FROM (SELECT case_id, src AS x FROM ev_edges UNION ALL SELECT case_id, dst FROM ev_edges) y WHERE (case_id, x) NOT IN (SELECT (case_id, address) FROM ev_entities)) z GROUP BY 1),
 q AS (SELECT case_id, count(*) FILTER (outcome = 'ok') AS n_mapped, count(*) FILTER (outcome = 'invalid') AS n_invalid, count(*) FILTER (outcome = 'missing_evidence') AS n_unsupported FROM j JOIN ev_entities USING (entity_id) GROUP BY 1)
 SELECT case_id, coalesce(n_edges, 0) AS n_edges, coalesce(n_missing, 0) AS n_missing, n_mapped, n_invalid, n_unsupported, CASE WHEN n_missing > 0 THEN 'missing_references' WHEN n_invalid + n_unsupported > 0 THEN 'invalid_mappings' ELSE 'ok' END AS status FROM q LEFT JOIN n USING (case_id) LEFT JOIN l USING (case_id)""",
)
def evidence_quality(t: Tables) -> DataFrame:
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    judged = _judged(t).join(t.ev_entities.select("entity_id", "case_id"), "entity_id")
    mapped = judged.groupBy("case_id").agg(count("ok").alias("n_mapped"), count("invalid").alias("n_invalid"), count("missing_evidence").alias("n_unsupported"))
    lost = E.missing_references(t.ev_edges, t.ev_entities).groupBy("case_id").agg(F.count("*").alias("n_missing"))
    stated = t.ev_edges.groupBy("case_id").agg(F.count("*").alias("n_edges"))
    rows = mapped.join(stated, "case_id", "left").join(lost, "case_id", "left").na.fill(0, ["n_edges", "n_missing"])
    status = F.when(F.col("n_missing") > 0, "missing_references").when(F.col("n_invalid") + F.col("n_unsupported") > 0, "invalid_mappings").otherwise("ok")
    return rows.select("case_id", "n_edges", "n_missing", "n_mapped", "n_invalid", "n_unsupported", status.alias("status"))


@query(
    "external_annotations_join",
    """SELECT 'entity' AS kind, entity_id AS id, CASE WHEN k % 5 = 0 THEN 'flagged_address' ELSE role END AS role_or_asset, CASE WHEN k % 5 = 0 THEN 'A' WHEN k % 5 = 1 THEN 'B' ELSE confidence END AS confidence, CASE WHEN k % 5 = 0 THEN 'scanner_red_tag' WHEN k % 5 = 1 THEN 'scanner_blue_tag' ELSE '' END AS status
 FROM (SELECT *, pos // 8 % (3 * n) AS k FROM ev_entities CROSS JOIN (SELECT count(*) AS n FROM supplier) s) e
 UNION ALL SELECT 'edge', reported_id, CASE WHEN o % 2 = 0 AND o % 3 = 0 THEN 'TRC10' WHEN o % 2 = 0 AND o % 5 = 0 THEN 'TRC20' ELSE asset END, CASE WHEN o % 2 = 0 AND o % 7 = 0 THEN 'A' ELSE confidence END, CASE WHEN o % 2 = 0 AND o % 11 = 0 THEN 'scanner_reverted' WHEN o % 2 = 0 THEN 'scanner_confirmed' ELSE verification_status END FROM (SELECT *, CAST(tx_hash AS HUGEINT) AS o FROM (SELECT * REPLACE ('0x' || ltrim(substr(tx_hash, 3), '0') AS tx_hash) FROM ev_edges) y) x""",
)
def external_annotations_join(t: Tables) -> DataFrame:
    k = F.conv(F.substring("address", 3, 40), 16, 10).cast("long")
    tags = t.ev_entities.select("address").distinct().select("address", F.when(k % 5 == 0, "scam").alias("red_tag"), F.when(k % 5 <= 1, "exchange").alias("blue_tag"), F.lit("").alias("name"))
    rows = t.ev_entities.withColumns({"evidence": F.array().cast("array<string>"), "entity": F.lit("")})
    people = R.annotated_entities(rows, tags).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("role").alias("role_or_asset"), "confidence", F.array_join("evidence", ",").alias("status"))
    key = F.col("o_orderkey")
    notes = t.orders.where(key % 2 == 0).select(F.expr("concat('0x', lpad(lower(hex(o_orderkey)), 64, '0'))").alias("tx_hash"), (key % 7 == 0).alias("risk"), (key % 11 == 0).alias("revert"), (key % 5 == 0).alias("trc20"), (key % 3 == 0).alias("trc10"))
    flows = R.annotated_edges(t.ev_edges, notes).select(F.lit("edge").alias("kind"), F.col("reported_id").alias("id"), F.col("asset").alias("role_or_asset"), "confidence", F.col("verification_status").alias("status"))
    return people.unionByName(flows)


_ROLE = "CASE role WHEN 'attacker_wallet' THEN 'attacker' WHEN 'exchange_deposit' THEN 'cex' WHEN 'mixer' THEN 'mixer' WHEN 'router' THEN 'dex' ELSE 'other' END"


@query(
    "stage_pattern",
    f"""WITH w AS (SELECT case_id, address, {_ROLE} AS role FROM (SELECT case_id, address, arg_min(role, entity_id) AS role FROM ev_entities GROUP BY ALL) a),
 c AS (SELECT e.reported_id AS edge_id, coalesce(s.role, 'other') AS sr, coalesce(d.role, 'other') AS dr, row_number() OVER (PARTITION BY e.case_id, e.src ORDER BY e.ts, e.reported_id) - 1 AS place, count(*) OVER (PARTITION BY e.case_id, e.src) AS n FROM ev_edges e LEFT JOIN w s ON s.case_id = e.case_id AND s.address = e.src LEFT JOIN w d ON d.case_id = e.case_id AND d.address = e.dst)
 SELECT edge_id, CASE WHEN sr = 'attacker' AND place = 0 THEN 'theft' WHEN dr = 'cex' THEN 'layering' WHEN dr = 'mixer' THEN 'mixing' WHEN dr = 'dex' THEN 'conversion' WHEN place = n - 1 THEN 'destination' WHEN place > 0 THEN 'layering' ELSE 'transfer' END AS stage,
 CASE WHEN dr = 'cex' THEN 'cex_deposit' WHEN dr = 'mixer' THEN 'mixer_deposit' WHEN dr = 'dex' THEN 'dex_swap' WHEN sr = 'attacker' THEN 'attacker_outflow' ELSE 'transfer' END AS pattern FROM c""",
)
def stage_pattern(t: Tables) -> DataFrame:
    """A chain is here the flows that leave one source, in order of time."""
    who = E.attribution(t.ev_entities).select("case_id", "address", F.expr(_ROLE).alias("role"))
    rows = t.ev_edges
    for end in ("src", "dst"):
        rows = rows.join(who.select("case_id", F.col("address").alias(end), F.col("role").alias(f"{end}_role")), ["case_id", end], "left")
    chain = Window.partitionBy("case_id", "src")
    rows = rows.na.fill("other", ["src_role", "dst_role"]).withColumns({"place": F.row_number().over(chain.orderBy("ts", "reported_id")) - 1, "n": F.count("*").over(chain)})
    roles = F.col("src_role"), F.col("dst_role")
    return rows.select(F.col("reported_id").alias("edge_id"), R.flow_stage(*roles, F.col("place"), F.col("n")).alias("stage"), R.flow_pattern(*roles).alias("pattern"))


@query(
    "merge_report_runs",
    r"""WITH d AS (SELECT *, split_part(url, '#', 1) AS u FROM report_docs), p AS (SELECT *, lower(split_part(u, '://', 1)) AS scheme, regexp_extract(u, '://([^/?]*)', 1) AS h, regexp_replace(regexp_extract(u, '://[^/?]*([^?]*)', 1), '/+$', '') AS path,
 list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda q: q <> '' AND lower(split_part(q, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'spm')) AS qs FROM d),
 s AS (SELECT *, scheme || '://' || regexp_replace(regexp_replace(lower(h), ':(80|443)$', ''), '^www\.', '') || path || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS site, strpos('ABCDE', grade) AS rank FROM p)
 SELECT site, list(DISTINCT run ORDER BY run) AS runs, list(DISTINCT url ORDER BY url) AS variants, arg_min(url, (rank, run, pos)) AS url, arg_min(source_type, (rank, run, pos)) AS source_type, arg_min(grade, (rank, run, pos)) AS grade, arg_max(filename, (-rank, length(filename), filename)) AS filename, CAST(count(DISTINCT run) AS INTEGER) AS n_runs FROM s GROUP BY site""",
)
def merge_report_runs(t: Tables) -> DataFrame:
    return R.merged_runs(t.report_docs).select("site", "runs", "variants", "url", "source_type", "grade", "filename", "n_runs")


@query(
    "compact_values",
    """SELECT p_partkey, substr('brand: ' || p_brand || CASE WHEN p_size > 0 THEN '; sizes: ' || array_to_string(list_slice(range(1, p_size + 1), 1, 3), ', ') ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '; type: ' || p_type ELSE '' END, 1, 40) AS shown, 'object' AS answer_format FROM part""",
)
def compact_values(t: Tables) -> DataFrame:
    sizes = F.when(F.col("p_size") > 0, F.sequence(F.lit(1), "p_size"))
    nested = F.struct(F.col("p_brand").alias("brand"), sizes.alias("sizes"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("type"))
    rows = t.part.select("p_partkey", nested.alias("value"))
    kind = rows.schema["value"].dataType
    return rows.select("p_partkey", R.compact_text(F.col("value"), kind, 3, 40).alias("shown"), F.lit(R.answer_format(kind)).alias("answer_format"))
