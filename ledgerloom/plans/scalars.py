"""Queries of projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..registry import query
from ..views import Tables


@query(
    "normalize_address",
    """SELECT event_id, '0x' || lpad(lower(to_hex(user_id)), 40, 'a') AS address, CASE WHEN event_id % 2 = 0 THEN '0x' || lpad(lower(to_hex(event_id)), 64, 'b') END AS tx, 'user ' || CAST(user_id AS VARCHAR) AS node FROM events""",
)
def normalize_address(t: Tables) -> DataFrame:
    text = F.expr("concat('From 0X: 0x', upper(lpad(hex(user_id), 40, 'a')), if(event_id % 2 = 0, concat(' in 0x', upper(lpad(hex(event_id), 64, 'b'))), ' in 0x12'))")
    node = F.expr("concat('  User ', cast(user_id as string), ' ')")
    return t.events.select("event_id", C.normalize_address(text).alias("address"), C.normalize_tx(F.expr("if(event_id % 2 = 0, concat('in 0x', upper(lpad(hex(event_id), 64, 'b'))), 'in 0x12')")).alias("tx"), C.normalize_node(node).alias("node"))


@query(
    "extract_mentions",
    """SELECT case_id, src, count(*) AS n_mentions FROM (SELECT DISTINCT case_id, src, dst AS m FROM dense UNION SELECT DISTINCT case_id, src, src FROM dense) x GROUP BY case_id, src""",
)
def extract_mentions(t: Tables) -> DataFrame:
    notes = t.dense.groupBy("case_id", "src").agg(F.concat_ws(" to ", F.first("src"), F.array_join(F.collect_list(F.upper("dst")), "; ")).alias("note"))
    note = F.regexp_replace("note", "0X", "0x")
    return notes.select("case_id", "src", F.size(C.mentions(note, C.ADDRESS)).cast("long").alias("n_mentions"))


@query(
    "extract_attacker_entries",
    """SELECT entity_id, address AS found, 'evm' AS format FROM ev_entities WHERE role = 'attacker_wallet' UNION ALL SELECT entity_id, 'So' || repeat('1', 30) || CAST(pos % 9 + 1 AS VARCHAR), 'solana' FROM ev_entities WHERE role = 'attacker_wallet'""",
)
def extract_attacker_entries(t: Tables) -> DataFrame:
    text = F.concat_ws(", ", F.upper(F.col("address")), F.concat(F.lit("So"), F.repeat(F.lit("1"), 30), (F.col("pos") % 9 + 1).cast("string")))
    rows = t.ev_entities.where("role = 'attacker_wallet'").select("entity_id", F.regexp_replace(text, "^0X", "0x").alias("text"))
    return attacker_entries(rows, "text").select("entity_id", "found", "format")


def attacker_entries(rows: DataFrame, text: str) -> DataFrame:
    """Each address in a free text: EVM ones first, then those in base 58 in what is left."""
    evm = rows.withColumn("found", F.explode(C.mentions(text, C.ADDRESS))).withColumn("format", F.lit("evm"))
    rest = F.regexp_replace(text, C.ADDRESS, " ")
    found = F.array_distinct(F.regexp_extract_all(rest, F.lit(f"\\b([{C.BASE58}]{{32,44}})\\b"), F.lit(1)))
    return evm.unionByName(rows.withColumn("found", F.explode(found)).withColumn("format", F.lit("solana")))


@query(
    "chain_format_predicates",
    """SELECT c_custkey, c_custkey % 4 = 0 AS evm, c_custkey % 4 = 1 AS tron, c_custkey % 4 = 2 AS solana, c_custkey % 4 = 3 AS tron_hash FROM customer""",
)
def chain_format_predicates(t: Tables) -> DataFrame:
    x = F.expr("case c_custkey % 4 when 0 then concat('0x', lpad(hex(c_custkey), 40, '0')) when 1 then concat('T', repeat('z', 33)) when 2 then concat('A', repeat('y', 39)) else lpad(lower(hex(c_custkey)), 64, '0') end")
    return t.customer.select("c_custkey", C.is_evm_address(x).alias("evm"), C.is_tron_address(x).alias("tron"), C.is_solana_address(x).alias("solana"), C.is_tron_hash(x).alias("tron_hash"))


@query(
    "coalesce_aliases",
    """SELECT event_id, coalesce(CASE WHEN event_type IN ('click', 'view') THEN event_type END, CAST(json_extract(props, '$.k') AS VARCHAR)) AS kind FROM events""",
)
def coalesce_aliases(t: Tables) -> DataFrame:
    direct = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("")
    return t.events.select("event_id", C.first_non_empty(direct, F.get_json_object("props", "$.k")).alias("kind"))


@query(
    "edge_amount",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2.5' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN '3.0' WHEN o_orderkey % 3 = 1 THEN '3000000000000000000' ELSE '77' END AS amount FROM orders""",
)
def edge_amount(t: Tables) -> DataFrame:
    eth = F.expr("case when o_orderkey % 3 = 0 then '2.5' end")
    raw = F.expr("case when o_orderkey % 3 = 1 then '3000000000000000000' else '77' end")
    token = F.expr("case when o_orderkey % 2 = 1 then '0xabc' else '' end")
    return t.orders.select("o_orderkey", C.edge_amount(eth, raw, token).alias("amount"))


@query("numeric_amount", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 AND value > 0 THEN value ELSE 0.0 END AS amount FROM events WHERE value >= 0""")
def numeric_amount(t: Tables) -> DataFrame:
    text = F.expr("case event_id % 4 when 0 then cast(value as string) when 1 then concat('', cast(value as string)) when 2 then concat('-', cast(value + 1 as string)) else 'NaN' end")
    return t.events.where("value >= 0").select("event_id", C.numeric_amount(text).alias("amount"))


@query(
    "normalize_transfers",
    """SELECT edge_id, case_id, src, dst, CASE WHEN src = '0x' || repeat('0', 40) THEN 'out' WHEN dst = '0x' || repeat('0', 40) THEN 'in' ELSE 'unknown' END AS direction, tx_hash, block_number, ts AS timestamp, amount FROM dense WHERE edge_type = 0""",
)
def normalize_transfers(t: Tables) -> DataFrame:
    raw = t.dense.withColumns({"from_address": F.upper("src"), "to_address": F.when(F.col("edge_type") == 0, F.concat(F.lit("x "), F.col("dst"))), "id": F.expr("substr(edge_id, 5)")})
    raw = raw.withColumn("from_address", F.regexp_replace("from_address", "^0X", "0x"))
    return normalized_transfers(raw, F.lit("0x" + "0" * 40)).select("edge_id", "case_id", "src", "dst", "direction", "tx_hash", "block_number", F.col("ts").alias("timestamp"), "amount")


def normalized_transfers(raw: DataFrame, seed) -> DataFrame:
    """Raw rows to transfers: aliases resolved, rows without both ends rejected, direction as seen from a seed."""
    rows = raw.withColumns({"src": C.normalize_address("from_address"), "dst": C.normalize_address("to_address")}).where("src is not null and dst is not null")
    direction = F.when(F.col("src") == seed, "out").when(F.col("dst") == seed, "in").otherwise("unknown")
    key = F.coalesce(C.non_empty("id"), C.stable_hash("src", "dst", "tx_hash"))
    return rows.withColumns({"edge_id": F.concat(F.lit("eth:"), key), "direction": direction})


@query("summarize_index_edge", """SELECT edge_id, tx_hash, CASE WHEN token_address IS NULL THEN 'native' ELSE 'token' END AS raw_kind, CASE WHEN token_address IS NULL THEN CAST(amount AS DOUBLE) END AS value_eth, CASE WHEN token_address IS NOT NULL THEN CAST(amount AS VARCHAR) END AS raw_token_amount FROM dense""")
def summarize_index_edge(t: Tables) -> DataFrame:
    native = F.col("token_address").isNull()
    return t.dense.select("edge_id", "tx_hash", F.when(native, "native").otherwise("token").alias("raw_kind"), F.when(native, F.col("amount").cast("double")).alias("value_eth"), F.when(~native, F.col("amount").cast("string")).alias("raw_token_amount"))


@query("stable_hash", """SELECT src, dst, 'pair:' || substr(sha256('["' || case_id || '", "' || src || '", "' || dst || '"]'), 1, 16) AS pair_id FROM (SELECT DISTINCT case_id, src, dst FROM dense) x""")
def stable_hash(t: Tables) -> DataFrame:
    return t.dense.select("case_id", "src", "dst").distinct().select("src", "dst", F.concat(F.lit("pair:"), C.stable_hash("case_id", "src", "dst")).alias("pair_id"))


@query("short_id", """SELECT DISTINCT substr(src, 1, 8) || '...' || right(src, 6) AS src, substr(tx_hash, 1, 10) || '...' || right(tx_hash, 8) AS tx, edge_id FROM dense""")
def short_id(t: Tables) -> DataFrame:
    return t.dense.select(C.short_id("src").alias("src"), C.short_id("tx_hash").alias("tx"), C.short_id("edge_id").alias("edge_id")).distinct()


@query(
    "slugs_and_ids",
    """SELECT c_custkey, trim(regexp_replace(lower(c_name || ' & Co.'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') || '_2022' AS case_key FROM customer""",
)
def slugs_and_ids(t: Tables) -> DataFrame:
    case = F.concat(F.lit("01-2022-"), F.col("c_name"), F.lit("-2022"))
    return t.customer.select("c_custkey", C.slug(F.concat(F.col("c_name"), F.lit(" & Co."))).alias("slug"), C.compact_case_id(case).alias("case_key"))


@query("parse_amounts", """SELECT o_orderkey, floor(o_totalprice) AS amount, 'USDC' AS symbol FROM orders""")
def parse_amounts(t: Tables) -> DataFrame:
    text = F.concat(F.lit("about "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" USDC lost"))
    return t.orders.select("o_orderkey", C.first_number(text).alias("amount"), F.regexp_extract(text, "[0-9][0-9,.]* ([A-Z]{2,10})", 1).alias("symbol"))


@query("date_windows", """SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) - 172800 AS start_ts, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 259200 AS end_ts FROM orders""")
def date_windows(t: Tables) -> DataFrame:
    w = C.date_window(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", w["start"].alias("start_ts"), w["end"].alias("end_ts"))


@query(
    "scanner_targets",
    """SELECT DISTINCT chain, target, kind, CASE chain WHEN 'ethereum' THEN 'https://etherscan.io/' ELSE 'https://bscscan.com/' END || kind || '/' || target AS url FROM (SELECT chain, address AS target, 'address' AS kind FROM ev_entities UNION ALL SELECT 'ethereum', tx_hash, 'tx' FROM ev_edges) x""",
)
def scanner_targets(t: Tables) -> DataFrame:
    both = t.ev_entities.select("chain", F.col("address").alias("target"), F.lit("address").alias("kind")).unionByName(t.ev_edges.select(F.lit("ethereum").alias("chain"), F.col("tx_hash").alias("target"), F.lit("tx").alias("kind")))
    host = F.when(F.col("chain") == "ethereum", "https://etherscan.io/").otherwise("https://bscscan.com/")
    return both.distinct().withColumn("url", F.concat(host, "kind", F.lit("/"), "target"))


@query(
    "normalize_url",
    """WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), s AS (SELECT page_id, lower(split_part(u, '://', 1)) AS scheme, regexp_replace(regexp_replace(lower(regexp_extract(split_part(u, '://', 2), '^[^/?]*')), ':(80|443)$', ''), '^www\\.', '') AS host, regexp_replace(regexp_extract(split_part(u, '://', 2), '^[^/?]*([^?]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'ref')) AS q FROM p)
 SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, scheme || '://' || host || path AS bare FROM s""",
)
def normalize_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.normalize_url("url").alias("url"), C.normalize_url("url", drop_query=True).alias("bare"))


@query(
    "clean_links",
    """SELECT page_id, 'https://news.example.org/' || CAST(page_id AS VARCHAR) AS link FROM pages WHERE page_id % 3 = 0""",
)
def clean_links(t: Tables) -> DataFrame:
    raw = t.pages.select("page_id", F.expr("case page_id % 3 when 0 then concat('https://duckduckgo.com/l/?uddg=https%3A%2F%2Fnews.example.org%2F', cast(page_id as string), '&rut=1') when 1 then 'https://www.bing.com/search?q=x' else 'https://ok.example.org/' end").alias("href"), F.expr("if(page_id % 3 = 2, 'ab', 'A title')").alias("title"))
    return cleaned_links(raw).select("page_id", "link")


def cleaned_links(rows: DataFrame) -> DataFrame:
    """Links of search results: redirects decoded, search engines' own links and titles under 3 characters dropped."""
    target = F.regexp_extract("href", "[?&](?:uddg|u|url|q)=(https?%3A[^&]*)", 1)
    rows = rows.withColumn("link", F.when(target != "", F.try_url_decode(target)).otherwise(F.col("href")))
    engine = F.lower(F.regexp_extract("link", "^https?://([^/]*)", 1)).rlike("(^|[.])(google|bing|duckduckgo|yahoo|baidu)[.]")
    return rows.where(~engine & (F.length(F.trim("title")) >= 3))


@query("sanitize_names", """SELECT p_partkey, regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') || '.pdf' AS filename FROM part""")
def sanitize_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", file_name(F.concat_ws("/", "p_name", "p_brand")).alias("filename"))


def file_name(c, most: int = 180):
    """A safe name of at most so many characters, with the ending .pdf."""
    base = F.regexp_replace(F.regexp_replace(c, "[.]pdf$", ""), "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.substring(base, 1, most - 4), F.lit(".pdf"))


@query(
    "validate_report_docs",
    """SELECT pos, CASE WHEN source_type NOT IN ('audit', 'news') THEN 'type' WHEN grade = 'E' THEN 'grade' WHEN NOT starts_with(url, 'http') THEN 'scheme' ELSE 'accepted' END AS outcome FROM report_docs""",
)
def validate_report_docs(t: Tables) -> DataFrame:
    reason = F.when(~F.col("source_type").isin("audit", "news"), "type").when(~F.col("grade").isin(*"ABCD"), "grade").when(~F.col("url").rlike("^https?://"), "scheme").otherwise("accepted")
    return t.report_docs.select("pos", reason.alias("outcome"))


@query("tokenize", """SELECT item_id, list_filter(regexp_extract_all(lower(text), '0x[0-9a-f]+|[a-z0-9_:-]{2,}|[\\x{4e00}-\\x{9fff}]'), lambda x: x <> '') AS tokens FROM benchmark""")
def tokenize(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", C.tokens("text").alias("tokens"))


@query(
    "token_usage",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN n ELSE 0 END AS input_tokens, CASE WHEN role = 'user' THEN 0 ELSE n END AS output_tokens, n AS total_tokens FROM (SELECT *, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM conversations) x""",
)
def token_usage(t: Tables) -> DataFrame:
    n = F.size(F.split("text", " ")).cast("long")
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", n).alias("prompt_tokens"), F.when(F.col("role") != "user", n).alias("output_tokens"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.lit(-1).cast("long").alias("total"))
    return usage(rows).select("conv_id", "turn", "input_tokens", "output_tokens", "total_tokens")


def usage(rows: DataFrame) -> DataFrame:
    """Two naming schemes as one; negatives count 0; a total that is missing is the sum."""
    low = lambda *cs: F.greatest(F.lit(0), F.coalesce(*(F.col(c).try_cast("long") for c in cs), F.lit(0)))
    a, b = low("input_tokens", "prompt_tokens"), low("output_tokens", "completion_tokens")
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(a + b)
    return rows.withColumns({"input_tokens": a, "output_tokens": b, "total_tokens": total})


@query(
    "version_parts",
    """SELECT o_orderkey, o_orderkey % 5 <> 0 AS parsed, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(o_orderkey % 4 AS INTEGER) END AS major, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 2 = 0 THEN 0 ELSE CAST(o_orderkey % 13 AS INTEGER) END AS minor FROM orders""",
)
def version_parts(t: Tables) -> DataFrame:
    v = F.expr("if(o_orderkey % 5 = 0, 'latest', concat('flows.v', cast(o_orderkey % 4 as string), if(o_orderkey % 2 = 0, '', concat('_', cast(o_orderkey % 13 as string)))))")
    return t.orders.select("o_orderkey", C.version_parts(v).alias("v")).select("o_orderkey", "v.parsed", "v.major", "v.minor")


@query("canonical_edge_id", """SELECT event_id, CAST(event_id AS VARCHAR) AS edge_key, event_id % 2 = 0 AS required FROM events""")
def canonical_edge_id(t: Tables) -> DataFrame:
    x = F.expr("case event_id % 3 when 0 then concat('eth:00', cast(event_id as string)) when 1 then concat(' ', cast(event_id as string)) else cast(event_id as string) end")
    return t.events.select("event_id", C.canonical_edge_id(x).alias("edge_key"), C.is_true(F.expr("if(event_id % 2 = 0, ' TRUE ', 'no')")).alias("required"))


@query("public_projection", """SELECT edge_id, case_id, src, dst, [asset] AS public_keys FROM dense""")
def public_projection(t: Tables) -> DataFrame:
    return public_rows(t).select("edge_id", "case_id", "src", "dst", F.map_values("free").alias("public_keys"))


def public_rows(t: Tables) -> DataFrame:
    free = F.create_map(F.lit("asset"), F.col("asset"), F.lit("gold_action"), F.lit("follow"), F.lit("correct_edges"), F.lit("x"))
    rows = t.dense.select("edge_id", "case_id", "src", "dst", F.struct("asset", F.lit("follow").alias("gold_action")).alias("context"), free.alias("free"))
    return public_view(rows)


#: Names that stand for an answer and stay out of public views.
ORACLE_KEYS = ("gold_action", "gold_actions", "correct_edges", "candidate_actions", "follow_edges", "gold_paths", "gold_seed_nodes", "answer", "answer_value", "labels")


def public_view(rows: DataFrame) -> DataFrame:
    """``rows`` without oracle columns, and without oracle keys in its structs and maps."""
    out = rows.drop(*ORACLE_KEYS)
    for f in out.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            own = [n for n in f.dataType.names if n in ORACLE_KEYS]
            if own:
                out = out.withColumn(f.name, F.col(f.name).dropFields(*own))
        elif kind == "map":
            out = out.withColumn(f.name, F.map_filter(f.name, lambda k, v: ~k.isin(*ORACLE_KEYS)))
    return out


@query(
    "compact_facts",
    """SELECT case_id, list(reported_id ORDER BY reported_id) AS edges, list(substr(stage, 1, 5) ORDER BY reported_id) AS stages FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY reported_id) AS rn FROM ev_edges) x WHERE rn <= 5 GROUP BY case_id""",
)
def compact_facts(t: Tables) -> DataFrame:
    from ..operators.relational import top_n_per_group

    first = top_n_per_group(t.ev_edges, ["case_id"], [F.col("reported_id")], 5)
    facts = first.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("reported_id", F.substring("stage", 1, 5).alias("stage")))).alias("f"))
    return facts.select("case_id", F.col("f.reported_id").alias("edges"), F.col("f.stage").alias("stages"))


@query(
    "case_name_match",
    """WITH k AS (SELECT pos, list_distinct(list_filter(string_split(lower(finding), ' '), lambda x: x NOT IN ('the', 'protocol', 'finance', 'of'))) AS words FROM ev_sources)
 SELECT a.pos AS left_key, b.pos AS right_key FROM k a JOIN k b ON a.pos < b.pos AND len(list_intersect(a.words, b.words)) >= 1 AND (len(list_intersect(a.words, b.words)) >= 2 OR len(list_intersect(a.words, b.words)) = least(len(a.words), len(b.words)))""",
)
def case_name_match(t: Tables) -> DataFrame:
    names = t.ev_sources.select("pos", name_words("finding").alias("words"))
    return name_matches(names, "pos").select("left_key", "right_key")


def name_words(c: str):
    generic = F.array(*(F.lit(w) for w in ("the", "protocol", "finance", "of")))
    return F.array_except(F.array_distinct(F.split(F.lower(c), " ")), generic)


def name_matches(names: DataFrame, key: str) -> DataFrame:
    """Pairs whose words are a subset of one another or share two; they meet on a shared word, so it is an equi-join."""
    one = names.select(key, "words", F.explode("words").alias("word"))
    a, b = one.select(F.col(key).alias("left_key"), F.col("words").alias("lw"), "word"), one.select(F.col(key).alias("right_key"), F.col("words").alias("rw"), "word")
    both = F.size(F.array_intersect("lw", "rw"))
    return a.join(b, "word").where("left_key < right_key").where((both >= 2) | (both == F.least(F.size("lw"), F.size("rw")))).select("left_key", "right_key").distinct()


@query("question_type", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'subject' WHEN 1 THEN 'predicate' WHEN 2 THEN 'object' ELSE 'verification' END AS question_type FROM events""")
def question_type(t: Tables) -> DataFrame:
    part = lambda k: F.when(F.col("event_id") % 4 == k, F.lit("*" if k else None)).otherwise("x")
    rows = t.events.select("event_id", part(0).alias("subject"), part(1).alias("predicate"), part(2).alias("object"))
    wild = lambda c: F.col(c).isNull() | F.col(c).isin("*", "?", "")
    return rows.select("event_id", F.when(wild("subject"), "subject").when(wild("predicate"), "predicate").when(wild("object"), "object").otherwise("verification").alias("question_type"))


@query("exploit_tx_rows", """SELECT case_id, tx_hash, count(*) AS n FROM ev_edges WHERE stage = 'theft' GROUP BY case_id, tx_hash""")
def exploit_tx_rows(t: Tables) -> DataFrame:
    notes = t.ev_edges.where("stage = 'theft'").select("case_id", F.concat(F.lit("Exploit in "), F.col("tx_hash"), F.lit(".")).alias("note"))
    return notes.select("case_id", F.explode(C.mentions("note", C.TX_HASH)).alias("tx_hash")).groupBy("case_id", "tx_hash").agg(F.count("*").alias("n"))


@query(
    "derived_keys",
    """SELECT edge_id, case_id || ':' || edge_id AS label_id, coalesce(token_address, asset) AS bucket, ln(1 + CAST(amount AS DOUBLE)) AS log_amount, coalesce(ts, block_number) AS at FROM dense""",
)
def derived_keys(t: Tables) -> DataFrame:
    from ..operators.policies import bucket

    return t.dense.select("edge_id", F.concat_ws(":", "case_id", "edge_id").alias("label_id"), bucket().alias("bucket"), F.log1p(F.greatest(F.lit(0.0), F.col("amount").cast("double"))).alias("log_amount"), F.coalesce("ts", "block_number").alias("at"))


@query("unwrap_rows", """SELECT event_id, CAST(event_id % 3 AS BIGINT) AS pos, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0""")
def unwrap_rows(t: Tables) -> DataFrame:
    body = F.expr("case when event_id % 5 = 0 then '{\"status\": \"error\"}' when event_id % 3 = 0 then concat('{\"edges\": [', props, ']}') when event_id % 3 = 1 then concat('{\"data\": {\"neighbors\": [', props, ']}}') else concat('{\"result\": {\"data\": {\"edges\": [', props, ']}}}') end")
    rows = t.events.select("event_id", (F.col("event_id") % 3).alias("pos"), F.try_parse_json(body).alias("doc"))
    return unwrapped(rows, "doc").select("event_id", "pos", F.try_variant_get("row", "$.k", "long").alias("k"))


def unwrapped(rows: DataFrame, doc: str) -> DataFrame:
    """One row for each element of the list below edges, neighbors, data or result, up to three levels down; errors have none."""
    keys = ("edges", "neighbors", "data", "result")
    paths = [f"$.{a}" for a in keys] + [f"$.{a}.{b}" for a in ("data", "result") for b in keys] + [f"$.{a}.{b}.{c}" for a in ("data", "result") for b in ("data", "result") for c in ("edges", "neighbors")]
    found = F.coalesce(*(F.try_variant_get(doc, p, "array<variant>") for p in paths))
    good = F.coalesce(F.try_variant_get(doc, "$.status", "string"), F.lit("ok")) != "error"
    return rows.where(good).withColumn("row", F.explode(found))


@query("import_external_qa", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no question' WHEN event_id % 4 = 1 THEN 'no answer' ELSE 'accepted' END AS outcome FROM events""")
def import_external_qa(t: Tables) -> DataFrame:
    text = F.expr("concat('{', if(event_id % 4 = 0, '', '\"question\": \"q\",'), if(event_id % 4 = 1, '', '\"answer\": \"a\",'), '\"id\": 1}')")
    parsed = F.from_json(text, "question string, answer string, id int")
    return t.events.select("event_id", parsed.alias("q")).select("event_id", F.when(C.non_empty("q.question").isNull(), "no question").when(C.non_empty("q.answer").isNull(), "no answer").otherwise("accepted").alias("outcome"))


@query(
    "flatten_docs",
    """SELECT case_id, 'entity:' || entity_id AS doc_key, 'entity' AS kind, role || ' ' || address AS text FROM ev_entities UNION ALL SELECT case_id, 'edge:' || reported_id, 'edge', stage || ' ' || src || ' ' || dst FROM ev_edges UNION ALL SELECT 'all', 'source:' || source_id, 'source', finding FROM ev_sources""",
)
def flatten_docs(t: Tables) -> DataFrame:
    doc = lambda df, case, key, kind, text: df.select(case.alias("case_id"), F.concat(F.lit(f"{kind}:"), F.col(key)).alias("doc_key"), F.lit(kind).alias("kind"), text.alias("text"))
    a = doc(t.ev_entities, F.col("case_id"), "entity_id", "entity", F.concat_ws(" ", "role", "address"))
    b = doc(t.ev_edges, F.col("case_id"), "reported_id", "edge", F.concat_ws(" ", "stage", "src", "dst"))
    return a.unionByName(b).unionByName(doc(t.ev_sources, F.lit("all"), "source_id", "source", F.col("finding")))
