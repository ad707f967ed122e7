"""Input views: transfers, evidence and documents derived from the provided tables.

Each view is a lazy DataFrame, so filters and column choices reach the scans. ``VIEW_SQL`` has the same views
for DuckDB. Money is DECIMAL(18, 4), so that sums do not depend on their order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _address(col: str, pad: str = "0", width: int = 40) -> str:
    return f"concat('0x', lpad(lower(hex({col})), {width}, '{pad}'))"


class Tables:
    """Tables of a folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _transfers(self, dense: bool) -> DataFrame:
        # One row: how many customers or suppliers there are; dense views fold addresses onto the suppliers.
        n = (self.supplier if dense else self.customer).agg(F.count("*").alias("n"))
        rows = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(n))
        src, sup = ("o_custkey % n", "l_suppkey % n") if dense else ("o_custkey", "l_suppkey")
        dst = "l_suppkey % n" if dense else "l_partkey % n"
        return rows.selectExpr(
            "concat('eth:', substr(sha2(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string), cast(unix_timestamp(l_shipdate) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)), 256), 1, 16)) as edge_id",
            "concat('case_', cast(year(l_shipdate) as string)) as case_id",
            f"{_address(src)} as src",
            f"{_address(dst)} as dst",
            f"{_address('l_orderkey', '0', 64)} as tx_hash",
            "cast(datediff(to_date(l_shipdate), date'1992-01-01') as bigint) * 7200 as block_number",
            "unix_timestamp(l_shipdate) as ts",
            "case when l_linestatus = 'O' then 0 else 1 end as edge_type",
            "l_returnflag as asset",
            f"case when l_linestatus = 'F' then {_address('l_suppkey', 'f')} end as token_address",
            "cast(l_extendedprice * (1 - l_discount) as decimal(18, 4)) as amount",
            "o_orderpriority as priority",
            "o_orderstatus as status",
        )

    @cached_property
    def transfers(self) -> DataFrame:
        """One row a transfer; addresses as many as customers."""
        return self._transfers(False)

    @cached_property
    def dense(self) -> DataFrame:
        """Transfers among as many addresses as suppliers, so that pairs repeat."""
        return self._transfers(True)

    @cached_property
    def ev_entities(self) -> DataFrame:
        """Entities that reports name: all customers. A third of their addresses take part in dense transfers."""
        n = self.supplier.agg(F.count("*").alias("n"))
        return self.customer.join(F.broadcast(n)).selectExpr(
            "concat('case_', cast(1995 + c_custkey % 8 as string)) as case_id",
            "c_custkey as pos",
            "concat('ent_', cast(c_custkey as string)) as entity_id",
            f"{_address('floor(c_custkey / 8) % (3 * n)')} as address",
            "case when c_custkey % 3 = 0 then 'ethereum' else 'bsc' end as chain",
            "case c_mktsegment when 'MACHINERY' then if(c_acctbal < 0, 'attacker_wallet', 'router') when 'BUILDING' then 'victim' when 'AUTOMOBILE' then 'exchange_deposit' when 'FURNITURE' then 'mixer' else 'router' end as role",
            "case when c_acctbal < 0 then 'C' when c_acctbal < 5000 then 'B' else 'A' end as confidence",
        )

    @cached_property
    def ev_edges(self) -> DataFrame:
        """Flows that reports state: urgent, filled transfers."""
        return self.dense.where("priority = '1-URGENT' and status = 'F'").selectExpr(
            "case_id",
            "concat('R', substr(edge_id, 5)) as reported_id",
            "src",
            "dst",
            "case asset when 'A' then 'theft' when 'N' then 'layering' else 'cash_out' end as stage",
            "case when edge_type = 0 then 'direct' else 'split' end as pattern",
            "asset",
            "amount",
            "ts",
            "tx_hash",
            "case when edge_type = 0 then 'chain_verified' else 'reported' end as verification_status",
            "case when amount < 20000 then 'C' when amount < 50000 then 'B' else 'A' end as confidence",
        )

    @cached_property
    def ev_sources(self) -> DataFrame:
        return self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
            "n_nationkey as pos", "concat('S', lpad(cast(n_nationkey as string), 2, '0')) as source_id", "n_name as entity", "substr('ABCDE', n_regionkey + 1, 1) as grade", "concat(n_name, ' of ', r_name, case n_nationkey % 6 when 0 then '; OFAC list' when 1 then '; attacker address' when 2 then '; Tornado Cash, a mixer' else '' end) as finding"
        )

    @cached_property
    def reports(self) -> DataFrame:
        """What is told of a case: one report an order."""
        amount = "cast(cast(o_totalprice as bigint) as string)"
        mine, other, far = _address("o_custkey"), _address("o_orderkey", "a"), _address("o_custkey", "b")
        solana = "concat('So', repeat('1', 30), cast(o_orderkey % 9 + 1 as string))"
        return self.orders.selectExpr(
            "o_orderkey as report_id",
            "concat('case_', cast(year(o_orderdate) as string)) as case_id",
            "case o_orderpriority when '1-URGENT' then 'Cross-chain Bridge' when '2-HIGH' then 'Lending' else 'Exchange' end as protocol_type",
            "case o_orderkey % 5 when 0 then 'Validator takeover' when 1 then 'Oracle abuse' when 2 then 'Reentrancy' else 'Access control' end as vulnerability_type",
            "case o_custkey % 4 when 0 then 'Private key leak' when 1 then 'Price feed error' when 2 then 'Mint without collateral' else 'Unknown' end as root_cause",
            f"case o_orderstatus when 'F' then concat('USDC swapped on a DEX. FTX: ', {amount}, ' ETH.') when 'O' then concat('Received from Tornado Cash ', {amount}, ' ETH. Huobi: 7.5 ETH.') else concat('Bridged ', {amount}, ' ETH to ', {far}, '; BNB, BitTorrent, stETH; sanction by OFAC.') end as fund_flow",
            "date_format(o_orderdate, 'yyyy-MM-dd') as incident_date",
            "array(concat('NATION_', cast(o_custkey % 7 as string))) as victims",
            f"case o_orderkey % 3 when 0 then array(concat('main ', {mine}), {solana}) when 1 then array(concat('fake sysvar ', {solana}), {mine}) else array({mine}, {other}) end as attackers",
            f"array(concat({amount}, ' ETH'), '1,200 usdc', 'some coins') as loss_assets",
        )

    @cached_property
    def report_docs(self) -> DataFrame:
        return self.pages.selectExpr(
            "cast(page_id % 3 as int) as run", "page_id as pos", "url", "concat('doc_', cast(page_id as string), repeat('x', cast(page_id % 4 as int)), '.pdf') as filename", "substr('ABCDE', cast(page_id % 5 as int) + 1, 1) as grade", "case when page_id % 7 = 0 then 'forum' when page_id % 2 = 0 then 'audit' else 'news' end as source_type"
        )


def _duck_address(col: str, pad: str = "0", width: int = 40) -> str:
    return f"('0x' || lpad(lower(to_hex(CAST({col} AS BIGINT))), {width}, '{pad}'))"


def _duck_transfers(dense: bool) -> str:
    n = "supplier" if dense else "customer"
    src = "o_custkey % n" if dense else "o_custkey"
    dst = "l_suppkey % n" if dense else "l_partkey % n"
    return f"""SELECT 'eth:' || substr(sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(epoch(l_shipdate) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 16) AS edge_id,
 'case_' || CAST(year(l_shipdate) AS VARCHAR) AS case_id, {_duck_address(src)} AS src, {_duck_address(dst)} AS dst,
 {_duck_address('l_orderkey', '0', 64)} AS tx_hash,
 CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 7200 AS block_number,
 CAST(epoch(l_shipdate) AS BIGINT) AS ts, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS edge_type, l_returnflag AS asset,
 CASE WHEN l_linestatus = 'F' THEN {_duck_address('l_suppkey', 'f')} END AS token_address,
 CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) AS amount, o_orderpriority AS priority, o_orderstatus AS status
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN (SELECT count(*) AS n FROM {n}) k"""


VIEW_SQL: dict[str, str] = {
    "transfers": _duck_transfers(False),
    "dense": _duck_transfers(True),
    "ev_entities": f"""SELECT 'case_' || CAST(1995 + c_custkey % 8 AS VARCHAR) AS case_id, c_custkey AS pos, 'ent_' || CAST(c_custkey AS VARCHAR) AS entity_id,
 {_duck_address('(c_custkey // 8) % (3 * n)')} AS address, CASE WHEN c_custkey % 3 = 0 THEN 'ethereum' ELSE 'bsc' END AS chain,
 CASE c_mktsegment WHEN 'MACHINERY' THEN CASE WHEN c_acctbal < 0 THEN 'attacker_wallet' ELSE 'router' END WHEN 'BUILDING' THEN 'victim' WHEN 'AUTOMOBILE' THEN 'exchange_deposit' WHEN 'FURNITURE' THEN 'mixer' ELSE 'router' END AS role,
 CASE WHEN c_acctbal < 0 THEN 'C' WHEN c_acctbal < 5000 THEN 'B' ELSE 'A' END AS confidence
 FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) k""",
    "ev_edges": """SELECT case_id, 'R' || substr(edge_id, 5) AS reported_id, src, dst,
 CASE asset WHEN 'A' THEN 'theft' WHEN 'N' THEN 'layering' ELSE 'cash_out' END AS stage, CASE WHEN edge_type = 0 THEN 'direct' ELSE 'split' END AS pattern,
 asset, amount, ts, tx_hash, CASE WHEN edge_type = 0 THEN 'chain_verified' ELSE 'reported' END AS verification_status,
 CASE WHEN amount < 20000 THEN 'C' WHEN amount < 50000 THEN 'B' ELSE 'A' END AS confidence
 FROM dense WHERE priority = '1-URGENT' AND status = 'F'""",
    "ev_sources": """SELECT n_nationkey AS pos, 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS source_id, n_name AS entity,
 substr('ABCDE', n_regionkey + 1, 1) AS grade, n_name || ' of ' || r_name || CASE n_nationkey % 6 WHEN 0 THEN '; OFAC list' WHEN 1 THEN '; attacker address' WHEN 2 THEN '; Tornado Cash, a mixer' ELSE '' END AS finding FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "reports": f"""SELECT o_orderkey AS report_id, 'case_' || CAST(year(o_orderdate) AS VARCHAR) AS case_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Cross-chain Bridge' WHEN '2-HIGH' THEN 'Lending' ELSE 'Exchange' END AS protocol_type,
 CASE o_orderkey % 5 WHEN 0 THEN 'Validator takeover' WHEN 1 THEN 'Oracle abuse' WHEN 2 THEN 'Reentrancy' ELSE 'Access control' END AS vulnerability_type,
 CASE o_custkey % 4 WHEN 0 THEN 'Private key leak' WHEN 1 THEN 'Price feed error' WHEN 2 THEN 'Mint without collateral' ELSE 'Unknown' END AS root_cause,
 CASE o_orderstatus WHEN 'F' THEN 'USDC swapped on a DEX. FTX: ' || a || ' ETH.' WHEN 'O' THEN 'Received from Tornado Cash ' || a || ' ETH. Huobi: 7.5 ETH.' ELSE 'Bridged ' || a || ' ETH to ' || {_duck_address('o_custkey', 'b')} || '; BNB, BitTorrent, stETH; sanction by OFAC.' END AS fund_flow,
 strftime(o_orderdate, '%Y-%m-%d') AS incident_date, ['NATION_' || CAST(o_custkey % 7 AS VARCHAR)] AS victims,
 CASE o_orderkey % 3 WHEN 0 THEN ['main ' || m, s] WHEN 1 THEN ['fake sysvar ' || s, m] ELSE [m, {_duck_address('o_orderkey', 'a')}] END AS attackers,
 [a || ' ETH', '1,200 usdc', 'some coins'] AS loss_assets
 FROM (SELECT *, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS a, {_duck_address('o_custkey')} AS m, 'So' || repeat('1', 30) || CAST(o_orderkey % 9 + 1 AS VARCHAR) AS s FROM orders) o""",
    "report_docs": """SELECT CAST(page_id % 3 AS INTEGER) AS run, page_id AS pos, url, 'doc_' || CAST(page_id AS VARCHAR) || repeat('x', CAST(page_id % 4 AS INTEGER)) || '.pdf' AS filename,
 substr('ABCDE', CAST(page_id % 5 AS INTEGER) + 1, 1) AS grade, CASE WHEN page_id % 7 = 0 THEN 'forum' WHEN page_id % 2 = 0 THEN 'audit' ELSE 'news' END AS source_type FROM pages""",
}
