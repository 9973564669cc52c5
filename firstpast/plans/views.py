"""Race-shaped views over the TPC-H-like test tables.

One SQL text serves both engines: two date expressions are the only tokens that
differ. Spark reads the parquet files, the checking engine sees registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firstpast.session import configure

_SPARK_TOKENS = {
    "DAYS": "datediff(l_shipdate, DATE'1995-01-01')",
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
}
_CHECK_TOKENS = {
    "DAYS": "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))",
    "US": "epoch_us(ts)",
}

_ARRIVALS = """
SELECT l_linestatus AS hub,
       CAST(floor(l_orderkey / 4) AS BIGINT) AS slot,
       CAST((l_orderkey % 4) * 32 AS BIGINT) AS fec_set_index,
       concat('src-', l_suppkey % 8) AS source,
       l_shipdate AS t,
       CAST(<DAYS> AS BIGINT) * 100000 + (l_partkey * 37) % 100000 AS rx_ns,
       CASE WHEN l_tax = 0.08 THEN NULL
            WHEN l_discount = 0.10 THEN md5(concat(l_orderkey, 'x'))
            ELSE md5(concat(l_orderkey, '')) END AS signature
FROM lineitem"""

_SHREDS = """
SELECT concat('p', l_suppkey % 4) AS provider,
       CAST(floor(l_orderkey / 4) AS BIGINT) AS slot,
       CAST((l_orderkey % 4) * 32 AS BIGINT) AS fec_set_index,
       l_returnflag = 'R' AS is_code,
       CAST(l_linenumber - 1 AS BIGINT) AS position,
       CAST((l_orderkey % 4) * 32 + l_linenumber - 1 AS BIGINT) AS shred_index,
       CASE WHEN l_returnflag = 'R' THEN CAST(1 + l_orderkey % 2 AS BIGINT) END AS num_data,
       CASE WHEN l_returnflag = 'R' THEN CAST(1 AS BIGINT) END AS num_coding,
       l_returnflag = 'A' AND l_linenumber <= 2 AS data_complete,
       l_linenumber = 7 AND l_returnflag <> 'R' AS last_in_slot,
       CAST(<DAYS> AS BIGINT) * 100000 + (l_partkey * 37) % 100000 AS rx_ns,
       l_discount <> 0.10 AS merkle_ok,
       CASE WHEN l_tax = 0.08 THEN false WHEN l_tax = 0.0 THEN NULL ELSE true END AS sig_ok,
       md5(concat(l_orderkey, '|', l_linenumber, '|', l_returnflag, '|', l_suppkey % 4, '|',
                  l_discount = 0.10, '|', l_tax = 0.08)) AS payload_hash,
       md5(concat(l_orderkey, '|', l_linenumber, '|', l_returnflag = 'R',
                  CASE WHEN l_quantity > 45 AND (l_discount = 0.10 OR l_tax = 0.08)
                       THEN '|x' ELSE '' END)) AS data_hash,
       CASE WHEN l_discount = 0.10 THEN NULL
            ELSE concat('root-', CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) END AS root,
       CAST(CASE WHEN l_quantity = 3 THEN 2 ELSE 1 END AS BIGINT) AS version
FROM lineitem"""

_VIEWS: dict[str, tuple[str, ...]] = {
    "arrivals": (_ARRIVALS,),
    # Deltas to the baseline source; NULL where the baseline never delivered.
    "arrivals_delta": ("""
SELECT a.*, a.rx_ns - b.base_ns AS delta_ns
FROM (""" + _ARRIVALS + """) a LEFT JOIN (
  SELECT hub, slot, fec_set_index, min(rx_ns) AS base_ns
  FROM (""" + _ARRIVALS + """) x WHERE source = 'src-0'
  GROUP BY hub, slot, fec_set_index) b
ON a.hub = b.hub AND a.slot = b.slot AND a.fec_set_index = b.fec_set_index""",),
    # The leader of a slot's first order; a slot whose first order is of low priority has none.
    "schedule": ("""
SELECT slot, leader FROM (
  SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS slot,
         CASE WHEN min_by(o_orderpriority, o_orderkey) <> '5-LOW'
              THEN concat('val-', min_by(o_custkey % 60, o_orderkey)) END AS leader
  FROM orders GROUP BY CAST(floor(o_orderkey / 4) AS BIGINT)) led
WHERE leader IS NOT NULL""",),
    # Which leader identities belong to which source brand.
    "leader_brands": ("""
SELECT DISTINCT concat('val-', c_custkey % 60) AS leader,
       CASE WHEN c_custkey % 60 < 24 THEN concat('src-', (c_custkey % 60) % 8) END AS brand
FROM customer""",),
    "shreds": (_SHREDS,),
    "txn_events": ("""
SELECT concat(user_id % 10, '-', CAST(floor(<US> / 21600000000) AS BIGINT)) AS signature,
       CAST(floor(<US> / 21600000000) AS BIGINT) AS slot,
       event_type AS source,
       <US> * 1000 AS ns
FROM events""",),
    "range_shreds": ("""
SELECT concat('p', l_suppkey % 2) AS provider, l_orderkey AS slot,
       CAST(l_linenumber - 1 AS BIGINT) AS shred_index,
       CAST(<DAYS> AS BIGINT) * 100000 + (l_partkey * 37) % 100000 AS rx_ns,
       l_returnflag = 'A' AS data_complete
FROM lineitem""",),
    "transactions": ("""
SELECT concat('tx-', l_orderkey, '-', l_linenumber) AS signature,
       l_orderkey AS slot,
       CAST(l_linenumber AS BIGINT) AS range_end_exclusive,
       l_returnflag = 'N' AS is_vote,
       l_tax = 0.08 AS failed,
       array(concat('acct-', l_partkey % 50), concat('acct-', l_suppkey % 20)) AS account_keys
FROM lineitem""", """
SELECT concat('tx-', l_orderkey, '-', l_linenumber) AS signature,
       l_orderkey AS slot,
       CAST(l_linenumber AS BIGINT) AS range_end_exclusive,
       l_returnflag = 'N' AS is_vote,
       l_tax = 0.08 AS failed,
       [concat('acct-', l_partkey % 50), concat('acct-', l_suppkey % 20)] AS account_keys
FROM lineitem"""),
    "providers": ("""
SELECT concat('src-', s_suppkey % 8) AS name, concat('10.0.', s_nationkey, '.', s_suppkey) AS src_ip,
       CASE WHEN s_acctbal > 5000 THEN 'paid' WHEN s_acctbal > 0 THEN 'free' ELSE 'unregistered' END AS tier,
       s_suppkey AS updated_at
FROM supplier""",),
    "first_provider": ("""
SELECT l_linestatus AS hub, concat('10.0.', s_nationkey, '.', s_suppkey) AS src_ip, l_shipdate AS t
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",),
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    text = _VIEWS[name][0]
    for token, expression in _SPARK_TOKENS.items():
        text = text.replace(f"<{token}>", expression)
    tables = {}
    for table in ("lineitem", "orders", "customer", "supplier", "events"):
        if f" {table}" in text:
            text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
            text = text.replace(f"JOIN {table}", f"JOIN {{{table}}}")
            tables[table] = scan(spark, sf_dir, table)
    return spark.sql(text, **tables)


def check_view(name: str) -> str:
    text = _VIEWS[name][-1]
    for token, expression in _CHECK_TOKENS.items():
        text = text.replace(f"<{token}>", expression)
    return text.strip()


def check_ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the checking engine."""
    return "WITH " + ",\n".join(f"{n} AS ({check_view(n)})" for n in names)
