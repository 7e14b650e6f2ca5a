"""Independent SQL (DuckDB dialect) for the correctness gate.

Each query gets the fixture views as CTEs, then its own SELECT.  These
strings are never run by Spark; they only check the DataFrame code.
"""

from __future__ import annotations

TRANSACTIONS = """
transactions AS (
SELECT
  concat('tx_', CAST(event_id AS STRING)) AS transaction_id,
  concat('user_', CAST(user_id AS STRING)) AS user_id,
  concat('mrc_', CAST((event_id * 31) % 100 AS STRING)) AS merchant_id,
  round(value * CASE WHEN dev < 35 THEN 400 ELSE 50 END, 2) AS amount,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'payment'
       WHEN 'view' THEN 'transfer' WHEN 'signup' THEN 'refund' ELSE 'withdrawal' END AS transaction_type,
  split_part('retail,electronics,grocery,travel,dining,healthcare,entertainment,online,atm,other', ',',
    CAST(1 + CASE WHEN dev < 35 OR event_id % 20 = 0 THEN (user_id + event_id) % 10
                  ELSE (user_id + 3 * (event_id % 2)) % 10 END AS INT)) AS merchant_category,
  CASE WHEN dev < 35 AND dev % 2 = 0 THEN 'unknown' WHEN event_id % 20 = 1 THEN 'tablet'
       ELSE split_part('mobile,desktop,tablet,pos_terminal', ',', CAST(1 + user_id % 4 AS INT)) END AS device_type,
  CASE WHEN dev < 35 THEN 'online'
       ELSE split_part('mobile_app,online,mobile_app,in_store', ',', CAST(1 + user_id % 4 AS INT)) END AS channel,
  CASE WHEN dev < 35 AND dev % 3 = 0 THEN 'Offshore City'
       ELSE concat('City_', CAST((user_id + event_id) % 2 AS STRING)) END AS city,
  split_part('US,IN,GB,DE,AU,CA,FR,SG,AE,BR', ',',
    CAST(1 + (nk + CASE WHEN dev < 35 AND dev % 3 = 0 THEN 1 ELSE 0 END) % 10 AS INT)) AS country,
  ts AS timestamp,
  (dev < 35 AND dev % 3 = 0) AS is_international,
  (dev >= 35 AND user_id % 4 = 3) AS card_present,
  CASE WHEN dev < 35 THEN 1 ELSE 0 END AS is_fraud
FROM (SELECT e.*, c.c_nationkey AS nk, (e.event_id * 7919 + 13) % 1000 AS dev
      FROM events e JOIN customer c ON c.c_custkey = e.user_id) t
)"""

RAW = """
raw_transactions AS (
SELECT transaction_id,
  CASE WHEN n % 50 = 17 THEN NULL ELSE user_id END AS user_id,
  merchant_id,
  CASE WHEN n % 50 = 7 THEN '-50.0' WHEN n % 50 = 23 THEN 'abc' ELSE CAST(amount AS STRING) END AS amount,
  CASE WHEN n % 50 = 11 THEN 'gambling' ELSE transaction_type END AS transaction_type,
  CASE WHEN n % 50 = 29 THEN 'food' ELSE merchant_category END AS merchant_category,
  CASE WHEN n % 10 = 3 THEN NULL ELSE device_type END AS device_type,
  channel, city,
  CASE WHEN n % 50 = 13 THEN 'USA' WHEN n % 3 = 0 THEN lower(country) ELSE country END AS country,
  CASE WHEN n % 50 = 19 THEN 'junk' ELSE CAST(date_trunc('second', timestamp) AS STRING) END AS timestamp,
  CASE WHEN n % 10 = 4 THEN NULL WHEN is_international THEN 'True' ELSE 'false' END AS is_international,
  CASE WHEN n % 10 = 5 THEN NULL WHEN card_present THEN 'true' ELSE 'False' END AS card_present
FROM (SELECT *, CAST(substr(transaction_id, 4) AS BIGINT) AS n FROM transactions) t
)"""

SCORED = """
scored AS (
SELECT *,
  CAST((n * 37) % 1000 AS DOUBLE) / 1000 * CAST(0.7 AS DOUBLE) + is_fraud * CAST(0.3 AS DOUBLE) AS fraud_probability,
  CAST((n * 91) % 1000 AS DOUBLE) / 1000 AS anomaly_score,
  date_trunc('second', timestamp) AS created_at, n AS id
FROM (SELECT *, CAST(substr(transaction_id, 4) AS BIGINT) AS n FROM transactions) t
)"""

GEO = """
geo_dim AS (
SELECT country, city
FROM (SELECT DISTINCT country FROM transactions) a
CROSS JOIN (SELECT 'City_0' AS city UNION ALL SELECT 'City_1' AS city) b
)"""

_VIEWS = {"transactions": TRANSACTIONS, "raw_transactions": RAW, "scored": SCORED,
          "geo_dim": GEO}
_NEEDS = {"raw_transactions": ["transactions"], "scored": ["transactions"],
          "geo_dim": ["transactions"]}


def sround(expr: str, digits: int) -> str:
    """DuckDB rounding that matches Spark's ``round`` on DOUBLE: half-up on the
    shortest decimal text of the value (DuckDB's own ``round`` scales the
    binary value, which differs at ties such as 28.349999999999998)."""
    return (f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) "
            f"AS DOUBLE)")


def with_views(body: str, *extra_ctes: str, views: tuple[str, ...] = ("transactions",)) -> str:
    """Prefix ``body`` with the fixture views it names plus its own CTEs."""
    names: list[str] = []
    for v in views:
        for dep in _NEEDS.get(v, []) + [v]:
            if dep not in names:
                names.append(dep)
    ctes = [_VIEWS[n] for n in names] + [c for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body
