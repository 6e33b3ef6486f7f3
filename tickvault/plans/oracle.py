"""DuckDB oracle SQL for every registered query.

Each oracle rebuilds the warehouse tables from the driver's views with the
same mapping as ``tickvault.sources.driver`` (FIXTURES.md §3) and then states
the query in plain SQL, independently of the Spark code path.
"""

from __future__ import annotations

# Warehouse tables over the driver views, as SQL text.
MODEL = {
    "series": """
  SELECT 'TS_' || CAST(event_id AS VARCHAR) AS seriesId,
         'INST_' || CAST(user_id AS VARCHAR) AS instrumentId,
         'DS_' || CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
                         WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS VARCHAR)
           AS dataSourceId,
         ts AS dataTimestamp, value AS close, props, event_id
  FROM events""",
    "sources": """
  SELECT 'DS_' || CAST(r_regionkey AS VARCHAR) AS dataSourceId, r_name AS providerName,
         lower(r_name) AS providerType, 'https://example.invalid/' || lower(r_name) AS apiEndpoint,
         'region ' || r_name AS description
  FROM region""",
    "instruments": """
  SELECT 'INST_' || CAST(p_partkey AS VARCHAR) AS instrumentId,
         upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR) AS symbol,
         p_name AS name, p_brand || ' ' || p_type AS description,
         lower(p_type) AS instrumentClass,
         CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'Global' END AS region,
         'USD' AS currency, p_partkey % 10 <> 9 AS isActive
  FROM part""",
    "attributes": """
  SELECT 'INST_' || CAST(p_partkey AS VARCHAR) AS instrumentId, 'brand' AS attributeName,
         p_brand AS attributeValue, 'str' AS attributeType FROM part
  UNION ALL
  SELECT 'INST_' || CAST(p_partkey AS VARCHAR), 'size', CAST(p_size AS VARCHAR), 'int'
  FROM part""",
    "change_feed": """
  SELECT 'INST_' || CAST(user_id AS VARCHAR) AS instrumentId, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'delete'
              ELSE 'restore' END AS op
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')""",
    "provenance": """
  SELECT 'PROV_' || CAST(event_id AS VARCHAR) AS provenanceId,
         'INST_' || CAST(user_id AS VARCHAR) AS instrumentId,
         'DS_' || CAST(event_id % 7 AS VARCHAR) AS sourceId,
         CASE WHEN event_id % 2 = 0 THEN 'bulk_import' ELSE 'time_series_data' END AS sourceType,
         ts AS ingestTime, props AS rawData, 'bulk_api_post' AS ingestionMethod, event_id
  FROM events""",
    "portfolios": """
  SELECT 'PORT_' || CAST(c_custkey AS VARCHAR) AS portfolioId, c_name AS portfolioName,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'individual' ELSE 'company' END AS ownerType,
         CAST(c_custkey AS VARCHAR) AS ownerId
  FROM customer""",
    "holdings": """
  SELECT 'PORT_' || CAST(o_custkey AS VARCHAR) AS portfolioId,
         'INST_' || CAST(l_partkey AS VARCHAR) AS instrumentId,
         l_quantity AS quantity, l_extendedprice / l_quantity AS averageCost,
         o_orderdate AS acquiredDate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({MODEL[n]}\n)" for n in names) + "\n"


NEWEST = "PARTITION BY instrumentId, dataSourceId ORDER BY dataTimestamp DESC, seriesId DESC"


def capped(source: str, cap: int) -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER ({NEWEST}) AS _rn FROM {source}) "
            f"WHERE _rn <= {cap})")


def exact_sum(value: str) -> str:
    """The correctly rounded sum of doubles: by their decimal text, not by a cast."""
    return f"CAST(CAST(sum(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE)"


EXACT_AVG = f"{exact_sum('close')} / count(close)"
