"""SQL that says what the queries of core_problems.py say, for a plain SQL engine."""

from __future__ import annotations

MOMENT = r"^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)\s*$"
UUID = r"^\s*(?:urn:uuid:)?[{(]?((?:[0-9a-f]-?){31}[0-9a-f])[)}]?\s*$"
ABSENT = r"^[\s\x{A0}[:punct:]0]*(?:(?:not (?:yet )?(?:available|known|specified)|to be (?:confirmed|determined|announced)|unknown|manufacturer|none|null|nil|nan|missing|n\W?a|tb[dca]|x{2,}|غير معروف)[\s\x{A0}[:punct:]0]*)*$"
COUNTS = r"""[ \t\n\r]*\{[ \t\n\r]*("([^"\\]|\\.)*"[ \t\n\r]*:[ \t\n\r]*(0|[1-9][0-9]*)[ \t\n\r]*(,[ \t\n\r]*"([^"\\]|\\.)*"[ \t\n\r]*:[ \t\n\r]*(0|[1-9][0-9]*)[ \t\n\r]*)*)?\}[ \t\n\r]*"""


def _readable(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '{MOMENT}') THEN TRY_CAST({column} AS TIMESTAMPTZ) END"


_RECORDS = f"""
WITH readable AS (
  SELECT kafka_topic, kafka_partition, kafka_offset, event_type, {_readable('occurred_at')} AS o, {_readable('recorded_at')} AS r FROM bronze_event),
placed AS (
  SELECT *, (o AT TIME ZONE 'UTC')::DATE AS event_day, (r AT TIME ZONE 'UTC')::DATE AS arrival_day, epoch_ms(r) - epoch_ms(o) > 259200000 AS beyond
  FROM readable WHERE o IS NOT NULL AND r IS NOT NULL)"""

_BAD_PRICE = "(retail_price_egp IS NULL OR retail_price_egp <= 0 OR retail_price_egp > 100000)"
_BAD_MAKER = f"(manufacturer IS NULL OR regexp_matches(lower(manufacturer), '{ABSENT}'))"
_BAD_COUNTS = f"(input_row_counts IS NULL OR NOT regexp_full_match(input_row_counts, '{COUNTS}'))"

_LOADS = f"""
prices AS (SELECT source_snapshot_label AS load, median(CASE WHEN NOT {_BAD_PRICE} THEN retail_price_egp::DOUBLE END) AS m FROM master_product GROUP BY 1),
middle AS (SELECT median(m) AS mid FROM prices),
makers AS (SELECT load, sum(n) AS n, max(CASE WHEN manufacturer IS NOT NULL THEN n ELSE 0 END) AS most, sum(CASE WHEN {_BAD_MAKER} THEN n ELSE 0 END) AS bad
           FROM (SELECT source_snapshot_label AS load, manufacturer, count(*) AS n FROM master_product GROUP BY 1, 2) GROUP BY 1)"""

_DEMAND = """
WITH counted AS (
  SELECT product_id, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, sum(requested_units * CASE WHEN demand_attempt_id IS NULL THEN copies ELSE 1 END) AS units
  FROM (SELECT demand_attempt_id, product_id, transaction_ts, requested_units, count(*) AS copies FROM demand_attempt
        WHERE product_id IS NOT NULL AND transaction_ts IS NOT NULL AND requested_units IS NOT NULL GROUP BY ALL)
  GROUP BY 1, 2),
grid AS (SELECT product_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM counted GROUP BY 1),
dense AS (SELECT product_id, day, coalesce(units, 0) AS units FROM grid LEFT JOIN counted USING (product_id, day)),
totals AS (SELECT product_id, day, units,
  sum(units) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7,
  sum(units) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30 FROM dense)"""

_COPIES = f"""
WITH keyed AS (SELECT *, replace(regexp_extract(lower(event_id), '{UUID}', 1), '-', '') AS uid FROM bronze_event),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY kafka_timestamp NULLS LAST, kafka_topic NULLS LAST, kafka_partition NULLS LAST, kafka_offset NULLS LAST) AS copy FROM keyed)"""

_SALES = """
SELECT '{table}' AS table_name, '{key}' AS column_name, {key} AS key_value, sum(w)::BIGINT AS row_count, sum(net_sales_egp * w) AS net_sales_egp, sum(gross_profit_egp * w) AS gross_profit_egp
FROM (SELECT {key}, net_sales_egp, gross_profit_egp, CASE WHEN {id} IS NULL THEN count(*) ELSE 1 END AS w FROM {table} WHERE {key} IS NOT NULL GROUP BY {id}, {key}, net_sales_egp, gross_profit_egp)
GROUP BY {key}"""

ORACLES = {
    "p1_found": f"""WITH {_LOADS}
SELECT 'master_product' AS table_name, 'retail_price_egp' AS column_name, product_id AS record_key FROM master_product WHERE {_BAD_PRICE}
UNION SELECT 'master_product', 'manufacturer', product_id FROM master_product WHERE {_BAD_MAKER}
UNION SELECT 'ingestion_run', 'input_row_counts', run_id FROM ingestion_run WHERE {_BAD_COUNTS}
UNION SELECT 'master_product', 'retail_price_egp', load FROM prices, middle WHERE load IS NOT NULL AND (m > 3 * mid OR m < mid / 3)
UNION SELECT 'master_product', 'manufacturer', load FROM makers WHERE load IS NOT NULL AND (bad * 4 > n OR most * 2 > n)""",
    "p1_aggregates": f"""WITH {_LOADS}
SELECT 'master_product' AS table_name, 'retail_price_egp' AS column_name, source_snapshot_label AS load, count(*) AS rows, count(*) - count(retail_price_egp) AS null_rows,
  count(DISTINCT retail_price_egp) AS distinct_values, count_if({_BAD_PRICE}) AS broken_rows, coalesce(max(m) > 3 * max(mid) OR max(m) < max(mid) / 3, false) AS out_of_order, round(max(m), 4) AS median
FROM master_product JOIN prices ON source_snapshot_label IS NOT DISTINCT FROM prices.load, middle GROUP BY source_snapshot_label
UNION ALL SELECT 'master_product', 'manufacturer', source_snapshot_label, count(*), count(*) - count(manufacturer), count(DISTINCT manufacturer), count_if({_BAD_MAKER}), max(bad) * 4 > max(n) OR max(most) * 2 > max(n), NULL
FROM master_product JOIN makers ON source_snapshot_label IS NOT DISTINCT FROM makers.load GROUP BY source_snapshot_label
UNION ALL SELECT 'ingestion_run', 'input_row_counts', NULL, count(*), count(*) - count(input_row_counts), count(DISTINCT input_row_counts), count_if({_BAD_COUNTS}), false, NULL FROM ingestion_run""",
    "p2_found": f"{_RECORDS} SELECT kafka_topic, kafka_partition, kafka_offset FROM placed WHERE beyond",
    "p2_revisions": f"""{_RECORDS}, cells AS (SELECT event_type, event_day, arrival_day, count(*) AS arrived FROM placed WHERE NOT beyond GROUP BY 1, 2, 3)
SELECT event_type, event_day::VARCHAR AS event_day, arrival_day::VARCHAR AS arrival_day, arrived,
  (sum(arrived) OVER (PARTITION BY event_type, event_day ORDER BY arrival_day))::BIGINT AS corrected_total,
  row_number() OVER (PARTITION BY event_type, event_day ORDER BY arrival_day) AS revision,
  arrival_day = max(arrival_day) OVER (PARTITION BY event_type, event_day) AS is_latest FROM cells""",
    "p3_found": f"{_DEMAND} SELECT product_id, day::VARCHAR AS demand_day FROM totals WHERE t30 = 0",
    "p3_trailing_totals": f"""{_DEMAND} SELECT product_id, day::VARCHAR AS day, units::BIGINT AS day_total, t7::BIGINT AS total_7d, t30::BIGINT AS total_30d,
  round(t7::DOUBLE / 7, 6) AS average_7d, round(t30::DOUBLE / 30, 6) AS average_30d FROM totals""",
    "p4_found": f"{_COPIES} SELECT kafka_topic, kafka_partition, kafka_offset FROM ranked WHERE uid <> '' AND copy > 1",
    "p4_single_deliveries": f"{_COPIES} SELECT kafka_topic, kafka_partition, kafka_offset, event_id, recorded_at FROM ranked WHERE uid IS NULL OR uid = '' OR copy = 1",
    "p5_found": """SELECT 'sale_line' AS table_name, 'product_id' AS column_name, product_id AS key_value FROM sale_line WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) * 25 >= (SELECT count(*) FROM sale_line)
UNION ALL SELECT 'sale_header', 'branch_id', branch_id FROM sale_header WHERE branch_id IS NOT NULL GROUP BY branch_id HAVING count(*) * 25 >= (SELECT count(*) FROM sale_header)""",
    "p5_sales_totals": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{k}' AS column_name, {k} AS key_value, count(*) AS row_count, sum(net_sales_egp) AS net_sales_egp, sum(gross_profit_egp) AS gross_profit_egp FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}"
        for t, k in (("sale_line", "product_id"), ("sale_header", "branch_id"))
    ),
    "p5_totals_of_reloads_once": _SALES.format(table="sale_line", key="product_id", id="sale_line_id") + " UNION ALL " + _SALES.format(table="sale_header", key="branch_id", id="sale_id"),
    "p6_found": """SELECT DISTINCT demand_attempt_id, price_observation_id FROM (
  SELECT a.demand_attempt_id, p.price_observation_id, row_number() OVER (PARTITION BY a.demand_attempt_id, a.transaction_ts, a.product_id ORDER BY p.observed_at DESC, p.loaded_at DESC, p.price_observation_id DESC) AS k
  FROM (SELECT DISTINCT demand_attempt_id, product_id, transaction_ts FROM demand_attempt WHERE demand_attempt_id IS NOT NULL) AS a
  JOIN product_price_history AS p ON a.product_id = p.product_id AND p.observed_at <= a.transaction_ts AND p.loaded_at <= a.transaction_ts
  WHERE p.price_egp IS NOT NULL) WHERE k = 1""",
}
