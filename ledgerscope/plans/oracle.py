"""Equivalent SQL of the registered queries, for the driver's side-by-side check.

Every text starts from the same mapping of the star-schema tables onto a case.
"""

from __future__ import annotations

from ledgerscope.plans.star_case import DIRTY

CASE = """
transactions AS MATERIALIZED (
  SELECT printf('tx-rec-%06d', o_orderkey) AS record_id, 'tx_' || o_orderkey AS txid, o_orderkey, o_custkey,
         o_totalprice, 1704067200 + (o_orderkey * 7919) % 2592000 AS timestamp_epoch,
         (1704067200 + (o_orderkey * 7919) % 2592000) * 1000000 AS us,
         (o_orderkey % 100) / 400.0 * o_totalprice / 1e4 AS fee,
         180 + o_orderkey % 400 AS size, 1 AS version, 0 AS locktime
  FROM orders),
inputs AS MATERIALIZED (
  SELECT txid, 0 AS input_index,
         lag(txid) OVER (PARTITION BY o_custkey ORDER BY timestamp_epoch, o_orderkey) AS prev_txid,
         0 AS prev_vout, 'W' || o_custkey AS address, o_totalprice / 1e4 AS amount
  FROM transactions
  UNION ALL
  SELECT txid, 1, 'tx_' || (o_orderkey - 11), 0,
         'W' || ((o_custkey * 7 + 3) % (SELECT count(DISTINCT o_custkey) FROM orders)), o_totalprice / 2e4
  FROM transactions WHERE o_orderkey % 3 = 0),
outputs AS MATERIALIZED (
  SELECT 'tx_' || l_orderkey AS txid,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity, l_discount) - 1 AS output_index,
         'W' || l_partkey AS address,
         CASE WHEN l_quantity <= 5 THEN l_extendedprice * (1 - l_discount) / 1e4 * 1e-6
              ELSE l_extendedprice * (1 - l_discount) / 1e4 END AS amount
  FROM lineitem),
network AS MATERIALIZED (
  SELECT 'net_' || event_id AS record_id, event_id, epoch_us(ts) AS us,
         CASE WHEN event_id % 4 <> 3
              THEN 'tx_' || ((event_id * 7) % (SELECT greatest(1, count(*) // 4) FROM orders)) END AS txid,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
         '192.0.2.' || (event_id % 250) AS dst_ip, 40000 + event_id % 1000 AS src_port,
         CASE event_type WHEN 'signup' THEN 9050 WHEN 'error' THEN 9999 ELSE 8333 END AS dst_port,
         'AS' || (15000 + user_id % 20) AS asn,
         ['US','DE','SG','NL','IN','GB'][user_id % 6 + 1] AS geo_country
  FROM events)
"""

PART = """
part AS MATERIALIZED (
  SELECT f.*, t.record_id, t.us FROM (
    SELECT txid, address, 1 AS sent, input_index AS position, amount FROM inputs
    UNION ALL SELECT txid, address, 0, output_index, amount FROM outputs) f
  JOIN transactions t USING (txid))
"""

PAIRS = """
pairs AS MATERIALIZED (
  SELECT DISTINCT i.address AS ia, o.address AS oa, i.txid
  FROM (SELECT DISTINCT txid, address FROM part WHERE sent = 1) i
  JOIN (SELECT DISTINCT txid, address FROM part WHERE sent = 0) o USING (txid)
  WHERE i.address <> o.address)
"""


def half_even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


r8 = lambda expr: half_even(expr, 8)

TX_FEATURES = f"""
tx_in AS (SELECT txid, count(*) AS input_count, sum(amount) AS total_input FROM inputs GROUP BY txid),
tx_sum AS (SELECT txid, sum(amount) AS s FROM outputs GROUP BY txid),
tx_out AS (
  SELECT o.txid, count(*) AS output_count, any_value(s) AS total_output,
         coalesce(-sum(CASE WHEN amount > 0 THEN amount / s * log2(amount / s) END), 0) AS bits,
         count(*) FILTER (WHERE amount < 0.0001) AS dust
  FROM outputs o JOIN tx_sum USING (txid) GROUP BY o.txid),
txf AS MATERIALIZED (
  SELECT t.txid, t.record_id, t.timestamp_epoch, coalesce(input_count, 0) AS input_count,
         coalesce(output_count, 0) AS output_count, {r8("coalesce(total_input, 0)")} AS total_input,
         {r8("coalesce(total_output, 0)")} AS total_output, fee,
         CASE WHEN total_input > 0 THEN fee / total_input ELSE 0 END AS fee_ratio,
         CASE WHEN input_count > 0 THEN coalesce(output_count, 0)::DOUBLE / input_count
              ELSE coalesce(output_count, 0) END AS input_output_ratio,
         {half_even("CASE WHEN total_output > 0 AND output_count > 1 THEN bits ELSE 0 END", 4)} AS output_entropy,
         coalesce(dust, 0) AS dust_outputs_count
  FROM transactions t LEFT JOIN tx_in USING (txid) LEFT JOIN tx_out USING (txid))
"""

WALLET_FEATURES = f"""
w_tx AS MATERIALIZED (
  SELECT address, txid, any_value(record_id) AS record_id, any_value(us) AS us,
         count(*) FILTER (WHERE sent = 1) AS s, count(*) FILTER (WHERE sent = 0) AS r
  FROM part GROUP BY address, txid),
w_sum AS (
  SELECT address, {r8("coalesce(sum(amount) FILTER (WHERE sent = 0), 0)")} AS total_incoming,
         {r8("coalesce(sum(amount) FILTER (WHERE sent = 1), 0)")} AS total_outgoing, count(*) AS flows,
         median(amount) AS median_transaction_value,
         count(*) FILTER (WHERE sent = 0 AND amount < 0.0001) AS dust_incoming_count,
         max(us) AS hi, min(us) AS lo
  FROM part GROUP BY address),
w_cnt AS (
  SELECT address, count(*) AS transaction_count, count(*) FILTER (WHERE r > 0) AS n_in,
         count(*) FILTER (WHERE s > 0) AS n_out FROM w_tx GROUP BY address),
w_gap AS (
  SELECT address, median(gap) AS median_time_gap FROM (
    SELECT address, (us - lag(us) OVER (PARTITION BY address ORDER BY us)) / 1e6 AS gap FROM part)
  WHERE gap IS NOT NULL GROUP BY address),
w_rep AS (
  SELECT address, max(c) AS max_repeated_value_count FROM (
    SELECT address, {half_even("amount", 4)} AS v, count(*) AS c FROM part WHERE sent = 1 GROUP BY 1, 2)
  GROUP BY address),
w_cin AS (SELECT oa AS address, count(DISTINCT ia) AS cin FROM pairs GROUP BY 1),
w_cout AS (SELECT ia AS address, count(DISTINCT oa) AS cout FROM pairs GROUP BY 1),
w_cp AS (
  SELECT address, count(DISTINCT b) AS cp FROM (
    SELECT ia AS address, oa AS b FROM pairs UNION ALL SELECT oa, ia FROM pairs) GROUP BY address),
w_net AS (
  SELECT address, count(DISTINCT src_ip) AS ips, count(DISTINCT geo_country) AS countries, count(DISTINCT asn) AS asns
  FROM w_tx JOIN network USING (txid) GROUP BY address),
wf AS MATERIALIZED (
  SELECT address AS wallet_address, 'wallet:' || address AS entity_id, transaction_count,
         n_in AS incoming_transaction_count, n_out AS outgoing_transaction_count,
         n_in AS in_degree, n_out AS out_degree,
         greatest(coalesce(cin, 0), n_in) AS fan_in, greatest(coalesce(cout, 0), n_out) AS fan_out,
         CASE WHEN n_in > 0 THEN n_out::DOUBLE / n_in ELSE n_out END AS fan_out_ratio,
         total_incoming, total_outgoing, total_incoming + total_outgoing AS total_volume,
         total_incoming - total_outgoing AS net_balance_change,
         CASE WHEN transaction_count > 1 THEN 1 ELSE 0 END AS address_reuse,
         (total_incoming + total_outgoing) / flows AS average_transaction_value, median_transaction_value,
         coalesce(cp, 0) AS unique_counterparties,
         coalesce(max_repeated_value_count, 0) AS max_repeated_value_count, dust_incoming_count,
         CASE WHEN hi > lo THEN flows::DOUBLE / ((hi - lo) / 1e6) ELSE flows END AS transaction_rate,
         coalesce(median_time_gap, 0) AS median_time_gap, (hi - lo) / 1e6 AS wallet_lifetime_seconds,
         coalesce(ips, 0) AS connected_ip_count, coalesce(countries, 0) AS unique_country_count,
         coalesce(asns, 0) AS unique_asn_count, transaction_count AS source_record_count, flows AS flow_count
  FROM w_sum JOIN w_cnt USING (address) LEFT JOIN w_gap USING (address) LEFT JOIN w_rep USING (address)
  LEFT JOIN w_cin USING (address) LEFT JOIN w_cout USING (address) LEFT JOIN w_cp USING (address)
  LEFT JOIN w_net USING (address))
"""

NETWORK_FEATURES = """
nf AS MATERIALIZED (
  SELECT src_ip AS ip, 'ip:' || src_ip AS entity_id, count(us) AS network_observation_count,
         count(DISTINCT dst_ip) AS unique_dst_ip_count, count(DISTINCT src_port) AS unique_src_port_count,
         count(DISTINCT dst_port) AS unique_dst_port_count, count(DISTINCT geo_country) AS unique_country_count,
         count(DISTINCT asn) AS unique_asn_count, count(DISTINCT txid) AS associated_tx_count,
         CASE WHEN max(us) > min(us) THEN count(us)::DOUBLE / ((max(us) - min(us)) / 1e6)
              ELSE count(us) END AS observation_rate,
         coalesce(median(gap), 0) AS median_network_time_gap, count(DISTINCT record_id) AS source_record_count
  FROM (SELECT *, (us - lag(us) OVER (PARTITION BY src_ip ORDER BY us)) / 1e6 AS gap FROM network)
  GROUP BY src_ip)
"""

LINKS = """
exact_links AS (
  SELECT n.record_id AS network_record_id, txid, t.record_id AS transaction_record_id,
         'exact_txid' AS method, abs(n.us - t.us) // 1000 AS time_delta_ms, 'shared_txid' AS basis, src_ip, dst_ip
  FROM network n JOIN transactions t USING (txid)),
loose AS (SELECT * FROM network n WHERE txid IS NULL OR txid NOT IN (SELECT txid FROM transactions)),
temporal_links AS (
  SELECT n.record_id AS network_record_id, t.txid, t.record_id AS transaction_record_id,
         'temporal_window' AS method, abs(n.us - t.us) // 1000 AS time_delta_ms, 'heuristic' AS basis, src_ip, dst_ip
  FROM loose n JOIN transactions t ON t.us BETWEEN n.us - 30000000 AND n.us + 30000000)
"""


def _with(select: str, *blocks: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(b.strip() for b in (CASE, *blocks)) + "\n" + select


ORACLES: dict[str, str] = {
    "case_tables": _with("""
SELECT 'transactions' AS tbl, count(*) AS n, count(DISTINCT txid) AS keys, """ + r8("sum(fee)") + """ AS total FROM transactions
UNION ALL SELECT 'inputs', count(*), count(DISTINCT coalesce(prev_txid, '-')), """ + r8("sum(amount)") + """ FROM inputs
UNION ALL SELECT 'outputs', count(*), count(DISTINCT txid || '/' || output_index), """ + r8("sum(amount)") + """ FROM outputs
UNION ALL SELECT 'network', count(*), count(DISTINCT txid), sum(src_port)::DOUBLE FROM network"""),
    "transaction_features": _with(
        "SELECT * REPLACE (" + half_even("fee", 8) + " AS fee, " + half_even("fee_ratio", 8) + " AS fee_ratio), "
        "input_count AS in_degree, output_count AS out_degree, total_output AS transaction_value FROM txf",
        TX_FEATURES,
    ),
    "wallet_features": _with(
        "SELECT * REPLACE (" + half_even("transaction_rate", 10) + " AS transaction_rate, "
        + half_even("median_transaction_value", 10) + " AS median_transaction_value) FROM wf",
        PART, PAIRS, WALLET_FEATURES,
    ),
    "wallet_sources": _with(
        "SELECT 'wallet:' || address AS entity_id, count(*) AS records, min(record_id) AS first_record, "
        "max(record_id) AS last_record FROM (SELECT DISTINCT address, record_id FROM part) GROUP BY address", PART),
    "wallet_first_sources": _with(
        "SELECT entity_id, string_agg(record_id, ',' ORDER BY record_id) AS records FROM ("
        "SELECT 'wallet:' || address AS entity_id, record_id, row_number() OVER (PARTITION BY address ORDER BY record_id) AS n "
        "FROM (SELECT DISTINCT address, record_id FROM part)) WHERE n <= 20 GROUP BY entity_id", PART),
    "network_features": _with(
        "SELECT * REPLACE (" + half_even("observation_rate", 10) + " AS observation_rate, "
        + half_even("median_network_time_gap", 7) + " AS median_network_time_gap) FROM nf", NETWORK_FEATURES),
    "address_edges": _with("SELECT ia AS source_address, oa AS target_address, txid FROM pairs", PART, PAIRS),
    "exact_links": _with("SELECT * FROM exact_links", LINKS),
    "temporal_links": _with("SELECT * FROM temporal_links", LINKS),
    "propagation_latency": _with("""
SELECT n.record_id, txid, src_ip, floor((n.us - t.us) / 1000)::BIGINT AS propagation_latency_ms FROM network n JOIN transactions t USING (txid)
UNION ALL SELECT n.record_id, t.txid, src_ip, floor((n.us - t.us) / 1000)::BIGINT
FROM loose n ASOF LEFT JOIN (SELECT us, max(txid) AS txid FROM transactions GROUP BY us) t ON n.us >= t.us""", LINKS),
    "correlation_status": _with("""
SELECT txid, CASE WHEN txid IN (SELECT txid FROM exact_links) THEN 'exactly_correlated'
                  WHEN txid IN (SELECT txid FROM temporal_links) THEN 'partially_correlated'
                  ELSE 'uncorrelated' END AS status FROM transactions""", LINKS),
    "relay_latency": _with("""
SELECT txid, arg_min(n.record_id, (n.us, n.record_id)) AS record_id, (min(n.us) - any_value(t.us)) // 1000 AS latency_ms
FROM network n JOIN transactions t USING (txid) WHERE n.us >= t.us GROUP BY txid"""),
    "relay_bursts": _with("""
SELECT 'RULE_MULTI_IP_RELAY_BURST' AS rule_id, txid, 'transaction:' || txid AS entity_id,
       count(DISTINCT src_ip) AS unique_ip_count, count(DISTINCT record_id) AS observations, 'high' AS severity,
       substr(txid, 1, 10) || ' came from ' || count(DISTINCT src_ip) || ' different addresses' AS description
FROM network WHERE txid IS NOT NULL GROUP BY txid HAVING count(DISTINCT src_ip) >= 3"""),
}


RECORDS = (
    """
base AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice)::BIGINT AS p,
  strftime(make_timestamp((1704067200 + o_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso,
  strftime(make_timestamp((1704067200 + o_orderkey) * 1000000), '%Y/%m/%d %H:%M:%S') AS slashed FROM orders),
dirty AS MATERIALIZED (SELECT k, """
    + ", ".join(f"{text} AS {name}" for name, text in DIRTY.items())
    + """ FROM base),
lists AS MATERIALIZED (SELECT *,
  list_transform(CASE WHEN senders LIKE '[%' THEN string_split(replace(replace(replace(senders, '[', ''), ']', ''), '"', ''), ',')
       WHEN senders LIKE '%|%' THEN string_split(senders, '|') ELSE string_split(senders, ';') END, lambda x: trim(x)) AS ia,
  CASE WHEN input_value LIKE '%|%' THEN string_split(input_value, '|') ELSE string_split(input_value, ',') END AS im,
  try_cast(tx_fee AS DOUBLE) AS fee, try_cast(output_value AS DOUBLE) AS om,
  (client_ip NOT LIKE '%:%' AND k % 300 > 255) AS bad_ip FROM dirty),
issues AS MATERIALIZED (
  SELECT record_id, 'error' AS issue_type, 'MISSING_TIMESTAMP' AS code, 'no time given' AS message
    FROM lists WHERE time = ''
  UNION ALL SELECT record_id, 'error', 'INVALID_TIMESTAMP', 'not a time: ' || time FROM lists WHERE time = 'not-a-date'
  UNION ALL SELECT record_id, 'error', 'MISSING_TXID', 'no txid given' FROM lists WHERE tx_hash = ''
  UNION ALL SELECT record_id, 'error', 'ARRAY_PARITY_INPUT_MISMATCH', 'input: ' || len(ia) || ' addresses beside ' || len(im) || ' amounts' FROM lists WHERE len(ia) <> len(im)
  UNION ALL SELECT record_id, 'error', 'NEGATIVE_INPUT_AMOUNT', 'Input amount at index 0 below zero: -5' FROM lists WHERE im[1] = '-5'
  UNION ALL SELECT record_id, 'error', 'INVALID_INPUT_AMOUNT', 'Input amount at index 0 is no number: abc' FROM lists WHERE im[1] = 'abc'
  UNION ALL SELECT record_id, 'error', 'NEGATIVE_OUTPUT_AMOUNT', 'Output amount at index 0 below zero: ' || output_value FROM lists WHERE om < 0
  UNION ALL SELECT record_id, 'error', 'NEGATIVE_FEE', 'fee below zero: ' || tx_fee FROM lists WHERE fee < 0
  UNION ALL SELECT record_id, 'error', 'INVALID_FEE', 'fee is no number: ' || tx_fee FROM lists WHERE fee IS NULL
  UNION ALL SELECT record_id, 'error', 'INVALID_SRC_IP', 'src_ip is no address: ' || client_ip FROM lists WHERE bad_ip
  UNION ALL SELECT record_id, 'error', 'INVALID_SRC_PORT', 'src_port is no port: ' || source_port FROM lists
       WHERE source_port::INT > 65535
  UNION ALL SELECT record_id, 'warning', 'MONETARY_DISCREPANCY', '' FROM lists
       WHERE im[1] <> 'abc' AND fee IS NOT NULL
         AND abs(list_sum(list_transform(im, lambda x: try_cast(x AS DOUBLE))) - (om + fee)) > 1e-8),
good AS MATERIALIZED (SELECT * FROM lists WHERE record_id NOT IN (SELECT record_id FROM issues WHERE issue_type = 'error')),
clean AS MATERIALIZED (
  SELECT record_id, trim(tx_hash) AS txid, 1704067200 + k AS timestamp_epoch, fee, array_to_string(ia, '+') AS input_addresses,
         list_sum(list_transform(im, lambda x: x::DOUBLE)) AS total_input, recipients AS output_addresses, om AS total_output,
         CASE WHEN k % 6 = 5 THEN CASE WHEN k % 10 = 0 THEN '2001:db8:0:0:1::' ELSE '2001:db8::1:0:0:' || (k % 10) END
              ELSE client_ip END AS src_ip, trim(server_ip) AS dst_ip, source_port::INT AS src_port, dest_port::INT AS dst_port,
         'US' AS geo_country, trim(as_number) AS asn FROM good)
"""
)


def _records(select: str) -> str:
    return f"WITH {RECORDS.strip()}\n{select}"


ORACLES |= {
    "validate_issues": _records("SELECT * FROM issues"),
    "validate_counters": _records("""
SELECT count(*) AS total_rows, (SELECT count(*) FROM good) AS accepted_rows, count(*) - (SELECT count(*) FROM good) AS rejected_rows,
       (SELECT count(*) FROM issues WHERE issue_type = 'warning') AS warning_count FROM lists"""),
    "normalize_records": _records("SELECT * FROM clean"),
    "source_csv": _records("SELECT * FROM clean"),
    "source_json": _records("SELECT * FROM clean"),
    "source_json_wrapped": _records("SELECT * FROM clean"),
    "source_xml": _records("SELECT * FROM clean"),
    "source_json_document": _records("SELECT * FROM clean"),
    "source_folder": _records("SELECT * FROM clean"),
    "source_ndjson_broken": _records("SELECT * FROM clean"),
    "source_xml_mixed": _records("SELECT * FROM clean"),
    "records_to_case": _records("""
SELECT txid, 'in' AS side, i.i - 1 AS position, ia[i.i] AS address, im[i.i]::DOUBLE AS amount
FROM (SELECT * REPLACE (trim(tx_hash) AS tx_hash), trim(tx_hash) AS txid FROM good), generate_series(1, len(ia)) AS i(i)
UNION ALL SELECT trim(tx_hash), 'out', 0, recipients, om FROM good"""),
    "case_findings": _with("""
SELECT 'E004_TRANSACTION_REFERENCE_MISSING' AS code, 'inputs.csv' AS file, 'txid' AS column_name, 'inputs.csv names ' ||
  (SELECT count(DISTINCT txid) FROM inputs WHERE substr(txid, 4)::INT % 10 = 9) || ' unknown txids' AS message
UNION ALL SELECT 'E004_TRANSACTION_REFERENCE_MISSING', 'outputs.csv', 'txid', 'outputs.csv names ' ||
  (SELECT count(DISTINCT txid) FROM outputs WHERE substr(txid, 4)::INT % 10 = 9) || ' unknown txids'
UNION ALL SELECT 'E003_TIMESTAMP_INVALID', 'transactions.csv', 'timestamp', 'transactions.csv has times that cannot be read'
UNION ALL SELECT 'E002_SCHEMA_INVALID', 'transactions.csv', 'fee', 'transactions.csv: fee falls below zero'
UNION ALL SELECT 'E002_SCHEMA_INVALID', 'inputs.csv', 'amount', 'inputs.csv: amount holds what is no number'
"""),
    "case_row_counts": _with("""
SELECT 'transactions' AS file, count(*) AS rows FROM transactions UNION ALL SELECT 'inputs', count(*) FROM inputs
UNION ALL SELECT 'outputs', count(*) FROM outputs UNION ALL SELECT 'network', count(*) FROM network"""),
    "orphan_flows": _with("""
SELECT DISTINCT prev_txid AS txid FROM inputs WHERE prev_txid IS NOT NULL AND prev_txid NOT IN (SELECT txid FROM transactions)"""),
    "duplicate_ids": _with("SELECT txid, count(*) AS n FROM network WHERE txid IS NOT NULL GROUP BY txid HAVING count(*) > 1"),
    "missing_endpoints": _with("""
SELECT DISTINCT txid FROM (SELECT prev_txid AS txid FROM inputs WHERE prev_txid IS NOT NULL UNION ALL SELECT txid FROM inputs WHERE prev_txid IS NOT NULL)
WHERE txid NOT IN (SELECT txid FROM outputs)"""),
    "time_inversions": _with("""
SELECT i.txid, i.prev_txid, p.timestamp_epoch - t.timestamp_epoch AS seconds_early FROM inputs i JOIN transactions t USING (txid)
JOIN transactions p ON p.txid = i.prev_txid WHERE t.timestamp_epoch < p.timestamp_epoch"""),
    "canonical_transactions": _with("""
SELECT txid, timestamp_epoch, strftime(make_timestamp(timestamp_epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso,
       CASE WHEN o_orderkey % 7 = 3 THEN 0 ELSE """ + half_even("fee", 8) + """ END AS fee, size::BIGINT AS size, 1 AS version, 0 AS locktime
FROM transactions"""),
    "canonical_flows": _with("""
SELECT txid, input_index AS at_index, prev_txid, address, """ + half_even("amount", 8) + """ AS amount, 'p2wpkh' AS script_type FROM inputs
UNION ALL SELECT txid, output_index, NULL, address, """ + half_even("amount", 8) + """, 'unknown' FROM outputs"""),
    "canonical_network": _with("""
SELECT txid, us // 1000000 AS timestamp_epoch,
       CASE WHEN event_id % 11 = 5 THEN '0.0.0.0' ELSE src_ip END AS src_ip, dst_ip,
       CASE WHEN event_id % 13 = 2 THEN 0 ELSE src_port END AS src_port, dst_port, asn,
       CASE WHEN event_id % 6 = 1 THEN 'UNKNOWN' ELSE geo_country END AS geo_country FROM network"""),
    "record_ids": _with("""
SELECT txid, printf('tx-rec-%06d', row_number() OVER (ORDER BY timestamp_epoch, txid) - 1) AS record_id FROM transactions"""),
    "entity_types": _with("""
SELECT id, CASE WHEN id LIKE 'wallet:%' OR id LIKE 'bc1%' OR (len(id) >= 25 AND (id LIKE '1%' OR id LIKE '3%')) THEN 'wallet'
  WHEN id LIKE 'transaction:%' OR id LIKE 'tx\\_%' ESCAPE '\\' OR (len(id) = 64 AND regexp_full_match(id, '[0-9a-fA-F]{64}')) THEN 'transaction'
  WHEN id LIKE 'ip:%' OR (contains(id, '.') AND regexp_matches(id, '[0-9]')) THEN 'ip'
  WHEN id LIKE 'asn:%' OR id LIKE 'AS%' THEN 'asn' WHEN id LIKE 'country:%' THEN 'country' ELSE 'wallet' END AS entity_type
FROM (SELECT txid AS id FROM transactions UNION SELECT 'transaction:' || txid FROM transactions UNION SELECT sha256(txid) FROM transactions
      UNION SELECT address FROM outputs UNION SELECT 'wallet:' || address FROM outputs UNION SELECT 'bc1' || address FROM outputs
      UNION SELECT src_ip FROM network UNION SELECT 'ip:' || src_ip FROM network UNION SELECT asn FROM network
      UNION SELECT 'asn:' || asn FROM network UNION SELECT 'country:' || geo_country FROM network)"""),
}

# --- entity graph

GRAPH = """
known AS (SELECT * FROM network WHERE txid IN (SELECT txid FROM transactions)),
ent_edges AS MATERIALIZED (
  SELECT src, dst, type, any_value(basis) AS basis, count(*)::DOUBLE AS weight, sum(amount) AS amount,
         min(us) AS first_us, max(us) AS last_us, count(record_id) AS records FROM (
    SELECT 'wallet:' || address AS src, 'transaction:' || txid AS dst, 'SPENT_FROM' AS type, 'tx_input' AS basis, amount, us, record_id
      FROM part WHERE sent = 1
    UNION ALL SELECT 'transaction:' || txid, 'wallet:' || address, 'SENT_TO', 'tx_output', amount, us, record_id FROM part WHERE sent = 0
    UNION ALL SELECT 'ip:' || src_ip, 'transaction:' || txid, 'RELAYED_BY', 'exact_txid', NULL, us, record_id FROM known
    UNION ALL SELECT 'ip:' || src_ip, 'asn:' || asn, 'HOSTED_IN', 'asn_lookup', NULL, NULL, NULL FROM network
    UNION ALL SELECT 'ip:' || src_ip, 'country:' || geo_country, 'LOCATED_IN', 'geoip', NULL, NULL, NULL FROM network)
  GROUP BY src, dst, type),
ent_nodes AS MATERIALIZED (
  SELECT DISTINCT 'wallet:' || address AS id, 'wallet' AS type, address AS label FROM part
  UNION ALL SELECT 'transaction:' || txid, 'transaction', CASE WHEN len(txid) > 12 THEN substr(txid, 1, 8) || '...' ELSE txid END FROM transactions
  UNION ALL SELECT DISTINCT 'ip:' || src_ip, 'ip', src_ip FROM network
  UNION ALL SELECT DISTINCT 'asn:' || asn, 'asn', asn FROM network
  UNION ALL SELECT DISTINCT 'country:' || geo_country, 'country', geo_country FROM network),
ent_deg AS MATERIALIZED (
  SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree
  FROM ent_nodes LEFT JOIN (SELECT dst AS id, count(*) AS i FROM ent_edges GROUP BY dst) USING (id)
  LEFT JOIN (SELECT src AS id, count(*) AS o FROM ent_edges GROUP BY src) USING (id)),
ent_und AS MATERIALIZED (SELECT src AS u, dst AS v FROM ent_edges UNION SELECT dst, src FROM ent_edges)
"""

ENT_WCC = """
cc(id, component) USING KEY (id) AS (
  SELECT id, id FROM ent_nodes
  UNION
  SELECT e.v, min(c.component) FROM cc c JOIN ent_und e ON e.u = c.id JOIN recurring.cc r ON r.id = e.v
  WHERE c.component < r.component GROUP BY e.v)
"""

SPENDS = """
spend_rows AS MATERIALIZED (
  SELECT i.prev_txid AS src, i.txid AS dst FROM inputs i JOIN outputs o ON o.txid = i.prev_txid AND o.output_index = i.prev_vout
  WHERE i.prev_txid <> i.txid),
spends AS MATERIALIZED (SELECT DISTINCT src, dst FROM spend_rows),
sp_und AS MATERIALIZED (SELECT src AS u, dst AS v FROM spends UNION SELECT dst, src FROM spends),
sp_in AS (SELECT dst AS txid, count(*) AS i FROM spends GROUP BY dst),
sp_out AS (SELECT src AS txid, count(*) AS o FROM spends GROUP BY src),
sp_deg AS MATERIALIZED (SELECT txid AS id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree
  FROM transactions LEFT JOIN sp_in USING (txid) LEFT JOIN sp_out USING (txid))
"""

# A node and an edge split their component if no edge beside a search tree leads around them.
WEAK = """
tree(id, parent, lvl) USING KEY (id) AS (
  SELECT id, NULL::VARCHAR, 0 FROM cc WHERE id = component
  UNION
  SELECT e.v, min(e.u), min(t.lvl) + 1 FROM tree t JOIN ent_und e ON e.u = t.id LEFT JOIN recurring.tree r ON r.id = e.v
  WHERE r.id IS NULL GROUP BY e.v),
above(node, c, p, lvl) AS (
  SELECT id, id, parent, lvl FROM tree WHERE parent IS NOT NULL
  UNION ALL
  SELECT a.node, t.id, t.parent, t.lvl FROM above a JOIN tree t ON t.id = a.p WHERE t.parent IS NOT NULL),
beside AS MATERIALIZED (
  SELECT u, v FROM ent_und e WHERE u < v AND NOT EXISTS (
    SELECT 1 FROM tree t WHERE t.id = e.u AND t.parent = e.v OR t.id = e.v AND t.parent = e.u)),
around AS MATERIALIZED (
  SELECT *, min(lvl) OVER (PARTITION BY u, v) AS top FROM (
    SELECT u, v, c, any_value(p) AS p, any_value(lvl) AS lvl FROM (
      SELECT u, v, c, p, lvl FROM beside JOIN above ON node = u UNION ALL SELECT u, v, c, p, lvl FROM beside JOIN above ON node = v)
    GROUP BY u, v, c HAVING count(*) = 1)),
linked AS MATERIALIZED (
  SELECT DISTINCT a.c AS a, b.c AS b FROM around a JOIN around b USING (u, v) WHERE a.lvl = a.top AND b.lvl = b.top AND a.c <> b.c),
safe(c) AS (
  SELECT c FROM around WHERE lvl > top
  UNION SELECT min(t.id) FROM tree t JOIN tree r ON r.id = t.parent WHERE r.parent IS NULL GROUP BY r.id
  UNION SELECT l.b FROM safe s JOIN linked l ON l.a = s.c)
"""

SPEND_WCC = """
cc(id, component) USING KEY (id) AS (
  SELECT txid, txid FROM transactions
  UNION
  SELECT e.v, min(c.component) FROM cc c JOIN sp_und e ON e.u = c.id JOIN recurring.cc r ON r.id = e.v
  WHERE c.component < r.component GROUP BY e.v)
"""

CYCLES = """
ent_cycles AS MATERIALIZED (
  SELECT id, count(*) AS short_cycle_count FROM (
    SELECT unnest(['wallet:' || address, 'transaction:' || txid]) AS id FROM (
      SELECT DISTINCT address, txid FROM part WHERE sent = 1 INTERSECT SELECT DISTINCT address, txid FROM part WHERE sent = 0)
    UNION ALL
    SELECT unnest(['wallet:' || a.ia, 'wallet:' || a.oa, 'transaction:' || a.txid, 'transaction:' || b.txid])
    FROM pairs a JOIN pairs b ON a.oa = b.ia AND a.ia = b.oa AND a.txid <> b.txid WHERE a.ia < a.oa) GROUP BY id)
"""


def _rank_rounds(nodes: str, edges: str, rounds: int, alpha: float = 0.85) -> str:
    """A fixed number of PageRank rounds as a chain of tables; ``edges`` is (src, dst, weight)."""
    out = [
        f"pr_w AS MATERIALIZED (SELECT src, sum(weight) AS total FROM {edges} GROUP BY src)",
        f"pr_n AS MATERIALIZED (SELECT id, count(*) OVER () AS n, id NOT IN (SELECT src FROM pr_w) AS idle FROM {nodes})",
        "pr_0 AS MATERIALIZED (SELECT id, n, idle, 1.0::DOUBLE / n AS r FROM pr_n)",
    ]
    for i in range(1, rounds + 1):
        out.append(f"""pr_{i} AS MATERIALIZED (
  SELECT p.id, p.n, p.idle, {alpha} * (coalesce(g.got, 0) + (SELECT coalesce(sum(r) FILTER (WHERE idle), 0) FROM pr_{i - 1}) / p.n)
         + (1 - {alpha}) / p.n AS r
  FROM pr_{i - 1} p LEFT JOIN (SELECT e.dst AS id, sum(q.r * e.weight / w.total) AS got FROM {edges} e JOIN pr_w w USING (src)
       JOIN pr_{i - 1} q ON q.id = e.src GROUP BY e.dst) g USING (id))""")
    return ",\n".join(out)


def _label_rounds(nodes: str, und: str, rounds: int) -> str:
    out = [f"lp_0 AS MATERIALIZED (SELECT id, id AS label FROM {nodes})"]
    for i in range(1, rounds + 1):
        out.append(f"""lp_{i} AS MATERIALIZED (
  SELECT id, arg_min(label, (-c, label)) AS label FROM (
    SELECT id, label, count(*) AS c FROM (SELECT e.u AS id, l.label FROM {und} e JOIN lp_{i - 1} l ON l.id = e.v
      UNION ALL SELECT id, label FROM lp_{i - 1}) GROUP BY id, label) GROUP BY id)""")
    out.append(f"""lp AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY label) AS community FROM lp_{rounds}),
lp_size AS (SELECT community, count(*) AS community_size FROM lp GROUP BY community)""")
    return ",\n".join(out)


def _core_rounds(und: str, rounds: int) -> str:
    """Repeated h-index of neighbours' values; more rounds than the graph needs change nothing."""
    out = [f"kc_0 AS MATERIALIZED (SELECT u AS id, count(*) AS core FROM {und} GROUP BY u)"]
    for i in range(1, rounds + 1):
        out.append(f"""kc_{i} AS MATERIALIZED (
  SELECT id, max(least(core, rn)) AS core FROM (
    SELECT e.u AS id, k.core, row_number() OVER (PARTITION BY e.u ORDER BY k.core DESC) AS rn
    FROM {und} e JOIN kc_{i - 1} k ON k.id = e.v) GROUP BY id)""")
    return ",\n".join(out)


TRIANGLES = """
und AS MATERIALIZED (SELECT DISTINCT least(ia, oa) AS u, greatest(ia, oa) AS v FROM pairs),
tri AS (
  SELECT id, count(*) AS triangle_count FROM (
    SELECT unnest([a.u, a.v, b.v]) AS id FROM und a JOIN und b ON a.v = b.u JOIN und c ON c.u = a.u AND c.v = b.v) GROUP BY id)
"""

TWO_HOPS = """
sp_two AS MATERIALIZED (SELECT DISTINCT a.src AS s, b.dst AS t FROM spends a JOIN spends b ON a.dst = b.src WHERE a.src <> b.dst)
"""

STEPS = """
steps AS MATERIALIZED (
  SELECT txid, timestamp_epoch, (timestamp_epoch - (SELECT min(timestamp_epoch) FROM transactions)) // 3600 + 1 AS time_step FROM transactions)
"""


def _reach(und: str, seed: str, hops: int) -> str:
    return f"""ego(id, hop) AS (
  SELECT '{seed}', 0 UNION SELECT e.v, g.hop + 1 FROM ego g JOIN {und} e ON e.u = g.id WHERE g.hop < {hops}),
near AS MATERIALIZED (SELECT id, min(hop) AS hop FROM ego GROUP BY id)"""


ORACLES |= {
    "entity_nodes": _with("SELECT * FROM ent_nodes", PART, GRAPH),
    "ip_attributes": _with("""
SELECT 'ip:' || src_ip AS id, arg_max(asn, (us, record_id)) AS asn, arg_max(geo_country, (us, record_id)) AS country FROM network GROUP BY src_ip"""),
    "entity_edges": _with("SELECT src, dst, type, basis, weight, " + r8("amount") + " AS amount, first_us, last_us, records FROM ent_edges", PART, GRAPH),
    "edge_sources": _with("""
SELECT src, dst, type, count(DISTINCT record_id) AS records, min(record_id) AS first_record FROM (
    SELECT 'wallet:' || address AS src, 'transaction:' || txid AS dst, 'SPENT_FROM' AS type, record_id FROM part WHERE sent = 1
    UNION ALL SELECT 'transaction:' || txid, 'wallet:' || address, 'SENT_TO', record_id FROM part WHERE sent = 0
    UNION ALL SELECT 'ip:' || src_ip, 'transaction:' || txid, 'RELAYED_BY', record_id FROM known) GROUP BY src, dst, type""", PART, GRAPH),
    "graph_summary": _with("""
SELECT 'nodes:' || type AS metric, count(*)::DOUBLE AS value FROM ent_nodes GROUP BY type
UNION ALL SELECT 'edges:' || type, count(*)::DOUBLE FROM ent_edges GROUP BY type
UNION ALL SELECT 'total_nodes', count(*)::DOUBLE FROM ent_nodes UNION ALL SELECT 'total_edges', count(*)::DOUBLE FROM ent_edges
UNION ALL SELECT 'density', (SELECT count(*) FROM ent_edges)::DOUBLE / (count(*) * (count(*) - 1)) FROM ent_nodes
UNION ALL SELECT 'connected_components', count(DISTINCT component)::DOUBLE FROM cc""", PART, GRAPH, ENT_WCC, recursive=True),
    "entity_degrees": _with("""
SELECT id, in_degree, out_degree, degree, degree::DOUBLE / ((SELECT count(*) FROM ent_nodes) - 1) AS degree_centrality,
       CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'source' WHEN out_degree = 0 AND in_degree > 0 THEN 'sink' ELSE 'intermediate' END AS role
FROM ent_deg""", PART, GRAPH),
    "graph_hubs": _with("SELECT id, degree, type FROM ent_deg JOIN ent_nodes USING (id) ORDER BY degree DESC, id LIMIT 10", PART, GRAPH),
    "entity_components": _with("SELECT id, component, count(*) OVER (PARTITION BY component) AS component_size FROM cc", PART, GRAPH, ENT_WCC, recursive=True),
    "weak_points": _with("""
SELECT 'edge' AS kind, least(id, parent) AS source, greatest(id, parent) AS target FROM tree
WHERE parent IS NOT NULL AND id NOT IN (SELECT c FROM around)
UNION ALL SELECT DISTINCT 'node', parent, '' FROM tree WHERE parent IS NOT NULL AND id NOT IN (SELECT c FROM safe)""", PART, GRAPH, ENT_WCC, WEAK, recursive=True),
    "spend_components": _with("SELECT id, component, count(*) OVER (PARTITION BY component) AS component_size FROM cc", SPENDS, SPEND_WCC, recursive=True),
    "short_cycles": _with("SELECT * FROM ent_cycles", PART, PAIRS, CYCLES),
    "wallet_cycles_3": _with("""
SELECT address, count(*) AS cycles FROM (
  SELECT unnest([a.ia, b.ia, c.ia]) AS address FROM p2 a JOIN p2 b ON a.oa = b.ia JOIN p2 c ON b.oa = c.ia AND c.oa = a.ia
  WHERE a.ia < b.ia AND a.ia < c.ia) GROUP BY address""", PART, PAIRS, "p2 AS MATERIALIZED (SELECT DISTINCT ia, oa FROM pairs)"),
    "wallet_cycles_4": _with("""
SELECT u AS address, sum(n)::BIGINT AS cycles FROM (
  SELECT f.u, f.n * b.n - coalesce(s.n, 0) AS n FROM ways f JOIN ways b ON b.u = f.w AND b.w = f.u
  LEFT JOIN (SELECT f.u, f.w, count(*) AS n FROM way f JOIN way b ON b.u = f.w AND b.w = f.u AND b.v = f.v GROUP BY f.u, f.w) s ON s.u = f.u AND s.w = f.w)
WHERE n > 0 GROUP BY u""", PART, PAIRS, "p2 AS MATERIALIZED (SELECT DISTINCT ia, oa FROM pairs WHERE ia <> oa)",
        "way AS MATERIALIZED (SELECT a.ia AS u, a.oa AS v, b.oa AS w FROM p2 a JOIN p2 b ON a.oa = b.ia WHERE a.ia <> b.oa)",
        "ways AS MATERIALIZED (SELECT u, w, count(*) AS n FROM way GROUP BY u, w)"),
    "spend_edges": _with("SELECT src AS source_txid, dst AS target_txid FROM spend_rows", SPENDS),
    "spend_degrees": _with("SELECT * FROM sp_deg", SPENDS),
    "wallet_triangles": _with("SELECT * FROM tri", PART, PAIRS, TRIANGLES),
    "spend_two_hops": _with("""
SELECT coalesce(f.id, b.id) AS id, coalesce(f.n, 0) AS forward_2hop_count, coalesce(b.n, 0) AS backward_2hop_count
FROM (SELECT s AS id, count(*) AS n FROM sp_two GROUP BY s) f FULL JOIN (SELECT t AS id, count(*) AS n FROM sp_two GROUP BY t) b ON f.id = b.id""",
        SPENDS, TWO_HOPS),
    "spend_cores": _with("SELECT txid AS id, coalesce(core, 0) AS core FROM transactions LEFT JOIN kc_25 ON id = txid", SPENDS, _core_rounds("sp_und", 25)),
    "entity_pagerank": _with("SELECT id, " + half_even("r", 10) + " AS pagerank FROM pr_8", PART, GRAPH, _rank_rounds("ent_nodes", "ent_edges", 8)),
    "entity_communities": _with("""
SELECT id, community, community_size, CASE WHEN community_size > 1 THEN coalesce(m, 0)::DOUBLE / (community_size * (community_size - 1)) ELSE 0 END AS community_density
FROM lp JOIN lp_size USING (community) LEFT JOIN (SELECT a.community, count(*) AS m FROM ent_edges e JOIN lp a ON a.id = e.src JOIN lp b ON b.id = e.dst
     WHERE a.community = b.community GROUP BY a.community) USING (community)""", PART, GRAPH, _label_rounds("ent_nodes", "ent_und", 5)),
    "sorted_table": _with("""
SELECT 'rows' AS item, count(*) AS value FROM transactions UNION ALL SELECT 'out_of_order', 0 UNION ALL SELECT 'overlapping_files', 0
UNION ALL SELECT 'unlisted_rows', 0 UNION ALL SELECT 'skips_files', 1
UNION ALL SELECT 'rows_in_range', count(*) FROM transactions WHERE us BETWEEN (SELECT min(us) + 86400000000 FROM transactions) AND (SELECT min(us) + 172800000000 FROM transactions)"""),
    "community_quality": _with("""
SELECT community, community_size, coalesce(i, 0)::DOUBLE AS internal_weight, coalesce(vol, 0)::DOUBLE AS volume,
       """ + half_even("CASE WHEN least(coalesce(vol, 0), whole - coalesce(vol, 0)) > 0 THEN (vol - 2 * i)::DOUBLE / least(vol, whole - vol) ELSE 0 END", 9) + """ AS conductance,
       """ + half_even("2 * coalesce(i, 0)::DOUBLE / whole - (coalesce(vol, 0)::DOUBLE / whole) * (coalesce(vol, 0)::DOUBLE / whole)", 9) + """ AS modularity
FROM lp_size LEFT JOIN (
  SELECT community, count(*) AS vol, sum(twin)::BIGINT // 2 AS i FROM (
    SELECT a.community, (a.community = b.community)::INT AS twin FROM ent_edges e JOIN lp a ON a.id = e.src JOIN lp b ON b.id = e.dst
    UNION ALL SELECT b.community, (a.community = b.community)::INT FROM ent_edges e JOIN lp a ON a.id = e.src JOIN lp b ON b.id = e.dst)
  GROUP BY community) USING (community), (SELECT 2 * count(*) AS whole FROM ent_edges)""", PART, GRAPH, _label_rounds("ent_nodes", "ent_und", 5)),
    "address_tx_edges": _with("""
SELECT DISTINCT 'addr_tx' AS edge, address, txid FROM inputs
UNION ALL SELECT DISTINCT 'tx_addr', address, txid FROM outputs WHERE txid IN (SELECT txid FROM inputs)"""),
    "originator_edges": _with("""
SELECT 'ip:' || src_ip AS originator_id, txid, us // 1000000 AS timestamp_epoch FROM network WHERE txid IN (SELECT txid FROM transactions)"""),
    "snapshot_edges": _with("SELECT time_step, src AS source_txid, dst AS target_txid FROM spend_rows JOIN steps ON txid = dst", SPENDS, STEPS),
    "ego_network": _with("SELECT id, hop, type FROM near JOIN ent_nodes USING (id)", PART, GRAPH, _reach("ent_und", "wallet:W1", 3), recursive=True),
    "ego_edges": _with("""
SELECT src, dst, type FROM ent_edges WHERE src IN (SELECT id FROM near WHERE hop < 2) OR dst IN (SELECT id FROM near WHERE hop < 2)""",
        PART, GRAPH, _reach("ent_und", "wallet:W1", 2), recursive=True),
    "spend_neighbourhood": _with("SELECT id, hop FROM near", SPENDS, _reach("sp_und", "tx_77", 5), recursive=True),
    "cospend_clusters": _with("""
SELECT substr(id, 3) AS address, component, count(*) OVER (PARTITION BY component) AS cluster_size FROM cc WHERE id LIKE 'a:%'""",
        "links AS MATERIALIZED (SELECT DISTINCT 'a:' || address AS u, 't:' || txid AS v FROM inputs UNION SELECT DISTINCT 't:' || txid, 'a:' || address FROM inputs)",
        """cc(id, component) USING KEY (id) AS (SELECT DISTINCT u, u FROM links UNION
  SELECT e.v, min(c.component) FROM cc c JOIN links e ON e.u = c.id JOIN recurring.cc r ON r.id = e.v WHERE c.component < r.component GROUP BY e.v)""",
        recursive=True),
    "neighbour_means": _with("""
SELECT txid AS id, coalesce(avg(x.in_degree), 0) AS in_degree, coalesce(avg(x.size), 0) AS size
FROM transactions t LEFT JOIN sp_und e ON e.v = t.txid LEFT JOIN (SELECT id, in_degree::DOUBLE AS in_degree, size::DOUBLE AS size FROM sp_deg JOIN transactions ON txid = id) x ON x.id = e.u
GROUP BY txid""", SPENDS),
    "normalised_sums": _with("""
SELECT e.src AS id, """ + half_even("sum(fee / sqrt(a.d * b.d))", 8) + """ AS fee FROM spends e JOIN (SELECT src, count(*) AS d FROM spends GROUP BY src) a USING (src)
JOIN (SELECT src AS dst, count(*) AS d FROM spends GROUP BY src) b USING (dst) JOIN transactions t ON t.txid = e.dst GROUP BY e.src""", SPENDS),
    "visible_graph": _with("""
SELECT src, dst, type FROM ent_edges WHERE type NOT IN ('OBSERVED', 'RELAYED_BY') AND src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)""",
        PART, GRAPH, "shown AS MATERIALIZED (SELECT id FROM ent_nodes WHERE type <> 'ip' ORDER BY id LIMIT 16000)"),
    "find_nodes": _with("SELECT id, type FROM ent_nodes WHERE contains(lower(id), 'w17') OR contains(lower(label), 'w17')", PART, GRAPH),
    "node_links": _with("""
SELECT 'out' AS direction, dst AS other, e.type, weight, n.type AS other_type, label FROM ent_edges e JOIN ent_nodes n ON n.id = dst WHERE src = 'wallet:W1'
UNION ALL SELECT 'in', src, e.type, weight, n.type, label FROM ent_edges e JOIN ent_nodes n ON n.id = src WHERE dst = 'wallet:W1'""", PART, GRAPH),
}

# --- rules, signals and fusion

RULES = f"""
peels AS MATERIALIZED (
  SELECT txid, address, small, large FROM (SELECT txid, min(address) AS address FROM inputs GROUP BY txid HAVING count(*) = 1)
  JOIN (SELECT txid, min(amount) AS small, max(amount) AS large FROM outputs GROUP BY txid HAVING count(*) = 2) USING (txid)
  WHERE large > 1.0 AND small / large < 0.15),
wr AS MATERIALIZED (
  SELECT wf.*, coalesce(short_cycle_count, 0) AS cyc, wallet_address IN (SELECT address FROM peels) AS peeler
  FROM wf LEFT JOIN ent_cycles ON id = entity_id),
hits AS MATERIALIZED (
  SELECT entity_id, 'RULE_BURST_ACTIVITY' AS rule_id, 'R01' AS code, 'medium' AS severity,
         least(1.0, {half_even("transaction_rate / 0.2", 2)}) AS confidence, {half_even("transaction_rate", 3)} AS observed_value,
         0.1::DOUBLE AS threshold, 'tx/sec' AS unit FROM wr WHERE transaction_count >= 10 AND transaction_rate >= 0.1
  UNION ALL SELECT entity_id, 'RULE_HIGH_FAN_OUT', 'R02', CASE WHEN fan_out >= 20 THEN 'high' ELSE 'medium' END,
         least(1.0, {half_even("fan_out / 20.0", 2)}), fan_out, 10, 'outputs' FROM wr WHERE fan_out >= 10
  UNION ALL SELECT entity_id, 'RULE_HIGH_FAN_IN', 'R03', CASE WHEN fan_in >= 20 THEN 'high' ELSE 'medium' END,
         least(1.0, {half_even("fan_in / 20.0", 2)}), fan_in, 10, 'inputs' FROM wr WHERE fan_in >= 10
  UNION ALL SELECT entity_id, 'RULE_RAPID_DISPERSAL', 'R04', 'high', least(1.0, {half_even("1.0 - median_time_gap / 30.0", 2)}),
         {half_even("median_time_gap", 2)}, 30, 'seconds' FROM wr WHERE transaction_count >= 5 AND median_time_gap > 0 AND median_time_gap <= 30
  UNION ALL SELECT entity_id, 'RULE_REPEATED_VALUE', 'R05', 'medium', least(1.0, {half_even("max_repeated_value_count / 10.0", 2)}),
         max_repeated_value_count, 5, 'occurrences' FROM wr WHERE max_repeated_value_count >= 5
  UNION ALL SELECT entity_id, 'RULE_SHORT_CYCLE', 'R06', 'high', 0.85, cyc, 1, 'cycles' FROM wr WHERE cyc > 0
  UNION ALL SELECT entity_id, 'RULE_DUST_ATTACK', 'R07', 'medium', least(1.0, {half_even("dust_incoming_count / 10.0", 2)}),
         dust_incoming_count, 5, 'dust_inputs' FROM wr WHERE dust_incoming_count >= 5
  UNION ALL SELECT entity_id, 'RULE_PEELING_CHAIN', 'R08', 'high', 0.9, 1, 1, 'chain' FROM wr
         WHERE peeler OR (transaction_count >= 3 AND fan_out >= 3 AND average_transaction_value > 0
                          AND median_transaction_value / average_transaction_value < 0.25)),
behave AS MATERIALIZED (
  SELECT entity_id, least(1.0, sum(CASE severity WHEN 'high' THEN 25 WHEN 'medium' THEN 15 ELSE 5 END)::BIGINT / 100.0)::DOUBLE AS behavior_score,
         count(*) AS rule_count FROM hits GROUP BY entity_id)
"""

TX_RULES = f"""
tx_hits AS MATERIALIZED (
  SELECT 'transaction:' || txid AS entity_id, record_id, 'RULE_FEE_ANOMALY' AS rule_id, 'R09' AS code,
         CASE WHEN fee_ratio > 0.5 THEN 'high' ELSE 'medium' END AS severity,
         least(1.0, CASE WHEN fee = 0 THEN 0.85 ELSE {half_even("fee_ratio / 0.2", 2)} END)::DOUBLE AS confidence,
         {half_even("fee_ratio", 4)} AS observed_value, 0.2::DOUBLE AS threshold, 'ratio' AS unit
  FROM txf WHERE total_input > 0 AND (fee_ratio >= 0.2 OR (fee = 0 AND total_input > 0.1)))
"""


def _pct(col: str, n: str) -> str:
    return (f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0 - 1.0)::DOUBLE / ({n} - 1.0)::DOUBLE")


NET_SIGNALS = f"""
ns0 AS (SELECT entity_id, connected_ip_count, transaction_count, {_pct("connected_ip_count", "count(*) OVER ()")} AS ip_p,
        {_pct("unique_country_count", "count(*) OVER ()")} AS country_p, {_pct("unique_asn_count", "count(*) OVER ()")} AS asn_p FROM wf),
ns AS MATERIALIZED (
  SELECT entity_id, {half_even("ip_p", 4)} AS unique_ip_percentile, {half_even("country_p", 4)} AS unique_country_percentile,
         {half_even("least(1.0, connected_ip_count / 3.0::DOUBLE)", 4)} AS relay_burst_signal,
         {half_even("0.35::DOUBLE * ip_p + 0.25::DOUBLE * country_p + 0.2::DOUBLE * asn_p + 0.2::DOUBLE * least(1.0::DOUBLE, connected_ip_count / 3.0::DOUBLE)", 4)} AS network_score,
         {half_even("least(1.0, connected_ip_count::DOUBLE / greatest(transaction_count, 1))", 4)} AS correlation_strength FROM ns0)
"""

GRAPH_SIGNALS = f"""
gs0 AS MATERIALIZED (
  SELECT wf.entity_id, wf.fan_out, d.degree, s.community_size, coalesce(c.short_cycle_count, 0) AS cyc,
         CASE WHEN s.community_size > 1 THEN coalesce(m, 0)::DOUBLE / (s.community_size * (s.community_size - 1)) ELSE 0 END AS density
  FROM wf JOIN ent_deg d ON d.id = wf.entity_id JOIN lp ON lp.id = wf.entity_id JOIN lp_size s USING (community)
  LEFT JOIN (SELECT a.community, count(*) AS m FROM ent_edges e JOIN lp a ON a.id = e.src JOIN lp b ON b.id = e.dst
             WHERE a.community = b.community GROUP BY a.community) i USING (community)
  LEFT JOIN ent_cycles c ON c.id = wf.entity_id),
gs1 AS (SELECT *, {_pct("degree", "count(*) OVER ()")} AS dp, {_pct("fan_out", "count(*) OVER ()")} AS fp,
        {_pct("community_size", "count(*) OVER ()")} AS sp, {_pct("density", "count(*) OVER ()")} AS np FROM gs0),
gs AS MATERIALIZED (
  SELECT entity_id, {half_even("dp", 4)} AS degree_percentile, {half_even("fp", 4)} AS fanout_percentile,
         {half_even("sp", 4)} AS community_size_percentile, {half_even("np", 4)} AS community_density_percentile,
         CASE WHEN cyc > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS cycle_signal,
         {half_even("0.2::DOUBLE * dp + 0.2::DOUBLE * fp + 0.2::DOUBLE * sp + 0.2::DOUBLE * np + 0.1::DOUBLE * (CASE WHEN cyc > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.1::DOUBLE * 0.5::DOUBLE", 4)} AS graph_score
  FROM gs1)
"""


def _tier(expr: str, cuts: tuple[float, float, float] = (85, 65, 40)) -> str:
    a, b, c = cuts
    return f"CASE WHEN {expr} >= {a} THEN 'CRITICAL' WHEN {expr} >= {b} THEN 'HIGH' WHEN {expr} >= {c} THEN 'MEDIUM' ELSE 'LOW' END"


WALLET_BLOCKS = (PART, PAIRS, WALLET_FEATURES)
RULE_BLOCKS = (*WALLET_BLOCKS, CYCLES, RULES)
CUSTOM = """
rules_table AS (SELECT * FROM (VALUES ('c1', 'Wide sender', 'wallet', 'fan_out', '>=', 12.0::DOUBLE, 'high', 1.0::DOUBLE),
  ('c2', 'Few partners', 'wallet', 'unique_counterparties', '<', 30.0::DOUBLE, 'medium', 0.5::DOUBLE),
  ('c3', 'Busy receiver', 'wallet', 'incoming_transaction_count', '>', 25.0::DOUBLE, 'critical', 2.0::DOUBLE),
  ('c4', 'No network', 'wallet', 'connected_ip_count', '==', 0.0::DOUBLE, 'low', 1.0::DOUBLE))
  AS t(rule_id, name, target, field, operator, threshold, severity, weight)),
c_hits AS MATERIALIZED (
  SELECT entity_id, rule_id, name AS rule_name, severity, weight, v AS observed_value, threshold, operator, field FROM (
    SELECT entity_id, r.*, CASE field WHEN 'fan_out' THEN fan_out WHEN 'unique_counterparties' THEN unique_counterparties
       WHEN 'incoming_transaction_count' THEN incoming_transaction_count ELSE connected_ip_count END::DOUBLE AS v FROM wf, rules_table r)
  WHERE CASE operator WHEN '>=' THEN v >= threshold WHEN '<' THEN v < threshold WHEN '>' THEN v > threshold ELSE v = threshold END)
"""

ALERTS = f"""
alerts AS MATERIALIZED (
  SELECT entity_id, 'wallet' AS entity_type, coalesce(behavior_score, 0) AS behavior_score, network_score, coalesce(rule_count, 0) AS rule_count,
         {half_even("(0.3::DOUBLE * coalesce(behavior_score, 0) + 0.1::DOUBLE * network_score) * 100.0::DOUBLE", 2)} AS priority_score
  FROM wf JOIN ns USING (entity_id) LEFT JOIN behave USING (entity_id)
  UNION ALL SELECT entity_id, 'transaction', confidence, 0.5, 1, {half_even("confidence * 80.0::DOUBLE", 2)} FROM tx_hits)
"""
ALERT_BLOCKS = (*RULE_BLOCKS, NET_SIGNALS, TX_FEATURES, TX_RULES, ALERTS)

ORACLES |= {
    "wallet_rules": _with("SELECT * FROM hits", *RULE_BLOCKS),
    "behaviour_scores": _with("SELECT * FROM behave", *RULE_BLOCKS),
    "transaction_rules": _with("SELECT * FROM tx_hits", TX_FEATURES, TX_RULES),
    "peel_transactions": _with("SELECT txid, address, " + half_even("small", 8) + " AS small, " + half_even("large", 8) + " AS large FROM peels",
        "peels AS (SELECT * FROM (SELECT txid, min(address) AS address FROM inputs GROUP BY txid HAVING count(*) = 1) JOIN "
        "(SELECT txid, min(amount) AS small, max(amount) AS large FROM outputs GROUP BY txid HAVING count(*) = 2) USING (txid) "
        "WHERE large > 1.0 AND small / large < 0.15)"),
    "port_anomalies": _with("""
SELECT CASE WHEN dst_port = 9050 THEN 'RULE_TOR_VPN_PORT' ELSE 'RULE_PORT_ANOMALY' END AS rule_id, record_id, src_ip, dst_port AS port, txid,
       CASE WHEN dst_port = 9050 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN dst_port = 9050 THEN src_ip || ' uses port 9050, known for anonymising relays'
            ELSE src_ip || ' talks to port ' || dst_port || ', which no ledger node uses by default' END AS description
FROM network WHERE dst_port IN (9050, 9999)"""),
    "custom_rule_hits": _with("SELECT * FROM c_hits", *WALLET_BLOCKS, CUSTOM),
    "custom_rule_scores": _with("""
SELECT entity_id, """ + half_even("least(100.0, sum(CASE severity WHEN 'critical' THEN 35.0 WHEN 'high' THEN 25.0 WHEN 'medium' THEN 15.0 ELSE 5.0 END * weight))::DOUBLE", 2)
        + " AS rule_score, count(*) AS custom_rule_count FROM c_hits GROUP BY entity_id", *WALLET_BLOCKS, CUSTOM),
    "custom_transaction_rules": _with("""
SELECT 'transaction:' || txid AS entity_id, 't1' AS rule_id, """ + half_even("fee_ratio", 4) + """ AS observed_value FROM txf WHERE fee_ratio > 0.15
UNION ALL SELECT 'transaction:' || txid, 't2', output_count::DOUBLE FROM txf WHERE output_count != 4""", TX_FEATURES),
    "network_signals": _with("SELECT * FROM ns", *WALLET_BLOCKS, NET_SIGNALS),
    "graph_signals": _with("SELECT *, 0.5::DOUBLE AS betweenness_percentile FROM gs", *WALLET_BLOCKS, GRAPH, _label_rounds("ent_nodes", "ent_und", 5), CYCLES, GRAPH_SIGNALS),
    "riskiest_wallets": _with("SELECT *, " + _tier("priority_score") + " AS severity FROM alerts WHERE entity_type = 'wallet' ORDER BY priority_score DESC, entity_id LIMIT 100", *ALERT_BLOCKS),
    "streams_alerts": _with("SELECT *, " + _tier("priority_score") + " AS severity FROM alerts", *ALERT_BLOCKS),
    "tier_counts": _with("""
SELECT tier AS severity, count(a.entity_id) AS alerts FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) AS t(tier)
LEFT JOIN (SELECT entity_id, """ + _tier("priority_score") + " AS s FROM alerts) a ON s = tier GROUP BY tier", *ALERT_BLOCKS),
    "lead_fusion": _with("""
SELECT entity_id, priority_score, """ + _tier("priority_score", (80, 60, 40)) + """ AS severity, CASE WHEN supervised_score >= 0.675 THEN 1 ELSE 0 END AS model_flag FROM (
  SELECT entity_id, supervised_score, """ + half_even(
        "CASE WHEN r > 0 THEN 0.85::DOUBLE * p + 0.15::DOUBLE * r ELSE p END", 2) + """ AS priority_score FROM (
    SELECT entity_id, supervised_score, rule_count * 10.0::DOUBLE AS r, 100.0::DOUBLE * CASE WHEN supervised_score IS NULL
      THEN 0.25::DOUBLE / 0.65::DOUBLE * fr + 0.2::DOUBLE / 0.65::DOUBLE * behavior_score + 0.08::DOUBLE / 0.65::DOUBLE * network_score
      ELSE 0.35::DOUBLE * supervised_score + 0.25::DOUBLE * fr + 0.2::DOUBLE * behavior_score + 0.08::DOUBLE * network_score END AS p
    FROM (SELECT *, CASE WHEN rule_count > 1 THEN (rule_count % 5) / 4.0::DOUBLE END AS supervised_score, (rule_count % 3) / 2.0::DOUBLE AS fr FROM alerts WHERE entity_type = 'wallet')))""",
        *ALERT_BLOCKS),
}

# --- model package

SIDES = """
t_in AS MATERIALIZED (SELECT txid, count(*) AS n, count(DISTINCT address) AS a, min(amount) AS lo, max(amount) AS hi, avg(amount) AS mean, median(amount) AS med,
  sum(amount) AS s FROM inputs GROUP BY txid),
t_out AS MATERIALIZED (SELECT txid, count(*) AS n, count(DISTINCT address) AS a, min(amount) AS lo, max(amount) AS hi, avg(amount) AS mean, median(amount) AS med,
  sum(amount) AS s FROM outputs GROUP BY txid),
e_in AS (SELECT txid, -sum(amount / s * log2(amount / s)) AS e FROM inputs JOIN t_in USING (txid) GROUP BY txid),
e_out AS (SELECT txid, -sum(amount / s * log2(amount / s)) AS e FROM outputs JOIN t_out USING (txid) GROUP BY txid)
"""

WALLET_MATRIX = """
v AS MATERIALIZED (SELECT DISTINCT address, txid, timestamp_epoch AS e FROM part JOIN transactions USING (txid)),
vg AS (SELECT address, e - lag(e) OVER (PARTITION BY address ORDER BY e) AS g FROM v),
vs AS (SELECT address, sum(g) AS gt, min(g) AS gl, max(g) AS gh, avg(g) AS gm, median(g) AS gd FROM vg WHERE g IS NOT NULL GROUP BY address),
vl AS (SELECT address, min(e) // 600 AS fb, max(e) // 600 AS lb, count(DISTINCT e) AS steps FROM v GROUP BY address),
wm AS (SELECT address, count(*) FILTER (WHERE sent = 1) AS ns, count(*) FILTER (WHERE sent = 0) AS nr, count(*) AS n,
  min(amount) AS lo, max(amount) AS hi, sum(amount) AS s, median(amount) AS med, coalesce(median(amount) FILTER (WHERE sent = 1), 0) AS smed,
  coalesce(median(amount) FILTER (WHERE sent = 0), 0) AS rmed, coalesce(sum(amount) FILTER (WHERE sent = 1), 0) AS ss FROM part GROUP BY address)
"""


def _d(expr: str, name: str, digits: int | None = None) -> str:
    return (half_even(f"({expr})", digits) if digits else f"({expr})") + f"::DOUBLE AS {name}"


ORACLES |= {
    "transaction_matrix": _with(
        "SELECT t.txid, time_step, " + ", ".join([
            _d("coalesce(d.in_degree, 0)", "in_txs_degree"), _d("coalesce(d.out_degree, 0)", "out_txs_degree"),
            _d("greatest(i.s, coalesce(o.s, 0) + t.fee)", '"total_BTC"', 10), _d("t.fee", "fees", 8), _d("t.size", "size"),
            _d("i.a", "num_input_addresses"), _d("coalesce(o.a, 0)", "num_output_addresses"),
            _d("i.lo", '"in_BTC_min"', 8), _d("i.hi", '"in_BTC_max"', 8), _d("i.med", '"in_BTC_median"', 10), _d("i.s", '"in_BTC_total"', 8),
            _d("coalesce(o.lo, 0)", '"out_BTC_min"', 8), _d("coalesce(o.hi, 0)", '"out_BTC_max"', 8), _d("coalesce(o.med, 0)", '"out_BTC_median"', 10),
            _d("coalesce(o.s, 0)", '"out_BTC_total"', 8), _d("coalesce(eo.e, 0)", '"Local_feature_2"', 5), _d("coalesce(ei.e, 0)", '"Local_feature_3"', 5),
            _d("i.n / greatest(1.0, coalesce(o.n, 0))", '"Local_feature_4"'),
            _d("coalesce(pm, 0)", '"Aggregate_feature_1"'), _d("coalesce(sm, 0)", '"Aggregate_feature_2"'),
            _d("coalesce(px, 0)", '"Aggregate_feature_3"'), _d("coalesce(sx, 0)", '"Aggregate_feature_4"'),
            _d("sin(7 * greatest(i.s, coalesce(o.s, 0) + t.fee) + coalesce(d.in_degree, 0))", '"Local_feature_7"', 5),
            _d("cos(9 * (coalesce(pm, 0) + coalesce(sm, 0) + 1.0))", '"Aggregate_feature_9"', 5),
            "184::BIGINT AS width",
        ]) + """ FROM transactions t JOIN steps USING (txid) LEFT JOIN t_in i USING (txid) LEFT JOIN t_out o USING (txid) LEFT JOIN e_in ei USING (txid)
LEFT JOIN e_out eo USING (txid) LEFT JOIN sp_deg d ON d.id = t.txid
LEFT JOIN (SELECT dst AS txid, avg(x.in_degree) AS pm, max(x.in_degree) AS px FROM spends JOIN sp_deg x ON x.id = src GROUP BY dst) p USING (txid)
LEFT JOIN (SELECT src AS txid, avg(x.out_degree) AS sm, max(x.out_degree) AS sx FROM spends JOIN sp_deg x ON x.id = dst GROUP BY src) q USING (txid)""",
        SPENDS, STEPS, SIDES),
    "wallet_matrix": _with(
        "SELECT address, 1 AS time_step, " + ", ".join([
            _d("ns", "num_txs_as_sender"), _d("nr", '"num_txs_as receiver"'), _d("fb", "first_block_appeared_in"), _d("lb", "last_block_appeared_in"),
            _d("greatest(1, lb - fb)", "lifetime_in_blocks"), _d("n", "total_txs"), _d("steps", "num_timesteps_appeared_in"),
            _d("s", "btc_transacted_total", 8), _d("lo", "btc_transacted_min", 8), _d("hi", "btc_transacted_max", 8), _d("med", "btc_transacted_median", 10),
            _d("ss", "btc_sent_total", 8), _d("smed", "btc_sent_median", 10), _d("rmed", "btc_received_median", 10), _d("0", "fees_total"),
            _d("coalesce(gt, 0) // 600", "blocks_btwn_txs_total"), _d("coalesce(gl, 0) // 600", "blocks_btwn_txs_min"), _d("coalesce(gh, 0) // 600", "blocks_btwn_txs_max"),
            _d("floor(coalesce(gm, 0) / 600)", "blocks_btwn_txs_mean"), _d("floor(coalesce(gd, 0) / 600)", "blocks_btwn_txs_median"),
            _d("n", "transacted_w_address_max"), _d("1", "transacted_w_address_mean"), "57::BIGINT AS width",
        ]) + " FROM wm JOIN vl USING (address) LEFT JOIN vs USING (address)", PART, WALLET_MATRIX),
    "wallet_matrix_documented": _with(
        "SELECT address, " + ", ".join([
            _d("coalesce(ft, 0)", "fees_total", 11), _d("coalesce(fx, 0)", "fees_max", 11), _d("coalesce(fd, 0)", "fees_median", 12),
            _d("coalesce(ig, 0) // 600", "blocks_btwn_input_txs_total"), _d("coalesce(og, 0) // 600", "blocks_btwn_output_txs_max"),
            _d("coalesce(multi, 0)", "num_addr_transacted_multiple"), _d("coalesce(total, 0)", "transacted_w_address_total"),
            _d("coalesce(tx, 0)", "transacted_w_address_max"), _d("coalesce(td, 0)", "transacted_w_address_median"),
        ]) + """ FROM (SELECT DISTINCT address FROM part)
LEFT JOIN (SELECT address, sum(fee) AS ft, max(fee) AS fx, median(fee) AS fd FROM (SELECT DISTINCT address, txid FROM part WHERE sent = 1) JOIN transactions USING (txid) GROUP BY address) USING (address)
LEFT JOIN (SELECT address, max(timestamp_epoch) - min(timestamp_epoch) AS ig FROM part JOIN transactions USING (txid) WHERE sent = 1 GROUP BY address) USING (address)
LEFT JOIN (SELECT address, max(g) AS og FROM (SELECT address, e - lag(e) OVER (PARTITION BY address ORDER BY e) AS g FROM
   (SELECT DISTINCT address, txid, timestamp_epoch AS e FROM part JOIN transactions USING (txid) WHERE sent = 0)) GROUP BY address) USING (address)
LEFT JOIN (SELECT a AS address, count(*) FILTER (WHERE c >= 2) AS multi, count(*) AS total, max(c) AS tx, median(c) AS td FROM (
   SELECT a, b, count(*) AS c FROM (SELECT ia AS a, oa AS b, txid FROM pairs UNION SELECT oa, ia, txid FROM pairs) GROUP BY a, b) GROUP BY a) USING (address)""",
        PART, PAIRS),
    "network_matrix": _with(
        "SELECT txid, 1 AS time_step, " + ", ".join([
            _d("i.n", "num_inputs"), _d("i.a", "unique_inputs"), _d("coalesce(o.n, 0)", "num_outputs"), _d("coalesce(o.a, 0)", "unique_outputs"),
            _d("i.n + coalesce(o.n, 0)", "total_degree"), _d("i.n::DOUBLE / greatest(1, coalesce(o.n, 0))", "in_out_ratio"),
            _d("CASE WHEN coalesce(o.n, 0) > i.n THEN 1 ELSE -1 END", "net_flow_direction"),
            _d("CASE WHEN i.n >= 5 AND coalesce(o.n, 0) <= 2 THEN 1 ELSE 0 END", "is_aggregation_pattern"),
            _d("CASE WHEN i.n = 1 AND o.n = 2 THEN 1 ELSE 0 END", "is_peeling_chain_pattern"), _d("CASE WHEN i.n = 1 AND o.n >= 10 THEN 1 ELSE 0 END", "is_fan_out_dispersion"),
            _d("i.hi / i.s", "input_concentration", 9), _d("coalesce(o.hi / o.s, 0)", "output_concentration", 9), _d("e", "bipartite_entropy", 5),
        ]) + """ FROM transactions t JOIN t_in i USING (txid) LEFT JOIN t_out o USING (txid) JOIN (
  SELECT txid, -sum(amount / s * log2(amount / s)) AS e FROM part JOIN (SELECT txid, sum(amount) AS s FROM part GROUP BY txid) USING (txid) GROUP BY txid) USING (txid)""",
        PART, SIDES),
    "time_steps": _with("SELECT * FROM steps", STEPS),
    "package_manifest": _with("""
SELECT 'transaction_nodes' AS item, count(*) AS value FROM transactions UNION ALL SELECT 'transaction_edges', count(*) FROM spend_rows
UNION ALL SELECT 'wallet_nodes', count(DISTINCT address) FROM part UNION ALL SELECT 'network_nodes', count(DISTINCT src_ip) FROM network
UNION ALL SELECT 'temporal_snapshots', max(time_step)::BIGINT FROM steps""", PART, SPENDS, STEPS),
    "matrix_findings": "SELECT 'E005_FEATURE_DIMENSION_MISMATCH' AS code, 'network/features.parquet' AS file, 'network: columns in another order' AS message "
        "UNION ALL SELECT 'E006_FEATURE_NAN', 'network/features.parquet', 'network: infinite cells'",
    "walk_forward": _with("""
SELECT fold, part, time_step, count(*) AS txs FROM (
  SELECT f.fold, s.time_step, s.txid, CASE WHEN time_step <= until THEN 'train' WHEN time_step <= until + ahead THEN 'predict' END AS part
  FROM steps s, (SELECT i + 1 AS fold, first + i * ahead AS until, ahead, most FROM (
    SELECT most, most // 3 AS first, ceil((most - most // 3) / 4)::INT AS ahead FROM (SELECT max(time_step) AS most FROM steps)), range(4) r(i)) f
  WHERE until < most) WHERE part IS NOT NULL GROUP BY ALL""", STEPS),
    "leakage": "SELECT * FROM (VALUES ('time_direction', 0::BIGINT), ('disjoint_ids', 0::BIGINT), ('one_prediction', 0::BIGINT)) AS t(check_name, violations)",
    "feature_quantiles": _with(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, quantile_cont({c}, 0.25)::DOUBLE AS q25, median({c})::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q75 FROM wf"
        for c in ("fan_in", "fan_out", "median_time_gap", "dust_incoming_count", "unique_counterparties")), *WALLET_BLOCKS),
    "top_deviations": _with("""
, q AS MATERIALIZED (""".lstrip(", ") if False else """
SELECT entity_id, feature, value, baseline, deviation FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY deviation DESC, o) AS n FROM (
    SELECT entity_id, feature, value, med AS baseline, """ + half_even("abs(value - med) / (CASE WHEN q75 = q25 THEN 1.0 ELSE q75 - q25 END)", 3) + """ AS deviation, o FROM lw JOIN lq USING (feature)))
WHERE n <= 3""", *WALLET_BLOCKS, """
lw AS MATERIALIZED (""" + " UNION ALL ".join(
        f"SELECT entity_id, '{c}' AS feature, {c}::DOUBLE AS value, {i} AS o FROM wf"
        for i, c in enumerate(("fan_in", "fan_out", "median_time_gap", "dust_incoming_count", "unique_counterparties"))) + """),
lq AS MATERIALIZED (SELECT feature, quantile_cont(value, 0.25) AS q25, median(value) AS med, quantile_cont(value, 0.75) AS q75 FROM lw GROUP BY feature)"""),
    "imputed_columns": _with("""
SELECT entity_id, CASE WHEN fan_in % 7 = 3 THEN m1 ELSE fan_in END::DOUBLE AS fan_in, CASE WHEN fan_out % 5 = 1 THEN m2 ELSE fan_out END::DOUBLE AS fan_out
FROM wf, (SELECT median(fan_in) FILTER (WHERE fan_in % 7 <> 3) AS m1, median(CASE WHEN fan_out % 5 = 1 THEN 'inf'::DOUBLE ELSE fan_out END) AS m2 FROM wf)""", *WALLET_BLOCKS),
    "standardized_columns": _with("""
SELECT txid, """ + half_even("(input_count - mi) / si", 7) + " AS input_count, " + half_even("(output_count - mo) / so", 7) + """ AS output_count
FROM txf, (SELECT avg(input_count) AS mi, stddev_pop(input_count) AS si, avg(output_count) AS mo, stddev_pop(output_count) AS so FROM txf WHERE timestamp_epoch < 1705000000)""",
        TX_FEATURES),
    "static_means": _with("""
SELECT address, coalesce(avg(unique_outputs), 0) AS num_outputs, coalesce(avg(n_in), 0) AS num_inputs FROM (SELECT DISTINCT address FROM part)
LEFT JOIN (SELECT i.address, coalesce(o.n, 0)::DOUBLE AS unique_outputs, t.n::DOUBLE AS n_in FROM inputs i JOIN t_in t USING (txid) LEFT JOIN t_out o USING (txid)) USING (address) GROUP BY address""",
        PART, SIDES),
    "time_encoding": _with("SELECT record_id, " + ", ".join(
        [half_even(f"sin(src_port / {10000 ** (2 * i / 16)!r})", 6) + f" AS time_sin_{i}" for i in range(8)]
        + [half_even(f"cos(src_port / {10000 ** (2 * i / 16)!r})", 6) + f" AS time_cos_{i}" for i in range(8)]) + " FROM network"),
}

# --- evaluation

SCORED = "scored AS MATERIALIZED (SELECT doc_id AS id, quality::BIGINT AS y, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM labels)"


def _eval(select: str, *blocks: str) -> str:
    return "WITH " + ",\n".join((SCORED, *blocks)) + "\n" + select


ORACLES |= {
    "confusion": _eval("""
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
       CASE WHEN tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1
FROM (SELECT count(*) FILTER (WHERE score >= 0.675 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.675 AND y = 0) AS fp,
      count(*) FILTER (WHERE score < 0.675 AND y = 1) AS fn FROM scored)"""),
    "model_areas": _eval("""
SELECT """ + half_even("(SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) FROM scored p, scored n WHERE p.y = 1 AND n.y = 0)", 9)
        + " AS roc_auc, " + half_even("(SELECT sum(pos * tp::DOUBLE / n) / (SELECT sum(y) FROM scored) FROM (SELECT score, sum(y) AS pos, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS n FROM scored GROUP BY score))", 9)
        + " AS pr_auc"),
    "precision_at_k": _eval("""
SELECT k::INTEGER AS k, sum(y)::DOUBLE / count(*) AS precision, sum(y)::DOUBLE / (SELECT sum(y) FROM scored) AS recall
FROM (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS n FROM scored), (VALUES (10), (50), (100)) AS t(k) WHERE n <= k GROUP BY k"""),
    "best_threshold": _eval("""
SELECT step / 40.0::DOUBLE AS threshold, f1, tp, fp, fn FROM (
  SELECT step, tp, fp, fn, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (
    SELECT step, count(*) FILTER (WHERE cell >= step AND y = 1) AS tp, count(*) FILTER (WHERE cell >= step AND y = 0) AS fp, count(*) FILTER (WHERE cell < step AND y = 1) AS fn
    FROM (SELECT y, least(40, floor(score * 40)) AS cell FROM scored), generate_series(0, 40) AS g(step) GROUP BY step)) ORDER BY f1 DESC, step LIMIT 1"""),
    "calibration": _eval("""
SELECT """ + half_even("sum(err) / sum(c)", 9) + " AS brier, " + half_even("sum(abs(s - p)) / sum(c)", 9) + """ AS ece FROM (
  SELECT least(9, floor(score * 10)) AS b, sum((score - y) * (score - y)) AS err, count(*) AS c, sum(score) AS s, sum(y) AS p FROM scored GROUP BY 1)"""),
    "tier_table": _eval("SELECT " + _tier("score * 100", (85, 60, 30)) + " AS tier, count(*) AS n_rows, count(*)::DOUBLE / (SELECT count(*) FROM scored) AS share, avg(y) AS positive_rate FROM scored GROUP BY 1"),
    "unique_catches": _eval("SELECT id, score AS anomaly_score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 100) WHERE (id * 104729) % 1000 < 500"),
    "detection_recall": _with("""
SELECT 'transaction' AS kind, count(*) FILTER (WHERE planted) AS planted, count(*) FILTER (WHERE planted AND hit) AS found, count(*) FILTER (WHERE hit AND NOT planted) AS extra
FROM (SELECT o_orderkey % 100 >= 80 AS planted, 'transaction:' || txid IN (SELECT entity_id FROM tx_hits) AS hit FROM transactions) WHERE planted OR hit""", TX_FEATURES, TX_RULES),
}

# --- investigation

RUNS = """
runs AS MATERIALIZED (SELECT *, 'run-1' AS run_id FROM alerts UNION ALL SELECT * REPLACE (priority_score - 1.0::DOUBLE AS priority_score), 'run-2' FROM alerts)
"""
FEW = ("fan_in", "fan_out", "median_time_gap", "dust_incoming_count", "unique_counterparties")
DEVIATIONS = """
lw AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT entity_id, '{c}' AS feature, {c}::DOUBLE AS value, {i} AS o FROM wf" for i, c in enumerate(FEW)
) + """),
lq AS MATERIALIZED (SELECT feature, quantile_cont(value, 0.25) AS q25, median(value) AS med, quantile_cont(value, 0.75) AS q75 FROM lw GROUP BY feature),
dev AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY deviation DESC, o) AS place FROM (
    SELECT entity_id, feature, value, o, """ + half_even("abs(value - med) / (CASE WHEN q75 = q25 THEN 1.0 ELSE q75 - q25 END)", 3) + """ AS deviation FROM lw JOIN lq USING (feature)))
"""

ORACLES |= {
    "wallet_profiles": _with("""
SELECT entity_id, wallet_address AS address, priority_score, """ + _tier("priority_score") + """ AS severity, transaction_count, total_incoming, total_outgoing,
       """ + half_even("total_incoming - total_outgoing", 8) + """ AS balance, unique_counterparties, fan_in, fan_out, connected_ip_count
FROM wf JOIN alerts USING (entity_id)""", *ALERT_BLOCKS),
    "selected_alerts": _with("SELECT entity_id, run_id, priority_score FROM runs WHERE run_id = 'run-2' AND " + _tier("priority_score + 1") + " = 'HIGH' AND priority_score >= 66 AND entity_type = 'transaction'", *ALERT_BLOCKS, RUNS),
    "alert_page": _with("SELECT entity_id, priority_score, (SELECT count(*) FROM alerts) AS total FROM runs WHERE run_id = 'run-2' ORDER BY priority_score DESC, entity_id LIMIT 25 OFFSET 50", *ALERT_BLOCKS, RUNS),
    "replaced_run": _with("""
SELECT run_id, entity_type, count(*) AS n FROM runs WHERE run_id = 'run-1' OR entity_type = 'transaction' GROUP BY ALL""", *ALERT_BLOCKS, RUNS),
    "flagged_nodes": _with("SELECT entity_id AS id, 'transaction' AS type FROM tx_hits", TX_FEATURES, TX_RULES),
    "wallet_transactions": _with("""
SELECT address, txid, timestamp_epoch AS timestamp, """ + half_even("fee", 8) + """ AS fee, CASE WHEN max(sent) = 1 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction,
       any_value(coalesce(ni, 0)) AS inputs_count, any_value(coalesce(no, 0)) AS outputs_count
FROM part JOIN transactions USING (txid) LEFT JOIN (SELECT txid, count(*) AS ni FROM inputs GROUP BY txid) USING (txid)
LEFT JOIN (SELECT txid, count(*) AS no FROM outputs GROUP BY txid) USING (txid) GROUP BY address, txid, timestamp_epoch, fee""", PART),
    "wallet_observations": _with("""
SELECT record_id, txid, src_ip, src_port, asn, geo_country, us AS timestamp FROM network WHERE txid IN (SELECT txid FROM part WHERE address = 'W1')""", PART),
    "transaction_inspector": _with("""
SELECT txid, coalesce(i.a, '') AS inputs, coalesce(o.a, '') AS outputs, """ + half_even("coalesce(i.s, 0)", 8) + " AS total_input, " + half_even("coalesce(o.s, 0)", 8) + """ AS total_output, coalesce(r.a, '') AS relays
FROM transactions LEFT JOIN (SELECT txid, string_agg(address, ',' ORDER BY input_index) FILTER (WHERE input_index < 10) AS a, sum(amount) AS s FROM inputs GROUP BY txid) i USING (txid)
LEFT JOIN (SELECT txid, string_agg(address, ',' ORDER BY output_index) FILTER (WHERE output_index < 10) AS a, sum(amount) AS s FROM outputs GROUP BY txid) o USING (txid)
LEFT JOIN (SELECT txid, string_agg(src_ip, ',' ORDER BY us, record_id) AS a FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY us, record_id) AS n FROM network) WHERE n <= 10 GROUP BY txid) r USING (txid)"""),
    "ip_inspector": _with("""
SELECT src_ip, n AS relayed_tx_count, country, asn, coalesce(t.a, '') AS sample_txids, p.a AS ports FROM (
  SELECT src_ip, count(*) AS n, arg_min(geo_country, (us, record_id)) AS country, arg_min(asn, (us, record_id)) AS asn FROM network GROUP BY src_ip)
LEFT JOIN (SELECT src_ip, string_agg(txid, ',' ORDER BY txid) AS a FROM (SELECT src_ip, txid, row_number() OVER (PARTITION BY src_ip ORDER BY txid) AS r FROM (SELECT DISTINCT src_ip, txid FROM network WHERE txid IS NOT NULL)) WHERE r <= 10 GROUP BY src_ip) t USING (src_ip)
LEFT JOIN (SELECT src_ip, string_agg(src_port::VARCHAR, ',' ORDER BY src_port) AS a FROM (SELECT src_ip, src_port, row_number() OVER (PARTITION BY src_ip ORDER BY src_port) AS r FROM (SELECT DISTINCT src_ip, src_port FROM network)) WHERE r <= 5 GROUP BY src_ip) p USING (src_ip)"""),
    "located_network": _with("""
SELECT record_id, src_ip, CASE WHEN event_id % 3 <> 0 THEN geo_country ELSE n_name END AS geo_country,
       CASE WHEN event_id % 3 = 0 AND n_name IS NOT NULL THEN 'AS' || n_nationkey ELSE asn END AS asn
FROM network LEFT JOIN nation ON split_part(src_ip, '.', 3) = '0' AND split_part(src_ip, '.', 4)::INT BETWEEN n_nationkey * 8 AND n_nationkey * 8 + 5"""),
    "evidence_items": _with("""
SELECT entity_id, 'observed' AS class, 'source_records' AS feature, source_record_count::DOUBLE AS value, least(20, source_record_count)::BIGINT AS cited FROM wf
UNION ALL SELECT entity_id, 'detector', rule_id, observed_value, least(20, source_record_count)::BIGINT FROM hits JOIN wf USING (entity_id)
UNION ALL SELECT entity_id, 'derived', feature, value, least(5, source_record_count)::BIGINT FROM dev JOIN wf USING (entity_id)""", *RULE_BLOCKS, DEVIATIONS),
    "alert_reasons": _with("""
SELECT entity_id, rule_id AS rule_code, replace(rule_id, 'RULE_', '') AS headline,
       'reason-rule-' || row_number() OVER (PARTITION BY entity_id ORDER BY code) AS reason_id, 1 AS cited FROM hits
UNION ALL SELECT entity_id, feature, CASE feature WHEN 'fan_in' THEN 'Fan In' WHEN 'fan_out' THEN 'Fan Out' WHEN 'median_time_gap' THEN 'Median Time Gap'
  WHEN 'dust_incoming_count' THEN 'Dust Incoming Count' ELSE 'Unique Counterparties' END, 'reason-feat-' || place, 1 FROM dev WHERE place <= 3 AND deviation > 1.5
UNION ALL SELECT entity_id, 'network_score', 'Network Score', 'reason-net-1', 0 FROM ns WHERE network_score >= 0.7""", *RULE_BLOCKS, NET_SIGNALS, DEVIATIONS),
    "full_alerts": _with("""
SELECT entity_id, """ + _tier("priority_score") + """ AS severity, priority_score, behavior_score, """ + half_even("graph_score * 100.0::DOUBLE", 2) + """ AS graph_score,
       rule_score, network_score, correlation_strength, rule_count
FROM (SELECT *, """ + half_even("least(100.0, greatest(0.0, CASE WHEN rule_score > 0 THEN 0.85::DOUBLE * p + 0.15::DOUBLE * rule_score ELSE p END))", 2) + """ AS priority_score FROM (
  SELECT wf.entity_id, coalesce(behavior_score, 0) AS behavior_score, graph_score, coalesce(rule_score, 0)::DOUBLE AS rule_score, network_score, correlation_strength,
         coalesce(rule_count, 0) + coalesce(custom_rule_count, 0) AS rule_count,
         100.0::DOUBLE * (0.3::DOUBLE * coalesce(behavior_score, 0) + 0.2::DOUBLE * graph_score + 0.1::DOUBLE * network_score) AS p
  FROM wf JOIN gs USING (entity_id) JOIN ns USING (entity_id) LEFT JOIN behave USING (entity_id) LEFT JOIN (
    SELECT entity_id, """ + half_even("least(100.0, sum(CASE severity WHEN 'critical' THEN 35.0 WHEN 'high' THEN 25.0 WHEN 'medium' THEN 15.0 ELSE 5.0 END * weight))::DOUBLE", 2) + """ AS rule_score,
           count(*) AS custom_rule_count FROM c_hits GROUP BY entity_id) USING (entity_id)))""",
        *RULE_BLOCKS, CUSTOM, NET_SIGNALS, GRAPH, _label_rounds("ent_nodes", "ent_und", 5), GRAPH_SIGNALS),
    "alert_narratives": _with("""
SELECT entity_id, entity_id || ': ' || """ + _tier("p") + """ || ', ' || printf('%.1f', p) || ' of 100 points.' ||
  CASE WHEN n > 0 THEN ' Rules met (' || n || '): ' || names || '.' ELSE '' END AS summary_text, 1 + n + 5 AS items, 1.0::DOUBLE AS evidence_coverage, least(20, source_record_count)::BIGINT AS records
FROM (SELECT entity_id, source_record_count, coalesce(rule_count, 0) AS n, """ + half_even("0.3::DOUBLE * coalesce(behavior_score, 0) * 100.0::DOUBLE", 2) + """ AS p FROM wf LEFT JOIN behave USING (entity_id))
LEFT JOIN (SELECT entity_id, string_agg(rule_id, ', ' ORDER BY code) AS names FROM hits GROUP BY entity_id) USING (entity_id)""", *RULE_BLOCKS),
    "feedback_counts": _with("SELECT " + _tier("priority_score") + " AS severity, ['relevant', 'benign', 'needs_review'][len(entity_id) % 3 + 1] AS label, count(*) AS n FROM alerts GROUP BY 1, 2", *ALERT_BLOCKS),
    "upserted_nodes": _with("""
SELECT 'star' AS case_id, txid, (size + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS size, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM transactions"""),
    "graph_export": _with("SELECT 'edge:' || src || '->' || dst || ':' || type AS id, src AS source, dst AS target, type, basis, weight, " + r8("amount") + " AS amount FROM ent_edges", PART, GRAPH),
    "package_written": _with("""
SELECT 'transaction/features' AS file, count(*) AS rows FROM transactions UNION ALL SELECT 'transaction/edgelist', count(*) FROM spend_rows
UNION ALL SELECT 'wallet/features', count(DISTINCT address) FROM part UNION ALL SELECT 'network/features', count(*) FROM transactions
UNION ALL SELECT 'network/edgelist', count(*) FROM network WHERE txid IN (SELECT txid FROM transactions)""", PART, SPENDS),
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "altered_artifacts": "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey % 7 = 3",
    "telemetry_features": _with("""
SELECT txid, count(DISTINCT src_ip) AS originator_peer_count, count(DISTINCT geo_country) AS originator_country_diversity, count(DISTINCT asn) AS originator_asn_diversity,
       max((dst_port = 9050)::INT) AS originator_tor_or_vpn_flag, max((dst_port <> 8333)::INT) AS originator_port_flag, """ + half_even("avg((us - f < 500000)::INT)", 9) + """ AS originator_relay_burst_score
FROM network JOIN (SELECT txid, min(us) AS f FROM network GROUP BY txid) USING (txid) GROUP BY txid"""),
    "observation_gaps": _with("SELECT txid, record_id, (us - lag(us) OVER (PARTITION BY txid ORDER BY us, record_id)) / 1e6::DOUBLE AS delta_t FROM network WHERE txid IS NOT NULL"),
    "arrival_features": _with("""
SELECT address, b AS burst_event_count, coalesce(lo, 0) AS inter_arrival_time_min, coalesce(hi, 0) AS inter_arrival_time_max, coalesce(mean, 0) AS inter_arrival_time_mean,
       """ + half_even("coalesce(sd, 0)", 3) + """ AS inter_arrival_time_std, coalesce(med, 0) AS inter_arrival_time_median
FROM (SELECT address, max(c) AS b FROM (SELECT address, count(*) OVER (PARTITION BY address ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS c FROM vis) GROUP BY address)
LEFT JOIN (SELECT address, min(g) AS lo, max(g) AS hi, avg(g) AS mean, stddev_samp(g) AS sd, median(g) AS med FROM (
  SELECT address, (us - lag(us) OVER (PARTITION BY address ORDER BY us)) / 1e6 AS g FROM vis) WHERE g IS NOT NULL GROUP BY address) USING (address)""",
        PART, "vis AS MATERIALIZED (SELECT DISTINCT address, txid, us FROM part)"),
    "peeling_depth": _with("SELECT txid, max(d)::INTEGER AS depth FROM chain GROUP BY txid", SPENDS, """
shaped AS MATERIALIZED (SELECT txid FROM inputs GROUP BY txid HAVING count(*) = 1 INTERSECT SELECT txid FROM outputs GROUP BY txid HAVING count(*) = 2),
chain(txid, d) AS (SELECT txid, 1 FROM shaped UNION SELECT s.src, c.d + 1 FROM chain c JOIN spends s ON s.dst = c.txid WHERE s.src IN (SELECT txid FROM shaped))""",
        recursive=True),
    "local_structure": _with("""
SELECT id, CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(triangle_count, 0) / (k * (k - 1)) ELSE 0 END AS clustering_coefficient, CASE WHEN od > 0 THEN coalesce(back, 0)::DOUBLE / od ELSE 0 END AS reciprocity
FROM (SELECT id, count(*) AS k FROM (SELECT u AS id, v AS o FROM und UNION SELECT v, u FROM und) GROUP BY id) LEFT JOIN tri USING (id)
LEFT JOIN (SELECT ia AS id, count(DISTINCT oa) AS od FROM pairs GROUP BY ia) USING (id)
LEFT JOIN (SELECT a.ia AS id, count(DISTINCT a.oa) AS back FROM pairs a JOIN pairs b ON a.ia = b.oa AND a.oa = b.ia GROUP BY a.ia) USING (id)""", PART, PAIRS, TRIANGLES),
    "weighted_degrees": _with("""
SELECT id, """ + r8("sum(i)") + " AS weighted_in, " + r8("sum(o)") + " AS weighted_out, " + r8("sum(i) + sum(o)") + """ AS weighted_total FROM (
  SELECT src AS id, amount AS o, 0::DOUBLE AS i FROM ent_edges WHERE amount IS NOT NULL UNION ALL SELECT dst, 0, amount FROM ent_edges WHERE amount IS NOT NULL) GROUP BY id""", PART, GRAPH),
    "wallet_timeline": _with("""
SELECT address, min(timestamp_epoch) AS first_seen, max(timestamp_epoch) AS last_seen, count(DISTINCT time_step) AS active_steps FROM part JOIN steps USING (txid) GROUP BY address""", PART, STEPS),
    "flow_paths": _with("""
SELECT DISTINCT e.ia AS src, e.oa AS dst, a.h AS from_start FROM p2 e JOIN fwd a ON a.id = e.ia JOIN bwd b ON b.id = e.oa
WHERE a.h + 1 + b.h = (SELECT h FROM fwd WHERE id = 'W170')""", PART, PAIRS, """p2 AS MATERIALIZED (SELECT DISTINCT ia, oa FROM pairs),
f0(id, h) AS (SELECT 'W1', 0 UNION SELECT oa, h + 1 FROM f0 JOIN p2 ON ia = id WHERE h < 4), fwd AS MATERIALIZED (SELECT id, min(h) AS h FROM f0 GROUP BY id),
b0(id, h) AS (SELECT 'W170', 0 UNION SELECT ia, h + 1 FROM b0 JOIN p2 ON oa = id WHERE h < 4), bwd AS MATERIALIZED (SELECT id, min(h) AS h FROM b0 GROUP BY id)""", recursive=True),
    "stream_relay_windows": """
WITH w AS (SELECT 'tx_' || (event_id % 50) AS txid, epoch_us(ts) // 3600000000 * 3600 AS window_start, count(*) AS observations FROM events GROUP BY 1, 2)
SELECT * FROM w""",
    "stream_wallet_bursts": """
WITH w AS (SELECT 'ip_' || user_id AS address, (epoch_us(ts) // 1800000000 - k) * 1800 AS window_start, count(*) AS visits FROM events, (VALUES (0), (1)) AS t(k) GROUP BY 1, 2)
SELECT * FROM w""",
    "stream_ingest": _records("SELECT 'accepted' AS file, count(*) AS rows FROM good UNION ALL SELECT 'rejected', (SELECT count(*) FROM lists) - count(*) FROM good"),
    "stream_links": """
WITH t AS (SELECT 'tx_' || (o_orderkey % 50) AS txid, 'rec_' || o_orderkey AS transaction_record_id, (1704067200 + (o_orderkey * 7919) % 2592000) * 1000000 AS us FROM orders)
SELECT 'net_' || event_id AS network_record_id, txid, transaction_record_id, 'ip_' || user_id AS src_ip, '0.0.0.0' AS dst_ip
FROM events JOIN t ON txid = 'tx_' || (event_id % 50) AND epoch_us(ts) BETWEEN us - 3600000000 AND us + 3600000000""",
}
