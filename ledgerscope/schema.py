"""Fixed names: column aliases, case tables and model matrices."""

from __future__ import annotations

import hashlib
import json

# Every accepted spelling of each canonical column.
ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "time", "ts", "ts_generation", "date", "datetime"),
    "src_ip": ("src_ip", "source_ip", "src", "client_ip", "ip_src", "source_address"),
    "dst_ip": ("dst_ip", "destination_ip", "dst", "server_ip", "ip_dst", "dest_ip", "destination_address"),
    "src_port": ("src_port", "source_port", "port_src", "client_port"),
    "dst_port": ("dst_port", "destination_port", "port_dst", "dest_port", "server_port"),
    "txid": ("txid", "transaction_id", "transaction_hash", "tx_hash", "hash", "tx_id"),
    "input_addresses": ("input_addresses", "inputs", "input", "vin_addresses", "from_addresses", "senders"),
    "output_addresses": ("output_addresses", "outputs", "output", "vout_addresses", "to_addresses", "recipients"),
    "input_amounts": ("input_amounts", "input_values", "vin_amounts", "from_amounts", "input_value", "vin_values"),
    "output_amounts": ("output_amounts", "output_values", "vout_amounts", "to_amounts", "output_value", "vout_values"),
    "fee": ("fee", "transaction_fee", "tx_fee", "fees"),
    "script_type": ("script_type", "script", "type", "tx_type"),
    "geo_country": ("geo_country", "country", "country_code", "src_country", "dst_country"),
    "asn": ("asn", "autonomous_system", "as_number", "asn_number", "src_asn", "dst_asn"),
}

LIST_COLUMNS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")

# Columns each case file must have.
REQUIRED: dict[str, tuple[str, ...]] = {
    "transactions": ("txid", "timestamp", "fee", "size"),
    "inputs": ("txid", "prev_txid", "prev_vout", "address", "amount"),
    "outputs": ("txid", "output_index", "address", "amount"),
    "network": ("txid", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port"),
}

CASE_STAGES = ("raw", "validated", "normalized", "correlated", "features", "graph", "models", "reports")

STATS = ("min", "max", "mean", "median", "total")
LOCAL_COUNT, AGGREGATE_COUNT = 93, 72


def transaction_columns() -> list[str]:
    """Local_feature_1.., Aggregate_feature_1.., then the named flow columns."""
    named = ["in_txs_degree", "out_txs_degree", "total_BTC", "fees", "size"]
    named += ["num_input_addresses", "num_output_addresses"]
    named += [f"{side}_BTC_{s}" for side in ("in", "out") for s in STATS]
    return (
        [f"Local_feature_{i}" for i in range(1, LOCAL_COUNT + 1)]
        + [f"Aggregate_feature_{i}" for i in range(1, AGGREGATE_COUNT + 1)]
        + named
    )


def wallet_columns() -> list[str]:
    spread = ("total", "min", "max", "mean", "median")
    # The columns before the repeated five-number groups ("as receiver" has a space).
    head = [
        "num_txs_as_sender",
        "num_txs_as receiver",
        "first_block_appeared_in",
        "last_block_appeared_in",
        "lifetime_in_blocks",
        "total_txs",
        "first_sent_block",
        "first_received_block",
        "num_timesteps_appeared_in",
    ]
    groups = ["btc_transacted", "btc_sent", "btc_received", "fees", "fees_as_share"]
    groups += ["blocks_btwn_txs", "blocks_btwn_input_txs", "blocks_btwn_output_txs"]
    body = [f"{g}_{s}" for g in groups for s in spread]
    return head + body + ["num_addr_transacted_multiple"] + [f"transacted_w_address_{s}" for s in spread]


def network_columns() -> list[str]:
    return [
        "num_inputs",
        "unique_inputs",
        "num_outputs",
        "unique_outputs",
        "total_degree",
        "in_out_ratio",
        "net_flow_direction",
        "is_aggregation_pattern",
        "is_peeling_chain_pattern",
        "is_fan_out_dispersion",
        "input_concentration",
        "output_concentration",
        "bipartite_entropy",
    ]


# Width and SHA-256 of the ordered column list of each model matrix.
MATRIX_CONTRACT = {
    "transaction": (182, "d25f2f8e7eb7faee636003aeabd8948401f2616925311af83706eb7813ab8a2e"),
    "wallet": (55, "e135dce14b253ce9395ded8241f3b24cdf1b3a3a71b697ea57c993ace2b6ed57"),
    "network": (13, "824e58b592ca73f08df5c2b01d1d71af6d34e1a79bdc9ee9d2a5a1237709b804"),
}


def order_hash(columns: list[str]) -> str:
    return hashlib.sha256(json.dumps(columns).encode()).hexdigest()
