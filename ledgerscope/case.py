"""A case: four tables and what is known of their sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Case:
    """transactions(record_id, txid, timestamp, timestamp_epoch, fee, size, version, locktime),
    inputs(txid, input_index, prev_txid, prev_vout, address, amount),
    outputs(txid, output_index, address, amount),
    network(record_id, timestamp, txid, src_ip, dst_ip, src_port, dst_port, asn, geo_country).

    ``bounds`` are upper bounds of the four row counts in that order; None means unknown, and
    operators then look for oversized groups themselves.
    """

    transactions: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    network: DataFrame
    bounds: tuple[int, int, int, int] | None = None

    @property
    def spark(self):
        return self.transactions.sparkSession

    @property
    def tx_rows(self) -> int | None:
        return self.bounds[0] if self.bounds else None

    @property
    def flow_rows(self) -> int | None:
        """Bound on participation rows, hence on wallets."""
        return self.bounds[1] + self.bounds[2] if self.bounds else None

    @property
    def net_rows(self) -> int | None:
        return self.bounds[3] if self.bounds else None

    @property
    def node_rows(self) -> int | None:
        """Bound on entity-graph nodes: a transaction, a wallet per flow row, three per observation."""
        return self.tx_rows + self.flow_rows + 3 * self.net_rows if self.bounds else None

    @classmethod
    def counted(cls, transactions, inputs, outputs, network) -> "Case":
        tables = (transactions, inputs, outputs, network)
        return cls(*tables, tuple(t.count() for t in tables))
