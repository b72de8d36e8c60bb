"""Forensic ledger and relay-telemetry analytics as PySpark DataFrame jobs."""
