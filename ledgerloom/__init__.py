"""Ledger-to-P&L on Spark: strict ingest, conformed dimensions, posting star, P&L mart."""
