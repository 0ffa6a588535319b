"""Bitemporal event-graph analytics expressed as Spark DataFrame operators."""
