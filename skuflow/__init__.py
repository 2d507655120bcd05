"""Marketplace catalogue reconciliation as Spark DataFrame operators."""
