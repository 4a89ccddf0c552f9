"""Linkage-disequilibrium analytics as Spark DataFrame operators."""
