"""Ordered-signal, network and corpus analytics as Spark DataFrame operators."""
