"""Scalar column expressions (JVM-side, no Python UDFs)."""
