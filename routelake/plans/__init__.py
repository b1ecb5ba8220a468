"""Registered queries: each pairs a Spark plan over the fixture views with its SQL twin."""
