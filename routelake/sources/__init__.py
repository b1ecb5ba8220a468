"""Inputs and written tables: fixture views over the driver's tables, the lake layout
(audit, snapshots, lineage cuts), catalog snapshots, and the route generator."""
