"""routelake: route-catalog and change-event analytics as Spark DataFrame operators.

Every operator is ``f(df, ..., params) -> DataFrame``: no collect, no wall clock,
no state on the driver. Time-dependent operators take an explicit ``as_of``.
"""

__version__ = "0.1.0"
