"""Operators of a training-data pipeline: one module per operator, thin queries in ``queries``.

Nothing outside this package imports it; it uses only general helpers of the library
(``routelake.session``)."""
