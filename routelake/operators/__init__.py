"""DataFrame operators. Each is ``f(df, ..., params) -> DataFrame``.

catalog      route table, point lookups, batch resolve, cache-aside, warm / invalidate
dml          get-or-create, upsert, create / (de)activate, change logs, data quality
audit        audit filters, projections, newest-first reports, aggregations, state over time
metrics      request, cache and metric aggregations
quantiles    exact order statistics by counting
timeseries   counters, gauges, histograms, SLIs, alerts
resilience   failure windows, retry budget, concurrency
ingest       text sources, correlation trace, outage range join
scan         skew-safe window primitives (chunked lag / running sum / as-of, halo frames, top-k)
"""
