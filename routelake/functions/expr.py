"""Scalar column expressions (JVM-side, codegen friendly). Each returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
CACHE_KEY_PREFIX = "route"
NOT_FOUND_SENTINEL = "__NOT_FOUND__"
POSITIVE_TTL_SECONDS = 60
NEGATIVE_TTL_SECONDS = 10
DEFAULT_EVENT_TYPE = "route_changed"
UNKNOWN = "unknown"
CORRELATION_PREFIX = "req-"
CORRELATION_PATTERN = r"^req-[0-9a-f]{16}$"
ACTIONS = ("created", "activated", "deactivated")
ROUTE_COLS = ("tenant", "service", "env", "version")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(c) -> Column:
    """Python-falsy test of the reference: null or empty string is missing (Q1)."""
    c = _c(c)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def all_present(*cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & present(c)
    return out


def route_cache_key(t="tenant", s="service", e="env", v="version") -> Column:
    """``route:{t}:{s}:{e}:{v}``; null when any part is missing (concat_ws would skip it)."""
    parts = [_c(x) for x in (t, s, e, v)]
    key = F.concat_ws(":", F.lit(CACHE_KEY_PREFIX), *parts)
    return F.when(all_present(*parts), key)


def route_partition_key(t="tenant", s="service", e="env", v="version") -> Column:
    parts = [_c(x) for x in (t, s, e, v)]
    return F.when(all_present(*parts), F.concat_ws(":", *parts))


def route_label(t="tenant", s="service", e="env", v="version") -> Column:
    return F.concat_ws("/", *[_c(x) for x in (t, s, e, v)])


def not_found_message(t="tenant", s="service", e="env", v="version") -> Column:
    return F.concat(F.lit("Route not found: "), route_label(t, s, e, v))


def split_route_key(key="route_key") -> Column:
    """Key back to a struct of the four parts; ``route:`` prefix dropped."""
    body = F.regexp_replace(_c(key), r"^route:", "")
    parts = F.split(body, ":", 4)
    return F.struct(*[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(ROUTE_COLS)])


ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?$"


def parse_iso_timestamp(s, fallback=None) -> Column:
    """ISO-8601 with ``Z``, an offset (-> UTC) or no zone; junk/missing -> fallback (Q4, Q5). The
    text must be a whole date, or a date and a time: a year or a time alone is junk."""
    parsed = F.when(F.trim(_c(s)).rlike(ISO_PATTERN), F.try_to_timestamp(_c(s)))
    return parsed if fallback is None else F.coalesce(parsed, _c(fallback))


def format_iso_timestamp(ts, zulu: bool = False) -> Column:
    """Python ``isoformat()``: no fraction when microseconds are 0, six digits otherwise (Q6)."""
    ts = _c(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    out = F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(frac)
    return F.concat(out, F.lit("Z")) if zulu else out


def format_day(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def format_clock(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


def new_event_id(seed=None) -> Column:
    """UUID4; pass ``seed`` (a column) for a repeatable UUID-shaped id from sha2."""
    if seed is None:
        return F.expr("uuid()")
    h = F.sha2(_c(seed).cast("string"), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def new_correlation_id(seed=None) -> Column:
    """``req-`` + 16 hex; repeatable when ``seed`` is given."""
    if seed is None:
        hexs = F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 16)
    else:
        hexs = F.substring(F.sha2(_c(seed).cast("string"), 256), 1, 16)
    return F.concat(F.lit(CORRELATION_PREFIX), hexs)


def default_correlation_id(cid, seed=None) -> Column:
    return F.coalesce(F.nullif(_c(cid), F.lit("")), new_correlation_id(seed))


def log_correlation_id(cid) -> Column:
    """Log lines print ``-`` when there is no id."""
    return F.coalesce(F.nullif(_c(cid), F.lit("")), F.lit("-"))


def event_to_json(*cols, keep_nulls: bool = True) -> Column:
    opts = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*[_c(c) for c in cols]), opts)


def event_from_json(value, schema) -> Column:
    return F.from_json(_c(value), schema, {"mode": "PERMISSIVE"})


def default_fields(event_type="event_type", metadata="metadata"):
    return (F.coalesce(_c(event_type), F.lit(DEFAULT_EVENT_TYPE)),
            F.coalesce(_c(metadata), F.create_map().cast("map<string,string>")))


def display_or_unknown(c) -> Column:
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(UNKNOWN))


def route_url_template(index, t="tenant", s="service", e="env", v="version") -> Column:
    """URL from parts by one of the six templates; ``index`` is 1-based (1..6)."""
    t, s, e, v = (_c(x) for x in (t, s, e, v))
    L = F.lit
    # The reference's six URL templates.
    templates = F.array(
        F.concat(L("https://"), s, L("."), t, L(".example.com/"), v),
        F.concat(L("https://"), s, L("-"), e, L("."), t, L(".example.com/"), v),
        F.concat(L("https://"), t, L("-"), s, L(".example.com/"), v),
        F.concat(L("https://api."), t, L(".example.com/"), s, L("/"), v),
        F.concat(L("https://"), s, L(".api."), t, L(".example.com/"), v),
        F.concat(L("https://"), e, L("."), s, L("."), t, L(".example.com/"), v),
    )
    return F.element_at(templates, _c(index).cast("int"))


def cache_ttl_remaining(expires_at, as_of) -> Column:
    """Whole seconds left, floor 0 (``TTL key``)."""
    secs = F.unix_micros(_c(expires_at)) - F.unix_micros(_c(as_of))
    return F.greatest(F.floor(secs / F.lit(1_000_000)), F.lit(0)).cast("long")


def status_of_resolve(outcome="outcome") -> Column:
    o = _c(outcome)
    return (F.when(o == "bad_request", 400)
            .when(o.isin("not_found", "negative_hit"), 404)
            .when(o == "unavailable", 503)
            .otherwise(200))


def action_valid(action="action") -> Column:
    return _c(action).isin(*ACTIONS)


def ts_plus_seconds(ts, secs) -> Column:
    """Timestamp + a (possibly fractional, possibly column) number of seconds, exact to 1 us."""
    micros = F.round(_c(secs) * F.lit(1_000_000)).cast("long") if not isinstance(secs, int) \
        else F.lit(secs * 1_000_000)
    return F.timestamp_micros(F.unix_micros(_c(ts)) + micros)


def lit_ts(s: str) -> Column:
    return F.to_timestamp(F.lit(s))
