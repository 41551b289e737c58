"""Bounded labels: any input becomes one of a few fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import SAFE_NAME

# The allowed labels.
ROUTES = ("single", "batch", "health", "ready", "metrics")
STATUSES = ("200", "202", "400", "401", "404", "413", "429", "500", "503")
OUTCOMES = ("success", "error", "saturated", "timeout")
FAILURE_REASONS = ("buffer_saturated", "timeout", "broker_error")
PROTOCOLS = ("HTTP/1.0", "HTTP/1.1", "HTTP/2.0")
OPERATION_KINDS = ("startup", "storage", "quarantine", "progress")
CONNECTION_ERRORS = ("fd_limit", "address_unavailable", "connection_refused", "cancelled", "timeout", "dns", "other")
RETRYABLE_FAILURES = ("connection", "bad_acknowledgement")


def within(value: Column, allowed: tuple[str, ...], other: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))


def route(c: Column) -> Column:
    return within(c, ROUTES, "other")


def status(c: Column) -> Column:
    return within(c, STATUSES, "other")


def outcome(c: Column) -> Column:
    return within(c, OUTCOMES, "error")


def failure_reason(c: Column) -> Column:
    return within(c, FAILURE_REASONS, "broker_error")


def protocol(c: Column) -> Column:
    return within(c, PROTOCOLS, "other")


def safe_name(c: Column) -> Column:
    """A topic name when it looks like one, else NULL."""
    return F.when(c.rlike(SAFE_NAME), c)


def error_class(cause: Column) -> Column:
    return within(cause, ("deadline", "canceled", "database", "network"), "operation")


def sqlstate(cause: Column, code: Column) -> Column:
    return F.when((cause == "database") & code.rlike("^[A-Z0-9]{5}$"), code)


def connection_error(code: Column) -> Column:
    """Class of a socket failure from its system code; NULL when there was none."""
    return (
        F.when(code.isNull(), F.lit(None))
        .when(code.isin("EMFILE", "ENFILE"), "fd_limit")
        .when(code.isin("EADDRNOTAVAIL", "EADDRINUSE"), "address_unavailable")
        .when(code == "ECONNREFUSED", "connection_refused")
        .when(code == "canceled", "cancelled")
        .when(code.isin("deadline", "ETIMEDOUT"), "timeout")
        .when(code == "dns", "dns")
        .otherwise("other")
    )


def delivery(status_code: Column, transport_error: Column, ids_match: Column) -> Column:
    """accepted, ambiguous or rejected. Without a status, or with IDs unlike those sent, nobody knows."""
    return (
        F.when(transport_error | status_code.isNull(), "ambiguous")
        .when((status_code != 202) & (status_code >= 500), "ambiguous")
        .when(status_code != 202, "rejected")
        .when(F.coalesce(ids_match, F.lit(False)), "accepted")
        .otherwise("ambiguous")
    )


def retryable(status_code: Column, failure: Column) -> Column:
    """Whether the same request may be sent again: 429, server failures, lost connections, bad acknowledgements."""
    by_status = (status_code == 429) | (status_code >= 500)
    return F.coalesce(F.when(failure.isNotNull(), failure.isin(*RETRYABLE_FAILURES)).otherwise(by_status), F.lit(False))


def bearer_key(header: Column) -> Column:
    """The key of an authorization header, with or without the ``Bearer `` prefix."""
    return F.regexp_replace(header, "^Bearer ", "")
