"""Human-readable labels of sizes, durations, scores, hashes and dates, and small enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _case(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*pairs[0])
    for p in pairs[1:]:
        out = out.when(*p)
    return out.otherwise(otherwise)


def size_label(c: Column) -> Column:
    """One decimal from KB to PB, whole bytes below; nothing counts as zero."""
    d = c.cast("double")
    steps = [(d.isNull(), F.lit("0 B")), (F.abs(d) < 1024, F.format_string("%d B", d.cast("long")))]
    steps += [(F.abs(d) < 1024.0 ** (i + 1), F.format_string(f"%.1f {u}", d / 1024.0**i)) for i, u in enumerate(_UNITS[:-1]) if i]
    return _case(steps, F.format_string("%.1f PB", d / 1024.0**5))


def size_label_short(c: Column) -> Column:
    """As shown in tables: zero decimals dropped, B to TB, '0 B' for none."""
    d = c.cast("double")

    def text(i: int) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", d / 1024.0**i), r"\.0$", ""), F.lit(f" {_UNITS[i]}"))

    return F.when(d == 0, F.lit("0 B")).otherwise(_case([(d < 1024.0 ** (i + 1), text(i)) for i in range(4)], text(4)))


def duration_label(seconds: Column) -> Column:
    s = seconds.cast("double")
    return (
        F.when(s.isNull() | (s < 0), F.lit("0.00s"))
        .when(s < 1, F.format_string("%.0fms", s * 1000))
        .when(s < 60, F.format_string("%.2fs", s))
        .when(s < 3600, F.format_string("%dm %.1fs", F.floor(s / 60).cast("int"), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int")))
    )


def milliseconds_label(ms: Column) -> Column:
    d = ms.cast("double")
    return F.when(d.isNull(), F.lit("N/A")).when(d < 1000, F.format_string("%.1fms", d)).otherwise(F.format_string("%.2fs", d / 1000))


def score_label(c: Column, digits: int = 4) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def percent_label(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f%%", c.cast("double") * 100))


def latency_label(ms: Column) -> Column:
    d = ms.cast("double")
    return F.when(d.isNull(), F.lit("N/A")).when(d < 1, F.lit("< 1 ms")).otherwise(F.format_string("%.1f ms", d))


def hash_label(c: Column, head: int = 8, tail: int = 6) -> Column:
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("..."), F.right(c, F.lit(tail))))


def date_label(ts: Column, pattern: str = "MMM d, yyyy") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit("—"))


def relative_label(ts: Column, now: Column) -> Column:
    s = (now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")).cast("long")

    def ago(n: Column, unit: str) -> Column:
        n = F.floor(n).cast("int")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return F.when(ts.isNull(), F.lit("—")).when(s < 60, F.lit("just now")).when(s < 3600, ago(s / 60, "minute")).when(s < 86400, ago(s / 3600, "hour")).otherwise(ago(s / 86400, "day"))


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<!^)(?=[A-Z])", "_"))


def url_host(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\w+://(?:[^@/]*@)?([^/:?#]+)", 1), F.lit(""))


def url_port(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\w+://(?:[^@/]*@)?[^/:?#]+:(\d+)", 1), F.lit("")).cast("int")


def next_run(frequency: Column, now: Column) -> Column:
    """An hour, a day or a week on; schedules by hand or by own rule have none."""
    return (
        F.when(frequency == "hourly", now + F.expr("INTERVAL 1 HOUR")).when(frequency == "daily", now + F.expr("INTERVAL 1 DAY")).when(frequency == "weekly", now + F.expr("INTERVAL 7 DAY"))
    )


def known_frequency(c: Column) -> Column:
    return F.when(F.lower(c).isin("manual", "hourly", "daily", "weekly", "custom"), F.lower(c)).otherwise(F.lit("custom"))


def confidence(score: Column) -> Column:
    """Scores up to 1 as they are, others as 1 / (1 + score), within 0.1 and 1, four decimals; it jumps just above 1."""
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.when(score <= 1, score).otherwise(1 / (1 + score)))), 4)


#: Retired document categories and their successors.
CATEGORY_SUCCESSORS = {"INCIDENT_POSTMORTEM": "INCIDENT_REPORT", "API_DOCUMENTATION": "MANUAL"}
CATEGORIES = ("RUNBOOK", "INCIDENT_REPORT", "MANUAL", "CONFIGURATION", "POLICY", "OTHER")
#: Display names of states.
STATE_LABELS = {"RUNBOOK": "Runbook", "INCIDENT_REPORT": "Incident Report", "MANUAL": "Manual", "CONFIGURATION": "Configuration", "POLICY": "Policy", "OTHER": "Other", "READY": "Ready", "EMBEDDED": "Indexed", "HEALTHY": "Operational"}


def remap(c: Column, to: dict[str, str], valid: tuple[str, ...], otherwise: str) -> Column:
    out = F.when(c.isin(*valid), c)
    for old, new in to.items():
        out = out.when(c == old, F.lit(new))
    return out.otherwise(F.lit(otherwise))


def category(c: Column) -> Column:
    return remap(c, CATEGORY_SUCCESSORS, CATEGORIES, "OTHER")


def state_label(c: Column) -> Column:
    out = None
    for k, v in STATE_LABELS.items():
        out = F.when(F.upper(c) == k, F.lit(v)) if out is None else out.when(F.upper(c) == k, F.lit(v))
    return out.otherwise(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def joined_tags(tags: Column) -> Column:
    return F.array_join(tags, ",")


def split_tags(c: Column) -> Column:
    """Tags of a comma-separated text; none in an empty one."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def error_kind(status: Column, own_code: Column, transport_code: Column, is_request: Column, is_error: Column) -> Column:
    """Code and status of a failure: the service's own code, a timeout, no answer, a bare status, else the client's own.

    Codes, statuses and the order of cases are fixed values, which results depend on.
    """

    def kind(code: Column, at: Column) -> Column:
        return F.struct(code.alias("code"), at.cast("int").alias("status"))

    answered = status.isNotNull()
    return (
        F.when(is_request & own_code.isNotNull(), kind(F.when(own_code == "", F.lit("API_ERROR")).otherwise(own_code), F.coalesce(status, F.lit(0))))
        .when(is_request & transport_code.eqNullSafe(F.lit("ECONNABORTED")), kind(F.lit("TIMEOUT"), F.lit(408)))
        .when(is_request & ~answered, kind(F.lit("NETWORK_ERROR"), F.lit(0)))
        .when(is_request, kind(F.concat(F.lit("HTTP_"), status.cast("string")), status))
        .when(is_error, kind(F.lit("CLIENT_ERROR"), F.lit(0)))
        .otherwise(kind(F.lit("UNKNOWN_ERROR"), F.lit(0)))
    )
