"""Closed vocabularies, odds, scores and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result texts of the first source, with method and decision type.
RESULTS = {
    "ko/tko": ("ko_tko", None), "tko - doctor's stoppage": ("ko_tko", None), "submission": ("submission", None), "decision - unanimous": ("decision", "unanimous"),
    "decision - split": ("decision", "split"), "decision - majority": ("decision", "majority"), "dq": ("dq", None), "overturned": ("overturned", None),
    "could not continue": ("other", None), "other": ("other", None),
}
# Stances that are told apart.
STANCES = ("orthodox", "southpaw", "switch")


def unknown_value(what: str, value: Column, kind: str = "string") -> Column:
    """An error for a spelling that no vocabulary has; nothing is guessed."""
    return F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))).cast(kind)


def result_method(result: Column, *, lenient: bool = False) -> Column:
    """struct(method, decision_type) of a result text; unknown raises, or is null if ``lenient``."""
    key = F.lower(F.trim(result))
    out = None
    for text, (method, kind) in RESULTS.items():
        s = F.struct(F.lit(method).cast("string").alias("method"), F.lit(kind).cast("string").alias("decision_type"))
        out = F.when(key == text, s) if out is None else out.when(key == text, s)
    missing = F.lit(None).cast("struct<method:string,decision_type:string>")
    return out.when(result.isNull(), missing) if lenient else out.when(result.isNull(), missing).otherwise(unknown_value("result", result, "struct<method:string,decision_type:string>"))


def stance(c: Column) -> Column:
    """Null or blank is unknown, an unlisted one other."""
    s = F.lower(F.trim(c))
    return F.when(F.coalesce(s, F.lit("")).isin("", "unknown"), "unknown").when(s.isin(*STANCES), s).otherwise("other")


def matchup(a: Column, b: Column, *, ordered: bool = True) -> Column:
    x, y = stance(a), stance(b)
    return F.concat_ws("_vs_", x, y) if ordered else F.concat_ws("_vs_", F.array_sort(F.array(x, y)))


def gender_of_class(weight_class: Column) -> Column:
    """struct(gender, guessed): women's classes are F, others M; null is guessed as M."""
    return F.struct(F.when(weight_class.startswith("Women's"), "F").otherwise("M").alias("gender"), weight_class.isNull().alias("guessed"))


def outcome_of_badges(b1: Column, b2: Column) -> Column:
    """win, draw or no_contest of the two badges of a bout; null for other pairs."""
    pair = F.array_join(F.array_sort(F.array(F.lower(b1), F.lower(b2))), "|")
    return F.when(pair == "l|w", "win").when(pair == "d|d", "draw").when(pair == "nc|nc", "no_contest")


def vocabulary_code(value: Column, vocabulary: list[str], other: str = "other") -> Column:
    """Index of a value; unseen ones have the index of ``other``, null stays null."""
    arr = F.array(*(F.lit(v) for v in vocabulary))
    at = F.array_position(arr, value) - 1
    return F.when(value.isNotNull(), F.when(at >= 0, at).otherwise(F.lit(vocabulary.index(other) if other in vocabulary else -1))).cast("int")


def moneyline_decimal(m: Column) -> Column:
    """Decimal price with three places; zero raises."""
    d = m.cast("decimal(12,2)")
    price = F.when(d > 0, 1 + F.try_divide(d, F.lit(100).cast("decimal(12,2)"))).when(d < 0, 1 + F.try_divide(F.lit(100).cast("decimal(12,2)"), -d)).when(d == 0, F.raise_error(F.lit("moneyline of 0")).cast("decimal(20,10)"))
    return F.round(price, 3).cast("double")


def devig(a: Column, b: Column) -> Column:
    """First side's probability without the margin; null for unusable prices."""
    ok = (a > 1) & (b > 1)
    return F.when(ok, F.try_divide(1 / F.nullif(a, F.lit(0.0)), 1 / F.nullif(a, F.lit(0.0)) + 1 / F.nullif(b, F.lit(0.0))))


def log_loss(y: Column, p: Column) -> Column:
    """Aggregate: mean log loss with probabilities clipped at 1e-15."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def accuracy(y: Column, p: Column) -> Column:
    """Aggregate: share of right calls; an exact 0.5 is no call."""
    call = F.when(p != 0.5, ((p > 0.5) == (y == 1)).cast("int"))
    return F.avg(call)


def multiclass_log_loss(y: Column, p: Column) -> Column:
    """Aggregate over a 0-based class and an array of probabilities."""
    return F.avg(-F.ln(F.least(F.greatest(F.element_at(p, (y + 1).cast("int")), F.lit(1e-15)), F.lit(1.0))))


def multiclass_brier(y: Column, p: Column) -> Column:
    hot = F.transform(p, lambda q, i: F.pow(q - F.when(i == y, 1.0).otherwise(0.0), 2))
    return F.avg(F.aggregate(hot, F.lit(0.0), lambda s, x: s + x))


def heuristic_probability(diff: Column, edge: Column) -> Column:
    """Chance from the sign of a difference: 0.5 plus or minus the edge, 0.5 when level or unknown."""
    return F.coalesce(0.5 + F.signum(diff) * edge, F.lit(0.5))


def app_today(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def whole_years(birth: Column, on: Column) -> Column:
    """Age in whole years; a birthday on 29 February comes on 1 March in common years."""
    before = F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(on) - F.year(birth) - before.cast("int")


def backoff(attempt: Column, base: float, cap: float, key: Column) -> Column:
    """Seconds to wait: half of the capped exponential fixed, half by a hash of the key (equal jitter)."""
    full = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return full / 2 + full / 2 * F.pmod(F.xxhash64(key, attempt), F.lit(10_000)) / 10_000


def retry_after(header: Column, default: int = 60, most: int = 3600) -> Column:
    """Seconds of a Retry-After header; unreadable or negative ones give the default."""
    n = F.when(F.trim(header).rlike(r"^\d{1,9}$"), F.trim(header).cast("int"))
    return F.least(F.coalesce(n, F.lit(default)), F.lit(most))


def is_fresh(fetched: Column, now: Column, ttl_seconds: Column, final_after: Column) -> Column:
    """Whether a cached page holds: for ever without a time to live, or if fetched once it was final."""
    return ttl_seconds.isNull() | F.coalesce(fetched >= final_after, F.lit(False)) | (F.unix_timestamp(now) - F.unix_timestamp(fetched) < ttl_seconds)


def error_disposition(kind: Column) -> Column:
    """struct(retry, reason) of an error class; the first rule that fits decides."""
    rule = lambda retry, reason: F.struct(F.lit(retry).alias("retry"), F.lit(reason).alias("reason"))
    return (
        F.when(kind.rlike("Block|Breaker"), rule(False, "blocked"))
        .when(kind.rlike("Parse|Layout|Vocabulary"), rule(False, "unreadable"))
        .when(kind.rlike("NotFound"), rule(False, "gone"))
        .when(kind.rlike("Timeout|Connection|Server|RateLimit"), rule(True, "transient"))
        .otherwise(rule(False, "unexpected"))
    )
