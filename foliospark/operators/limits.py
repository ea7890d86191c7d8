"""Rate limits, retries and backoff."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foliospark.functions.names import free

RETRYABLE = (408, 429, 500, 502, 503, 504)
WINDOW_S, DAY_S = 60, 86_400


#: A key's calls are counted in spans of so many windows, each in a task of its own.
SPAN_WINDOWS = 64


def sliding_counts(calls: DataFrame, key: str, ts: str, seconds: int = WINDOW_S, oldest: bool = False) -> DataFrame:
    """``calls`` with ``in_window``: calls of the key in the last ``seconds``, both ends included, its own included; with ``oldest`` also
    the age in seconds of the first of them.

    A key's history is cut into spans of time, so that a hot key is counted by many tasks. What a span's first calls look back to, the last
    window of the span before, is copied into it: one call of SPAN_WINDOWS on average. Calls without a time are counted together."""
    window, span = seconds * 1_000_000, seconds * 1_000_000 * SPAN_WINDOWS
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    at, own, cut = free(calls, "micros", "own", "cut")
    rows = calls.withColumn(at, micros).withColumn(own, F.floor(F.col(at) / F.lit(span)))
    after = F.floor((F.col(at) + window) / F.lit(span))
    both = F.when(after > F.col(own), F.array(own, after)).otherwise(F.array(own))
    w = Window.partitionBy(key, cut).orderBy(at).rangeBetween(-window, 0)
    out = rows.withColumn(cut, F.explode(both)).withColumn("in_window", F.count(F.lit(1)).over(w))
    if oldest:
        out = out.withColumn("oldest_age", (F.col(at) - F.min(at).over(w)) / 1e6)
    return out.filter(F.col(cut).eqNullSafe(F.col(own))).drop(at, own, cut)


def wait_seconds(oldest_age: Column, in_window: Column, most: int) -> Column:
    return F.when(in_window >= most, F.greatest(F.lit(0.0), WINDOW_S - oldest_age + 0.1)).otherwise(0.0)


def daily_quota(calls: DataFrame, most: int, *, key: str = "key", seq: str = "seq", seconds: str = "seconds") -> DataFrame:
    """key, seq, used, refused for each call. A key's calls pass one task in order of time and seq, but none are held there: a
    window that is anchored at its first call can't be cut into parts."""
    dealt = calls.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(seconds).cast("double").alias("seconds"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "seconds", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, n = object(), None, 0
        for batch in batches:
            keys, used, refused = batch.column(0).to_pylist(), [], []
            for k, t in zip(keys, batch.column(2).to_pylist()):
                if k != at:
                    at, start, n = k, None, 0
                if start is None or t - start >= DAY_S:
                    start, n = t, 0
                refused.append(n >= most)
                n += n < most
                used.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(used, pa.int64()), pa.array(refused, pa.bool_())], names=["key", "seq", "used", "refused"])

    return dealt.mapInArrow(fold, "key long, seq long, used long, refused boolean")


def backoff_ceiling(attempt: Column, base: float = 4.0, cap: float = 120.0) -> Column:
    return F.greatest(F.lit(base), F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1)))


def backoff(attempt: Column, hint: Column, is_api_error: Column, base: float = 4.0, cap: float = 120.0, seed: int = 0) -> Column:
    """Seconds to wait: the server's hint within its bounds, else drawn between base and ceiling; for other errors a multiple
    of base."""
    drawn = base + F.rand(seed) * (backoff_ceiling(attempt, base, cap) - base)
    return F.when(~is_api_error, F.least(F.lit(cap), base * attempt)).when(hint.isNotNull(), F.least(F.lit(cap), F.greatest(F.lit(0.5), hint))).otherwise(drawn)


def is_retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


# The keys that name a delay.
HINT_KEYS = ("retryDelay", "retry_delay", "Retry-After", "retryAfter")
_PLAIN = re.compile(r"[0-9]+(\.[0-9]+)?")


def _seconds(given: object) -> float | None:
    """A number, or a text with a plain decimal and perhaps an s behind it."""
    if isinstance(given, (int, float)):
        return float(given)
    if isinstance(given, str):
        number = given.strip().removesuffix("s").strip()
        return float(number) if _PLAIN.fullmatch(number) else None
    return None


def delay_of(details: str | None) -> float | None:
    """The first delay in a JSON text: its objects' items in their order, depth first. What a hint's key holds is taken or passed over, not
    searched. An array's entries count at the top only if they are objects. None if there is none or the text isn't JSON."""
    try:
        given = json.loads(details or "")
    except ValueError:
        return None
    waiting = [given] if isinstance(given, dict) else [x for x in reversed(given) if isinstance(x, dict)] if isinstance(given, list) else []
    while waiting:
        x = waiting.pop()
        if isinstance(x, _Hint):
            if (seconds := _seconds(x.value)) is not None:
                return seconds
        elif isinstance(x, dict):
            waiting += [_Hint(v) if k in HINT_KEYS else v for k, v in reversed(x.items())]
        elif isinstance(x, list):
            waiting += reversed(x)
    return None


@dataclass
class _Hint:
    value: object


def delay_said(message: str | None) -> float | None:
    """The first delay that a message states: the words retry and delay, together or with a space or an underscore between them, a
    colon or an equals sign, a plain decimal and a unit that begins with s; quotes may close the words and open the number."""
    low = (message or "").lower()
    at = low.find("delay")
    while at >= 0:
        before, rest = low[:at], low[at + 5 :]
        if before.removesuffix("_" if before.endswith("_") else " ").endswith("retry"):
            rest = rest[rest[:1] in ("'", '"') :].lstrip()
            if rest[:1] in (":", "="):
                rest = rest[1:].lstrip()
                rest = rest[rest[:1] in ("'", '"') :].lstrip() if rest[:1] in ("'", '"') else rest
                number = _PLAIN.match(rest)
                if number and rest[number.end() :].lstrip().startswith("s"):
                    return float(number[0])
        at = low.find("delay", at + 1)
    return None


@F.pandas_udf(DoubleType())
def _delays(details: pd.Series, message: pd.Series) -> pd.Series:
    found = [delay_of(d) if d else None for d in details]
    return pd.Series([delay_said(m) if f is None else f for f, m in zip(found, message)], dtype="float64")


def retry_hint(details: Column, message: Column) -> Column:
    """Seconds from an error's JSON, at any depth, else from its message; null without either. Errors are few: they are read in Python."""
    found = _delays(F.coalesce(details, F.lit("")), F.coalesce(message, F.lit("")))
    return F.when(~F.isnan(found), found)
