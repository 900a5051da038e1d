"""Small functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fizzbuzz(n: Column) -> Column:
    """Fizz, Buzz, FizzBuzz or the number; 0 is "0"."""
    return (
        F.when(n == 0, "0")
        .when(n % 15 == 0, "FizzBuzz")
        .when(n % 3 == 0, "Fizz")
        .when(n % 5 == 0, "Buzz")
        .otherwise(n.cast("string"))
    )


def vat_inclusive_price(price: Column, rate: Column) -> Column:
    return price * (F.lit(1) + rate)


def price_of_json(body: Column) -> Column:
    """The price in a JSON body {"price": number}."""
    return F.from_json(body, "price double")["price"]


def rate_of_json(body: Column) -> Column:
    """The rate in a JSON body {"vat_rate": number}."""
    return F.from_json(body, "vat_rate double")["vat_rate"]


def backoff_ms(attempt: Column, jitter_ms: Column | None = None) -> Column:
    """Doubling waits from 2 ms, with jitter, up to 32 s; 32 s from the 31st attempt on."""
    wait = (F.lit(2) * F.pow(F.lit(2.0), F.least(attempt, F.lit(31)))).cast("long")
    return F.least(wait + (F.lit(0) if jitter_ms is None else jitter_ms), F.lit(32_000)).cast("long")


def rtt_ms(line: Column) -> Column:
    """Milliseconds in a ping's reply, at single precision; null without one."""
    found = F.regexp_extract(line, r"time[=<]([\d.]+)[ ]?ms", 1)  # a fixed value: the form of ping's replies
    return F.when(found != "", found.try_cast("float").cast("double"))


def sum_of_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def same_bytes(a: Column, b: Column) -> Column:
    """Equal length and bytes; null is equal to nothing."""
    return F.coalesce(a.cast("binary") == b.cast("binary"), F.lit(False))


def fingerprint(body: Column) -> Column:
    """SHA-256 of bytes, in hexadecimal."""
    return F.sha2(body.cast("binary"), 256)
