"""Column functions: time keys, hashes, risk rules and seeded choices. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_key(date: Column, time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 of a date and a time string; null where they don't parse."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(pattern)))


def epoch_or_zero(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit(pattern))), F.lit(0))


def seconds_of_day(time: Column, default: int = 43_200) -> Column:
    """Seconds of ``h:m:s``; noon where it doesn't parse."""
    part = F.split(time, ":")
    at = lambda i: F.try_element_at(part, F.lit(i)).try_cast("int")
    return F.coalesce(at(1) * 3600 + at(2) * 60 + at(3), F.lit(default))


def hour_or_default(text: Column, default: int = 12) -> Column:
    """The number that the text is; the literal reading of a rule that is meant for hours."""
    return F.coalesce(text.try_cast("int"), F.lit(default))


def hour_of(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(86_400)) / 3600)


def off_hours(hour: Column) -> Column:
    return ((hour < 6) | (hour > 22)).cast("int")


def amount_text(amount: Column) -> Column:
    """A double as fixed decimals, the same text in every engine."""
    return amount.cast("decimal(18,2)").cast("string")


def poh_input(sender: Column, receiver: Column, amount: Column, when: Column) -> Column:
    return F.concat_ws("|", F.concat_ws("->", sender, receiver), amount_text(amount), when)


def poh_hash(sender: Column, receiver: Column, amount: Column, when: Column) -> Column:
    return F.sha2(poh_input(sender, receiver, amount, when).cast("binary"), 256)


def rule_score(amount: Column, kind: Column, currency: Column, sender_region: Column, receiver_region: Column, kinds: list[str], rare: list[str], common: list[str], regions: list[str], large: float = 100_000.0) -> Column:
    """Six additive rules: 2.0 large amount, 1.5 kind of payment, 1.2 rare and 0.5 common currency, 0.8 for each region."""
    rules = ((amount > large, 2.0), (kind.isin(kinds), 1.5), (currency.isin(rare), 1.2), (currency.isin(common), 0.5), (sender_region.isin(regions), 0.8), (receiver_region.isin(regions), 0.8))
    total = F.lit(0.0)
    for test, weight in rules:
        total = total + F.when(test, weight).otherwise(0.0)
    return total


def edge_risk(label: Column, amount: Column, hour: Column, large: float = 5000.0) -> Column:
    """1.5 for the label, 1.0 for a large amount, 0.5 outside office hours."""
    return F.when(label == 1, 1.5).otherwise(0.0) + F.when(amount > large, 1.0).otherwise(0.0) + F.when((hour < 6) | (hour > 22), 0.5).otherwise(0.0)


def objective(recall: Column, f1: Column) -> Column:
    return 0.6 * recall + 0.4 * f1


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
