"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pegwatch.rules import HOUR


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nearest_hour(ts: Column | str, tolerance: int | None = None) -> Column:
    """Nearest whole hour (half to even) as epoch seconds, NULL beyond ``tolerance`` seconds."""
    hour = (F.bround(col(ts) / HOUR) * HOUR).cast("bigint")
    return hour if tolerance is None else F.when(F.abs(col(ts) - hour) <= tolerance, hour)


def iso_hour(ts: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(ts)), "yyyy-MM-dd'T'HH:00'Z'")


def known_time(start: Column | str, confirmed: Column | str) -> Column:
    """Second from which an episode is known: an hour after its start, later if confirmation came later."""
    return F.greatest(col(start) + HOUR, F.coalesce(col(confirmed), col(start)))


def is_clean(flag: Column | str) -> Column:
    """True for a blank or false-like quality flag, whatever type it was stored as."""
    text = F.lower(F.trim(F.coalesce(col(flag).cast("string"), F.lit(""))))
    return text.isin("", "false", "0", "0.0", "nan", "none")


def is_true(flag: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(flag).cast("string"), F.lit("")))).isin("true", "1", "1.0")


def severity(depth: Column | str, tiers: Sequence[tuple[float, str]]) -> Column:
    """First tier whose cut lies above the absolute depth; a NULL depth takes the first tier."""
    out = F.when(col(depth).isNull(), F.lit(tiers[0][1]))
    for cut, name in tiers:
        out = out.when(F.abs(col(depth)) < cut, F.lit(name))
    return out.otherwise(F.lit(tiers[-1][1]))


def threshold_units(dev: Column | str, theta: Column | str) -> Column:
    """Deviation in units of the asset's threshold. ``least`` and ``greatest`` would turn NULL into a bound."""
    d = col(dev)
    return F.when(d.isNotNull(), F.greatest(F.least(d, F.lit(1.0)), F.lit(-1.0)) / col(theta))


def clip(x: Column | str, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), lo), hi))


def log_level(x: Column | str) -> Column:
    return F.when(col(x).isNotNull(), F.log1p(F.greatest(col(x), F.lit(0.0))))


def guarded_ratio(num: Column | str, den: Column | str, floor: float = 1e4) -> Column:
    return F.when(col(den) >= floor, col(num) / col(den))


def log_add_exp0(x: Column | str) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(col(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(col(x))))


def tie_jitter(a: Column | str, b: Column | str) -> Column:
    """Deterministic tie-breaker below any score difference, from the CRC of the joined ids."""
    return F.crc32(F.concat_ws("|", col(a), col(b)).cast("binary")) / F.lit(2.0**32) * F.lit(1e-9)


def hash_uniform(*parts: Column | str) -> Column:
    """Number in [0, 1) from the first 12 hex digits of an MD5: the same on every engine and every re-run."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))


def hit_probability(w: Column | str, k: Column | str, n: Column | str) -> Column:
    """Chance that k of n rows drawn without replacement meet at least one of w given rows (w is at most 72)."""
    w, k, n = col(w).cast("bigint"), col(k).cast("double"), col(n).cast("double")
    log_miss = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(w - 1, F.lit(0))), F.lit(0.0),
        lambda acc, i: acc + F.log((n - k - i) / (n - i)),
    )
    return (
        F.when(w.isNull() | (w <= 0), F.lit(0.0))
        .when(n - w < k, F.lit(1.0))
        .otherwise(1.0 - F.exp(log_miss))
    )


def hex_bits(word: Column | str, low: int, width: int) -> Column:
    """``width`` bits (at most 52) from bit ``low`` upwards of an unsigned integer written as 64 hex digits."""
    first, last = low // 4, (low + width - 1) // 4
    digits = F.substring(col(word), 64 - last, last - first + 1)
    value = F.conv(digits, 16, 10).cast("bigint")
    return F.shiftright(value, low - 4 * first).bitwiseAND(F.lit((1 << width) - 1))


def hex_word(text: Column | str) -> Column:
    """A 0x-prefixed number padded to 64 hex digits, NULL for anything else."""
    digits = F.lower(F.substring(col(text), 3, 64))
    return F.when(F.lower(col(text)).rlike("^0x[0-9a-f]{1,64}$"), F.lpad(digits, 64, "0"))


def bit_set(text: Column | str, bit: Column | str) -> Column:
    """Whether ``bit`` (0 is the lowest) of a 0x-prefixed bitmap is set."""
    digit = F.substring(hex_word(text), (F.lit(64) - F.floor(col(bit) / 4)).cast("int"), F.lit(1))
    return F.expr("true") & (
        F.shiftright(F.conv(digit, 16, 10).cast("int"), 0).bitwiseAND(
            F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), (col(bit) % 4 + 1).cast("int"))) > 0
    )


def hour_keys(first: Column | str, last: Column | str, step: int = HOUR) -> Column:
    """All grid times from ``first`` to ``last``: turns a range condition into an equality key."""
    return F.explode(F.when(col(first) <= col(last), F.sequence(col(first), col(last), F.lit(step).cast("bigint"))))
