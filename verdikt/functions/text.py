"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Col = str | Column


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every white-space character (``trim`` alone removes blanks only).
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Col) -> Column:
    """The text without white space at its ends.  Trimming looks at every character, so a text with visible ends is left as it is."""
    c = col(c)
    visible = lambda at: F.substring(c, at, 1).between("!", "~")
    return F.when(visible(1) & visible(-1), c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def nonblank(c: Col) -> Column:
    s = strip(c)
    return F.when(F.length(s) > 0, s)


def to_int(c: Col) -> Column:
    """Integer reading of a text column: digits with optional minus signs in front, else null."""
    # the cast drops the white space itself; most numbers are one digit, which needs no pattern
    digit = (F.length(col(c)) == 1) & col(c).between("0", "9")
    return F.when(digit | col(c).rlike(r"^\s*-*\d+\s*$"), col(c).try_cast("bigint"))


def json_int(c: Col) -> Column:
    """Integer reading of a JSON number or text: also of numbers like 3.0 and of true and false."""
    whole = F.when(col(c).rlike(r"^-?\d+\.0+$"), F.split(col(c), r"\.")[0].try_cast("bigint"))
    return F.coalesce(to_int(c), whole, F.when(col(c) == "true", 1).when(col(c) == "false", 0).cast("bigint"))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def share(cond: Column) -> Column:
    """Mean of a condition, counting null as false."""
    return F.avg(F.coalesce(cond.cast("double"), F.lit(0.0)))


def n_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def draw_key(seed: object, *keys: Col) -> Column:
    """Seeded draw order: sorting by it is a shuffle that does not depend on the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]).cast("binary"))


def stable_int(c: Column) -> Column:
    """First 32 bits of an md5 as a number in [0, 2^32)."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that holds, else null; checks that are null do not hold."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in checks])


def first_line(c: Col) -> Column:
    return F.regexp_extract(col(c), r"\A[^\n]*", 0)
