"""Normalisers as column expressions: text in, canonical text and flags out, no Python code per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as blank, compared exactly after trimming.
BLANK = ["", "-", "--", ".", "없음", "미정", "n/a", "na", "null", "none", "NULL", "None", "nan", "NaN", "0000-00-00"]
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = "".join(map(chr, range(0x21, 0x7F)))


def let(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


#: The characters that Unicode calls white space.
_SPACES = list(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; cells that have none there are passed on as they are."""
    return F.when(F.substring(c, 1, 1).isin(_SPACES) | F.substring(c, -1, 1).isin(_SPACES), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


_BLANK = "|".join(re.escape(b) for b in sorted(BLANK, key=len, reverse=True))


def is_blank(c: Column) -> Column:
    """Null, or one of BLANK with white space of any kind around it; looked at once from the front, without going back."""
    return c.isNull() | c.rlike(rf"(?U)^\s*+(?:{_BLANK})?+\s*+$")


#: Texts that squeeze() leaves alone: words of usual characters with one space between.
_SQUEEZED = r"^(?:[!-~가-힣０-９]++(?: [!-~가-힣０-９]++)*+)?+\z"


def squeeze(c: Column) -> Column:
    """Trimmed, with tabs, line ends, no-break and wide spaces, and runs of spaces as one space; null if nothing changes."""
    out = F.regexp_replace(strip(c), "[\\t\\r\\n　 ]+| {2,}", " ")
    # most cells have nothing to change, which one look tells
    return F.when(~c.rlike(_SQUEEZED) & c.rlike("(?U)^\\s|\\s$|[\\t\\r\\n\u3000\u00a0]| {2}"), F.when(out != c, out))


def half_width(c: Column) -> Column:
    return F.translate(c, _FULL, _HALF)


def text(c: Column) -> Column:
    """Half-width, trimmed, single spaces, one form of the company marker."""
    return F.regexp_replace(F.regexp_replace(strip(half_width(c)), " {2,}", " "), "㈜", "(주)")


def _part(c: Column, unit: str, scale: int) -> tuple[Column, Column]:
    """What stands before a unit, scaled (a bare unit counts one; null if it is no number), and what comes after it."""
    there, x = c.contains(unit), F.substring_index(c, unit, 1)
    value = F.when(~there, F.lit(0)).when(x == "", F.lit(scale)).otherwise(x.try_cast("decimal(30,8)") * scale)
    return value, F.when(there, F.substring_index(c, unit, -1)).otherwise(c)


def _small(c: Column) -> Column:
    """A segment below ten thousand: a number, or numbers before 천, 백, 십; null if there is none."""

    def added(seg: Column) -> Column:
        total, rest = F.lit(0), seg
        for unit, scale in (("천", 1000), ("백", 100), ("십", 10)):
            value, rest = _part(rest, unit, scale)
            total = total + value
        return total + F.when(rest == "", F.lit(0)).otherwise(rest.try_cast("decimal(30,8)"))

    return F.when(c.rlike("[천백십]"), let(c, added)).otherwise(c.try_cast("decimal(30,8)"))


#: What a unit in a column's header multiplies plain numbers by.
UNITS = {"억": 10**8, "만": 10**4, "천": 10**3}
#: Numbers as they may stand alone, without commas and spaces.
_PLAIN = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
_UNITED = r"^([0-9.천백십]+억)?([0-9.천백십]+만)?([0-9.천백십]*|[+-][0-9.]+)원?$"


def _money(c: Column) -> Column:
    return strip(F.regexp_replace(F.translate(strip(c), "０１２３４５６７８９，．", "0123456789,."), r"[₩\\]|KRW", ""))


def _bare(t: Column) -> Column:
    return F.translate(t, ", ", "")


def _scale(unit: str | None) -> int | None:
    return UNITS.get((unit or "").rstrip("원").strip())


def amount(c: Column, unit: str | None = None) -> Column:
    """A whole amount of money as DECIMAL(20,0), null if the text is none: 1,000,000  ₩5,000  5천만원  1억 2천만  1.5억  -500.

    unit: that of the column's header (억, 만 or 천, with or without 원); it scales plain numbers.
    Cells of digits and commas, with or without 만 and 원, are cast without any further look.
    """
    scale = _scale(unit)
    whole = lambda x: F.when(x == F.floor(x), x).try_cast("decimal(20,0)")
    number = lambda t: F.translate(_bare(t), "_", "").try_cast("decimal(30,8)")

    def read(t: Column) -> Column:
        plain = _bare(t).rlike(_PLAIN)
        if scale is not None:
            return F.when(plain, let(number(t) * scale, whole)).otherwise(_united(t))
        return F.when(plain, let(number(t), whole)).otherwise(_united(t))

    if scale is not None:
        return let(_money(c), read)
    # the usual forms need no steps, which spares them the lambdas
    plain, man = F.translate(c, ",원", "").try_cast("decimal(20,0)"), (F.translate(c, "만원", "").try_cast("decimal(20,0)") * 10_000).try_cast("decimal(20,0)")
    return F.when(c.rlike("^[0-9][0-9,]{0,17}원?$"), plain).when(c.rlike("^[0-9]{1,12}만원?$"), man).otherwise(let(_money(c), read))


def amount_certain(c: Column, unit: str | None = None) -> Column:
    """False for plain numbers that the header's unit scales."""
    return F.lit(True) if _scale(unit) is None else ~_bare(_money(c)).rlike(_PLAIN)


def _united(text: Column) -> Column:
    """Amounts with 억, 만, 천, 백, 십 or 원; nothing is zero but what begins with 0."""

    def total(t: Column) -> Column:
        bare = F.regexp_replace(t, "원$", "")
        eok, rest = F.when(bare.contains("억"), F.substring_index(bare, "억", 1)), F.substring_index(bare, "억", -1)
        man, rest = F.when(rest.contains("만"), F.substring_index(rest, "만", 1)), F.substring_index(rest, "만", -1)
        zero = F.lit(0).cast("decimal(30,8)")
        add = lambda there, seg, scale: F.when(there, _small(seg) * scale).otherwise(zero)
        return add(eok.isNotNull(), eok, 10**8) + add(man.isNotNull(), man, 10**4) + add(rest != "", rest, 1)

    def signed(t: Column) -> Column:
        return let(total(t), lambda x: F.when(((x != 0) | t.startswith("0")) & (x == F.floor(x)), x).try_cast("decimal(20,0)"))

    return let(F.regexp_replace(text, r"[,_\s]", ""), lambda t: F.when(t.rlike(_UNITED) & t.rlike("[억만천백십원]"), signed(t)))


_SHORT = r"^([0-9]{2})[-./]([0-9]{1,2})[-./]([0-9]{1,2})$"


def _made(t: Column, form: str, to: str) -> Column:
    """The date that the groups of a layout make, null if the text isn't in it or the day doesn't exist."""
    return F.when(t.rlike(form), F.regexp_replace(t, form, to).try_cast("date"))


def date(c: Column, period: tuple[str, str] | None = None) -> Column:
    """STRUCT<value DATE, certain BOOLEAN>: the first layout that fits; null value if none does.

    Two digits are a year from 2000 on; such a day is certain within the period, and
    outside it if month and day don't make another day the other way round.
    """
    sure = lambda day, certain: F.struct(day.alias("value"), (day.isNotNull() & certain).alias("certain"))
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), sure(c.try_cast("date"), F.lit(True))).otherwise(let(strip(c), lambda t: _date(t, period, sure)))


def _date(t: Column, period: tuple[str, str] | None, sure) -> Column:
    ymd = "$1-$2-$3"
    fifth = F.substring(t, 5, 1)
    # the fifth character tells which layouts can fit
    year_first = (
        F.when(fifth == "-", _made(t, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})([ T][0-9]{2}:[0-9]{2}.*)?$", ymd))
        .when(fifth.isin(".", "/"), _made(t, r"^([0-9]{4})[./]\s*([0-9]{1,2})[./]\s*([0-9]{1,2})\.?$", ymd))
        .when(fifth == "년", _made(t, r"^([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일?$", ymd))
        .otherwise(F.coalesce(_made(t, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", ymd), F.when(t.rlike("^0*[3-6][0-9]{4}$") & t.try_cast("int").between(30000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int")))))
    )
    slash = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    month_first, day_first = _made(t, slash, "$3-$1-$2"), _made(t, slash, "$3-$2-$1")
    a, b = (F.substring_index(F.substring_index(t, "/", i), "/", -1).try_cast("int") for i in (1, 2))
    one = F.coalesce(a.between(1, 12) != b.between(1, 12), F.lit(False))
    short, swapped = _made(t, _SHORT, "20$1-$2-$3"), _made(t, _SHORT, "20$1-$3-$2")
    within = short.between(*(F.lit(x).cast("date") for x in period)) if period else F.lit(False)
    return (
        F.when(t.rlike(slash), sure(F.coalesce(month_first, day_first), one))
        .when(t.rlike(_SHORT), sure(short, within | F.coalesce(swapped == short, F.lit(True))))
        .otherwise(sure(year_first, F.lit(True)))
    )


def simple_date(c: Column) -> Column:
    """STRUCT<value DATE, ambiguous BOOLEAN> by the older list of layouts: two-digit months and days, month first between slashes; two-digit years are ambiguous."""

    def read(t: Column) -> Column:
        ymd = "$1-$2-$3"
        forms = [r"^([0-9]{4})-([0-9]{2})-([0-9]{2})([ T][0-9]{2}:[0-9]{2}.*)?$", "^([0-9]{4})([0-9]{2})([0-9]{2})$", r"^([0-9]{4})\.([0-9]{2})\.([0-9]{2})$", "^([0-9]{4})/([0-9]{2})/([0-9]{2})$"]
        day = F.coalesce(*(_made(t, f, ymd) for f in forms), _made(t, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2"))
        return F.struct(day.alias("value"), t.rlike("^[0-9]{2}[-./][0-9]{2}[-./][0-9]{2}$").alias("ambiguous"))

    return let(strip(c), read)


def digits(c: Column) -> Column:
    # digits and hyphens, the usual form, need no look at each character
    return F.when(c.rlike(r"^[0-9-]*+\z"), F.replace(c, F.lit("-"), F.lit(""))).otherwise(F.regexp_replace(half_width(c), "[^0-9]", ""))


#: Weights of the first nine digits of a business number.
WEIGHTS = [1, 3, 7, 1, 3, 7, 1, 3, 5]


def check_digit_ok(c: Column) -> Column:
    """Whether the tenth digit of a business number is right; null if it has not ten digits."""

    def right(n: Column) -> Column:
        at = [F.floor(n / 10 ** (9 - i)) % 10 for i in range(10)]
        total = sum((w * x for w, x in zip(WEIGHTS, at, strict=False)), F.lit(0)) + F.floor(at[8] * 5 / 10)
        return (10 - total % 10) % 10 == at[9]

    number = lambda x: let(digits(x), lambda d: F.when(F.length(d) == 10, d).try_cast("long"))
    # the cell is named once, for filters that are pushed below the projection that makes it
    return let(let(c, number), right)


def business_number(c: Column) -> Column:
    """XXX-XX-XXXXX, or null if there are not ten digits."""
    made = lambda d: F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 5)))
    return F.when(c.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{5}\z"), c).otherwise(let(digits(c), made))


def business_key(c: Column) -> Column:
    return F.coalesce(business_number(c), c)


def phone(c: Column) -> Column:
    """0xx-xxxx-xxxx, or null if the digits don't make a number."""
    d = digits(c)
    return F.when(strip(c).rlike("^0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}$"), strip(c)).when(d.rlike("^0[0-9]{9}$"), F.regexp_replace(d, "^(...)(...)(....)$", "$1-$2-$3")).when(d.rlike("^0[0-9]{10}$"), F.regexp_replace(d, "^(...)(....)(....)$", "$1-$2-$3"))


def year(c: Column) -> Column:
    """The first run of four or eight digits gives the year."""
    return F.nullif(F.regexp_extract(c, r"(?<![0-9])([0-9]{4})(?:[0-9]{4})?(?![0-9])", 1), F.lit(""))


def kind(c: Column) -> Column:
    """empty, numeric, date or text."""
    t = strip(c)
    return F.when(c.isNull() | (t == ""), "empty").when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "numeric").when(F.try_to_date(F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t), "yyyy-MM-dd").isNotNull(), "date").otherwise("text")
