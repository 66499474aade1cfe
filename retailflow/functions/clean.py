"""Cleaning rules as native column expressions.

Missing values are SQL nulls throughout. Ids are strings; a trailing ".0", which numeric
exports leave behind, is removed from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand for "nothing", compared exactly.
NULL_TOKENS = ("", " ", "  ", "None", "none", "NULL", "null", "-", "--", "nan")
# Recoded stores and sexes.
STORES = {"kanzler-style.ru": "ИНТЕРНЕТ-МАГАЗИН"}
SEXES = {"male": "Мужской", "female": "Женский"}
# Names of months, of item types, and labels of what is unknown.
MONTHS = ("Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь")
IS_CATEGORY, IS_ITEM = "Категория", "Номенклатура"
UNKNOWN, UNKNOWN_GROUP = "Не указан", "Не указано"
# Upper ends of age groups and their labels.
AGE_GROUPS = ((13, "до 14"), (25, "14-25"), (35, "26-35"), (45, "36-45"), (55, "46-55"), (65, "56-65"))
OLDEST = "65+"
# Item kinds that the selection leaves out.
UNSELECTED_KINDS = ("Наборы трусов", "Трусы NOS (нижнее белье)", "Трусы (нижнее белье)", "Носки", "Носки NOS")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare_id(c: Column | str) -> Column:
    """An id without a trailing ".0". Only ids that hold one are matched."""
    c = col(c).cast("string")
    return F.when(F.contains(c, F.lit(".0")), F.regexp_replace(c, r"\.0$", "")).otherwise(c)


def item_code(*codes: Column | str) -> Column:
    """The first code that is there, without ".0", cut to 6 characters."""
    return F.substring(F.coalesce(*[bare_id(c) for c in codes]), 1, 6)


def to_number(c: Column | str) -> Column:
    """A double, null where the text is no number."""
    return col(c).cast("string").try_cast("double")


def whole(c: Column | str, default: int = 0) -> Column:
    """A number cut toward zero; what is no number gives the default."""
    n = to_number(c)
    return F.coalesce(F.when(F.isnan(n), None).otherwise(n), F.lit(float(default))).cast("long")


def clipped_quantity(c: Column | str, low: int = 1, high: int = 10) -> Column:
    """A quantity from low to high; a missing one is 1."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(to_number(c), F.lit(1.0))))


def discount_pct(base: Column | str, line: Column | str) -> Column:
    """Per cent off the base amount, rounded half to even; 0 where the base is 0."""
    b, n = col(base).cast("double"), col(line).cast("double")
    return F.coalesce(F.bround(F.try_divide(b - n, b) * 100.0, 0), F.lit(0.0)).cast("long")


def currency(code_ru: Column | str, code_kz: Column | str) -> Column:
    """RUB if the first code is there, else KZT if the second is."""
    return F.when(col(code_ru).isNotNull(), "RUB").when(col(code_kz).isNotNull(), "KZT")


def to_date(c: Column | str) -> Column:
    """The date of a timestamp or date text, null where it can't be read."""
    return F.try_to_timestamp(col(c).cast("string")).cast("date")


def age_at(event: Column | str, birth: Column | str) -> Column:
    """Full years at the event; before the birthday of that year one less."""
    e, b = col(event), col(birth)
    early = (F.month(e) * 100 + F.day(e)) < (F.month(b) * 100 + F.day(b))
    return (F.year(e) - F.year(b) - early.cast("int")).cast("int")


def age_group(age: Column | str) -> Column:
    a = col(age)
    out = F.when(a.isNull(), UNKNOWN)
    for high, label in AGE_GROUPS:
        out = out.when(a <= high, label)
    return out.otherwise(OLDEST)


def recode(c: Column | str, names: dict[str, str]) -> Column:
    """Names that are listed are replaced, others stay."""
    out = col(c)
    for old, new in names.items():
        out = F.when(col(c) == old, new).otherwise(out)
    return out


def full_name(last: Column | str, first: Column | str, middle: Column | str) -> Column:
    """The parts with a space between them, a missing one as empty, trimmed at the ends."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (last, first, middle)]))


def category(c: Column | str) -> Column:
    """A category id without ".0", dots, commas and outer blanks."""
    return F.trim(F.translate(bare_id(c), ".,", ""))


def category_path(*parts: Column | str) -> Column:
    """Cleaned parts joined by "_", without those that are missing; null if all are."""
    clean = F.filter(F.array(*[category(p) for p in parts]), lambda c: c != "nan")  # a null isn't kept either
    return F.when(F.size(clean) > 0, F.array_join(clean, "_"))


def known(c: Column | str) -> Column:
    """Null for a cell that stands for nothing."""
    return F.when(~F.array_contains(F.array(*map(F.lit, NULL_TOKENS)), col(c)), col(c))


def phone(*numbers: Column | str) -> Column:
    return F.coalesce(*[bare_id(n) for n in numbers])


def item_type(category_code: Column | str) -> Column:
    return F.when(col(category_code).isNotNull(), IS_CATEGORY).otherwise(IS_ITEM)


def label(c: Column | str, missing: str = UNKNOWN) -> Column:
    return F.coalesce(col(c), F.lit(missing))


def month_name(month: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), col(month).cast("int"))


def date_text(c: Column | str) -> Column:
    return F.date_format(col(c), "dd.MM.yyyy")


def period_text(low: Column | str, high: Column | str) -> Column:
    return F.concat(date_text(low), F.lit(" — "), date_text(high))


def grouped(n: Column | str) -> Column:
    """A whole number with dots between the thousands."""
    return F.translate(F.format_number(col(n), 0), ",", ".")


def ranked_line(name: Column | str, code: Column | str, n: Column | str) -> Column:
    return F.format_string("%s (%s) — %s", col(name), col(code).cast("string"), col(n).cast("string"))


def timestamp_or_epoch(c: Column | str) -> Column:
    return F.coalesce(F.try_to_timestamp(col(c).cast("string")), F.lit("1970-01-01 00:00:00").cast("timestamp"))
