"""Column functions on names, titles, amounts and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.params import BOARD_CHANGE, CONTRACT, EXCLUDED

NUMBER = r"(\d[\d,]*(?:\.\d+)?)"
# Legal forms that a company's name goes without.
LEGAL_FORMS = r"\b(limited|ltd|pvt|private|public|incorporated|inc|llp|company|co|corporation|corp|and|&)\b"
# States, in order of precedence, and words of the central government.
STATES = ("maharashtra", "telangana", "karnataka", "tamil nadu", "west bengal", "odisha", "andhra pradesh", "bihar")
CENTRAL = ("nhai", "railway", "defense", "ministry", "central")


def normal_name(name: Column) -> Column:
    """Lower case, without punctuation and legal forms, single spaces; '' for null."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[.\-,()'\"/\\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, LEGAL_FORMS, " "), r"\s+", " "))


def announcement_kind(title: Column) -> Column:
    """'contract', 'board_change' or null; an excluded title is null whatever else it says."""
    return F.when(title.rlike(EXCLUDED), None).when(title.rlike(CONTRACT), "contract").when(title.rlike(BOARD_CHANGE), "board_change")


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), ",", "").try_cast("double")


def rupees(text: Column) -> Column:
    """An amount in Indian notation: crore (1e7) before lakh (1e5) before a plain number; null if there is none."""
    x = F.trim(F.replace(text, F.lit("₹"), F.lit("")))
    crore, lakh = _number(x, rf"(?i){NUMBER}\s*(?:cr(?:ore)?|crores?)"), _number(x, rf"(?i){NUMBER}\s*(?:lakhs?|lac)")
    return F.coalesce(crore * 1e7, lakh * 1e5, _number(x, r"([\d,]+(?:\.\d+)?)"))


def contract_value_cr(text: Column) -> Column:
    """The first amount after Rs, INR or the rupee sign, in crores: millions are tenths, billions hundreds, no unit is rupees."""
    pattern = r"(?i)(?:rs\.?|inr|₹)\s*([\d,.]+)\s*(crore|cr|million|billion)?"
    value, unit = _number(text, pattern), F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(unit == "million", value / 10).when(unit == "billion", value * 100).when(unit == "", value / 1e7).otherwise(value)


def issuing_state(text: Column) -> Column:
    """The first of STATES that the text names, else 'central' by its words, else 'unknown'."""
    x, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("unknown")
    for words, told in ((CENTRAL, "central"), *(((s,), s) for s in reversed(STATES))):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(x, F.lit(w))
        out = F.when(has, told).otherwise(out)
    return out


def bond_year(text: Column, default: int = 2023) -> Column:
    """The year of 12-Apr-19, of a 20xx anywhere, or of a trailing -yy, in this order."""
    dated = F.year(F.try_to_date(text, "dd-MMM-yy"))
    full = F.regexp_extract(text, r"(20\d{2})", 1).try_cast("int")
    short = F.lit(2000) + F.regexp_extract(text, r"-(\d{2})$", 1).try_cast("int")
    return F.coalesce(dated, full, short, F.lit(default)).cast("int")


def event_date(text: Column, as_of: Column) -> Column:
    """An ISO date or date-time, dd/MM/yyyy, dd-MM-yyyy or dd MMM yyyy; as_of where none fits."""
    iso = F.try_to_date(F.substring_index(text, "T", 1), "yyyy-MM-dd")
    return F.coalesce(iso, *[F.try_to_date(text, f) for f in ("dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy")], as_of)


def debt_to_equity(ratio: Column, debt: Column, equity: Column) -> Column:
    """A ratio over 10 is in per cent; without one, debt over a positive equity."""
    return F.when(ratio.isNotNull(), F.when(ratio > 10, ratio / 100).otherwise(ratio)).when(equity > 0, debt / equity)


def director_number(text: Column) -> Column:
    """A director's number of 7 or 8 digits, with leading zeros to 8; else null."""
    return F.when(F.trim(text).rlike(r"^\d{7,8}$"), F.lpad(F.trim(text), 8, "0"))


def money(value: Column) -> Column:
    """'1.50 Cr', '2.00 Lakh' or the number with commas."""
    return F.when(value >= 1e7, F.concat(F.format_number(value / 1e7, 2), F.lit(" Cr"))).when(value >= 1e5, F.concat(F.format_number(value / 1e5, 2), F.lit(" Lakh"))).otherwise(F.format_number(value, 0))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def months_until(year: Column, month: Column, as_of: Column) -> Column:
    """Whole calendar months, whatever the day."""
    return (year - F.year(as_of)) * 12 + month - F.month(as_of)


def fenced_json(text: Column) -> Column:
    """A model's answer without markdown fences."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?|```\s*$", ""), r"^\s+|\s+$", "")
