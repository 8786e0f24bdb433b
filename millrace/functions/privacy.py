"""Masking of personal data as Column -> Column functions. The patterns are our own; tokens are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.filters import bound, gated

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
DASHED = r"[0-9]+-[0-9]+-[0-9]+"
#: Groups of four, or 4-6-5.
CARD = r"\b(?:(?:[0-9]{4}[ -]?){3}[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})\b"
PHONE = r"\b1[3-9][0-9]{9}\b"
#: Area code in parentheses or before one hyphen or space; without a mark between, digits are too often something else.
LANDLINE = r"(\(0[1-9][0-9]{1,2}\) ?|\b0[1-9][0-9]{1,2}[- ])[2-8][0-9]{6,7}\b"
QQ = r"(QQ|qq)[ :]{0,3}[1-9][0-9]{4,10}"
ID_CARD = r"\b[1-9][0-9]{16}[0-9Xx]\b"


def replace_ip(c: Column, token: str = "<IP>") -> Column:
    return gated(c, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: F.regexp_replace(t, IP, token))


#: EMAIL and DASHED for long runs of one class: a match begins where a run, or what the last match left of one, does,
#: and no run is given back, so the time is linear in the text. They match what the plain patterns match.
_EMAIL_ONCE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_DASHED_ONCE = r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++"


def replace_email(c: Column, token: str = "<EMAIL>") -> Column:
    return gated(c, lambda t: t.contains("@"), lambda t: F.regexp_replace(t, _EMAIL_ONCE, token))


def replace_customer_number(c: Column, token: str = "<NUMBER>") -> Column:
    return F.regexp_replace(c, _DASHED_ONCE, token)


def luhn(c: Column) -> Column:
    """Whether the digits of a string pass the Luhn sum and number 13, 15, 16 or 19."""
    digits = F.reverse(F.regexp_replace(c, "[^0-9]", ""))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda k: F.struct(k.alias("k"), F.try_to_number(F.substring(digits, k, 1), F.lit("9")).cast("int").alias("d")))
    doubled = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(F.when(x["k"] % 2 == 0, doubled(x["d"])).otherwise(x["d"]), F.lit(0)))
    return F.length(digits).isin(13, 15, 16, 19) & (total % 10 == 0)


def replace_bank_id(c: Column, token: str = "<CARD>") -> Column:
    """Card-shaped numbers that pass the Luhn sum are replaced wherever they occur."""

    def replaced(t: Column) -> Column:
        valid = F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(CARD), 0)), luhn)
        return F.aggregate(valid, t, lambda text, card: F.replace(text, card, F.lit(token)))

    return bound(c, replaced)


def replace_phone_number(c: Column, token: str = "<PHONE>") -> Column:
    """Mobile and landline numbers."""
    return F.regexp_replace(F.regexp_replace(c, PHONE, token), LANDLINE, token)


def replace_qq(c: Column, token: str = "<QQ>") -> Column:
    return F.regexp_replace(c, QQ, token)


def replace_id_card(c: Column, token: str = "<ID>") -> Column:
    return F.regexp_replace(c, ID_CARD, token)


def replace_number(c: Column) -> Column:
    """Cards, telephone and QQ numbers and identity numbers, in this order; all have four digits in a row."""

    def rules(t: Column) -> Column:
        for rule in (replace_bank_id, replace_phone_number, replace_qq, replace_id_card):
            t = rule(t)
        return t

    return gated(c, lambda t: t.rlike("[0-9]{4}"), rules)


def mask_private(c: Column) -> Column:
    return replace_number(replace_email(replace_ip(c)))
