"""IBAN: validity and mask."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgercheck.fixed import IBAN_ACCOUNT_FORMAT

_CLASSES = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Za-z0-9]"}


def _pattern() -> str:
    """One pattern over all countries: country code, check digits, account part."""
    countries = []
    for country, form in IBAN_ACCOUNT_FORMAT.items():
        account = "".join(
            f"{_CLASSES[kind]}{{{count}}}" for count, kind in re.findall(r"(\d+)([nac])", form)
        )
        countries.append(f"{country}[0-9]{{2}}{account}")
    return "^(?:" + "|".join(countries) + r")\z"


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capitals, letters counting from 10."""
    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        value = F.when(code < 58, code - 48).otherwise(code - 55)
        return F.pmod(rest * F.when(code < 58, F.lit(10)).otherwise(F.lit(100)) + value, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban_valid(iban: Column) -> Column:
    """True or false by country form and check digits; NULL when there is no IBAN."""
    tail = F.concat(F.substring(iban, 5, 1 << 30), F.substring(iban, 1, 4))
    check = F.substring(iban, 3, 2)
    sound = iban.rlike(_pattern()) & check.between("02", "98")
    return F.when(
        F.trim(iban) != "",
        F.when(sound, mod97(F.upper(tail)) == 1).otherwise(F.lit(False)),
    )


def iban_mask(iban: Column) -> Column:
    """The first and last four characters; the rest never leaves the model."""
    return F.concat(F.substring(iban, 1, 4), F.lit(" … "), F.right(iban, F.lit(4)))
