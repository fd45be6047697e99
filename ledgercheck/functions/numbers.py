"""Numbers in export text: amounts, percentages, integers, and money as text.

A number is read in steps, each a thin layer of columns over the one before:

    bare       the text without sign and blanks
    shape      how many separators it has, and what follows the last ones
    separator  the character that starts the decimals ('' none, NULL undecidable)
    literal    a plain number text with a dot

Most values are written plainly, with decimals that prove their separator: one pattern and a
cast read them.  Only the others take the steps, each as the argument of the next, so that a
step is worked out once and no row is copied from layer to layer.  The steps are plain string
functions; one pattern per value decides at the end whether the literal is a number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = {"amount": (15, 2), "percent": (5, 3)}

_PLAIN = r"^[0-9]+(\.[0-9]+)?\z"
# texts the steps below read the same way under any notation, and that always fit: without
# separators or with one or two decimals, thousands in groups or not
_PLAIN_DOT = r"^[+-]?(?:[0-9]{1,13}(?:\.[0-9]{1,2})?|[0-9]{1,3}(?:,[0-9]{3}){1,3}\.[0-9]{1,2})\z"
_PLAIN_COMMA = r"^[+-]?(?:[0-9]{1,13}|[0-9]{1,3}(?:\.[0-9]{3}){1,3}),[0-9]{1,2}\z"
_PLAIN_PERCENT = r"^[+-]?[0-9]{1,2}(?:[.,][0-9]{1,3})?\z"


def sign(text: Column) -> Column:
    """'-' for a negative number; a sign at the end counts before one at the start."""
    t = F.trim(text)
    minus = t.endswith("-") | (t.startswith("-") & ~t.endswith("+"))
    return F.when(minus, F.lit("-")).otherwise(F.lit(""))


def body(text: Column) -> Column:
    """The text without its one sign and without blanks between the digits."""
    t = F.trim(text)
    bare = (
        F.when(t.endswith("-") | t.endswith("+"), F.left(t, F.length(t) - 1))
        .when(t.startswith("-") | t.startswith("+"), F.substring(t, 2, 1 << 30))
        .otherwise(t)
    )
    return F.replace(bare, F.lit(" "), F.lit(""))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _behind_last(text: Column, mark: str) -> Column:
    return F.length(F.substring_index(text, mark, -1))


def shape(bare: Column) -> Column:
    """Dots, commas, and the characters behind the last of each."""
    return F.struct(
        _count(bare, ".").alias("dots"), _count(bare, ",").alias("commas"),
        _behind_last(bare, ".").alias("after_dot"), _behind_last(bare, ",").alias("after_comma"),
    )


def decimal_separator(s: Column, notation: Column) -> Column:
    """Which character starts the decimals of an amount, from its shape.

    Both characters: the later one.  One character, several times: it groups thousands.
    One character once with exactly three digits behind it: only the notation of the
    file ('de' or 'iso') can tell, and without one the value stays undecided.
    """
    dots, commas = s["dots"], s["commas"]
    return (
        F.when((dots > 0) & (commas > 0),
               F.when(s["after_dot"] < s["after_comma"], F.lit(".")).otherwise(F.lit(",")))
        .when(dots + commas != 1, F.lit(""))
        .when((dots == 1) & (s["after_dot"] != 3), F.lit("."))
        .when((commas == 1) & (s["after_comma"] != 3), F.lit(","))
        .when(notation == "iso", F.when(dots == 1, F.lit(".")).otherwise(F.lit("")))
        .when(notation == "de", F.when(commas == 1, F.lit(",")).otherwise(F.lit("")))
    )


def percent_separator(s: Column) -> Column:
    """A percentage has no thousands: one separator is the decimal one, more are an error."""
    return (
        F.when(s["dots"] + s["commas"] == 0, F.lit(""))
        .when(s["dots"] + s["commas"] > 1, F.lit(None).cast("string"))
        .when(s["dots"] == 1, F.lit(".")).otherwise(F.lit(","))
    )


def dotted(bare: Column, separator: Column) -> Column:
    """The number with a dot for its decimals and without thousands; NULL without a digit."""
    no_dots = F.replace(bare, F.lit("."), F.lit(""))
    kept = (
        F.when(separator == "", F.replace(no_dots, F.lit(","), F.lit("")))
        .when(separator == ".", F.replace(bare, F.lit(","), F.lit("")))
        .when(separator == ",", F.replace(no_dots, F.lit(","), F.lit(".")))
    )
    return F.nullif(F.nullif(kept, F.lit("")), F.lit("."))


def literal(kept: Column) -> Column:
    """Complete number text: '.5' becomes '0.5', '1.' becomes '1'; NULL if it is no number."""
    filled = F.when(kept.startswith("."), F.concat(F.lit("0"), kept)).otherwise(kept)
    only_dot_last = kept.endswith(".") & (F.instr(kept, ".") == F.length(kept))
    complete = F.when(only_dot_last, F.substring_index(kept, ".", 1)).otherwise(filled)
    return complete


def fits(lit: Column, digits: int, decimals: int) -> Column:
    """True when the literal needs no rounding in DECIMAL(digits, decimals)."""
    whole = F.substring_index(lit, ".", 1)
    has_dot = F.contains(lit, F.lit("."))
    fraction = F.when(has_dot, F.length(lit) - F.length(whole) - 1).otherwise(F.lit(0))
    return (
        lit.isNotNull()
        & (fraction <= decimals)
        & (F.length(F.ltrim(whole, F.lit("0"))) <= digits - decimals)
    )


def typed(signed: Column, lit: Column, kind: str) -> Column:
    """The decimal of a sign and a literal, NULL when it does not fit without loss."""
    digits, decimals = SCALES[kind]
    number = F.concat(signed, lit).try_cast(f"decimal({digits},{decimals})")
    return F.when(fits(lit, digits, decimals) & lit.rlike(_PLAIN), number)


def parse_integer(text: Column) -> Column:
    """Integer text to INT: digits with an optional sign, leading zeros allowed."""
    digits = body(text)
    return F.when(digits.rlike(r"^[0-9]+\z"), F.concat(sign(text), digits).try_cast("int"))


def plain(text: Column, kind: str) -> Column:
    """The decimal of a text that is written plainly; NULL for any other."""
    if kind == "percent":
        dotted_text = F.when(text.rlike(_PLAIN_PERCENT), F.replace(text, F.lit(","), F.lit(".")))
    else:
        dotted_text = F.when(
            text.rlike(_PLAIN_DOT), F.replace(text, F.lit(","), F.lit(""))
        ).when(text.rlike(_PLAIN_COMMA), F.translate(text, ",.", "."))
    digits, decimals = SCALES[kind]
    return dotted_text.try_cast(f"decimal({digits},{decimals})")


def _given(value: Column, step: Callable[[Column], Column]) -> Column:
    """A step over a value that is worked out once."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def by_steps(text: Column, kind: str, notation: Column) -> Column:
    """The decimal of any text, step by step."""
    def separator(s: Column) -> Column:
        return decimal_separator(s, notation) if kind == "amount" else percent_separator(s)

    return _given(body(text), lambda bare: _given(
        _given(shape(bare), separator), lambda mark: _given(
            dotted(bare, mark), lambda kept: _given(
                literal(kept), lambda lit: typed(sign(text), lit, kind)))))


def parse_columns(df: DataFrame, kinds: dict[str, str], notation: Column) -> DataFrame:
    """Add `<column>__typed` for every amount and percent column."""
    return df.withColumns({
        f"{name}__typed": F.coalesce(
            plain(F.col(name), kind), F.when(F.col(name).isNotNull() & (F.col(name) != ""),
                                             by_steps(F.col(name), kind, notation)))
        for name, kind in kinds.items() if kind in SCALES
    })


def _proof(bare: Column, s: Column) -> Column:
    """What the shape of one amount proves: 'de', 'iso', or NULL for nothing."""
    dots, commas = s["dots"], s["commas"]
    decimal = (
        F.when((dots > 0) & (commas > 0),
               F.when(s["after_dot"] < s["after_comma"], F.lit("iso")).otherwise(F.lit("de")))
        .when(dots > 1, F.lit("de")).when(commas > 1, F.lit("iso"))
        .when((dots == 1) & s["after_dot"].between(1, 2), F.lit("iso"))
        .when((commas == 1) & s["after_comma"].between(1, 2), F.lit("de"))
    )
    return F.when(decimal.isNotNull() & bare.rlike(r"^[0-9.,]+\z"), decimal)


def value_notation(text: Column) -> Column:
    """What one amount proves about its file: 'de', 'iso', or NULL for nothing."""
    return F.when(
        text.rlike(_PLAIN_DOT), F.when(F.contains(text, F.lit(".")), F.lit("iso"))
    ).when(text.rlike(_PLAIN_COMMA), F.lit("de")).otherwise(
        _given(body(text), lambda bare: _given(shape(bare), lambda s: _proof(bare, s))))


def group_digits(digits: Column) -> Column:
    """'1234567' to '1.234.567'."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+\z)", ".")


def money(amount: Column, currency: Column) -> Column:
    """German money text with its currency; more than two decimals are an error."""
    exact = amount.cast("decimal(15,2)")
    text = F.translate(F.format_number(exact, 2), ",.", ".,")
    # a difference that rounds to nothing is still a difference
    checked = F.when(exact != amount, F.raise_error(F.lit("money: more than two decimals"))
                     .cast("string")).otherwise(text)
    return F.when(currency.isNull(), checked).otherwise(F.concat(checked, F.lit(" "), currency))


def trim_zeros(number: Column) -> Column:
    """'2.500' to '2.5', '2.000' to '2'."""
    return F.rtrim(F.rtrim(number.cast("string"), F.lit("0")), F.lit("."))


def amount_text(amount: Column) -> Column:
    """An amount as text with two decimals and a dot."""
    return amount.cast("decimal(15,2)").cast("string")


def parse_cents(text: Column) -> Column:
    """'-12.30' to -1230; text of another form is NULL."""
    return F.when(text.rlike(r"^-?\d+\.\d{2}\z"), F.replace(text, F.lit("."), F.lit(""))
                  .try_cast("decimal(38,0)"))
