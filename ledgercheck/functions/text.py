"""Text to comparable text: norms, flags, whole words, names, templates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgercheck.fixed import (
    EU_COUNTRIES,
    PLACEHOLDER_TERMS,
    TRANSLITERATION,
    VAT_PATTERNS,
    VAT_PREFIX_OF_COUNTRY,
    WORD_CHARACTERS,
)

EXCERPT_LENGTH = 200


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def parse_flag(text: Column) -> Column:
    """'X' is true, empty is NULL; any other text is unreadable and NULL as well."""
    return F.when(F.upper(F.trim(text)) == "X", F.lit(True))


def reference_norm(text: Column) -> Column:
    """Letters and digits only, in capitals."""
    return F.when(text.rlike(r"^[A-Z0-9]*\z"), text).otherwise(
        F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")))


def iban_norm(text: Column) -> Column:
    return F.upper(F.replace(text, F.lit(" "), F.lit("")))


def tax_norm(text: Column) -> Column:
    return F.upper(F.translate(text, " .", ""))


def signed_amount(amount: Column, debit_credit: Column) -> Column:
    """Credit (H) is negative, everything else keeps its sign."""
    return F.when(debit_credit == "H", -amount).otherwise(amount).cast("decimal(15,2)")


def partner_key(text: Column, prefix: str) -> Column:
    """Key with the role prefix; an empty key stays NULL."""
    return F.when(F.trim(text) != "", F.concat(F.lit(prefix), text))


def item_key(*parts: Column) -> Column:
    """Parts joined by '|'; NULL as soon as one part is NULL."""
    glued = []
    for part in parts:
        glued += [F.lit("|"), part]
    return F.concat(*glued[1:])


def excerpt(columns: list[Column]) -> Column:
    """Raw values of a row, tab-separated and cut to the length a reject may show."""
    filled = [F.coalesce(c, F.lit("")) for c in columns]
    return F.left(F.concat_ws("\t", *filled), F.lit(EXCERPT_LENGTH))


# -- VAT ids ---------------------------------------------------------------------------

def vat_prefix(vat_norm: Column) -> Column:
    return F.substring(vat_norm, 1, 2)


def has_letter_prefix(vat_norm: Column) -> Column:
    return vat_prefix(vat_norm).rlike(r"^[A-Z]{2}\z")


def expected_vat_prefix(country: Column) -> Column:
    """The prefix a VAT id of this EU country starts with; NULL outside the EU."""
    prefix = country
    for code, other in VAT_PREFIX_OF_COUNTRY.items():
        prefix = F.when(country == code, F.lit(other)).otherwise(prefix)
    return F.when(country.isin(*EU_COUNTRIES), prefix)


def with_vat_prefix(vat_norm: Column, prefix: Column) -> Column:
    return F.concat(prefix, F.substring(vat_norm, 3, 1 << 30))


def whole_text_pattern(pattern: str) -> str:
    """A '^…$' pattern whose end does not accept a trailing line break."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def matches_a_vat_pattern(vat_norm: Column) -> Column:
    """One compiled pattern instead of a join: a list this short is a literal."""
    return vat_norm.rlike("|".join(whole_text_pattern(p) for p in VAT_PATTERNS.values()))


def vat_pattern_of(prefix: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in VAT_PATTERNS.items() for x in pair])
    return F.try_element_at(table, prefix)


# -- placeholder words -----------------------------------------------------------------

def placeholder_pattern() -> str:
    """Any of the words, longest first, with no letter or digit on either side."""
    longest_first = sorted(PLACEHOLDER_TERMS, key=len, reverse=True)
    choice = "|".join(re.escape(term) for term in longest_first)
    return f"(?<![{WORD_CHARACTERS}])(?:{choice})(?![{WORD_CHARACTERS}])"


def has_placeholder(text: Column) -> Column:
    """True when a placeholder stands in the text as a word of its own."""
    return F.coalesce(F.lower(text).rlike(placeholder_pattern()), F.lit(False))


def placeholder_word(text: Column) -> Column:
    """The first placeholder found as it is shown ('' if none): 'n.a.' is shown as 'n.a'."""
    found = F.regexp_extract(F.lower(text), placeholder_pattern(), 0)
    return F.coalesce(F.rtrim(found, F.lit(".")), F.lit(""))


# -- names -----------------------------------------------------------------------------

def display_name(name: Column, city: Column) -> Column:
    """'name, city', each only when it is not blank; NULL when both are."""
    parts = [blank_to_null(F.trim(c)) for c in (name, city)]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(", ", *parts))


def _folded_letters() -> tuple[str, str]:
    """Accented Latin letters and their plain letter, by Unicode decomposition."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base.isascii():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


def name_core(text: Column) -> Column:
    """Small letters and digits only: umlauts written out, accents dropped."""
    core = F.lower(text)
    for letter, written in TRANSLITERATION.items():
        core = F.replace(core, F.lit(letter), F.lit(written))
    accented, plain = _folded_letters()
    return F.regexp_replace(F.translate(core, accented, plain), "[^a-z0-9]+", "")


def plain_account(text: Column) -> Column:
    """Account number without role prefix and leading zeros, for comparison."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Z]:", ""), r"^0+(?=\d)", "")


def fill(template: str, params: Column) -> Column:
    """Put params (a map) into the {names} of a template; a missing name gives NULL."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(F.try_element_at(params, F.lit(piece)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def said(template: str, **values: Column) -> Column:
    """A sentence with columns in the {names} of its template; a NULL gives NULL."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        values[piece].cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces) if i % 2 or piece])
