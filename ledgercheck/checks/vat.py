"""VAT ids: prefix against country, and format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model, contract, evidence, params
from ledgercheck.functions import text

MASTER = {"CUSTOMER": "KNA1", "VENDOR": "LFA1"}


def _vat_ids(model: Model, role: str) -> DataFrame:
    vat = model["bp_tax_id"].filter(F.col("tax_id_type") == "VAT").select(
        "bp_key", "value", "value_norm"
    )
    return vat.join(model.partners(role, "role", "country"), "bp_key")


def vat_prefix(model: Model, role: str) -> DataFrame:
    """The letters of the VAT id are not those of the partner's country."""
    norm = F.col("value_norm")
    found = (
        _vat_ids(model, role)
        .withColumn("expected", text.expected_vat_prefix(F.col("country")))
        .filter(text.has_letter_prefix(norm) & (F.length(norm) >= 4)
                & (text.vat_prefix(norm) != F.col("expected")))
    )
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table=MASTER[role],
        source_field="STCEG", current_value=F.col("value"),
        proposed_value=text.with_vat_prefix(norm, F.col("expected")),
        source_summary=F.concat(
            F.lit("Sitzland "), "country", F.lit(" erwartet Präfix "), "expected",
            F.lit(" – ohne VIES-Bestätigung")),
        evidence=F.array(evidence(
            "deterministic", "KNA1.LAND1", F.col("country"), True,
            "Präfix aus Sitzland abgeleitet")),
        params=params(country=F.col("country"), expected_prefix=F.col("expected")),
    )


def vat_format(model: Model, role: str) -> DataFrame:
    """The VAT id fits no known form.

    Letters no form is known for are not judged.
    """
    norm = F.col("value_norm")
    found = (
        _vat_ids(model, role)
        .withColumns({
            "prefix": text.vat_prefix(norm), "lettered": text.has_letter_prefix(norm),
            "form": text.vat_pattern_of(text.vat_prefix(norm)),
        })
        .filter(~text.matches_a_vat_pattern(norm) & (~F.col("lettered") | F.col("form").isNotNull()))
    )
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table=MASTER[role],
        source_field="STCEG", current_value=F.col("value"),
        current_display=F.when(
            F.col("lettered"), F.concat(F.lit("entspricht nicht dem Format für "), "prefix")
        ).otherwise(F.lit("kein Länderpräfix – sieht wie eine Steuernummer aus")),
        evidence=F.array(evidence(
            "deterministic", "vat_id_patterns",
            F.coalesce("form", F.lit("kein Muster für dieses Präfix")), False,
            "Formatmuster nach dem Präfix des Werts, nicht nach dem Sitzland", kind="policy")),
        params=params(befund=F.when(
            F.col("lettered"), F.concat(F.lit("Format "), "prefix")
        ).otherwise(F.lit("ohne Länderpräfix"))),
    )
