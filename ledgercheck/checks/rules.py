"""The checks with what every finding of theirs says."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

from ledgercheck.checks import (
    bank_data,
    cross_role,
    double_payment,
    items,
    master_data,
    vat,
)
from ledgercheck.checks.contract import Model


@dataclass(frozen=True)
class Remediation:
    sap_transaction: str
    path: str
    field: str | None
    steps: tuple[str, ...] = ()
    mass_change_eligible: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    version: str
    title: str
    category: str
    severity: str
    damage_class: int
    tier: str
    action_type: str
    requires: tuple[str, ...]
    why: str
    if_wrong: str
    remediation: Remediation
    check: Callable[[Model], DataFrame]

    @property
    def side(self) -> str:
        return self.id.split("-")[0]


_BP, _TAX, _BANK, _CC = "business_partner", "bp_tax_id", "bp_bank_account", "bp_company_code"
_ITEM, _REL, _HOUSE, _TERMS = "fi_item", "bp_relevance", "company_code", "payment_terms"

# Titles are fixed values: they are shown, searched and sorted by.
_TITLE = {
    "VAL-001": "USt-ID-Präfix passt nicht zum Sitzland ({country})",
    "VAL-002": "USt-IdNr. ohne gültiges Format ({befund})",
    "VAL-003": "IBAN mit ungültiger Prüfziffer ({iban_masked})",
    "VAL-005": "Platzhalter statt echtem Wert im Feld {feld}",
    "AR-COM-002": "Zahlungsbedingung im Buchungskreis {company_code} nicht gepflegt",
    "AR-CON-002": "Löschvormerkung/Buchungssperre bei Debitor mit offenen Posten ({open_items})",
    "HYG-001": "Löschkandidat: kein Posten im Postenfenster, angelegt vor {window_from}",
    "AR-LEA-001": "Unapplied Cash: {amount} seit {days} Tagen ohne Rechnungsbezug",
    "AP-COM-003": "Prüfung auf doppelte Rechnung nicht gesetzt (Buchungskreis {company_code})",
    "AP-CON-001": "Dieselbe Bankverbindung bei {konten} Kreditoren ({iban_masked})",
    "AP-LEA-001": "Mögliche Doppelzahlung: {amount} an Kreditor, Referenz {ref_a} / {ref_b}",
    "AP-LEA-002": "Skontoverlust 12 Monate: {loss} bei {invoices} Rechnungen",
    "CROSS-DUP-001": "Kunde und Lieferant mit derselben {match_label} ({match_value})",
}
_CHANGE = {"CUSTOMER": "XD02", "VENDOR": "XK02"}
_PREFIX = {"CUSTOMER": "AR", "VENDOR": "AP"}


def _both_sides(role: str) -> list[Rule]:
    side, change = _PREFIX[role], _CHANGE[role]
    return [
        Rule(
            f"{side}-VAL-001", "1.0", _TITLE["VAL-001"], "validity", "high", 2, "B", "review",
            (_BP, _TAX),
            "Mit einem fremden Länderpräfix lässt sich die Nummer nicht bestätigen; der "
            "steuerliche Nachweis für den Geschäftsvorfall fehlt.",
            "Das Präfix allein macht die Nummer nicht gültig. Vor der Übernahme bestätigen.",
            Remediation(change, "Steuerung → USt-IdNr.", "STCEG"),
            partial(vat.vat_prefix, role=role),
        ),
        Rule(
            f"{side}-VAL-002", "1.0", _TITLE["VAL-002"], "validity", "high", 2, "C", "review",
            (_BP, _TAX),
            "Eine Nummer in falscher Form wird bei keiner Abfrage bestätigt, und eine "
            "Steuernummer an dieser Stelle verfälscht die Meldungen.",
            "Eine passend gemachte, aber erfundene Nummer ist schlechter als die erkannte Lücke.",
            Remediation(change, "Steuerung → USt-IdNr. / Steuernummer", "STCEG / STCD1", (
                "Ohne Länderpräfix: Wert als Steuernummer prüfen und umtragen",
                "Richtige Nummer beim Geschäftspartner erfragen und bestätigen lassen")),
            partial(vat.vat_format, role=role),
        ),
        Rule(
            f"{side}-VAL-003", "1.2" if role == "CUSTOMER" else "1.1", _TITLE["VAL-003"],
            "validity", "critical", 1, "C", "review", (_BP, _BANK, _REL),
            "Eine Zahlung über diese IBAN kommt zurück oder trifft ein fremdes Konto.",
            "Eine falsch berichtigte IBAN ist eine Überweisung an Dritte und kaum rückholbar.",
            Remediation(change, "Zahlungsverkehr → Bankverbindungen", "IBAN", (
                "Bankverbindung über einen bekannten Kontakt bestätigen lassen",
                "Mit einem zweiten Dokument vergleichen",
                "Änderung im Vier-Augen-Prinzip freigeben")),
            partial(bank_data.invalid_iban, role=role),
        ),
        Rule(
            f"{side}-HYG-001", "1.0", _TITLE["HYG-001"], "hygiene", "low", 3, "decision",
            "decision", (_BP, _REL, _ITEM),
            "Ein Konto ohne jede Bewegung kostet in jeder Liste Zeit und lädt zu "
            "Fehlbuchungen ein.",
            "Eine ruhende, aber gewollte Beziehung ginge verloren; Fristen vorher prüfen.",
            Remediation("XD06" if role == "CUSTOMER" else "XK06",
                        "Löschvormerkung setzen, Archivierung über SARA", "LOEVM", (
                            "Aufbewahrungsfrist prüfen",
                            "Löschen, behalten oder nur sperren: Entscheidung festhalten")),
            partial(master_data.unused_account, role=role),
        ),
    ]


RULES: list[Rule] = sorted([
    *_both_sides("CUSTOMER"),
    *_both_sides("VENDOR"),
    Rule(
        "AR-VAL-005", "1.0", _TITLE["VAL-005"], "validity", "medium", 3, "C", "review", (_BP,),
        "Ein Konto mit Platzhalternamen lässt sich weder anschreiben noch zuordnen.",
        "Ein erfundener Name ist schwerer zu erkennen als ein Platzhalter.",
        Remediation("XD02", "Adresse → Name / Ort", "NAME1 / ORT01", (
            "Echten Wert aus Beleg oder Auftrag übernehmen",
            "Ohne Beleg das Konto sperren statt umbenennen")),
        master_data.placeholder,
    ),
    Rule(
        "AR-COM-002", "1.0", _TITLE["AR-COM-002"], "completeness", "medium", 2, "C", "review",
        (_BP, _CC, _ITEM, _TERMS),
        "Ohne Zahlungsbedingung entsteht die Fälligkeit aus dem, was jemand eintippt.",
        "Eine falsche Bedingung verschiebt alle künftigen Fälligkeiten dieses Kunden.",
        Remediation("XD02", "Buchungskreisdaten → Zahlungsverkehr", "ZTERM"),
        master_data.terms_missing,
    ),
    Rule(
        "AR-CON-002", "1.0", _TITLE["AR-CON-002"], "consistency", "high", 3, "decision",
        "decision", (_BP, _CC, _HOUSE, _ITEM),
        "Offene Forderungen auf einem gesperrten Konto werden nicht mehr verfolgt.",
        "Eine aufgehobene Sperre lässt Buchungen zu, die verhindert werden sollten.",
        Remediation("XD05 / XD06", "XD05 Sperre setzen/aufheben, XD06 Löschvormerkung",
                    "SPERR / LOEVM", (
                        "Grund der Sperre oder Vormerkung klären",
                        "Kennzeichen aufheben oder Posten bereinigen")),
        master_data.blocked_with_open_items,
    ),
    Rule(
        "AR-LEA-001", "1.0", _TITLE["AR-LEA-001"], "leakage", "medium", 3, "B", "review",
        (_BP, _ITEM),
        "Geld ohne Rechnungsbezug verfälscht die offenen Posten und löst Mahnungen aus.",
        "Eine falsch zugeordnete Zahlung schließt eine Rechnung, die noch offen ist.",
        Remediation("F-32", "Debitor ausgleichen: Zahlung und offene Rechnung(en) auswählen",
                    None, (
                        "Verwendungszweck der Zahlung heraussuchen",
                        "Passende Rechnung ausgleichen oder Rückzahlung veranlassen")),
        items.unapplied_cash,
    ),
    Rule(
        "AP-COM-003", "1.0", _TITLE["AP-COM-003"], "completeness", "high", 3, "A",
        "mass_change", (_BP, _CC),
        "Ohne das Kennzeichen warnt das System nicht, wenn eine Rechnung zweimal kommt.",
        "Bei wiederkehrenden Referenzen erscheinen unnötige Warnungen.",
        Remediation("XK02", "Buchungskreisdaten → Zahlungsverkehr → Prüfung doppelte Rechnung",
                    "REPRF", (
                        "Feld für die betroffenen Sätze in einer Massenänderung setzen",
                        "An einem Rechnungseingang prüfen, dass die Warnung erscheint"),
                    mass_change_eligible=True),
        master_data.invoice_check_off,
    ),
    Rule(
        "AP-CON-001", "1.0", _TITLE["AP-CON-001"], "consistency", "critical", 1, "C", "review",
        (_BP, _BANK, _CC, "bp_partner_function", _REL),
        "Mehrere Konten mit einer Bankverbindung sind eine Dublette oder eine umgeleitete "
        "Zahlung.",
        "Eine Änderung an der richtigen Bankverbindung leitet Zahlungen an Dritte.",
        Remediation("XK02", "Zahlungsverkehr → Bankverbindungen", "IBAN", (
            "Stammsätze vergleichen",
            "Fehlenden Regulierer nachtragen oder Dublette auflösen",
            "Sonst Zahlsperre setzen und beim Lieferanten nachfragen")),
        bank_data.shared_iban,
    ),
    Rule(
        "AP-LEA-001", "1.0", _TITLE["AP-LEA-001"], "leakage", "critical", 2, "B", "review",
        (_BP, _ITEM),
        "Dieselbe Rechnung wurde vermutlich zweimal bezahlt; das Geld ist abgeflossen.",
        "Eine Rückforderung ohne Doppelzahlung belastet die Beziehung zum Lieferanten.",
        Remediation("FBL1N", "Belegpaar prüfen, dann Rückforderung/Verrechnung anstoßen", None, (
            "Belege und Rechnungsbilder vergleichen",
            "Rückforderung oder Verrechnung veranlassen")),
        double_payment.double_payment,
    ),
    Rule(
        "AP-LEA-002", "1.0", _TITLE["AP-LEA-002"], "leakage", "medium", 3, "C", "process",
        (_BP, _HOUSE, _ITEM, _TERMS),
        "Vereinbartes Skonto verfällt, weil der Zahllauf die Frist verpasst.",
        "Früher zahlen kostet Liquidität; der Takt gilt für alle Rechnungen des Kreditors.",
        Remediation("F110", "Zahllauf-Parameter: Termin/Frequenz oder Zahlwegauswahl für diesen "
                    "Kreditor", None, (
                        "Takt des Zahllaufs an die Skontofrist anpassen",
                        "Rechnungen mit laufender Frist vorziehen")),
        items.lost_discount,
    ),
    Rule(
        "CROSS-DUP-001", "1.0", _TITLE["CROSS-DUP-001"], "duplicate", "medium", 2, "B", "review",
        (_BP, _TAX, _BANK, _REL),
        "Forderungen und Verbindlichkeiten desselben Partners werden nicht verrechnet.",
        "Bei verschiedenen Rechtsträgern wäre eine Verrechnung unzulässig.",
        Remediation("XD02 / XK02",
                    "Steuerung → Verrechnungskennzeichen (Debitor/Kreditor gegenseitig eintragen)",
                    None, (
                        "Prüfen, ob es derselbe Rechtsträger ist",
                        "Konten gegenseitig eintragen, nicht zusammenführen")),
        cross_role.customer_is_vendor,
    ),
], key=lambda rule: rule.id)
RULE_BY_ID = {rule.id: rule for rule in RULES}
