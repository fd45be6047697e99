"""Words, codes, patterns and texts that results must show unchanged.

Everything here is plain data.  The tables are small and of a size known from this
file, which is why they may be turned into literals.
"""

# -- document types by side and class ------------------------------------------------
DOC_TYPES = {
    "AR": {"invoice": ["DR"], "credit_memo": ["DG"], "payment": ["DZ"], "reversal": []},
    "AP": {"invoice": ["KR", "RE"], "credit_memo": ["KG"], "payment": ["KZ"], "reversal": []},
}
SIDE_OF_ROLE = {"CUSTOMER": "AR", "VENDOR": "AP"}
ROLES_OF_SIDE = {"ar": ("CUSTOMER",), "ap": ("VENDOR",), "both": ("CUSTOMER", "VENDOR")}
ROLE_PREFIX = {"CUSTOMER": "C:", "VENDOR": "V:"}

# -- VAT ids -------------------------------------------------------------------------
EU_COUNTRIES = (
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE",
    "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE",
)
VAT_PREFIX_OF_COUNTRY = {"GR": "EL"}
VAT_PATTERNS = {
    "AT": r"^ATU\d{8}$",
    "BE": r"^BE[01]\d{9}$",
    "BG": r"^BG\d{9,10}$",
    "CY": r"^CY\d{8}[A-Z]$",
    "CZ": r"^CZ\d{8,10}$",
    "DE": r"^DE\d{9}$",
    "DK": r"^DK\d{8}$",
    "EE": r"^EE\d{9}$",
    "EL": r"^EL\d{9}$",
    "ES": r"^ES[A-Z0-9]\d{7}[A-Z0-9]$",
    "FI": r"^FI\d{8}$",
    "FR": r"^FR[A-Z0-9]{2}\d{9}$",
    "HR": r"^HR\d{11}$",
    "HU": r"^HU\d{8}$",
    "IE": r"^IE(\d{7}[A-Z]{1,2}|\d[A-Z+*]\d{5}[A-Z])$",
    "IT": r"^IT\d{11}$",
    "LT": r"^LT(\d{9}|\d{12})$",
    "LU": r"^LU\d{8}$",
    "LV": r"^LV\d{11}$",
    "MT": r"^MT\d{8}$",
    "NL": r"^NL\d{9}B\d{2}$",
    "PL": r"^PL\d{10}$",
    "PT": r"^PT\d{9}$",
    "RO": r"^RO\d{2,10}$",
    "SE": r"^SE\d{12}$",
    "SI": r"^SI\d{8}$",
    "SK": r"^SK\d{10}$",
    "XI": r"^XI(\d{9}|\d{12}|GD\d{3}|HA\d{3})$",
    "CH": r"^CHE\d{9}(MWST|TVA|IVA)?$",
    "GB": r"^GB(\d{9}|\d{12}|GD\d{3}|HA\d{3})$",
    "NO": r"^NO\d{9}MVA$",
}

# -- placeholder words in names and cities -------------------------------------------
PLACEHOLDER_TERMS = (
    "test", "xxx", "dummy", "unbekannt", "neuanlage", "muster", "probe", "tbd", "???",
    "kein name", "n.a.",
    "testkunde", "testfirma", "testlieferant", "musterfirma", "musterkunde", "mustermann",
    "dummykunde",
)
WORD_CHARACTERS = "a-z0-9äöüß"  # of a regular expression; anything else ends a word

# -- IBAN: account part per country (public IBAN registry) -----------------------------
# n digits, a capital letters, c letters or digits; the number is the exact count.
IBAN_ACCOUNT_FORMAT = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n",
    "BE": "12n", "BG": "4a6n8c", "BH": "4a14c", "BI": "23n", "BR": "23n1a1c",
    "BY": "4c4n16c", "CH": "5n12c", "CR": "18n", "CY": "8n16c", "CZ": "20n", "DE": "18n",
    "DJ": "23n", "DK": "14n", "DO": "4c20n", "EE": "16n", "EG": "25n", "ES": "20n",
    "FI": "14n", "FK": "2a12n", "FO": "14n", "FR": "10n11c2n", "GB": "4a14n", "GE": "2a16n",
    "GI": "4a15c", "GL": "14n", "GR": "7n16c", "GT": "24c", "HR": "17n", "HU": "24n",
    "IE": "4a14n", "IL": "19n", "IQ": "4a15n", "IS": "22n", "IT": "1a10n12c",
    "JO": "4a4n18c", "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c", "LC": "4a24c",
    "LI": "5n12c", "LT": "16n", "LU": "3n13c", "LV": "4a13c", "LY": "21n",
    "MC": "10n11c2n", "MD": "20c", "ME": "18n", "MK": "3n10c2n", "MN": "16n", "MR": "23n",
    "MT": "4a5n18c", "MU": "4a19n3a", "NI": "4a20n", "NL": "4a10n", "NO": "11n",
    "OM": "3n16c", "PK": "4a16c", "PL": "24n", "PS": "4a21c", "PT": "21n", "QA": "4a21c",
    "RO": "4a16c", "RS": "18n", "RU": "14n15c", "SA": "2n18c", "SC": "4a20n3a",
    "SD": "14n", "SE": "20n", "SI": "15n", "SK": "20n", "SM": "1a10n12c", "SO": "19n",
    "ST": "21n", "SV": "4a20n", "TL": "19n", "TN": "20n", "TR": "6n16c", "UA": "6n19c",
    "VA": "18n", "VG": "4a16n", "XK": "16n", "YE": "4a4n18c",
}

# -- CP1252: the characters of bytes 0x80 to 0x9F (blank: byte not assigned) -------------
CP1252_HIGH = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"

# -- enumerations of the finding document, each in its rank order -------------------------
SEVERITIES = ("low", "medium", "high", "critical")
TIERS = ("A", "B", "C", "decision")
SIDES = ("AR", "AP", "CROSS")
STATUSES = ("open", "in_progress", "done", "accepted_risk", "rejected")
CATEGORIES = (
    "completeness", "validity", "consistency", "hygiene", "risk", "duplicate", "leakage",
)
ACTION_TYPES = ("mass_change", "review", "decision", "process")
ACTIVITY_STATUSES = ("active", "dormant", "never_posted")
STAGES = ("raw", "staged", "canonical")
EVIDENCE_SOURCES = (
    "deterministic", "vies", "iban_checksum", "duplicate_record", "invoice",
    "bank_statement", "payment_run", "change_document", "statistics", "model",
    "external_register", "postal_code_list", "policy",
)
REFERENCE_KINDS = (
    "document", "master_field", "cluster", "external_query", "statement", "netting",
    "payment_run", "policy",
)
DECISION_ACTIONS = ("accept", "reject", "assign")
REASON_STATUS = {
    "intentionally_separate": "rejected",
    "data_correct": "rejected",
    "not_relevant": "rejected",
    "accepted_risk": "accepted_risk",
}
REASON_LABELS = {
    "intentionally_separate": "bewusst getrennt geführt",
    "data_correct": "Daten sind korrekt",
    "not_relevant": "nicht relevant",
    "accepted_risk": "Risiko akzeptiert",
}
DUNNING_LEVELS = ((90, 3), (60, 2), (30, 1))
CLEANUP_COLUMNS = (
    "bp_key", "company_code", "source_table", "source_field", "current", "proposed",
    "tier", "rule_id",
)

# -- reject reasons ------------------------------------------------------------------
REJECT_REASON = {
    "amount": "Betrag nicht als DECIMAL(15,2) lesbar",
    "percent": "Prozentsatz nicht als DECIMAL(5,3) lesbar",
    "date": "Datum nicht lesbar",
    "integer": "Ganzzahl nicht lesbar",
    "flag": 'Kennzeichen ist weder leer noch "X"',
}
REJECT_DEBIT_CREDIT = (
    "SHKZG: weder S noch H – das Vorzeichen von amount_signed_local ist nicht bestimmbar"
)
REJECT_AMBIGUOUS_IBAN = (
    "TIBAN: mehrere IBAN mit demselben VALID_FROM – "
    "die Bankverbindung ist nicht eindeutig bestimmbar"
)

# -- initial values that mean "empty" ---------------------------------------------------
DATE_INITIALS = ("00000000", "00.00.0000", "0000-00-00")

# -- letters written out when a name is reduced to its core ------------------------------
TRANSLITERATION = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
REJECT_EMPTY = "{target}.{column} ist leer"
REJECT_ORPHAN = "Stammsatz fehlt: {bp_key} steht nicht in business_partner"
REJECT_TWICE = (
    "{columns} {key} kommt in {source} mehrfach vor – keine der Zeilen wird uebernommen"
)
REJECT_TAKEN = "{columns} {key} steht bereits aus einer anderen Quelltabelle in {target}"

# -- fixed values: forms of the fields of a finding ------------------------------------------
MASK_PATTERN = r"^(?:[A-Za-z0-9] ?){0,4}(?:…|\.\.\.|\*{2,}) ?(?:[A-Za-z0-9] ?){0,4}\z"
AMOUNT_PATTERN = r"^-?[0-9]+\.[0-9]{2}\z"
CURRENCY_PATTERN = r"^[A-Z]{3}\z"
KEY_PATTERN = r"^[CV]:[A-Za-z0-9]+\z"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}\z"
FINDING_FORMS = {
    "finding_id": r"^F-[a-f0-9]{12}\z",
    "rule_id": r"^(AR|AP|CROSS)-(COM|VAL|CON|HYG|RSK|DUP|LEA)-[0-9]{3}\z",
    "rule_version": r"^[0-9]+\.[0-9]+\z", "entity.bp_key": KEY_PATTERN, "data_as_of": DATE_PATTERN,
    "relevance.open_items": AMOUNT_PATTERN, "relevance.volume_12m": AMOUNT_PATTERN,
    "relevance.currency": CURRENCY_PATTERN, "relevance.last_activity_on": DATE_PATTERN,
    "impact_eur.amount": AMOUNT_PATTERN, "impact_eur.currency": CURRENCY_PATTERN,
}

# -- fixed values: sentences of the checks ------------------------------------------------
IBAN_WRONG = "Prüfziffer ungültig (Mod-97)"
IBAN_WRONG_NOTE = "Mod-97-Prüfung fehlgeschlagen"
IBAN_REFERENCE = "TIBAN BANKL {bank_key} / BVTYP {bank_type}"
IBAN_SHARED = "bei {n} Kreditorenkonten hinterlegt, ohne Regulierer-Bezug"
IBAN_SHARED_NOTE = "dieselbe IBAN bei {n} Konten"
PAYER_REFERENCE = "LFA1-LNRZA / LFB1-LNRZB / Partnerrollen"
PAYER_NONE = "kein Regulierer hinterlegt"
PAYER_NOTE = (
    "Ein Zentralregulierer traegt die Bankverbindung seiner Mitglieder zu Recht; "
    "hier verbindet die Konten keiner"
)
OPEN_ITEMS_AT_STAKE = {
    "CUSTOMER": "Offene Posten {money}, die über diese IBAN per Lastschrift eingezogen würden",
    "VENDOR": "Offene Posten {money}, die an diese IBAN gezahlt würden",
}
CROSS_ROLE = (
    "derselbe Geschäftspartner ist als Debitor und als Kreditor geführt "
    "(Übereinstimmung: {criteria})"
)
CROSS_ROLE_PROPOSAL = (
    "Verrechnung prüfen und beide Konten gegenseitig eintragen – nicht zusammenführen"
)
CROSS_ROLE_SUMMARY = (
    "Deterministischer Abgleich: {criteria} identisch bei Debitor und {vendors}; "
    "kein Namens- oder Adressabgleich"
)
ONE_VENDOR = "einem Kreditorenkonto"
SOME_VENDORS = "{n} Kreditorenkonten"
CROSS_ROLE_NOTE = "dieselbe {criterion} bei Debitor und Kreditor"
PAID_TWICE = "Zwei bezahlte Rechnungen über {money}"
PAID_TWICE_PROPOSAL = "Rückforderung oder Verrechnung"
PAID_TWICE_SUMMARY = (
    "Belegpaar {a} / {b}: gleicher Betrag, Referenz {likeness}, {days} Tage Abstand, "
    "keine Gutschrift in 180 Tagen{more}"
)
PAID_TWICE_MORE = "; {n} passende Belege"
PAID_TWICE_FORMULA = "Betrag der zweiten Zahlung, keine Gutschrift gefunden"

# -- names, streets and cities for comparison: fixed values ----------------------------
NOISE_WORDS = (
    "fa", "fa.", "firma", "i.l.", "i.g.", "i.a.", "werk", "niederlassung",
    "zweigniederlassung", "zentrale", "hauptverwaltung", "c/o", "z.hd.", "zhd", "the", "&",
    "und", "+",
)
LEGAL_FORMS = {
    "gmbh": ("g.m.b.h.", "g.m.b.h", "ges.m.b.h.", "gesmbh",
             "gesellschaft mit beschraenkter haftung", "gesellschaft mit beschränkter haftung",
             "gmbh."),
    "gmbh_co_kg": ("gmbh & co. kg", "gmbh & co kg", "gmbh und co. kg", "gmbh+co.kg",
                   "gmbh & co.kg", "g.m.b.h. & co. kg"),
    "ag": ("aktiengesellschaft", "a.g."),
    "ag_co_kg": ("ag & co. kg", "ag & co kg"),
    "kg": ("kommanditgesellschaft", "k.g."),
    "ohg": ("offene handelsgesellschaft", "o.h.g."),
    "ek": ("e.k.", "e. k.", "eingetragener kaufmann", "eingetragene kauffrau", "e.kfm.",
           "e.kfr."),
    "ug": ("ug (haftungsbeschraenkt)", "ug (haftungsbeschränkt)", "ug haftungsbeschraenkt",
           "unternehmergesellschaft"),
    "se": ("societas europaea",),
    "eg": ("e.g.", "eingetragene genossenschaft"),
    "ev": ("e.v.", "eingetragener verein"),
    "stiftung": (),
    "kgaa": ("kgaa", "kommanditgesellschaft auf aktien"),
    "ltd": ("limited", "ltd.", "co. ltd", "co., ltd."),
    "plc": ("p.l.c.", "public limited company"),
    "inc": ("inc.", "incorporated"),
    "llc": ("l.l.c.",),
    "corp": ("corp.", "corporation"),
    "sa": ("s.a.", "société anonyme", "sociedad anonima", "sociedad anónima"),
    "sas": ("s.a.s.",),
    "sarl": ("s.a.r.l.", "s.à r.l.", "sàrl"),
    "srl": ("s.r.l.", "s.r.l"),
    "spa": ("s.p.a.",),
    "bv": ("b.v.",),
    "nv": ("n.v.",),
    "sp_z_oo": ("sp. z o.o.", "sp.z o.o.", "spolka z ograniczona odpowiedzialnoscia"),
    "sro": ("s.r.o.", "spol. s r.o."),
    "as": ("a.s.",),
    "ab": ("aktiebolag",),
    "oy": ("oyj",),
}
STREET_WORDS = {
    "strasse": ("str.", "str", "straße", "strasse"),
    "platz": ("pl.", "platz"),
    "weg": ("weg",),
    "allee": ("allee",),
    "ring": ("ring",),
    "chaussee": ("chaussee", "ch."),
    "gasse": ("gasse", "g."),
    "ufer": ("ufer",),
    "damm": ("damm",),
    "postfach": ("postfach", "pf", "pf.", "p.f.", "pob", "p.o. box", "po box", "boîte postale",
                 "bp", "casella postale"),
    "avenue": ("ave.", "ave", "av.", "avenue"),
    "road": ("rd.", "rd", "road"),
    "street": ("st.", "st", "street"),
    "boulevard": ("blvd.", "blvd", "bd", "boulevard"),
    "rue": ("rue", "r."),
    "via": ("via", "v."),
    "calle": ("calle", "c/", "c."),
    "laan": ("laan", "ln."),
    "straat": ("straat",),
    "ulica": ("ul.", "ul", "ulica"),
}
STREET_ENDINGS = ("strasse", "str")
CITY_SUFFIXES = (
    " am main", " a. main", " a.m.", " an der donau", " a.d. donau", " an der saale",
    " im breisgau", " i. br.", " i.br.",
)
CITY_DISTRICT_MARKS = (" ot ", " - ")
CITY_ALIASES = {
    "muenchen": ("munich", "monaco di baviera", "münchen"),
    "koeln": ("cologne", "köln"),
    "nuernberg": ("nuremberg", "nürnberg"),
    "wien": ("vienna", "vienne"),
    "zuerich": ("zurich", "zürich"),
    "frankfurt": ("frankfurt am main", "frankfurt/main", "frankfurt a. m.", "ffm"),
}

# -- what accounts of one partner have in common: own texts -----------------------------
SAME_KEY = {"VAT": "USt-ID gleich", "IBAN": "IBAN gleich"}
NAME_ALIKE = ("Name nach Normalisierung exakt", "Name ähnlich")
STREET_ALIKE = ("Straße gleich", "Straße ähnlich")
SAME_PLACE = {"postal_code": "PLZ gleich", "city_norm": "Ort gleich"}
FUZZY_HINT = "Weniger als die Hälfte der Partner hat einen starken Schlüssel"
DUPLICATE_SEEN = "{n} Konten für {name}"
DUPLICATE_LEAD = "Führendes Konto {account} prüfen, die übrigen {rest} sperren"
DUPLICATE_OPTIONS = (
    ("Zusammenführen prüfen", "Posten werden auf das führende Konto umgebucht"),
    ("Konto sperren", "Auf das Konto wird nicht mehr gebucht"),
    ("Löschvormerkung", "Das Konto wird archiviert, sobald es leer ist"),
)
GOLDEN_SOURCE = "{field} aus {account}"

# -- change documents, clearings, rebookings, offsets: own texts ------------------------
BANK_TABLES = ("LFBK", "KNBK", "TIBAN")
CHANGE_SEEN = "Bankdaten {days} Tage vor einer Zahlung geändert, {n} Zahlungen"
CHANGE_NOTE = "Letzte Änderung der Bankdaten vor der Zahlung"
CHANGE_FORMULA = "Summe der Zahlungen nach der Änderung"
OVERPAID = "{paid} gezahlt auf {owed}"
OVERPAID_NOTE = "Ausgleich ohne Gutschrift, Zahlung über dem Rechnungsbetrag"
OVERPAID_FORMULA = "{paid} abzüglich {owed}"
REBOOKED = "{n} Posten zwischen zwei Debitoren umgebucht"
REBOOKED_NOTE = "Gegenläufige Posten eines Belegs mit gleichem Betrag"
OFFSET_SEEN = "Forderung {a} und Verbindlichkeit {b} beim selben Partner"
OFFSET_NOTE = "Verbunden über USt-ID oder IBAN"
OFFSET_FORMULA = "Kleinerer Betrag von Forderung und Verbindlichkeit"
PAID_ON_TWO = "Beleg auf einem Konto der Dublette"

# -- kind of impact by check: money that is gone, money at stake; fixed values ----------
IMPACT_KIND = {
    "AP-LEA-001": "loss", "AP-LEA-002": "loss", "AR-CON-002": "exposure",
    "AR-VAL-003": "exposure", "AP-VAL-003": "exposure",
}

# -- postal codes by country ------------------------------------------------------------
POSTAL_CODE_PATTERNS = {
    "DE": r"^\d{5}$",
    "AT": r"^\d{4}$",
    "CH": r"^\d{4}$",
    "LI": r"^\d{4}$",
    "NL": r"^\d{4}\s?[A-Z]{2}$",
    "BE": r"^\d{4}$",
    "LU": r"^L?-?\d{4}$",
    "FR": r"^\d{5}$",
    "IT": r"^\d{5}$",
    "ES": r"^\d{5}$",
    "PT": r"^\d{4}-\d{3}$",
    "PL": r"^\d{2}-\d{3}$",
    "CZ": r"^\d{3}\s?\d{2}$",
    "SK": r"^\d{3}\s?\d{2}$",
    "HU": r"^\d{4}$",
    "DK": r"^\d{4}$",
    "SE": r"^\d{3}\s?\d{2}$",
    "NO": r"^\d{4}$",
    "FI": r"^\d{5}$",
    "IE": r"^[A-Z]\d{2}\s?[A-Z0-9]{4}$",
    "GB": r"^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$",
    "US": r"^\d{5}(-\d{4})?$",
    "CA": r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$",
    "RO": r"^\d{6}$",
    "BG": r"^\d{4}$",
    "HR": r"^\d{5}$",
    "SI": r"^\d{4}$",
    "GR": r"^\d{3}\s?\d{2}$",
    "TR": r"^\d{5}$",
    "CN": r"^\d{6}$",
    "JP": r"^\d{3}-?\d{4}$",
    "IN": r"^\d{6}$",
    "AU": r"^\d{4}$",
}

# -- sentences of the checks of master data and terms beside the client's 17 --------------
DIRECT_DEBIT_METHODS = ("E", "L")
TRANSFER_METHODS = ("T", "U")
VAT_MISSING = "USt-ID nicht gepflegt, Sitzland {country}"
BANK_MISSING = "Zahlweg {methods} ohne Bankverbindung"
DUNNING_MISSING = "Mahnverfahren nicht gepflegt"
DUNNING_PROPOSAL = "Standardverfahren {procedure} eintragen"
POSTAL_WRONG = "entspricht nicht dem Format für {country}"
TERMS_DEVIATE = "{n} von {all} Rechnungen mit anderer Zahlungsbedingung"
TERMS_USED = "{n} von {all} Rechnungen tragen {terms}"
BANK_ABROAD = "IBAN aus {bank}, Sitz in {country}"
IBAN_OF_CUSTOMERS = "bei {n} Debitorenkonten hinterlegt, ohne Regulierer-Bezug"
NEVER_POSTED = "seit Anlage am {day} ohne Posten"
DISCOUNT_LATE = "Skonto nach Fristablauf auf {n} Rechnungen"
DISCOUNT_LATE_FORMULA = "Summe der nach Fristablauf gewährten Skonti"
PAID_BLOCKED = "{n} Zahlungen an ein gesperrtes oder zur Löschung vorgemerktes Konto"
PAID_BLOCKED_FORMULA = "Summe der Zahlungen der letzten {months} Monate"

# -- sentences of review ------------------------------------------------------------------
GROUP_RELEASED = "Über Stichprobe der Regelgruppe freigegeben ({size} von {total} geprüft)"
ACCEPT_FOUR_EYES = "Bankdaten: Vier-Augen erforderlich – nur Review"
ACCEPT_CHOOSE = "Erst eine der Optionen wählen"
