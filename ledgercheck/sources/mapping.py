"""How export tables map to the canonical model.

The tables below are fixed values: the technical field names of an SAP ECC export, the
canonical column each one fills, the fields that may be there without being read, and the
type class of every mapped field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- fixed values --------------------------------------------------------------------
_PARTNER = {
    "LAND1": "country", "NAME1": "name1", "NAME2": "name2", "NAME3": "name3",
    "NAME4": "name4", "SORTL": "search_term", "ORT01": "city", "PSTLZ": "postal_code",
    "REGIO": "region", "STRAS": "street", "PFACH": "po_box", "PSTL2": "po_box_postal_code",
    "ADRNR": "address_id", "XCPDK": "is_one_time", "LOEVM": "deletion_flag",
    "SPERR": "central_block", "KONZS": "group_key", "SPRAS": "language",
    "ERDAT": "created_on", "ERNAM": "created_by", "TELF1": "phone",
    "STCD1": "tax_id.TAX1", "STCD2": "tax_id.TAX2", "STCEG": "tax_id.VAT",
}
_COMPANY = {
    "BUKRS": "company_code", "AKONT": "recon_account", "ZTERM": "payment_terms",
    "SPERR": "posting_block", "LOEVM": "deletion_flag", "ZWELS": "payment_methods",
    "ZAHLS": "payment_block", "TOGRU": "tolerance_group", "ZUAWA": "sort_key",
    "ERDAT": "created_on", "ERNAM": "created_by",
}
_BANK = {
    "BANKS": "bank_country", "BANKL": "bank_key", "BANKN": "account_number",
    "BKONT": "bank_control_key", "BVTYP": "partner_bank_type", "KOINH": "account_holder",
    "XEZER": "collection_auth",
}
_ITEM = {
    "BUKRS": "company_code", "GJAHR": "fiscal_year", "BELNR": "document_no",
    "BUZEI": "line_item", "BUDAT": "posting_date", "BLDAT": "document_date",
    "CPUDT": "entry_date", "BLART": "doc_type", "BSCHL": "posting_key",
    "SHKZG": "debit_credit", "UMSKZ": "special_gl", "WAERS": "currency",
    "WRBTR": "amount_doc", "DMBTR": "amount_local", "XBLNR": "reference",
    "ZUONR": "assignment", "SGTXT": "item_text", "ZFBDT": "baseline_date",
    "ZTERM": "payment_terms", "ZBD1T": "cash_disc_days1", "ZBD1P": "cash_disc_pct1",
    "SKFBT": "cash_disc_base", "SKNTO": "cash_disc_taken", "ZLSCH": "payment_method",
    "ZLSPR": "payment_block", "REBZG": "invoice_ref_doc", "HKONT": "gl_account",
    "AUGDT": "clearing_date", "AUGBL": "clearing_doc",
}
_ITEM_IGNORED = (
    "MANDT UMSKS MONAT GSBER MWSKZ MWSTS ZBD2T ZBD2P ZBD3T WSKTO REBZJ REBZZ REBZT "
    "XREF1 XREF2 XREF3 FILKD ZLSCH2 "
)
_AR_ITEM_IGNORED = _ITEM_IGNORED + "MANSP MSCHL MANST MADAT VBELN VBEL2 KKBER"
_AP_ITEM_IGNORED = _ITEM_IGNORED + "EBELP EMPFB"

FIELD_TYPES = {
    "amount": "DMBTR SKFBT SKNTO WRBTR",
    "percent": "ZBD1P ZPRZ1 ZPRZ2",
    "date": "AUGDT BLDAT BUDAT CPUDT ERDAT MADAT VALID_FROM ZFBDT",
    "integer": "MAHNS ZBD1T ZTAG1 ZTAG2 ZTAG3 ZTAGG",
    "flag": "LOEVM REPRF SPERR XCPDK XEZER",
}
TAX_FIELDS = {"STCD1": "TAX1", "STCD2": "TAX2", "STCEG": "VAT"}
KIND_OF = {field: kind for kind, fields in FIELD_TYPES.items() for field in fields.split()}


@dataclass(frozen=True)
class ExportTable:
    """One export table: what it fills, for which role, and from which fields."""

    name: str
    target: str
    fields: dict[str, str]
    ignored: frozenset[str]
    role: str | None = None
    is_open: bool | None = None

    @property
    def main_target(self) -> str | None:
        """The canonical table this export fills, NULL for one that only adds a column."""
        return None if "." in self.target else self.target

    def source_of(self, target: str) -> str | None:
        return next((s for s, t in self.fields.items() if t == target), None)

    def kind(self, field: str) -> str:
        return KIND_OF.get(field, "text")


def _table(name, target, fields, ignored="", role=None, is_open=None) -> ExportTable:
    return ExportTable(name, target, fields, frozenset(ignored.split()), role, is_open)


_ALL = [
    _table("T001", "company_code",
           {"BUKRS": "company_code", "BUTXT": "name", "WAERS": "currency", "LAND1": "country"},
           "MANDT ORT01 SPRAS KTOPL PERIV KOKFI RCOMP ADRNR STCEG FIKRS WAABW XFDIS TXJCD "
           "XVALV XSKFN XBBBF XBBBS"),
    _table("KNA1", "business_partner",
           {"KUNNR": "source_id", **_PARTNER, "KTOKD": "account_group", "KNRZA": "alt_payer_key"},
           "MANDT ANRED TELFX TELF2 DUEFL NODEL CASSD KUKLA BRSCH STKZU STKZN ADRNR2",
           role="CUSTOMER"),
    _table("LFA1", "business_partner",
           {"LIFNR": "source_id", **_PARTNER, "KTOKK": "account_group", "LNRZA": "alt_payer_key"},
           "MANDT ANRED TELFX SPERM SPERQ XZEMP EMNFR DUEFL NODEL KUNNR", role="VENDOR"),
    _table("KNB1", "bp_company_code",
           {"KUNNR": "bp_key", **_COMPANY, "MAHNA": "dunning_procedure", "KNRZB": "alt_payer_key"},
           "MANDT XVERR FDGRV VZSKZ XAUSZ ZINDT ZINRT MGRUP ZSABE KVERM ALTKN XEDIP HBKID",
           role="CUSTOMER"),
    _table("LFB1", "bp_company_code",
           {"LIFNR": "bp_key", **_COMPANY, "LNRZB": "alt_payer_key",
            "REPRF": "double_invoice_check"},
           "MANDT XVERR QLAND MINDK HBKID XEDIP ZINDT FDGRV ALTKN XPORE CERDT KVERM",
           role="VENDOR"),
    _table("KNBK", "bp_bank_account", {"KUNNR": "bp_key", **_BANK},
           "MANDT BKREF EBPP_ACCNAME", role="CUSTOMER"),
    _table("LFBK", "bp_bank_account", {"LIFNR": "bp_key", **_BANK},
           "MANDT BKREF EBPP_ACCNAME", role="VENDOR"),
    _table("TIBAN", "bp_bank_account.iban",
           {"BANKS": "bank_country", "BANKL": "bank_key", "BANKN": "account_number",
            "BKONT": "bank_control_key", "IBAN": "iban", "VALID_FROM": "valid_from"},
           "MANDT ERDAT ERNAM"),
    _table("KNVP", "bp_partner_function",
           {"KUNNR": "bp_key", "VKORG": "sales_org", "VTWEG": "dist_channel",
            "SPART": "division", "PARVW": "function", "KUNN2": "partner_bp_key",
            "PARZA": "counter"},
           "MANDT LIFNR PERNR PARNR KNREF DEFPA", role="CUSTOMER"),
    _table("KNB5", "bp_dunning",
           {"KUNNR": "bp_key", "BUKRS": "company_code", "MABER": "dunning_area",
            "MAHNS": "dunning_level", "MADAT": "last_dunned_on", "MANSP": "dunning_block",
            "KNRMA": "dunning_recipient_key"},
           "MANDT", role="CUSTOMER"),
    _table("T052", "payment_terms",
           {"ZTERM": "terms_key", "ZTAGG": "day_limit", "ZTAG1": "days1", "ZPRZ1": "pct1",
            "ZTAG2": "days2", "ZPRZ2": "pct2", "ZTAG3": "days3"},
           "MANDT ZDART ZFAEL ZMONA ZSTG1 ZSMN1 ZSTG2 ZSMN2 ZSTG3 ZSMN3 XSPLT KOART XSCRC"),
    _table("T052U", "payment_terms.description",
           {"ZTERM": "terms_key", "SPRAS": "language", "TEXT1": "description"},
           "MANDT ZTAGG TEXT2"),
    _table("ADR6", "business_partner.email",
           {"ADDRNUMBER": "address_id", "SMTP_ADDR": "email"},
           "CLIENT PERSNUMBER DATE_FROM CONSNUMBER FLGDEFAULT FLG_NOUSE HOME_FLAG "
           "VALID_FROM VALID_TO REMARK DFT_RECEIV"),
    _table("BSID", "fi_item", {"KUNNR": "bp_key", **_ITEM}, _AR_ITEM_IGNORED,
           role="CUSTOMER", is_open=True),
    _table("BSAD", "fi_item", {"KUNNR": "bp_key", **_ITEM}, _AR_ITEM_IGNORED,
           role="CUSTOMER", is_open=False),
    _table("BSIK", "fi_item", {"LIFNR": "bp_key", **_ITEM, "EBELN": "po_number"},
           _AP_ITEM_IGNORED, role="VENDOR", is_open=True),
    _table("BSAK", "fi_item", {"LIFNR": "bp_key", **_ITEM, "EBELN": "po_number"},
           _AP_ITEM_IGNORED, role="VENDOR", is_open=False),
]
EXPORT_TABLES = {table.name: table for table in _ALL}

# -- fixed values: columns by which a table is told ----------------------------------------
TELLING = {
    "KNA1": ("KUNNR", "LAND1", "NAME1", "ORT01"),
    "KNB1": ("KUNNR", "BUKRS", "AKONT"),
    "KNBK": ("KUNNR", "BANKS", "BANKL", "BANKN"),
    "TIBAN": ("BANKS", "BANKL", "BANKN", "IBAN"),
    "KNVP": ("KUNNR", "PARVW", "KUNN2"),
    "KNVV": ("KUNNR", "VKORG", "VTWEG", "SPART"),
    "KNB5": ("KUNNR", "BUKRS", "MABER"),
    "LFA1": ("LIFNR", "LAND1", "NAME1", "ORT01"),
    "LFB1": ("LIFNR", "BUKRS", "AKONT"),
    "LFBK": ("LIFNR", "BANKS", "BANKL", "BANKN"),
    "BSID": ("KUNNR", "BELNR", "BUZEI", "DMBTR", "AUGDT"),
    "BSAD": ("KUNNR", "BELNR", "BUZEI", "DMBTR", "AUGBL"),
    "BSIK": ("LIFNR", "BELNR", "BUZEI", "DMBTR", "AUGDT"),
    "BSAK": ("LIFNR", "BELNR", "BUZEI", "DMBTR", "AUGBL"),
    "T001": ("BUKRS", "BUTXT", "WAERS"),
    "T052": ("ZTERM", "ZTAG1", "ZPRZ1"),
    "T052U": ("ZTERM", "TEXT1"),
    "ADR6": ("ADDRNUMBER", "SMTP_ADDR"),
    "CDHDR": ("OBJECTCLAS", "OBJECTID", "CHANGENR"),
    "CDPOS": ("OBJECTCLAS", "CHANGENR", "TABNAME", "FNAME"),
}

# the order in which two sources of one target are taken; the earlier one wins a key
SOURCE_ORDER = sorted(EXPORT_TABLES)


def check_header(delivered: DataFrame) -> DataFrame:
    """Compare delivered columns (table, column) with the mapping.

    One row per problem: `unknown` for a column the mapping neither reads nor ignores,
    `missing` for a mapped column the export does not have.
    """
    spark = delivered.sparkSession
    rows = [
        (t.name, c, "mapped") for t in _ALL for c in t.fields
    ] + [(t.name, c, "ignored") for t in _ALL for c in t.ignored]
    known = spark.createDataFrame(rows, "table string, column string, use string")
    wanted = known.filter("use = 'mapped'").join(
        delivered.select("table").distinct(), "table", "left_semi"
    )
    unknown = delivered.join(known, ["table", "column"], "left_anti")
    missing = wanted.join(delivered, ["table", "column"], "left_anti")
    return unknown.select("table", "column", F.lit("unknown").alias("problem")).unionByName(
        missing.select("table", "column", F.lit("missing").alias("problem"))
    )


def filled_columns(rows: DataFrame, file: str) -> DataFrame:
    """file, column: the columns of an export that have a value, by one pass over all its rows.

    A blank, and a date of zeros, is no value."""
    blank = r"^(\s*|0{8})$"
    counts = rows.agg(*[F.count(F.when(~F.col(f"`{c}`").rlike(blank), 1)).alias(c)
                        for c in rows.columns])
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n"))
                                 for c in rows.columns])).alias("x")
    return counts.select(listed).filter("x.n > 0").select(
        F.lit(file).alias("file"), F.col("x.column").alias("column"))


def tell_tables(delivered: DataFrame) -> DataFrame:
    """Which table a file is, by its columns (file, column): file, table, outcome, fits.

    A table fits when the file has all its telling columns.  Of several fits the table is the one
    that knows most of the file's columns, then the one with most telling columns.  Two such fits
    are `ambiguous`, no fit is `unknown`, and neither names a table."""
    spark = delivered.sparkSession
    rows = []
    for table, columns in TELLING.items():
        known = EXPORT_TABLES.get(table)
        names = {*columns, *(known.fields if known else ()), *(known.ignored if known else ())}
        rows += [(table, c, c in columns, len(columns)) for c in sorted(names)]
    known = spark.createDataFrame(rows, "table string, column string, telling boolean, needed int")
    fits = delivered.distinct().join(known, "column").groupBy("file", "table", "needed").agg(
        F.count_if("telling").alias("n"), F.count("*").alias("known")).filter("n = needed")
    best = fits.groupBy("file", "known", "needed").agg(
        F.count("*").alias("ties"), F.min("table").alias("table")).groupBy("file").agg(
        F.max(F.struct("known", "needed", "ties", "table")).alias("best"),
        F.sum("ties").alias("fits"))
    told = delivered.select("file").distinct().join(best, "file", "left")
    unique = F.col("best.ties") == 1
    return told.select(
        "file", F.when(unique, F.col("best.table")).alias("table"),
        F.when(unique, F.lit("told")).when(F.col("best").isNotNull(), F.lit("ambiguous"))
        .otherwise(F.lit("unknown")).alias("outcome"),
        F.coalesce("fits", F.lit(0)).cast("int").alias("fits"))


def unknown_columns(table: ExportTable, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in table.fields and c not in table.ignored]


def missing_columns(table: ExportTable, columns: list[str]) -> list[str]:
    return [c for c in table.fields if c not in columns]
