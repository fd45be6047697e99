"""Raw exports derived from the driver tables.

Customers and suppliers become partners, orders and line items become postings; every
source row becomes a row.  The formulas plant the irregularities the checks look for, and
are written a second time, independently, in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgercheck.operators.staging import ROW_NO

COUNTRIES = ("DE", "AT", "FR", "IT", "NL", "PL", "GR", "BE", "ES", "CH")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _numbered(df: DataFrame, number: str) -> DataFrame:
    """A row number that follows from the row itself; exports in files get their line."""
    return df.withColumn(ROW_NO, F.expr(number).cast("bigint"))


def _x(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'X' END"


def _ten(key: str) -> str:
    return f"lpad(CAST({key} AS STRING), 10, '0')"


def _company(key: str) -> str:
    return f"CASE WHEN {key} % 3 < 2 THEN '1000' ELSE '2000' END"


def _day(expression: str) -> str:
    return f"replace(CAST({expression} AS STRING), '-', '')"


_CREATED = "CASE WHEN k % 71 <> 9 THEN date_add(DATE'1993-01-01', CAST(k % 2500 AS INT)) END"
_N9 = "lpad(CAST((vk * 7919 + 12345) % 1000000000 AS STRING), 9, '0')"
_BBAN = (
    "concat(lpad(CAST(10000000 + m * 7 + off DIV 1000 AS STRING), 8, '0'), "
    "lpad(CAST(m * 13 + off AS STRING), 10, '0'))"
)


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers with the numbers all partner tables are derived from."""
    customers = _read(spark, sf_dir, "customer").selectExpr(
        "'C' AS side", "c_custkey AS k", "c_name AS name", "c_nationkey AS nation",
        "c_custkey AS vk", "c_custkey AS m", "CAST(0 AS BIGINT) AS off",
    )
    suppliers = (
        _read(spark, sf_dir, "supplier")
        .selectExpr("s_suppkey AS k", "s_name AS name", "s_nationkey AS nation",
                    "CASE WHEN s_suppkey % 14 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS m")
        .selectExpr("'V' AS side", "k", "name", "nation",
                    "CASE WHEN k % 10 = 0 THEN k ELSE k + 5000000 END AS vk", "m",
                    "CAST(CASE WHEN m % 20 = 0 THEN 0 ELSE 5000000 END AS BIGINT) AS off")
    )
    base = customers.unionByName(suppliers)
    country = F.element_at(
        F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("nation") % 10 + 1).cast("int")
    )
    return base.withColumns({
        "country": country, "n9": F.expr(_N9), "bban": F.expr(_BBAN),
        "created": F.expr(_CREATED), "id": F.expr(_ten("k")),
    })


def _vat() -> tuple[Column, Column]:
    """First match wins: no, short, foreign or unknown prefix, else the national form."""
    prefix = F.expr(
        "CASE WHEN side = 'V' AND k % 10 = 0 THEN 'DE' "
        "WHEN country = 'GR' THEN 'EL' ELSE country END"
    )
    national = F.expr(
        "CASE vat_prefix WHEN 'AT' THEN concat('U', left(n9, 8)) WHEN 'FR' THEN concat('12', n9) "
        "WHEN 'IT' THEN concat('01', n9) WHEN 'NL' THEN concat(n9, 'B01') "
        "WHEN 'PL' THEN concat('5', n9) WHEN 'BE' THEN concat('0', n9) "
        "WHEN 'ES' THEN concat('A', left(n9, 7), '1') WHEN 'CH' THEN concat('E', n9, 'MWST') "
        "ELSE n9 END"
    )
    return prefix, (
        F.when(F.expr("k % 43 = 2"), F.col("n9"))
        .when(F.expr("k % 37 = 6"), F.concat("vat_prefix", F.left("n9", F.lit(5))))
        .when(F.expr("k % 31 = 8"), F.expr(
            "CASE WHEN country = 'DE' THEN concat('ATU', left(n9, 8)) ELSE concat('DE', n9) END"))
        .when(F.expr("k % 61 = 10"), F.concat(F.lit("XX"), F.col("n9")))
        .when(F.expr("k % 5 = 0"), F.concat("vat_prefix", F.lit(" "), national))
        .otherwise(F.concat("vat_prefix", national))
    )


def _master(base: DataFrame, side: str) -> DataFrame:
    key, group, payer = (
        ("KUNNR", "KTOKD", "KNRZA") if side == "C" else ("LIFNR", "KTOKK", "LNRZA")
    )
    prefix, vat = _vat()
    df = base.filter(F.col("side") == side).withColumn("vat_prefix", prefix)
    df = df.withColumn("STCEG", vat)
    payer_value = "CASE WHEN k % 28 = 1 THEN " + _ten("k - 1") + " END" if side == "V" else "''"
    return _numbered(df.selectExpr(
        "k", "'100' AS MANDT", f"id AS {key}", "country AS LAND1",
        "CASE WHEN k % 97 = 3 THEN concat('Test ', name) WHEN k % 101 = 4 THEN 'unbekannt' "
        "ELSE name END AS NAME1",
        "CASE WHEN k % 89 = 5 THEN 'MUSTER' ELSE concat('Ort ', nation) END AS ORT01",
        "lpad(CAST(k % 90000 AS STRING), 5, '0') AS PSTLZ",
        "concat('Weg ', CAST(k % 50 AS STRING)) AS STRAS", "id AS ADRNR",
        f"'{'DEBI' if side == 'C' else 'KRED'}' AS {group}",
        f"{_x('k % 12 = 5')} AS XCPDK", f"{_x('k % 41 = 0')} AS LOEVM",
        f"{_x('k % 53 = 1')} AS SPERR", f"{payer_value} AS {payer}",
        f"coalesce({_day('created')}, '00000000') AS ERDAT",
        "concat(left(n9, 3), '/', substr(n9, 4, 3), '/', substr(n9, 7, 3)) AS STCD1", "STCEG",
    ), "k").drop("k")


def _company_rows(base: DataFrame, side: str) -> DataFrame:
    key, payer = ("KUNNR", "KNRZB") if side == "C" else ("LIFNR", "LNRZB")
    payer_value = "CASE WHEN k % 42 = 1 THEN " + _ten("k - 1") + " END" if side == "V" else "''"
    check = ["CASE WHEN k % 6 <> 0 THEN 'X' END AS REPRF"] if side == "V" else []
    # some partners deliver the same company code twice
    copies = base.filter(F.col("side") == side).withColumn(
        "copy", F.explode(F.expr("sequence(0, CASE WHEN k % 83 = 7 THEN 1 ELSE 0 END)"))
    )
    return _numbered(copies.selectExpr(
        "k", "copy", f"id AS {key}", f"{_company('k')} AS BUKRS", "'0000140000' AS AKONT",
        "CASE WHEN k % 23 <> 0 THEN concat('ZB0', CAST(k % 5 AS STRING)) END AS ZTERM",
        f"{_x('k % 59 = 2')} AS SPERR", f"{_x('k % 67 = 4')} AS LOEVM",
        f"{payer_value} AS {payer}", f"coalesce({_day('created')}, '00000000') AS ERDAT", *check,
    ), "k * 2 + copy").drop("k", "copy")


def _bank_rows(base: DataFrame, side: str) -> DataFrame:
    key = "KUNNR" if side == "C" else "LIFNR"
    return _numbered(base.filter(F.col("side") == side).selectExpr(
        "k", f"id AS {key}", "'DE' AS BANKS", "left(bban, 8) AS BANKL",
        "substr(bban, 9, 10) AS BANKN", "'' AS BKONT",
        "lpad(CAST(k % 3 + 1 AS STRING), 4, '0') AS BVTYP", "name AS KOINH",
    ), "k").drop("k")


def _ibans(base: DataFrame) -> DataFrame:
    check = (
        "CASE WHEN k % 29 = 4 THEN '00' ELSE lpad(CAST(98 - "
        "CAST(CAST(concat(bban, '131400') AS DECIMAL(38,0)) % 97 AS INT) AS STRING), 2, '0') END"
    )
    return _numbered(base.selectExpr(
        "k", "side", "'DE' AS BANKS", "left(bban, 8) AS BANKL", "substr(bban, 9, 10) AS BANKN",
        f"concat('DE', {check}, ' ', bban) AS IBAN",
        f"coalesce({_day('created')}, '00000000') AS VALID_FROM", "'' AS BKONT",
    ), "k * 2 + CASE WHEN side = 'C' THEN 0 ELSE 1 END").drop("k", "side")


def _german(amount: str) -> str:
    return f"translate(format_number({amount}, 2), ',.', '.,')"


def _customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _read(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey AS n", "o_orderstatus AS status", "to_date(o_orderdate) AS day",
            "CAST(o_totalprice AS DECIMAL(15,2)) AS amount",
            # branches post through their head office
            "CASE WHEN o_custkey % 19 = 3 THEN o_custkey - 1 ELSE o_custkey END AS k",
            "CASE WHEN o_orderkey % 50 = 7 THEN 'DZ' WHEN o_orderkey % 40 = 1 THEN 'DG' "
            "WHEN o_orderkey % 97 = 11 THEN 'AB' ELSE 'DR' END AS BLART",
        )
        .withColumn("open", F.expr("BLART = 'DZ' OR status = 'O'"))
        .selectExpr(
            "open", "n AS _row_no",
            f"CASE WHEN n % 701 = 5 THEN {_ten('k + 90000000')} ELSE {_ten('k')} END AS KUNNR",
            f"{_company('k')} AS BUKRS", "CAST(year(day) AS STRING) AS GJAHR",
            f"{_ten('n')} AS BELNR", "'001' AS BUZEI", f"{_day('day')} AS BUDAT",
            f"CASE WHEN n % 499 = 3 THEN 'n/a' ELSE {_day('day')} END AS BLDAT",
            f"{_day('day')} AS CPUDT", "BLART",
            "CASE WHEN BLART IN ('DZ', 'DG') THEN 'H' ELSE 'S' END AS SHKZG",
            "CASE WHEN BLART = 'DZ' AND n % 150 = 107 THEN 'A' END AS UMSKZ",
            "CASE WHEN n % 601 <> 4 THEN 'EUR' END AS WAERS",
            f"{_german('amount')} AS WRBTR", f"{_german('amount')} AS DMBTR",
            "CASE WHEN BLART = 'DZ' THEN CASE WHEN n % 100 <> 7 THEN concat('ZA/', n) END "
            "ELSE concat('rg-', n) END AS XBLNR",
            f"{_day('day')} AS ZFBDT",
            "CASE WHEN n % 4 = 0 THEN 'ZB04' ELSE concat('ZB0', CAST(k % 5 AS STRING)) END "
            "AS ZTERM",
            f"CASE WHEN open THEN '00000000' ELSE {_day('date_add(day, CAST(n % 60 AS INT))')} "
            "END AS AUGDT",
            "CASE WHEN NOT open THEN concat('A', n) END AS AUGBL",
        )
    )


def _vendor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _read(spark, sf_dir, "lineitem")
        .selectExpr(
            "l_orderkey AS n", "l_linenumber AS line", "l_linestatus AS status",
            "CAST(l_quantity AS INT) AS quantity", "to_date(l_shipdate) AS day",
            "CAST(floor(l_extendedprice / 2500) * 2500 + 100 AS DECIMAL(15,2)) AS amount",
            "CASE WHEN l_suppkey % 33 = 7 THEN l_suppkey - 1 ELSE l_suppkey END AS k",
            "CASE WHEN l_returnflag = 'R' AND l_quantity <= 5 THEN 'KG' "
            "WHEN l_orderkey % 61 = 13 THEN 'KZ' WHEN l_linenumber % 2 = 0 THEN 'KR' "
            "ELSE 'RE' END AS BLART",
        )
        .withColumn("open", F.expr("BLART <> 'KG' AND status = 'O'"))
        .selectExpr(
            "open", "n * 10 + line AS _row_no", f"{_ten('k')} AS LIFNR",
            f"{_company('k')} AS BUKRS", "CAST(year(day) AS STRING) AS GJAHR",
            f"{_ten('n')} AS BELNR", "lpad(CAST(line AS STRING), 3, '0') AS BUZEI",
            f"{_day('day')} AS BUDAT", f"{_day('day')} AS BLDAT", f"{_day('day')} AS CPUDT",
            "BLART",
            "CASE WHEN n % 499 = 3 THEN '?' WHEN BLART IN ('KG', 'KZ') THEN 'S' ELSE 'H' END "
            "AS SHKZG",
            "CASE WHEN line = 4 AND n % 37 = 5 THEN 'USD' ELSE 'EUR' END AS WAERS",
            "CAST(amount AS STRING) AS WRBTR", "CAST(amount AS STRING) AS DMBTR",
            "CASE WHEN BLART = 'KG' THEN concat('GS', n) ELSE concat('RE', n % 50) END AS XBLNR",
            f"{_day('day')} AS ZFBDT", "concat('ZB0', CAST(k % 5 AS STRING)) AS ZTERM",
            "CASE WHEN k % 2 = 0 THEN '14' ELSE '0' END AS ZBD1T",
            "CASE WHEN k % 2 = 0 THEN '2.000' ELSE '0.000' END AS ZBD1P",
            "CASE WHEN k % 2 = 0 THEN CAST(amount AS STRING) ELSE '0.00' END AS SKFBT",
            "CASE WHEN k % 2 = 0 AND n % 9 = 0 "
            "THEN CAST(CAST(amount * 0.02 AS DECIMAL(15,2)) AS STRING) ELSE '0.00' END AS SKNTO",
            f"CASE WHEN open THEN '00000000' ELSE {_day('date_add(day, quantity)')} END AS AUGDT",
            "CASE WHEN NOT open THEN concat('A', n) END AS AUGBL",
        )
    )


def raw_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All export tables of the derived client, every column text."""
    base = partners(spark, sf_dir)
    ar, ap = _customer_items(spark, sf_dir), _vendor_items(spark, sf_dir)
    nation = _read(spark, sf_dir, "nation")
    return {
        "T001": _numbered(_read(spark, sf_dir, "region").selectExpr(
            "r_regionkey", "CAST((r_regionkey + 1) * 1000 AS STRING) AS BUKRS",
            "r_name AS BUTXT", "'EUR' AS WAERS", "'DE' AS LAND1"), "r_regionkey"
        ).drop("r_regionkey"),
        "KNA1": _master(base, "C"),
        "LFA1": _master(base, "V"),
        "KNB1": _company_rows(base, "C"),
        "LFB1": _company_rows(base, "V"),
        "KNBK": _bank_rows(base, "C"),
        "LFBK": _bank_rows(base, "V"),
        "TIBAN": _ibans(base),
        "KNVP": _numbered(base.filter("side = 'C'").selectExpr(
            "k", "id AS KUNNR", "'1000' AS VKORG", "'10' AS VTWEG", "'00' AS SPART",
            "'RG' AS PARVW",
            f"CASE WHEN k % 13 = 4 THEN {_ten('k - 1')} ELSE id END AS KUNN2",
            "'000' AS PARZA"), "k").drop("k"),
        "KNB5": _numbered(base.filter("side = 'C'").selectExpr(
            "k", "id AS KUNNR", f"{_company('k')} AS BUKRS", "'01' AS MABER",
            "CAST(k % 4 AS STRING) AS MAHNS", f"{_day('created')} AS MADAT"), "k").drop("k"),
        "T052": _numbered(nation.selectExpr(
            "n_nationkey AS n", "concat('ZB0', CAST(n_nationkey % 5 AS STRING)) AS ZTERM",
            "lpad(CAST(n_nationkey DIV 5 * 10 AS STRING), 2, '0') AS ZTAGG",
            "CAST(n_nationkey AS STRING) AS ZTAG1", "'2,000' AS ZPRZ1", "'30' AS ZTAG3"),
            "n").drop("n"),
        "T052U": _numbered(nation.selectExpr(
            "n_nationkey AS n", "concat('ZB0', CAST(n_nationkey % 5 AS STRING)) AS ZTERM",
            "CASE n_nationkey DIV 5 WHEN 0 THEN 'E' WHEN 1 THEN 'D' WHEN 2 THEN 'F' "
            "WHEN 3 THEN 'I' END AS SPRAS",
            "concat('Bedingung ', CAST(n_nationkey AS STRING)) AS TEXT1"), "n").drop("n"),
        "ADR6": _numbered(_read(spark, sf_dir, "orders").selectExpr(
            "o_orderkey", f"{_ten('o_custkey')} AS ADDRNUMBER",
            "concat('prio', left(o_orderpriority, 1), '.', o_custkey, '@example.com') "
            "AS SMTP_ADDR"), "o_orderkey").drop("o_orderkey"),
        "BSID": ar.filter("open").drop("open"),
        "BSAD": ar.filter("NOT open").drop("open"),
        "BSIK": ap.filter("open").drop("open"),
        "BSAK": ap.filter("NOT open").drop("open"),
    }
