import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgercheck.fixed import VAT_PATTERNS
from ledgercheck.functions import bank, dates, ids, numbers, text
from ledgercheck.operators.staging import parse_values

AMOUNTS = [  # text, with notation de, iso, none
    ("1.234,56", "1234.56", "1234.56", "1234.56"), ("1234.56", "1234.56", "1234.56", "1234.56"),
    ("1.234,56-", "-1234.56", "-1234.56", "-1234.56"), ("-1,5", "-1.50", "-1.50", "-1.50"),
    ("+7", "7.00", "7.00", "7.00"), ("1 234,50", "1234.50", "1234.50", "1234.50"),
    (",56", "0.56", "0.56", "0.56"), ("1.", "1.00", "1.00", "1.00"),
    ("1.234", "1234.00", None, None), ("1,234", None, "1234.00", None),
    ("1.2.3", "123.00", "123.00", "123.00"), ("1.234.567", "1234567.00", "1234567.00", "1234567.00"),
    (".", None, None, None), (",", None, None, None), ("", None, None, None),
    ("abc", None, None, None), ("1,234.567", None, None, None), ("12.345.678.901.234", None, None, None),
    ("1234567890123", "1234567890123.00",) + ("1234567890123.00",) * 2,
    ("12345678901234", None, None, None), ("1E5", None, None, None), ("-5+", None, None, None),
    ("--5", None, None, None), ("5\n", None, None, None), ("1,..", None, None, None),
    ("00012,00", "12.00", "12.00", "12.00"), (None, None, None, None),
]


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("place,notation", [(1, "de"), (2, "iso"), (3, None)])
def test_amounts(spark, place, notation):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(AMOUNTS)], "i int, v string")
    found = parse_values(df, "v", "amount", notation).orderBy("i").collect()
    assert [r.v__typed for r in found] == [r[place] and D(r[place]) for r in AMOUNTS]


def test_percentages(spark):
    texts = ["2,000", "2.5", "1.000,5", "100,000", "99,999", "1.2.3", "3-", "0,0001", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    found = [r.v__typed for r in parse_values(df, "v", "percent").orderBy("i").collect()]
    # 100,000 has three digits before the separator, one more than the type holds
    assert found == [D("2.000"), D("2.500"), None, None, D("99.999"), None, D("-3.000"), None, None]


def test_dates(spark):
    texts = ["20260830", "30.08.2026", "5.3.2026", "2026-08-30", "00000000", "31.02.2026", "x", "",
             "2026-8-30", "20260-8-30", "2026083T", "1.1.20261", "30.08.26", "29022024", "20240229",
             " 20260830 ", "1.2.3.2026", "2026-08-30T10", None]
    day = dt.date(2026, 8, 30)
    none = [None] * 20
    assert values(spark, texts, dates.parse_date(F.col("v"))) == [
        day, day, dt.date(2026, 3, 5), day, None, None, None, None, None, None, None, None, None,
        None, dt.date(2024, 2, 29), day, *none[:3]]


def test_integers_and_flags(spark):
    texts = ["007", "2147483647", "2147483648", "1,0", "-5", "5-", "", "x", " 3 ", None]
    assert values(spark, texts, numbers.parse_integer(F.col("v"))) == [
        7, 2147483647, None, None, -5, -5, None, None, 3, None]
    assert values(spark, ["X", "x", " X ", "", "Y", None], text.parse_flag(F.col("v"))) == [
        True, True, True, None, None, None]


def test_notation_of_a_value(spark):
    texts = ["1.234,56", "1,234.56", "12,5", "12.5", "1.234", "0", "", "1.2.3", "1,2,3", "a,5", None]
    assert values(spark, texts, numbers.value_notation(F.col("v"))) == [
        "de", "iso", "de", "iso", None, None, None, "de", "iso", None, None]


def test_iban(spark):
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606",
             "DE88370400440532013000", "DE8937040044053201300", "XX89370400440532013000",
             "GB82WES112345698765432", "NL91ABNA0417164300", "CH9300762011623852957", "", None]
    assert values(spark, ibans, bank.iban_valid(F.col("v"))) == [
        True, True, True, False, False, False, False, True, True, None, None]
    assert values(spark, ibans[:1], bank.iban_mask(F.col("v"))) == ["DE89 … 3000"]


def test_iban_check_digits_are_unique(spark):
    # 97 and 00 leave the same remainder; only the digits the formula gives are valid
    account = "370400440532013000"
    found = values(spark, [f"DE{i:02d}{account}" for i in range(100)], bank.iban_valid(F.col("v")))
    assert found.count(True) == 1 and found[89]


def test_money(spark):
    amounts = ["42100.00", "-1234567.50", "0.00", "999.99", None]
    column = numbers.money(F.col("v").cast("decimal(15,2)"), F.lit("EUR"))
    assert values(spark, amounts, column) == [
        "42.100,00 EUR", "-1.234.567,50 EUR", "0,00 EUR", "999,99 EUR", None]
    plain = numbers.money(F.col("v").cast("decimal(15,2)"), F.lit(None).cast("string"))
    assert values(spark, ["1.00"], plain) == ["1,00"]
    with pytest.raises(Exception, match="two decimals"):
        values(spark, ["1.234"], numbers.money(F.col("v").cast("decimal(15,3)"), F.lit("EUR")))


def test_placeholders(spark):
    names = ["Test GmbH", "Testo SE", "XXX", "Kein Name", "n.a.", "Testkunde 2", "???", "Ümuster",
             "Muster-Probe", "Contest", None]
    assert values(spark, names, text.has_placeholder(F.col("v"))) == [
        True, False, True, True, True, True, True, False, True, False, False]
    assert values(spark, ["Die TEST-Firma"], text.placeholder_word(F.col("v"))) == ["test"]


def test_texts(spark):
    assert values(spark, ["RE-47/11 ä", "--", None], text.reference_norm(F.col("v"))) == [
        "RE4711", "", None]
    assert values(spark, ["Müller & Söhne", "Café Ñandú"], text.name_core(F.col("v"))) == [
        "muellersoehne", "cafenandu"]
    assert values(spark, ["C:000123", " V:0 ", "0042"], text.plain_account(F.col("v"))) == [
        "123", "0", "42"]
    assert values(spark, ["0001", " ", None], text.partner_key(F.col("v"), "C:")) == [
        "C:0001", None, None]
    params = F.create_map(F.lit("a"), F.col("v"))
    assert values(spark, ["1"], text.fill("x {a} y", params)) == ["x 1 y"]
    assert values(spark, ["1"], text.fill("x {b} y", params)) == [None]


def test_times(spark):
    stamps = ["2026-08-30T09:15:00Z", "2026-08-30T09:15:00+00:00", "2026-08-30T09:15:00+02:00",
              "2026-08-30T09:15:00", "soon"]
    assert values(spark, stamps, dates.utc_stamp_text(F.col("v"))) == [
        "2026-08-30T09:15:00Z", "2026-08-30T09:15:00Z", None, None, None]
    assert values(spark, stamps[:2], dates.utc_minute_text(F.col("v"))) == [
        "30.08.2026 09:15 UTC", None]


def test_finding_id_is_a_hash_of_all_its_columns(spark):
    import hashlib

    row = dict(bp_key="C:1", company_code=None, source_table="KNA1", source_field="STCEG",
               current_value="x", finding_key="")

    def made(values_):
        df = spark.createDataFrame([tuple(values_[c] for c in ids.ID_COLUMNS)],
                                   ", ".join(f"{c} string" for c in ids.ID_COLUMNS))
        return df.select(ids.finding_id(F.lit("AR-VAL-001"))).first()[0]

    expected = hashlib.sha1(b"AR-VAL-001|C:1||KNA1|STCEG|x|").hexdigest()[:12]
    assert made(row) == f"F-{expected}"
    assert made({**row, "company_code": "", "finding_key": None}) == f"F-{expected}"
    assert len({made({**row, c: "other"}) for c in ids.ID_COLUMNS}) == len(ids.ID_COLUMNS)


def test_every_vat_pattern_starts_with_its_prefix():
    # the prefix join of the pattern table relies on it
    assert all(p.startswith(f"^{prefix}") for prefix, p in VAT_PATTERNS.items())


def test_plain_texts_are_read_as_by_the_steps(spark):
    """A text written plainly is read without the steps, and with the same result and proof."""
    shapes = ["7", "12,3", "12.30", "1.234", "1,234", "1.234,50", "1,234.50", "1.234.567,8",
              "12.34,56", "9999999999999.99", "99999999999999", "0000000000000.10", "123.456.7",
              ",5", ".5", "5.", "1,234,567", "1.2345", "1 234,50", "", "12a", "99,125", "100,5"]
    texts = [f"{before}{t}{after}" for t in shapes for before in ("", "-", "+", " ")
             for after in ("", "-", "+", "\n")] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    given = {}
    for kind, notation in (("amount", "de"), ("amount", "iso"), ("amount", None),
                           ("percent", None)):
        steps = numbers.by_steps(F.col("t"), kind, F.lit(notation).cast("string"))
        quick = numbers.plain(F.col("t"), kind)
        given[f"{kind}_{notation}"] = F.struct(
            quick.alias("quick"), steps.alias("steps"))
    bare = numbers.body(F.col("t"))
    proof = numbers._proof(bare, numbers.shape(bare))
    rows = df.select("t", numbers.value_notation(F.col("t")).alias("proof"),
                     proof.alias("by_shape"),
                     *[c.alias(n) for n, c in given.items()]).collect()
    read = 0
    for row in rows:
        assert row["proof"] == row["by_shape"], row["t"]
        for name in given:
            if row[name]["quick"] is not None:
                read += 1
                assert row[name]["quick"] == row[name]["steps"], (name, row["t"])
    assert read > 50


def test_amounts_of_a_table_are_typed_in_one_projection(spark):
    """No row is copied from step to step: the typing of all amount columns is one projection."""
    df = spark.range(3).selectExpr("CAST(id AS STRING) AS a", "CAST(id * 2 AS STRING) AS b")
    made = numbers.parse_columns(df, {"a": "amount", "b": "percent"}, F.lit("de"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 2  # the texts, and their typing
