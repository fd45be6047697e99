import pytest

from ledgercheck.operators import staging


def raw(spark, columns, *rows):
    names = ["_row_no", *columns.split()]
    ddl = "_row_no bigint, " + ", ".join(f"{c} string" for c in columns.split())
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], ddl).select(*names)


ITEM = "KUNNR BUKRS BUDAT SHKZG WAERS WRBTR DMBTR XBLNR"


def one(**given):
    row = dict(KUNNR="1", BUKRS="1000", BUDAT="20260101", SHKZG="S", WAERS="EUR", WRBTR="1,00",
               DMBTR="1,00", XBLNR="a-1")
    return tuple({**row, **given}.values())


def test_first_failing_field_is_the_reason(spark, settle):
    df = raw(spark, ITEM, one(), one(BUDAT="x", WRBTR="y"), one(SHKZG="Z"), one(BUDAT="00000000"),
             one(SHKZG=None))
    staged = staging.stage(df, "BSID", settle)
    reasons = {r.row_no: r.reason for r in staged.rejects.collect()}
    assert set(reasons) == {2, 3, 5}
    assert reasons[2].startswith("BUDAT") and reasons[3].startswith("SHKZG")
    excerpt = staged.rejects.filter("row_no = 2").first().raw_excerpt
    assert excerpt == "1\t1000\tx\tS\tEUR\ty\t1,00\ta-1"
    assert tuple(staging.stage_counts(staged).first()) == ("BSID", 5, 2, 3)


def test_sign_is_applied_once(spark, settle):
    df = raw(spark, ITEM, one(), one(SHKZG="H", DMBTR="2.000,50"))
    staged = staging.stage(df, "BSID", settle)
    assert [str(r.amount_signed_local) for r in staged.rows.orderBy("_row_no").collect()] == [
        "1.00", "-2000.50"]
    assert str(staging.control_totals(staged).first().amount) == "-1999.50"


def test_the_file_decides_an_undecided_amount(spark, settle):
    german = raw(spark, ITEM, one(), one(WRBTR="1.234", DMBTR="1.234"))
    staged = staging.stage(german, "BSID", settle, "iso")
    assert tuple(staged.notation.first()) == ("de", "Datei")
    assert str(staged.rows.agg({"WRBTR": "max"}).first()[0]) == "1234.00"
    silent = raw(spark, ITEM, one(WRBTR="1.234", DMBTR="5"))
    assert staging.stage(silent, "BSID", settle).rejects.count() == 1
    given = staging.stage(silent, "BSID", settle, "de")
    assert tuple(given.notation.first()) == ("de", "Parameter") and given.rows.count() == 1


def test_values_of_one_column_that_disagree_prove_nothing(spark, settle):
    df = raw(spark, ITEM, one(WRBTR="1,5", DMBTR="1"), one(WRBTR="1.5", DMBTR="1"))
    assert tuple(staging.file_notation(df, "BSID").first()) == (None, "unbestimmt")


def test_two_columns_that_disagree_fail(spark, settle):
    df = raw(spark, ITEM, one(WRBTR="1,5", DMBTR="1.5"))
    with pytest.raises(Exception, match="two amount columns"):
        staging.stage(df, "BSID", settle).rows.collect()


def test_unknown_columns_fail_and_missing_ones_are_named(spark, settle):
    with pytest.raises(ValueError, match="unknown columns"):
        staging.stage(raw(spark, "KUNNR ODD", ("1", "2")), "KNA1", settle)
    staged = staging.stage(raw(spark, "MANDT KUNNR NAME1", ("100", "1", "x")), "KNA1", settle)
    assert "LAND1" in staged.missing and staged.columns == ["KUNNR", "NAME1"]


def test_totals_need_company_code_and_currency(spark, settle):
    df = raw(spark, "KUNNR SHKZG DMBTR", ("1", "S", "1,00"))
    with pytest.raises(ValueError, match="control total"):
        staging.control_totals(staging.stage(df, "BSID", settle))
