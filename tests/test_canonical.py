import pytest

from ledgercheck.operators.canonical import (
    Scope,
    build_canonical,
    conservation,
    ibans,
    key_places,
    repeated_places,
    with_place,
)
from ledgercheck.operators.staging import stage
from ledgercheck.plans.run import Settler
from ledgercheck.session import work_folder
from ledgercheck.sources.mapping import EXPORT_TABLES

ITEM = dict(BUKRS="1000", GJAHR="2026", BELNR="1", BUZEI="001", BUDAT="20260101", BLART="DR",
            SHKZG="S", WAERS="EUR", WRBTR="1,00", DMBTR="1,00")


def staged(spark, **tables):
    settle = Settler(spark, work_folder(spark, "staged"))
    result = {}
    for name, rows in tables.items():
        columns = list(dict.fromkeys(c for r in rows for c in r))
        ddl = "_row_no bigint, " + ", ".join(f"{c} string" for c in columns)
        raw = spark.createDataFrame(
            [(i, *[r.get(c) for c in columns]) for i, r in enumerate(rows, 1)], ddl)
        result[name] = stage(raw, name, settle).rows
    return result


def customers(*keys):
    return [dict(KUNNR=k, NAME1=f"N{k}", ADRNR=k) for k in keys]


def reasons(model):
    return sorted((r.source_table, r.row_no, r.reason) for r in model.rejects().collect())


def test_duplicates_orphans_and_empty_fields(spark, settle):
    model = build_canonical(staged(
        spark, KNA1=customers("1", "2"),
        BSID=[dict(ITEM, KUNNR="1"), dict(ITEM, KUNNR="1"), dict(ITEM, KUNNR="9", BELNR="2"),
              dict(ITEM, KUNNR="1", BELNR="3", WAERS=None), dict(ITEM, KUNNR="1", BELNR="4"),
              dict(ITEM, KUNNR="", BELNR="6")],
        BSAD=[dict(ITEM, KUNNR="1", BELNR="4", AUGDT="20260202"), dict(ITEM, KUNNR="1", BELNR="5")],
    ), settle=settle)
    assert [r.item_key for r in model["fi_item"].orderBy("item_key").collect()] == [
        "1000|2026|4|001", "1000|2026|5|001"]
    found = reasons(model)
    assert [(t, n) for t, n, _ in found] == [("BSID", n) for n in (1, 2, 3, 4, 5, 6)]
    texts = [r for _, _, r in found]
    assert "mehrfach" in texts[0] and texts[0] == texts[1]
    assert texts[2] == "Stammsatz fehlt: C:9 steht nicht in business_partner"
    assert texts[3] == "fi_item.currency ist leer (WAERS)"
    # BSAD comes first by name, so the cleared item holds the key
    assert "bereits aus einer anderen Quelltabelle" in texts[4]
    assert texts[5] == "fi_item.bp_key ist leer (KUNNR)"
    counts = {r.table: tuple(r)[1:] for r in conservation(model).collect()}
    assert counts["fi_item"] == (2, 6, 0) and counts["business_partner"] == (2, 0, 0)


def test_a_rejected_row_holds_no_key(spark, settle):
    model = build_canonical(staged(
        spark, KNA1=customers("1"), BSAD=[dict(ITEM, KUNNR="9")], BSID=[dict(ITEM, KUNNR="1")],
    ), settle=settle)
    assert model["fi_item"].first().is_open
    assert [(t, n) for t, n, _ in reasons(model)] == [("BSAD", 1)]


def test_lazy_and_settled_models_agree(spark, settle):
    tables = staged(spark, KNA1=customers("1", "1", "2"), BSID=[dict(ITEM, KUNNR="2")] * 2)
    assert reasons(build_canonical(tables)) == reasons(build_canonical(tables, settle=settle))


def test_scope(spark, settle):
    tables = staged(
        spark, KNA1=customers("1", "2"), LFA1=[dict(LIFNR="1", NAME1="v")],
        KNB1=[dict(KUNNR="1", BUKRS="1000"), dict(KUNNR="2", BUKRS="2000")],
        BSID=[dict(ITEM, KUNNR="1"), dict(ITEM, KUNNR="2", BUKRS="2000"),
              dict(ITEM, KUNNR="1", BELNR="2", BUDAT="20250101")],
        T001=[dict(BUKRS="1000", WAERS="EUR"), dict(BUKRS="2000", WAERS="CHF")])
    code = build_canonical(tables, Scope(company_codes=("1000",)), settle)
    assert [r.bp_key for r in code["business_partner"].collect()] == ["C:1"]
    assert code["fi_item"].count() == 2 and code["company_code"].count() == 1
    assert reasons(code) == []
    counts = {r.table: r.out_of_scope for r in conservation(code).collect()}
    assert counts["business_partner"] == 2 and counts["fi_item"] == 1
    side = build_canonical(tables, Scope(side="ap"), settle)
    assert [r.bp_key for r in side["business_partner"].collect()] == ["V:1"]
    import datetime as dt

    day = dt.date(2026, 1, 1)
    window = build_canonical(tables, Scope(item_window_from=day, item_window_to=day), settle)
    assert window["fi_item"].count() == 2


def test_iban_choice(spark):
    key = dict(BANKS="DE", BANKL="1", BKONT=None)
    rows = [dict(key, BANKN="1", IBAN="DE1", VALID_FROM="20200101"),
            dict(key, BANKN="1", IBAN="DE2", VALID_FROM="20210101"),
            dict(key, BANKN="2", IBAN="DE3", VALID_FROM="20210101"),
            dict(key, BANKN="2", IBAN="DE4", VALID_FROM="20210101"),
            dict(key, BANKN="3", IBAN="DE5", VALID_FROM=None),
            dict(key, BANKN="4", IBAN="DE 6", VALID_FROM="20200101"),
            dict(key, BANKN="4", IBAN="DE6", VALID_FROM="20200101")]
    found = {r.account_number: r for r in ibans(staged(spark, TIBAN=rows)["TIBAN"]).collect()}
    assert found["1"].iban == "DE2" and not found["1"].ambiguous
    assert found["2"].ambiguous and not found["4"].ambiguous
    assert found["3"].valid_from is None and found["3"].iban == "DE5"


def test_bank_account_with_ambiguous_iban_is_rejected(spark, settle):
    key = dict(BANKS="DE", BANKL="1", BANKN="2", BKONT=None)
    model = build_canonical(staged(
        spark, KNA1=customers("1"), KNBK=[dict(key, KUNNR="1")],
        TIBAN=[dict(key, IBAN="DE1", VALID_FROM="20200101"),
               dict(key, IBAN="DE2", VALID_FROM="20200101")]), settle=settle)
    assert model["bp_bank_account"].count() == 0
    assert reasons(model)[0][2].startswith("TIBAN: mehrere IBAN")


def test_text_and_mail_choice(spark, settle):
    model = build_canonical(staged(
        spark, KNA1=customers("1"), T052=[dict(ZTERM="Z1"), dict(ZTERM="Z2")],
        T052U=[dict(ZTERM="Z1", SPRAS="E", TEXT1="e"), dict(ZTERM="Z1", SPRAS="D", TEXT1="d"),
               dict(ZTERM="Z2", SPRAS="I", TEXT1="i"), dict(ZTERM="Z2", SPRAS="F", TEXT1="f")],
        ADR6=[dict(ADDRNUMBER="1", SMTP_ADDR="b@x"), dict(ADDRNUMBER="1", SMTP_ADDR="a@x")],
    ), settle=settle)
    assert {r.terms_key: r.description for r in model["payment_terms"].collect()} == {
        "Z1": "d", "Z2": "f"}
    assert model["business_partner"].first().email == "a@x"


def test_tax_ids_become_rows(spark, settle):
    rows = [dict(KUNNR="1", NAME1="x", STCD1="1/2", STCEG="de 1.2")]
    model = build_canonical(staged(spark, KNA1=rows), settle=settle)
    assert {(r.tax_id_type, r.value_norm) for r in model["bp_tax_id"].collect()} == {
        ("TAX1", "1/2"), ("VAT", "DE12")}


def test_a_missing_required_field_stops_the_build(spark):
    row = {k: v for k, v in dict(ITEM, KUNNR="1").items() if k != "BUDAT"}
    with pytest.raises(ValueError, match="BUDAT is missing"):
        build_canonical(staged(spark, KNA1=customers("1"), BSID=[row]))


def test_every_mapped_field_names_a_canonical_column():
    from ledgercheck.schema import CANONICAL

    for spec in EXPORT_TABLES.values():
        if spec.main_target:
            names = {c.name for c in CANONICAL[spec.main_target]}
            targets = {t for t in spec.fields.values() if "." not in t}
            assert targets <= names, (spec.name, targets - names)


def test_tables_are_made_when_asked_for_and_once():
    from ledgercheck.checks.contract import LazyModel
    from ledgercheck.session import Stages

    made = []
    tables = Stages("abc", lambda name: made.append(name) or name.upper())
    model = LazyModel(tables, lambda: made.append("dates") or (1, 2), {}).having({"b": "own"})
    assert model["b"] == "own" and model.missing(("a", "x")) == ["x"] and made == []
    assert model["a"] == model["a"] == "A" and made == ["a"]
    assert model.as_of == 1 and made == ["a", "dates"]
    assert sorted(tables.all().values()) == ["A", "B", "C"] and sorted(made) == ["a", "b", "c", "dates"]


def test_only_keys_in_question_are_asked(spark, settle):
    """Rows are shuffled for their key only where a bit of the keys used twice is set; null keys and
    tables without such keys included."""
    rows = spark.sql("SELECT CASE WHEN id <> 7 THEN CAST(id AS STRING) END AS k FROM range(5000)")
    twice = rows.filter("CAST(k AS INT) % 100 = 3")
    asked = with_place(rows, ["k"], settle(key_places(twice, ["k"]), "places")).filter("_asked")
    found = {r["k"] for r in asked.collect()}
    assert {str(i) for i in range(3, 5000, 100)} <= found and len(found) < 60
    none = with_place(rows, ["k"], settle(key_places(twice.limit(0), ["k"]), "none"))
    assert none.count() == 5000 and none.filter("_asked").isEmpty()


def test_rows_are_read_once_for_the_places_of_repeated_keys(spark, settle):
    """All keys used twice have their bit, null keys none; the keys are not joined for that."""
    rows = spark.sql("SELECT CASE WHEN id % 50 <> 7 THEN CAST(id % 4900 AS STRING) END AS k "
                     "FROM range(5000)")
    places = repeated_places(rows, ["k"])
    assert "join" not in places._jdf.queryExecution().optimizedPlan().toString().lower()
    asked = {r["k"] for r in with_place(rows, ["k"], settle(places, "places")).filter(
        "_asked").collect()}
    assert {str(i) for i in range(100) if i % 50 != 7} <= asked and len(asked) < 110


def test_only_rows_of_repeated_keys_are_kept_aside(spark, settle):
    """What is kept aside for a verdict are rows of keys used twice; keys are in no table."""
    made = {}

    def noted(df, name):
        made[name] = settle(df, name)
        return made[name]

    rows = [dict(ITEM, KUNNR="1", BELNR=f"{i}") for i in range(40)] + [
        dict(ITEM, KUNNR="1", BELNR="7")]
    model = build_canonical(staged(spark, KNA1=customers("1"), BSID=rows), settle=noted)
    assert made["fi_item-asked"].count() == 2 and "fi_item-twice" not in made
    assert model["fi_item"].count() == 39 and len(reasons(model)) == 2


def test_a_place_is_a_bit_of_a_number(spark, settle):
    """No text is made of a byte to look at its bit, and the last bit of a word counts as well."""
    rows = spark.sql("SELECT CAST(id AS STRING) AS k FROM range(3000)")
    places = settle(key_places(rows.filter("CAST(k AS INT) % 2 = 0"), ["k"]), "bits")
    marked = with_place(rows, ["k"], places)
    plan = marked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "conv(" not in plan and "hex(" not in plan
    assert marked.filter("CAST(k AS INT) % 2 = 0 AND NOT _asked").isEmpty()
    assert marked.filter("CAST(k AS INT) % 2 = 1 AND _asked").count() < 10


def test_rows_are_written_once_with_their_place(spark, settle):
    """The rows in question are a part of the one written table; no second pass looks for them."""
    made = {}

    def noted(df, name):
        made[name] = settle(df, name)
        return made[name]

    rows = [dict(ITEM, KUNNR="1", BELNR=f"{i}") for i in range(40)] + [
        dict(ITEM, KUNNR="1", BELNR="7")]
    model = build_canonical(staged(spark, KNA1=customers("1"), BSID=rows), settle=noted)
    assert made["fi_item-marked"].count() == 41 and "fi_item" not in made
    assert sorted(r.item_key for r in model["fi_item"].select("item_key").collect()) == sorted(
        r.item_key for r in made["fi_item-marked"].filter("NOT _asked").select("item_key").collect())
    assert made["fi_item-marked"].filter("_asked").count() == 2


def test_few_other_rows_are_asked_beside_many_repeated_keys(spark, settle):
    rows = spark.sql("SELECT CAST(id AS STRING) AS k FROM range(1200000)")
    places = settle(key_places(rows.filter("CAST(k AS INT) < 1000000"), ["k"]), "bits")
    marked = with_place(rows, ["k"], places)
    assert marked.filter("CAST(k AS INT) < 1000000 AND NOT _asked").isEmpty()
    assert marked.filter("CAST(k AS INT) >= 1000000 AND _asked").count() < 3000   # of 200000
