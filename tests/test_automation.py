import datetime as dt

from ledgercheck.operators import automation
from ledgercheck.session import work_folder
from ledgercheck.sources.mapping import TELLING, filled_columns, tell_tables


def decided(spark, rows):
    return spark.createDataFrame([(f, r, ok, dt.datetime(2026, 1, d)) for f, r, ok, d in rows],
                                 automation.DECIDED)


def test_versions_keep_the_latest_row_and_skip_unfinished_ones(spark):
    state = automation.Versions(spark, work_folder(spark, "versions"), automation.DECIDED)
    assert state.read().count() == 0 and state.complete() == []
    state.upsert(decided(spark, [("a", "R", True, 1), ("b", "R", True, 5)]), ["finding_id"],
                 "decided_at")
    state.upsert(decided(spark, [("a", "R", False, 2), ("b", "R", False, 4), ("c", "S", True, 1)]),
                 ["finding_id"], "decided_at")
    assert {r["finding_id"]: r["confirmed"] for r in state.read().collect()} == {
        "a": False, "b": True, "c": True}
    assert {r["finding_id"] for r in state.read(1).collect()} == {"a", "b"}
    # a folder without its mark is a run that broke off: it neither counts nor stays
    decided(spark, [("x", "X", True, 1)]).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{state.folder}/v=3")
    assert state.complete() == [1, 2] and state.read().count() == 3
    state.upsert(decided(spark, [("d", "S", True, 1)]), ["finding_id"], "decided_at")
    assert state.complete() == [1, 2, 3] and state.read().count() == 4


def test_a_rule_earns_tier_a_and_loses_it(spark):
    """99 of 100 are enough, 98 are not, and 49 cases never are; the way back is the same rule."""
    rows = [(f"{rule}{i}", rule, i >= wrong, 1) for rule, n, wrong in
            (("good", 100, 1), ("bad", 100, 2), ("few", 49, 0), ("just", 50, 0)) for i in range(n)]
    record = automation.rule_record(decided(spark, rows))
    assert {r["rule_id"]: r["earned"] for r in record.collect()} == {
        "good": True, "bad": False, "few": False, "just": True}
    found = spark.createDataFrame(
        [(1, "good", 2, "B"), (2, "good", 1, "B"), (3, "good", 2, "C"), (4, "bad", 3, "A"),
         (5, "new", 3, "A"), (6, "good", 3, "decision")],
        "n int, rule_id string, damage_class int, tier string")
    tiers = {r["n"]: r["tier"] for r in automation.with_earned_tiers(found, record).collect()}
    assert tiers == {1: "A", 2: "B", 3: "C", 4: "B", 5: "B", 6: "decision"}


def test_delta(spark):
    schema = "finding_id string, rule_id string, tier string, impact string"
    before = spark.createDataFrame([("a", "R", "B", None), ("b", "R", "B", "1"), ("c", "R", "B", "2")],
                                   schema)
    now = spark.createDataFrame([("b", "R", "A", None), ("c", "R", "B", "2"), ("d", "S", "C", None)],
                                schema)
    assert sorted(map(tuple, automation.delta(before, now, ["tier", "impact"]).collect())) == [
        ("a", "R", "gone", None), ("b", "R", "changed", "tier,impact"), ("c", "R", "same", None),
        ("d", "S", "new", None)]


def test_scores_weigh_money(spark):
    found = spark.createDataFrame(
        [(("P",), "x", "R1", "critical"), (("P",), "x", "R1", "critical"), (("P",), "y", "R2", "low"),
         (("Q",), "x", "R3", "high")],
        "entity struct<bp_key:string>, category string, rule_id string, severity string")
    money = spark.createDataFrame([("P", 99, 0), ("Q", -199, 100), ("Z", 599, 0)],
                                  "bp_key string, open_items_local int, volume_12m_local int")
    assert dict(automation.partner_scores(found).collect()) == {"P": 55, "Q": 80}
    scores = {r["category"]: (r["partners"], r["score"])
              for r in automation.category_scores(found, money).collect()}
    assert scores == {"x": (2, 90.0), "y": (1, 99.5), None: (2, 89.5)}


def test_tables_told_by_columns(spark):
    rows = [(t, c) for t, columns in TELLING.items() for c in columns]
    rows += [("none", "KUNNR"), ("extra", "ZZZ"), *[("extra", c) for c in TELLING["T001"]]]
    rows += [("both", c) for c in {*TELLING["BSID"], *TELLING["BSAD"]}]
    got = {r["file"]: (r["table"], r["outcome"]) for r in tell_tables(
        spark.createDataFrame(rows, "file string, column string")).collect()}
    assert got["both"] == (None, "ambiguous") and got["none"] == (None, "unknown")
    assert got["extra"] == ("T001", "told")
    assert {t: got[t] for t in TELLING} == {t: (t, "told") for t in TELLING}


def test_filled_columns(spark):
    df = spark.createDataFrame([("a", "", None, "00000000"), (None, " ", None, "20260101")],
                               "x string, y string, z string, `d.e` string")
    assert sorted(r["column"] for r in filled_columns(df, "f").collect()) == ["d.e", "x"]
