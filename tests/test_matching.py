import itertools
import random

import duckdb
import pytest
from conftest import item, make_model, partner
from pyspark.sql import functions as F

from ledgercheck.checks import duplicates
from ledgercheck.functions import names
from ledgercheck.functions.similarity import jaro_winkler
from ledgercheck.operators import matching
from ledgercheck.operators.components import clusters, summary


def normal(spark, function, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(function(F.col("t")).alias("n")).collect()]


NAMES = {
    "Müller Maschinenbau GmbH": ("MUELLER MASCHINENBAU", "gmbh"),
    "Firma Mueller-Maschinenbau G.m.b.H.": ("MUELLER MASCHINENBAU", "gmbh"),
    "MÜLLER & Söhne Ges.m.b.H.": ("MUELLER SOEHNE", "gmbh"),
    "Müller und Söhne Gesellschaft mit beschränkter Haftung": ("MUELLER SOEHNE", "gmbh"),
    "Bau AG & Co. KG": ("BAU", "ag_co_kg"),
    "Bau GmbH und Co. KG": ("BAU", "gmbh_co_kg"),
    "Bau GMBH+CO.KG": ("BAU", "gmbh_co_kg"),
    "AG": ("AG", None), "und": ("UND", None), "Stiftung Warentest": ("STIFTUNG WARENTEST", None),
    "Warentest Stiftung": ("WARENTEST", "stiftung"),
    "Meier e. K.": ("MEIER", "ek"), "Meier eingetragener Kaufmann": ("MEIER", "ek"),
    "Société Générale S.A.": ("SOCIETE GENERALE", "sa"),
    "Dupont S.à r.l.": ("DUPONT", "sarl"), "The Kowalski sp. z o.o.": ("KOWALSKI", "sp_z_oo"),
    "Smith Co., Ltd.": ("SMITH", "ltd"), "Zentrale Einkauf KGaA": ("EINKAUF", "kgaa"),
    "Kunst AG Bau GmbH": ("KUNST BAU", "gmbh"), "Oyj Nokia Oyj": ("OYJ NOKIA", "oy"),
    " ": (None, None), "!?": (None, None), "Łódź a.s.": ("ODZ", "as"),
    "Agentur Segmüller": ("AGENTUR SEGMUELLER", None),
}


def test_names(spark):
    assert normal(spark, names.name_norm, [*NAMES, None]) == [n for n, _ in NAMES.values()] + [None]
    assert normal(spark, names.legal_form_norm, [*NAMES, None]) == [
        f for _, f in NAMES.values()] + [None]


def test_streets_and_cities(spark):
    streets = {"Robert-Bosch-Str. 12": "ROBERT BOSCH STRASSE 12",
               "Robert Bosch Straße 12": "ROBERT BOSCH STRASSE 12",
               "Hauptstr.5a": "HAUPT STRASSE 5A", "Haupt Str. 5 - 7": "HAUPT STRASSE 5-7",
               "Straße des 17. Juni 135": "STRASSE DES 17 JUNI 135", "P.O. Box 9": "POSTFACH 9",
               "Postfach": "POSTFACH", "7": "7", "": None, "Str.": "STRASSE"}
    assert normal(spark, names.street_norm, [*streets, None]) == [*streets.values(), None]
    cities = {"86159 Augsburg": "AUGSBURG", "Augsburg OT Lechhausen": "AUGSBURG",
              "Munich": "MUENCHEN", "MÜNCHEN": "MUENCHEN", "Frankfurt/Main": "FRANKFURT",
              "Frankfurt am Main": "FRANKFURT", "Münster (Westf.)": "MUENSTER",
              "Berlin - Mitte": "BERLIN", "Halle an der Saale": "HALLE", "-": None}
    assert normal(spark, names.city_norm, [*cities, None]) == [*cities.values(), None]


def test_jaro_winkler_equals_another_engine(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("ABCD") for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    rows = list(zip(words, words[1:] + words[:1])) + [("MARTHA", "MARHTA"), ("A", "A"), ("", "")]
    rows += [(w, "".join(rng.sample(w, len(w)))) for w in words]
    got = spark.createDataFrame(rows, "a string, b string").select(
        jaro_winkler(F.col("a"), F.col("b"))).collect()
    con = duckdb.connect()
    for (a, b), row in zip(rows, got):
        want = con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert row[0] == pytest.approx(want, abs=1e-12)


def parts(keys, pairs):
    """Least key of the connected part of every key that has a pair."""
    at = {k: k for k in keys}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    linked = {k for pair in pairs for k in pair}
    return {k: root(k) for k in linked}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_union_find(spark, settle, seed):
    rng = random.Random(seed)
    pairs = [(f"k{a:04d}", f"k{b:04d}") for a, b in
             ((rng.randrange(400), rng.randrange(400)) for _ in range(260)) if a != b]
    pairs += [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(150)]   # a long path
    pairs += [("hub", f"s{i:03d}") for i in range(200)]             # a hot key
    links = spark.createDataFrame(pairs, "u string, v string")
    got = {r["key"]: r["cluster"] for r in clusters(links, settle, f"c{seed}").collect()}
    assert got == parts({k for p in pairs for k in p}, pairs)
    assert clusters(links.limit(0), settle, f"e{seed}").count() == 0


def test_summary_of_labels(spark):
    links = spark.createDataFrame([("b", "a", "B"), ("c", "b", "C"), ("y", "x", "C")],
                                  "u string, v string, tier string")
    found = spark.createDataFrame([(k, k2) for k, k2 in zip("abcxy", "aaaxx")],
                                  "key string, cluster string")
    assert sorted(map(tuple, summary(links, found, "tier").collect())) == [
        ("a", 3, 2, "B", "C"), ("x", 2, 1, "C", "C")]


@pytest.mark.parametrize("seed", range(6))
def test_block_links_connect_what_all_pairs_connect(spark, settle, seed):
    """Blocks in which many, most or all members have payer links."""
    rng = random.Random(seed)
    members, excluded = [], set()
    for block in range(25):
        keys = [f"{block:02d}-{i:02d}" for i in range(rng.randrange(1, 9))]
        members += [(block, k) for k in keys]
        dense = rng.choice((0.05, 0.5, 0.85, 1.0))
        excluded |= {p for p in itertools.combinations(keys, 2) if rng.random() < dense}
    hub = [f"h{i:03d}" for i in range(150)]        # one pays for all others of a hot block
    members += [(99, k) for k in hub]
    excluded |= {(hub[0], k) for k in hub[1:]} | {(hub[3], k) for k in hub[60:90]}
    pairs = [p for _, own in itertools.groupby(sorted(members), key=lambda m: m[0])
             for p in itertools.combinations([k for _, k in own], 2) if p not in excluded]
    payers = spark.createDataFrame(
        [*excluded, *[(b, a) for a, b in excluded]], "bp_key string, other string")
    links = [tuple(r) for r in matching.block_links(
        spark.createDataFrame(members, "block int, bp_key string"), payers, settle,
        f"b{seed}").collect()]
    assert {tuple(sorted(x)) for x in links} <= set(pairs)
    keys = {k for _, k in members}
    assert parts(keys, links) == parts(keys, pairs)
    assert len(links) < 1000    # not the 11 000 pairs of the hot block


def vat(key, value):
    return dict(bp_key=key, tax_id_type="VAT", value=value, value_norm=value)


def bank(key, value):
    return dict(bp_key=key, iban=value, iban_norm=value)


def at(key, name, street, **more):
    return partner(key, **{**dict(name1=name, street=street, postal_code="86159", city="Augsburg"),
                           **more})


def shaped(match):
    return {(r["cluster_id"], r["bp_key"]): (r["tier"], r["pattern"]) for r in
            match.members.filter("bp_key <> cluster_id").collect()}


def test_tiers_exclusions_and_chain(spark, settle):
    model = make_model(
        spark,
        business_partner=[
            at("C:01", "Müller Maschinenbau GmbH", "Robert-Bosch-Str. 12"),
            at("C:02", "Mueller Maschinenbau GmbH", "Robert Bosch Straße 12"),
            at("C:03", "Mueller Maschinenbau AG", "Robert Bosch Straße 12"),    # other legal form
            at("C:04", "Ganz Anders", "Am Ring 1"), at("C:05", "Noch Anders", "Am Ring 2"),
            at("C:06", "Dritte", "Am Ring 3"),
            at("C:07", "Zahler", "Weg 1"), at("C:08", "Bezahlt", "Weg 2", alt_payer_key="C:07"),
            at("C:09", "Einmal", "Weg 3", is_one_time=True), at("C:10", "Einmal", "Weg 3"),
            at("V:01", "Müller Maschinenbau GmbH", "Robert-Bosch-Str. 12"),    # the other side
            at("C:11", "Xylophon Handel", "Weg 9"), at("C:12", "Xylopron Handel", "Weg 9"),
            at("C:13", "Huber", None), at("C:14", "Huber", None)],
        bp_tax_id=[vat("C:04", "DE1"), vat("C:05", "DE1"), vat("C:07", "DE2"), vat("C:08", "DE2")],
        bp_bank_account=[bank("C:05", "X1"), bank("C:06", "X1"), bank("V:01", "X1")])
    match = matching.match(model, settle)
    assert shaped(match) == {
        ("C:01", "C:02"): ("C", "Name nach Normalisierung exakt, Straße gleich, PLZ gleich, "
                                "Ort gleich"),
        ("C:04", "C:05"): ("B", "USt-ID gleich, Straße ähnlich, PLZ gleich, Ort gleich"),
        ("C:04", "C:06"): ("C", "Straße ähnlich, PLZ gleich, Ort gleich"),
        ("C:11", "C:12"): ("C", "Name ähnlich, Straße gleich, PLZ gleich, Ort gleich")}
    tiers = {r["cluster_id"]: r["tier"] for r in match.clusters.collect()}
    assert tiers == {"C:01": "C", "C:04": "C", "C:11": "C"}
    found = duplicates.duplicates(model, match, "CUSTOMER").collect()
    assert {r["bp_key"] for r in found} == set(tiers)
    assert all("%" not in str(r.asDict(True)) for r in found)   # no score in a finding


def test_golden_record_takes_the_valid_vat_id(spark, settle):
    """Two accounts of one partner: only the VAT id has a clear winner, and no bank field."""
    model = make_model(
        spark,
        business_partner=[at("C:0000100234", "Müller Maschinenbau GmbH", "Robert-Bosch-Str. 12"),
                          at("C:0000100987", "Mueller Maschinenbau GmbH",
                             "Robert Bosch Straße 12")],
        bp_tax_id=[vat("C:0000100234", "AT U12345678"), vat("C:0000100987", "DE123456780")],
        bp_bank_account=[bank("C:0000100234", "DE1"), bank("C:0000100987", "DE2")])
    rows = duplicates.records(model, matching.match(model, settle))
    assert [tuple(r) for r in duplicates.golden_records(rows).collect()] == [
        ("C:0000100234", "vat_id", "DE123456780", "C:0000100987", "duplicate_record")]


def test_rare_words_weigh_more(spark):
    rows = [(f"C:{i}", "CUSTOMER", "MUELLER " + w) for i, w in enumerate(["BAU"] * 50 + ["RAR"])]
    weights = {r["word"]: r["weight"] for r in matching.word_weights(
        spark.createDataFrame(rows, "bp_key string, role string, name_norm string")).collect()}
    assert weights["RAR"] == 1.0 > weights["BAU"] > weights["MUELLER"]


def test_hot_values_make_no_pairs(spark, settle):
    """A third of all accounts with one VAT id, a third in one form: links grow with accounts."""
    n = 900
    same = [at(f"C:{i:04d}", "Copy GmbH", "Weg 1") for i in range(n // 3)]
    shared = [at(f"C:{i:04d}", f"Firma {i}", f"Weg {i}") for i in range(n // 3, 2 * n // 3)]
    model = make_model(spark, business_partner=same + shared,
                       bp_tax_id=[vat(p["bp_key"], "DE9") for p in shared])
    match = matching.match(model, settle)
    assert sorted((r["members"], r["tier"]) for r in match.clusters.collect()) == [
        (n // 3, "B"), (n // 3, "C")]
    assert match.links.count() < 3 * n
    assert match.candidates.count() < n


def test_empty_tables(spark, settle):
    match = matching.match(make_model(spark), settle)
    assert match.members.count() == match.clusters.count() == 0
    assert matching.profile(match.vectors, match.keys).count() == 0



def test_paid_on_two_accounts_of_one_vendor(spark):
    import datetime as dt

    def paid(key, number, day, reference="RE-77"):
        return item(key, doc_type="KR", document_no=number, reference=reference,
                    reference_norm=reference.replace("-", ""), is_open=False,
                    document_date=dt.date(2026, 1, day), amount_doc="500.00")

    model = make_model(spark, business_partner=[partner(f"V:{i}") for i in range(1, 5)], fi_item=[
        paid("V:2", "20", 9), paid("V:1", "30", 20), paid("V:3", "40", 20),   # 3 is no duplicate
        paid("V:1", "50", 25), paid("V:4", "60", 28, "XX-99")])
    members = spark.createDataFrame([("V:1", "V:1"), ("V:1", "V:2"), ("V:1", "V:4")],
                                    "cluster_id string, bp_key string")
    found = duplicates.paid_on_two_accounts(model, members).collect()
    assert [(r["bp_key"], r["related_bp_keys"], r["finding_key"]) for r in found] == [
        ("V:2", ["V:1"], "20|30")]
    assert [d["document_no"] for d in found[0]["documents"]] == ["20", "30"]


def test_similar_blocks_of_one_name_connect_as_all_pairs(spark, settle):
    """Copies of a few names on streets that differ by a number, some of which pay for each other:
    the links connect what all pairs of accounts do, and grow with accounts and not with pairs."""
    rng = random.Random(5)
    accounts = [at(f"C:{i:04d}", f"{rng.choice(('Copy', 'Copi'))} Handel" + rng.choice(
                    ("", "", " GmbH", " AG")), f"Platz {rng.randrange(9)}",
                   postal_code=rng.choice((None, f"{i:05d}", "86159")),
                   city=rng.choice((None, "Augsburg", "Bonn"))) for i in range(300)]
    for row in accounts:
        if rng.random() < 0.3:
            row["alt_payer_key"] = rng.choice(accounts)["bp_key"]
    model = make_model(spark, business_partner=accounts)
    match = matching.match(model, settle)
    rows = [r.asDict() for r in match.vectors.collect()]
    pays = {tuple(r) for r in match.excluded.collect()}
    words = sorted({(r["name_norm"], r["street_norm"]) for r in rows})
    weight = {r["word"]: r["weight"] for r in match.weights.collect()}
    con = duckdb.connect()

    def jw(a, b):
        return con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]

    streets = {(a, b): jw(a, b) for a in {s for _, s in words} for b in {s for _, s in words}}
    names_ = {n for n, _ in words}

    def name_sim(a, b):
        x, y = a.split(), b.split()
        best = [weight[v] * max(jw(v, w) for w in o) for s, o in ((x, y), (y, x)) for v in s]
        return sum(best) / sum(weight[v] for v in x + y)

    sims = {(a, b): name_sim(a, b) for a in names_ for b in names_}
    form = ("role", *matching.CLASS[1:])

    def similar(a, b):
        if all(a[c] == b[c] for c in form):
            return True
        place = a["postal_code"] is not None and a["postal_code"] == b["postal_code"]
        if not place and a["name_norm"] != b["name_norm"]:
            return False
        town = a["city_norm"] == b["city_norm"]
        forms = (a["legal_form_norm"], b["legal_form_norm"])
        return ((place or town and a["city_norm"] is not None)
                and sims[a["name_norm"], b["name_norm"]] >= matching.JW_NAME
                and streets[a["street_norm"], b["street_norm"]] >= matching.JW_STREET
                and (None in forms or forms[0] == forms[1]))

    pairs = [(a["bp_key"], b["bp_key"]) for a, b in itertools.combinations(
        sorted(rows, key=lambda r: r["bp_key"]), 2)
        if similar(a, b) and (a["bp_key"], b["bp_key"]) not in pays]
    links = [(r["u"], r["v"]) for r in match.links.collect()]
    assert {tuple(sorted(x)) for x in links} <= set(pairs)
    keys = {r["bp_key"] for r in rows}
    assert parts(keys, links) == parts(keys, pairs)


def test_candidates_in_chunks_are_all_pairs(spark, settle, monkeypatch):
    """Classes of one name meet once each, however many travel in a row; no link lists them."""
    monkeypatch.setattr(matching, "CHUNK", 7)
    n = 400
    accounts = [at(f"C:{i:04d}", "Copy", f"Platz {i % 3}", postal_code=f"{i:05d}")
                for i in range(n)]
    match = matching.match(make_model(spark, business_partner=accounts), settle)
    pairs = [(r["u"], r["v"]) for r in match.candidates.collect()]
    assert sorted(pairs) == list(itertools.combinations([a["bp_key"] for a in accounts], 2))
    assert match.links.count() < 2 * n
    assert [r["members"] for r in match.clusters.collect()] == [n]
