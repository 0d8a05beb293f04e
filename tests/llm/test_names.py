"""Linking of name spellings."""

import random

import pytest

from weftgraph.llm import names as N

ALIASES = [(1, "William", "Bill", "given_name"), (2, "Eleanor", "Nell", "given_name"), (3, "Penelope", "Nell", "given_name"), (4, "Pharmaceuticals", "Pharma", "sector"), (5, "Insurance Services", "Ins. Svcs", "sector"), (6, "Limited", "Ltd", "legal_form")]
SECTORS = ["Pharmaceuticals", "Food and Beverage", "Insurance Services", "Agriculture", "Mining"]

GROUPS = [
    ["William Karstenlor", "Bill Karstenlor", "KARSTENLOR, W.", "Dr. William H. Karstenlor", "Willaim Karstenlor", "Ｗｉｌｌｉａｍ Karstenlor", 'William "Bill" Karstenlor', "William Karstenlor, CFO", "karstenlor william", "William Karstenlr", "William Kar Stenlor"],
    ["Winona Belsomtir", "Belsomtir, Winona"],
    ["Dromvaltes Pharmaceuticals Limited", "The Dromvaltes Pharma Ltd.", "Pharmaceuticals, Dromvaltes Ltd", "DromvaltesPharmaceuticals Limited", "Dromvaltes (Pharmaceuticals)", "Dromvatles Pharm. Limited", "dromvaltes_pharmaceuticals_limited", "Dromval-tes Pharmaceuticals", "Dromvalt. Pharmaceuticals Ltd"],
    ["Dromvaltes Food and Beverage Limited", "Dromvaltes F&B Ltd", "Dromvaltes Food &amp; Beverage"],
    ["Kelmurasto Growth Fund IV", "Growth Fund 4 Kelmurasto", "Kelmurasto Growth Fd No. 4 LP", "kelmurasto growth fund four"],
    ["Kelmurasto Growth Fund V"],
    ["Kelmurasto Bond Fund IV"],
    ["Eleanor Tirvasmol", "Nell Tirvasmol"],
    ["Robert Zuldenpar"],
    ["Rebecca Zuldenpar"],
    ["R. Zuldenpar"],
]


def fillers():
    """Names that let the lists of business lines be counted."""
    rng = random.Random(1)
    core = lambda: "".join(rng.choice("bdgklmprst") + rng.choice("aeiou") + rng.choice("lrnms") for _ in range(4)).title()
    return [f"{core()} {s} {f}" for s in SECTORS for f in ("Limited", "Company") for _ in range(4)]


@pytest.fixture(scope="module")
def linked(spark):
    rows, want = [], {}
    for g, spellings in enumerate(GROUPS):
        for s in spellings:
            kind = "organization" if any(w in s.lower() for w in ("fund", " fd", "dromva")) else "person"
            rows.append((len(rows), s, kind))
            want[s] = g
    rows.append((len(rows), "William Karstenlor", "PERSON"))
    rows += [(900, None, "person"), (901, "", "organization"), (902, " !! ", None), (903, "Dromvaltes Operating Margin", "financial_metric"), (904, "Dromvaltes Pharmaceuticals Limited", "event"), (905, "x" * 5000, "organization")]
    rows += [(1000 + i, s, "organization") for i, s in enumerate(fillers())]
    df = spark.createDataFrame(rows, "vec_id bigint, entity_name string, entity_type string").selectExpr("*", "1 AS id", "2 AS row", "3 AS name")
    aliases = spark.createDataFrame(ALIASES, "alias_id bigint, full_form string, short_form string, kind string")
    members, _ = N.same_entities(df, aliases)
    return rows, want, {tuple(r) for r in N.found_pairs(members).collect()}


def test_spellings_are_linked_and_others_are_not(linked):
    rows, want, got = linked
    name = {r[0]: r[1] for r in rows}
    should = {(a, b) for a in name for b in name if a < b and name[a] in want and name[b] in want and want[name[a]] == want[name[b]] and name[a] != name[b] and a < 900 and b < 900}
    wrong = {(name[a], name[b]) for a, b in got - should}
    missed = {(name[a], name[b]) for a, b in should - got}
    assert not wrong and not missed


def test_rows_that_never_count(linked):
    _, _, got = linked
    assert not {x for p in got for x in p} & set(range(900, 906))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, entity_name string, entity_type string")
    aliases = spark.createDataFrame([], "alias_id bigint, full_form string, short_form string, kind string")
    members, _ = N.same_entities(df, aliases)
    assert N.found_pairs(members).collect() == []


def test_nearer_spellings_take_no_link_away(spark):
    cores = ["Karstenlormat", "Karstenlormta", "Karstanlorzat", "Karstanlorzut", "Belsomt", "Belsuzt"]  # X and its typo, Y two edits from X and its typo; short ones
    aliases = spark.createDataFrame(ALIASES, "alias_id bigint, full_form string, short_form string, kind string")

    def found(use):
        rows = [(i, f"William {cores[i]}", "person") for i in use] + [(1000 + i, x, "organization") for i, x in enumerate(fillers())]
        members, _ = N.same_entities(spark.createDataFrame(rows, "vec_id bigint, entity_name string, entity_type string"), aliases)
        return {tuple(r) for r in N.found_pairs(members).collect()}

    assert found([0, 2, 4, 5]) == {(0, 2)}
    assert found(range(6)) == {(a, b) for a in range(4) for b in range(a + 1, 4)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _distance(a, b):
    """Edits; a swap of neighbours is one."""
    d = _edits(a, b)
    return 1 if d == 2 and N.edit1(a, b) else d


def people(spark, given, surnames, copies=1):
    aliases = spark.createDataFrame(ALIASES, "alias_id bigint, full_form string, short_form string, kind string")
    forms = ["{g} {s}", "{s}, {g}", "Dr. {g} {s}", "{g} {s}, CFO", "{g} H. {s}"][:copies]
    texts = [f.format(g=given, s=x) for x in surnames for f in forms]
    rows = [(i, t, "person") for i, t in enumerate(texts)] + [(1000 + i, x, "organization") for i, x in enumerate(fillers())]
    members, _ = N.same_entities(spark.createDataFrame(rows, "vec_id bigint, entity_name string, entity_type string"), aliases)
    return texts, {tuple(r) for r in N.found_pairs(members).collect()}


def test_short_surnames_are_different_people(spark):
    assert people(spark, "William", ["Hall", "Hill", "Hull", "Ball", "Bell", "Belt", "Lee", "Li", "Lu"])[1] == set()


def test_attested_names_are_not_chained(spark):
    texts, got = people(spark, "William", ["Karstenlor", "Karstenler", "Karstanler"], copies=4)
    assert {(texts[a].count("Karstenlor"), texts[b].count("Karstenlor")) for a, b in got} <= {(1, 1), (0, 0)}
    assert all(len({x for x in ("Karstenlor", "Karstenler", "Karstanler") for t in (texts[a], texts[b]) if x in t}) == 1 for a, b in got) and got


def test_large_groups_give_every_pair_and_classes(spark):
    rows = [(i, f"n{i % 90}", 7) for i in range(300)] + [(400, "a", 8), (401, "a", 8), (402, "b", 8), (500, "x", 9)]
    members = spark.createDataFrame(rows, "row bigint, name string, grp bigint")
    got = [tuple(r) for r in N.found_pairs(members).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[1] != b[1]}
    assert len(got) == len(want) and set(got) == want
    by = {r.row: (r.class_id, r.rows, r.names) for r in N.classes(members).collect()}
    assert by[299] == (0, 300, 90) and by[402] == (400, 3, 2) and 500 not in by


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)} | {"abcdefghij", "abdcefghij", "xabcdefghi", "abcdefg"}
    units = [(i, "s" if i % 4 else "t", w) for i, w in enumerate(sorted(words))]
    got = {(r.a, r.b): r.d for r in N.segment_join(spark.createDataFrame(units, "u bigint, scope string, core string")).collect()}
    want = {(a[0], b[0]) for a in units for b in units if a[0] < b[0] and a[1] == b[1] and _distance(a[2], b[2]) <= N.edits(min(len(a[2]), len(b[2])))}
    assert set(got) == want
    assert all((d <= 1) == N.edit1(units[a][2], units[b][2]) for (a, b), d in got.items())


def test_links_need_no_large_plan(spark):
    """One plan of all kinds of links held a hundred shuffles, which filled the driver."""
    from weftgraph.plans import Scratch

    names = spark.createDataFrame([(1, "Vandersloot Mining Ltd", "organization"), (2, "Vandersloot Mining Limited", "organization"), (3, "W. Brentwaite", "person"), (4, "William Brentwaite", "person")], "id bigint, name string, typed string")
    aliases = spark.createDataFrame([("Mining", "Mng", "sector")], "full_form string, short_form string, kind string")
    links = N.link_names(names, aliases, Scratch(spark, "t"))
    assert {frozenset(r) for r in links.collect()} == {frozenset((1, 2)), frozenset((3, 4))}
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()


def test_lookup_salts_only_where_a_key_is_hot(spark, monkeypatch):
    from weftgraph.plans import lookup, skew

    monkeypatch.setattr(skew, "HOT_LEAST", 100)
    right = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    for left, hot in ((spark.range(1000).selectExpr("id AS k", "id AS x"), False), (spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id END AS k", "id AS x"), True)):
        for how in ("inner", "left"):
            got = lookup(left, right, "k", 1000, how)
            assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
            assert ("_salt" in got._jdf.queryExecution().analyzed().toString()) == hot
