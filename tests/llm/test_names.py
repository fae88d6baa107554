import pytest

from tessera.llm.name_text import NICKNAMES, Profile, Scorer, Spelling, choose, distance, familiar_form, nickname_table, short_form
from tessera.llm.names import resolve_names

KNOWN = [
    (1, "org", "Louzzara Engineering Studios LLC"), (2, "org", "Louzzara Studios"), (3, "org", "Lainessane & Delarlith GmbH"), (4, "org", "Kurlarn Networks Logistics"), (5, "org", "Sakund Health Inc."),
    (6, "org", "Sakund Laboratories"), (7, "org", "Baphåsh Ltd."), (8, "org", "Baphåsh Laboratories Ltd."), (20, "person", "Katherine Klorvebrook"), (21, "person", "Deborah Klorvebrook"),
    (22, "person", "Alexander C. Plarvustead"), (23, "person", "Benjamin Plarvustead"), (24, "person", "Alexandra Senash"), (25, "person", "Alexander Senash"),
    (26, "person", "Edward Crombearnulo"),
]
ALONE = {3, 4}  # heads that one firm only has; 7 is its head alone
PROFILES = [Profile(i, kind, name, i in ALONE | {7}) for i, kind, name in KNOWN]
SCORER = Scorer(nickname_table(NICKNAMES))


def best(text):
    s = Spelling(text)
    return None if s.empty else choose([(m[0], k.id) for k in PROFILES if (m := SCORER.match(s, k))])


@pytest.mark.parametrize(
    "text, want",
    [
        ("Louzzara Engineering Studios GmbH", 1), ("Louzzara Eng. Studio", 1), ("louzzaraengineeringstudios.example", 1), ("Louzzara Enginereign Syudios Inc. Group", 1), ("LES", 1), ("LouzzaraEngineeringStudios", 1),
        ("Studios, Louzzara", 2), ("The Louzzara Sttudios Incorporated", 2), ("LAINESSANE UND DELARLITH", 3), ("Lainessane &amp; Delarlith PLC – Talent", 3), ("Kurlarn", 4), ("Kurlarn Netw. Log.™", 4),
        ("Sakund Hlth LLC | Jobs", 5), ("Sakund Labs", 6), ("SAKUNDLABORATORIES, LTD.", 6), ("Sakund Laboratories (Thornwick)", 6), ("Baphash", 7), ("Sakund", None), ("Sakund Travel B.V.", None), ("Louzzulvique Dental", None),
        ("Klorvebrook, Katherine", 20), ("K. KLLORVEBROOK", 20), ("Kathy Klorvebrook", 20), ("katherine.klorvebrook@mail.example (Katherine Klorvebrook)", 20), ("Klorvebrook, K. - HR", 20), ("Posted by Debbie Klorvebrook", 21),
        ("Recruiter: Dr. Klorvebrook D", 21), ("Alexander Plarvustead via feed", 22), ("Alexander D. Plarvustead", None), ("Benny Plarvustead, Talent Partner", 23), ("A. Senash", None), ("Lexi Senash", 24), ("Xander Senash", 25),
        ("Crombearnulo, E.", 26), ("E. CROMBEAMULO", 26), ("Yolanda Crombearnulo", None), ("Kurlarn Networks Logistics Inorporated", 4), ("Samantha L.", None), ("HR Team", None), ("admin", None), ("noreply@firm.example", None), ("", None), ("—", None), ("x" * 5000, None),
    ],
)
def test_spellings(text, want):
    assert best(text) == want


def test_rules_of_words():
    assert all(short_form(*x) for x in (("mfg", "manufacturing"), ("svcs", "services"), ("intl", "international"), ("labs", "laboratories"), ("dept", "department"), ("pwr", "power")))
    assert not any(short_form(*x) for x in (("travel", "technologies"), ("data", "dental"), ("power", "pwr"), ("x", "xerox"), ("", "a")))
    assert all(familiar_form(*x) for x in (("ben", "benjamin"), ("debby", "deborah"), ("steffi", "stefanie"), ("beth", "elizabeth"), ("ed", "edward")))
    assert not any(familiar_form(*x) for x in (("anna", "hannes"), ("bob", "robert"), ("edward", "edward"), ("", "ed")))


def test_distance():
    assert [distance(*x) for x in (("ab", "ba", 2), ("abc", "abd", 2), ("abc", "xyz", 2), ("", "ab", 2), ("same", "same", 0))] == [1, 1, 3, 2, 0]


def test_columns(spark):
    known = spark.createDataFrame([*KNOWN, (99, "org", None)], "entity_id long, kind string, name string")
    rows = [(1, "Kurlarn", "K. Klorvebrook", "x"), (1, "Kurlarn", None, None), (2, None, "admin", None), (3, " ", "", None), (4, "Sakund Travel", "Kurlarn", None), (5, "Kurlannr", None, None)]
    df = spark.createDataFrame(rows, "row_id long, company string, creator string, entity_id string")
    got = sorted(map(tuple, resolve_names(df, known, ["company", "creator"]).collect()))
    assert got == [(1, "company", 4), (1, "company", 4), (1, "creator", 20), (4, "creator", 4), (5, "company", 4)]
    assert resolve_names(df.limit(0), known, ["company"]).count() == 0
    assert resolve_names(df, known.limit(0), ["company"]).count() == 0


def test_records_merge_through_each_other(spark):
    """Names and words of no test table: only a merged spelling brings the last of each near."""
    known = [(1, "org", "Orvantel Shipbuilding"), (2, "org", "Miravec Shipbuilding"), (3, "person", "Wolfgang Iderstrom"), (4, "org", " "), (5, "person", "—"), (6, "org", "Orvantel Catering")]
    rows = [(1, "Orvantel Shipbldg"), (2, "Orvantel Shpbldg"), (3, "Orvantel Shpbldgx"), (4, "Wolfi Iderstrom"), (5, "Wolfii Iderstrom"), (6, "Orvantel Sailing"), (7, "Orvantel"), (8, "—")]
    df = spark.createDataFrame(rows, "row_id long, company string")
    got = {(r["row_id"], r["entity_id"]) for r in resolve_names(df, spark.createDataFrame(known, "entity_id long, kind string, name string"), ["company"]).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 3), (5, 3)}
    alone = df.where("row_id in (3, 5)")
    got = {r["row_id"] for r in resolve_names(alone, spark.createDataFrame(known, "entity_id long, kind string, name string"), ["company"]).collect()}
    assert 3 not in got


def test_merged_spellings_bring_further_ones_near(spark):
    known = spark.createDataFrame([(1, "org", "Wethiorelle Robotics Energy Ltd.")], "entity_id long, kind string, name string")
    far = "Wxthiorxlle"  # two edits off: it shares no key with the name, but one with a spelling between
    df = spark.createDataFrame([(1, "Wethiorxlle"), (2, far)], "row_id long, company string")
    assert sorted(r["row_id"] for r in resolve_names(df, known, ["company"]).collect()) == [1, 2]
