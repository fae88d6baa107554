import pytest

from tessera.functions.quantity_text import Factors, automaton, quantities
from tessera.functions.unit_text import dimension, figure, segment, worded
from tessera.operators.quantities import extract_quantities

FACTORS = [
    *[("pay_currency", c, float(f)) for c, f in dict(USD=1, EUR=1.08, GBP=1.27, INR=0.012, CHF=1.12, CAD=0.73).items()],
    *[("pay_period", p, float(f)) for p, f in dict(hour=2000, day=250, week=50, month=12, year=1).items()],
    ("experience", "year", 12.0), ("experience", "month", 1.0), ("experience", "week", 0.230769), ("distance", "km", 1000.0), ("distance", "mile", 1609.344), ("distance", "metre", 1.0),
    ("worktime", "hour per week", 60.0), ("worktime", "hour per day", 300.0), ("worktime", "full time", 2400.0), ("worktime", "minute per week", 1.0),
]
KNOWN, TOPICS = Factors(FACTORS), automaton()


def read(text):
    return {q: (low, high) for q, low, high in quantities(text.lower(), TOPICS, KNOWN)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Salary: US$52 to 70.00 an hour", {"pay": (104000, 140000)}),
        ("The band is between £81,000 and 105,000 p.a..", {"pay": (102870, 133350)}),
        ("Compensation is €128-138k annually, depending on what you bring.", {"pay": (138240, 149040)}),
        ("Gehaltsband: 88'000–102'000 CHF/Jahr", {"pay": (98560, 114240)}),
        ("Gehalt: 165 Tsd. bis 201 Tsd. € jährlich", {"pay": (178200, 217080)}),
        ("Salaire : 75 000 € par an", {"pay": (81000, 81000)}),
        ("Pagamos de 162.000 a 218.000 €/año brutos.", {"pay": (174960, 235440)}),
        ("We pay 22.5 LPA for this post.", {"pay": (27000, 27000)}),
        ("The band is ₹between 21.5 and 26 lakh p.a..", {"pay": (25800, 31200)}),
        ("Compensation is ninety-eight thousand to one hundred and thirty-three thousand dollars a year", {"pay": (98000, 133000)}),
        ("Currency: USD (thousands)\nPay basis: year\nRate: 82 to 93", {"pay": (82000, 93000)}),
        ("Pay figures are in GBP gross per day. Band: 190 to 240", {"pay": (60325, 76200)}),
        ("Montants en milliers de EUR par an. Salaire : de 65,5 à 74,5", {"pay": (70740, 80460)}),
        ("Band: 190 to 240", {}),
        ("A signing bonus of $5k is paid after probation. Revenue passed €8 million last year.", {}),
        ("Backend Engineer $59k/yr", {}),
        ("Prior work with dbt for 8+ years is needed.", {"experience": (96, 96)}),
        ("You bring 3 – 6 years of working experience with WebGL.", {"experience": (36, 72)}),
        ("Praxis im Beruf: 6 Jahre und 6 Monate, etwa mit Flink.", {"experience": (78, 78)}),
        ("You bring 260 weeks of working experience with Go.", {"experience": (60, 60)}),
        ("We ask for a year and a half of professional practice in .NET.", {"experience": (18, 18)}),
        ("Il faut entre 8 et 10 ans de pratique professionnelle avec Docker.", {"experience": (96, 120)}),
        ("The contract runs for 92 months with an option to extend. Notice is 3 months.", {}),
        ("You should live within fifty-five miles of our Norquay office.", {"distance": (88514, 88514)}),
        ("Radio de residencia en torno a Luneville-Sud: 7.500 metros.", {"distance": (7500, 7500)}),
        ("Maximaler Arbeitsweg nach Brackenford: 14.000 m.", {"distance": (14000, 14000)}),
        ("Our crews look after 260 km of fibre around Altmoor.", {}),
        ("Hours: 1,440 minutes a week", {"worktime": (1440, 1440)}),
        ("You work 37:30 hours weekly. Day to day you port things.", {"worktime": (2250, 2250)}),
        ("Temps de travail : 34h00 par semaine", {"worktime": (2040, 2040)}),
        ("The post is 85% of full time.", {"worktime": (2040, 2040)}),
        ("Arbeitszeit: 0,85 VZÄ", {"worktime": (2040, 2040)}),
        ("Dedicación: 4,5 horas al día", {"worktime": (1350, 1350)}),
        # Sentences that none of the test tables has.
        ("Annual salary of $80,000 per year.", {"pay": (80000, 80000)}),
        ("Starting wage is 52,000 EUR per annum", {"pay": (56160, 56160)}),
        ("Applicants need 3+ years of experience", {"experience": (36, 36)}),
        ("Five and a half years of experience", {"experience": (66, 66)}),
        ("40 hours per week", {"worktime": (2400, 2400)}),
        ("Within 25 km of our office", {"distance": (25000, 25000)}),
        ("You should live, and we mean it whatever the timetable of the ferry says, at most 25 km from the office", {"distance": (25000, 25000)}),
        ("Commute of 3000000 millimetres", {"distance": (3000, 3000)}),
        ("Live within 30 hectometres", {"distance": (3000, 3000)}),
        ("Live where winds of 25 m/s blow over 80 m² of roof, within 4 km", {"distance": (4000, 4000)}),
        ("A bonus of 5000 EUR a year is paid", {}),
        ("Currency: EUR (thousands) Pay basis: year Rate: 141 – 159 Day to day you port the lake", {"pay": (152280, 171720)}),
        ("Umfang: 70 % einer Vollzeitstelle", {"worktime": (1680, 1680)}),
        ("", {}), ("You work", {}), ("Salary: " + "x" * 100_000, {}),
    ],
)
def test_statements(text, want):
    assert read(text) == want


def test_segmentation_follows_the_field():
    assert segment("m around us", "distance") == (1, [("length", "metre")])
    assert segment("kEUR/Jahr".lower(), "pay")[1] == [("scale", 1e3), ("currency", "EUR"), ("per", None), ("time", "year")]
    assert segment("hectometres", "distance")[1] == [("prefix", 1e2), ("length", "metre")]
    assert dimension(segment("km²", "distance")[1]) == (0, 0, 2) and dimension(segment("m/s", "distance")[1]) == (0, -1, 1)
    assert dimension(segment("€/h", "pay")[1]) == (1, -1, 0)
    assert segment("hrs/week", "worktime")[1] == [("time", "hour"), ("per", None), ("time", "week")]


def test_numbers():
    for text, n in (("1,680", 1680), ("37,5", 37.5), ("0.875", 0.875), ("88'000", 88000), ("12,50,000", 1250000), ("1.234,50", 1234.5)):
        assert figure(text, 0) == (n, len(text))
    for text, n in (("eighty-seven thousand", 87000), ("siebenundachtzigtausend", 87000), ("quatre-vingt-dix-sept mille", 97000), ("treinta y cinco", 35), ("one hundred and nineteen", 119)):
        assert worded(text, 0) == (n, len(text))


def test_column(spark):
    rows = [(1, "Hours: 40 hrs/week", "x"), (1, "Hours: 40 hrs/week", "x"), (2, None, None), (3, " ", None), (None, "Hours: 40 hrs/week", None)]
    df = spark.createDataFrame(rows, "row_id long, content string, quantity string")
    units = spark.createDataFrame(FACTORS, "quantity string, unit string, factor double")
    got = [tuple(r) for r in extract_quantities(df, units).collect()]
    assert sorted(got, key=str) == sorted([(1, "worktime", 2400, 2400)] * 2 + [(None, "worktime", 2400, 2400)], key=str)
    assert extract_quantities(df.limit(0), units).count() == 0
