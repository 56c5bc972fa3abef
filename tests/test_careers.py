"""Entries of resumes, line by line."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchspark.operators import careers


def day(year, month=1):
    return dt.date(year, month, 1)


@pytest.fixture(scope="module")
def read(spark):
    def run(section, text, most=25):
        rows = [(1, section, i, x) for i, x in enumerate(text.split("\n"))]
        df = spark.createDataFrame(rows, "doc long, section string, line_no int, line string")
        return [r.asDict() for r in careers.career_entities(df, "doc", 2026, most).orderBy("kind", "position").collect()]

    return run


SPANS = {
    "Feb 2018 - April 2021": (day(2018, 2), day(2021, 4), False),
    "September, 2019 \u2013 present": (day(2019, 9), None, True),
    "Nov 2022 \u2014 till  date": (day(2022, 11), None, True),
    "2011-2014": (day(2011), day(2014), False),
    "7/2016 until 11/2017": (day(2016, 7), day(2017, 11), False),
    "Aug 2015 through 2019": (day(2015, 8), day(2019), False),
    "2020 to 2016": (day(2016), day(2020), False),
    "October 2012 - May 2013": (day(2012, 10), day(2013, 5), False),
    "Part-time tutor, Jan 2004": (day(2004), None, False),
    "ongoing": (None, None, True),
    "1920 - 2001": (None, day(2001), False),
    "Founded 1849": None,
    "Wrote services that scale": None,
    "version 12021": None,
    "": None,
}


def test_held_dates(spark):
    df = spark.createDataFrame([(x,) for x in SPANS], "line string").select("line", careers.held_dates(F.col("line"), 2026).alias("d"))
    assert {r.line: tuple(r.d) if r.d else None for r in df.collect()} == SPANS


def test_a_header_of_three_lines(read):
    (e,) = read("EXPERIENCE", "Data Analyst\nBlue River Systems | Lyon, France\nFull time\nMar 2019 - Present\n* Counted things\n  2) Counted more")
    assert (e["name"], e["organisation"], e["location"]) == ("Data Analyst", "Blue River Systems", "Lyon, France")
    assert (e["employment_type"], e["start"], e["is_current"], e["confidence"]) == ("FULL_TIME", day(2019, 3), True, 0.9)
    assert e["highlights"] == ["Counted things", "Counted more"]


def test_a_fourth_line_is_left_out(read):
    (e,) = read("EXPERIENCE", "Chief Architect at Old Firm\nred\ngreen\nSite Manager\n2001 - 2003")
    assert e["name"] == "Site Manager"
    assert e["organisation"] == "red"
    assert e["confidence"] == 0.7


def test_dates_beside_the_title_and_two_entries(read):
    a, b = read("EXPERIENCE", "Lead Designer | Kite Studio     Jun 2010 - Jul 2012\n- drew\n\nJunior Developer, Pine Bank\n2008 - 2009\n- wrote")
    assert (a["name"], a["organisation"], a["highlights"]) == ("Lead Designer", "Kite Studio", ["drew"])
    assert (b["name"], b["organisation"], b["position"], b["end"]) == ("Junior Developer", "Pine Bank", 2, day(2009))


def test_no_role_no_entry_and_no_dates_no_entry(read):
    assert read("EXPERIENCE", "Green Meadow Company\n2010 - 2012\n- planted") == []
    assert read("EXPERIENCE", "I was an engineer for many years.") == []


def test_a_role_without_an_employer(read):
    (e,) = read("EXPERIENCE", "Freelance Programmer\n2014 - 2016")
    assert (e["organisation"], e["employment_type"], e["confidence"]) == (None, "CONTRACT", 0.7)


def test_repeated_entries_stay_once(read):
    (e,) = read("EXPERIENCE", "QA Engineer | Nord Ltd\n2014 - 2016\n- first\nqa  engineer | NORD, Ltd.\nJan 2014 - 2015\n- second")
    assert e["highlights"] == ["first"]
    assert e["content_key"] == "exp:qaengineer:nordltd:201401"


def test_education(read):
    (e,) = read("EDUCATION", "M.Tech in Robotics.\nInstitute of Machines, Delft\n2012 to 2014\nGPA 3.7/4.0")
    assert (e["name"], e["degree"], e["field_of_study"]) == ("Institute of Machines, Delft", "M.Tech in Robotics.", "Robotics")
    assert (e["level"], e["grade"], e["end"], e["confidence"]) == ("MASTERS", "3.7/4.0", day(2014), 0.9)
    assert read("EDUCATION", "B.Sc\n2012 - 2014") == []


@pytest.mark.parametrize(("text", "grade"), [
    ("2016 - 2020 CGPA: 8.4", "8.4"), ("2016 - 2020 CGPA", None), ("9.1 CGPA", "9.1"), ("scored 72.5 % overall", "72.5 %"), ("Second Class", "Second Class"),
    ("marks 640, first class", "first class"), ("1.2.3 gpa, distinction", "distinction"), ("nothing", None),
])
def test_grades(spark, text, grade):
    assert spark.range(1).select(careers.grade_of(F.lit(text))).first()[0] == grade


def test_projects(read):
    a, b, c = read("PROJECTS", (
        "- no project yet\nKiln \u2014 https://kiln.example/app\nA sentence about it, which is long enough to be read as its prose.\n- fired pots\n"
        "Lonely name\nRoad Map | 2015 - 2016\nLantern\n- www.lantern.example shines\n- on"
    ))
    assert (a["name"], a["url"], a["description"], a["highlights"]) == ("Kiln", "https://kiln.example/app", "A sentence about it, which is long enough to be read as its prose.", ["fired pots"])
    assert (b["name"], b["start"], b["end"], b["highlights"]) == ("Road Map", day(2015), day(2016), [])
    assert (c["name"], c["url"], c["description"]) == ("Lantern", "www.lantern.example", "www.lantern.example shines")


def test_prose_opens_a_project_only_where_none_is_open(read):
    (e,) = read("PROJECTS", "2019\nA tool that sorts parcels by weight and by the place they go to.\nIt has been in use for a long while and nobody has complained.")
    assert e["name"] == "A tool that sorts parcels by weight and by the place they go to."
    assert e["description"] == "It has been in use for a long while and nobody has complained."


def test_certifications(read):
    found = read("CERTIFICATIONS", "- Oracle Database Expert \u2013 Level 2, 2019\n\nFirst Aid | Red House\nCloud Basics | Udemy\n2020\nSingle\n" + "x " * 120)
    assert [(e["name"], e["organisation"], e["start"], e["confidence"]) for e in found] == [
        ("Oracle Database Expert \u2013 Level 2", "Oracle", day(2019), 0.9), ("First Aid | Red House", None, None, 0.7), ("Cloud Basics", "Udemy", None, 0.9),
    ]


def test_caps_and_other_sections(read):
    assert len(read("CERTIFICATIONS", "\n".join(f"Great Course {i}" for i in range(30)))) == 25
    assert read("SUMMARY", "Engineer | Acme Ltd\n2010 - 2012") == []
    assert read("EXPERIENCE", "") == []
