import pytest

from millrace.llm import names

SAME = [
    ["Dưỡn Lệ Hiềm", "duon le hiem", "DƯỠN LỆ HIỀM", "Dưỡn  Lệ  Hiềm", "Hiềm Dưỡn Lệ", "PV Dưỡn Lệ Hiềm", "Theo Dưỡn Lệ Hiềm", "Dưỡn Lệ Hiềm (tổng hợp)", "D. Lệ Hiềm", "Duon Lệ Hiềm", "Bài và ảnh: Dưỡn Lệ Hiềm", "Dưỡn Lệ Hềim"],
    ["William Denstrow", "Denstrow, William", "By Bill Denstrow", "WILLIAM DENSTROW", "W. Denstrow", "Denstrow W.", "Wil. Denstrow", "William Denstrow, staff writer", "William J. Denstrow", "Williaam Denstrow"],
    ["Marc Cawdrell", "Cawdrell, Marc", "marc cawdrell"],
    ["Mark Cawdrell", "Cawdrell, Mark", "mark cawdrell"],
    ["Data Journalism Unit Mirepoolledger", "Mirepoolledger - Data Journalism Unit", "DJU Mirepoolledger", "Data Journalism Unit (Mirepoolledger)", "Data Journalism Unit, Mirepoolledger"],
    ["Mark Brindleigh", "mark brindleigh"], ["Marc Vossberg", "MARC VOSSBERG"], ["Tạc Lệ Khảm", "Tac Le Kham"], ["Tạc Sĩ Hiềm", "TẠC SĨ HIỀM"], ["William Okervane", "Okervane, Bill"],
]
NOBODY = [None, "", " ", "-", "admin", "N/A", "Unknown", "…", "12"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(a, f"https://s{k}.example/x", "e", 1) for k, group in enumerate(SAME) for a in group] + [(a, "https://s0.example/", "e", 1) for a in NOBODY] + [("W. Denstrow", None, "e", 1)] * 3
    df = spark.createDataFrame(rows, "author string, url string, entity string, n int")
    return df, names.same_name_pairs(df).collect(), names.profiles(df).collect()


def test_variants(found):
    _, pairs, _ = found
    got = {(r.author_a, r.author_b) for r in pairs}
    want = {(a, b) for group in SAME for a in group for b in group if a < b}
    assert got - want == set(), "different people linked"
    assert len(want - got) == 0, want - got


def test_nobody_and_empty(spark, found):
    df, _, profiles = found
    assert not {r.author for r in profiles} & set(NOBODY)
    assert names.same_name_pairs(df.limit(0)).count() == 0
    assert names.same_name_pairs(spark.createDataFrame([(None, None), ("x", None), ("q" * 100_000, None)], "author string, url string")).count() == 0


@pytest.mark.parametrize("a,b,near", [("abc", "abd", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "abc", False), ("abc", "cba", False), ("abcd", "ab", False)])
def test_one_error(a, b, near):
    assert names.one_error(a, b) is near and names.one_error(b, a) is near


def test_shared_initials_stay_apart(spark):
    rows = [("Anna Bold", "https://a.example/"), ("Alan Bold", "https://b.example/"), ("A. Bold", "https://c.example/"), ("A. Bold", None)]
    df = spark.createDataFrame(rows, "author string, url string")
    assert names.same_name_pairs(df).count() == 0
    near = spark.createDataFrame([*rows[:2], ("A. Bold", "https://b.example/9")], "author string, url string")
    assert [(r.author_a, r.author_b) for r in names.same_name_pairs(near).collect()] == [("A. Bold", "Alan Bold")]


def test_long_names_and_chains(spark):
    rows = [("Juan Carlos Maria de la Cruz Vega", "https://a.example/")] * 3 + [("J. Carlos Maria de la Cruz Vega", "https://b.example/"), ("Ann " * 2000, "https://a.example/"), ("Ann " * 2000 + "B.", "https://a.example/")]
    # two misspellings of a short form that itself joins the full name
    rows += [("Dưỡn Lệ Hiềm", "https://c.example/")] * 4 + [("Lệ Hiềm", "https://c.example/")] * 2 + [("LỆ HIỀM", "https://c.example/"), ("By Lệ Hiềm", "https://c.example/"), ("Lệ Hiềmm", "https://d.example/"), ("Lệ Hiiềm", "https://d.example/")]
    df = spark.createDataFrame(rows, "author string, url string")
    by = {}
    for r in names.profiles(df).collect():
        by.setdefault(r.entity, set()).add(r.author)
        assert r.name in {x for x, _ in rows}
    groups = sorted(map(sorted, by.values()), key=len)
    assert sorted(["Dưỡn Lệ Hiềm", "Lệ Hiềm", "LỆ HIỀM", "By Lệ Hiềm", "Lệ Hiềmm", "Lệ Hiiềm"]) in groups
    assert sorted(["Juan Carlos Maria de la Cruz Vega", "J. Carlos Maria de la Cruz Vega"]) in groups
