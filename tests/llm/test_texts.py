import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import htmltree
from millrace.llm import frequent_lines, looks, main_body

CONTENTS = "id string, url string, title string, content string, author string, site string, keys int, line string"


def contents(spark, rows):
    return spark.createDataFrame([(i, u, t, c, a, "x", 1, "y") for i, u, t, c, a in rows], CONTENTS)


@pytest.mark.parametrize(
    "text,form",
    [
        ("plain", None), ("Trận đấu – “vượt” m² №7 5 µg ❤️ 👩‍💻 α Ωμέγα «Северный ветер» fi", None), ("", None), ("नमस्‍ते", None), ("1️⃣ 🏴󠁧󠁢󠁥󠁮󠁧󠁿", None),
        ("é", "é"), ("ｈọｃ １２", "học 12"), ("𝐭𝗁𝚎", "the"), ("ﬁrst", "first"), ("a b c　d", "a b c d"), ("Ho­me​", "Home"), ("а house iѕ", "a house is"),
        ("ɡood", "good"), ("sа́ch", "sách"), ("Ðông", "Đông"), ("Ðað", None), ("x‍y", "xy"), ("a️", "a"), ("﻿", ""),
        ("hօuse", "house"), ("ᎢᎻE end", "THE end"), ("Հայաստան", None), ("ᏣᎳᎩ", None),
    ],
)
def test_forms(text, form):
    assert looks.form(text) == (text if form is None else form)
    assert looks.form(looks.form(text)) == looks.form(text)


def test_keys():
    assert looks.key("  ＴＨＥ  Ｅｎｄ ") == "the end" == looks.key("The  End")
    assert looks.key("Straße") == looks.key("STRASSE") and looks.key("m²") == "m2"


def test_changed_fields(spark):
    df = contents(spark, [("1", "u", "ok", "bаd", None), ("1", "u", "ok", "bаd", None), ("2", "u", None, "fine\n​x", "a"), (None, "u", "ｘ", "", "a"), ("4", "u", "y" * 300_000 + "​", None, None)])
    assert {(r.id, r.field) for r in looks.changed_fields(df).collect()} == {("1", "content"), ("2", "content"), (None, "title"), ("4", "title")}
    assert looks.changed_fields(df.limit(0)).count() == 0
    forms = {(r.id, r.field): r for r in looks.normal_forms(df).collect()}
    assert forms["1", "content"].form == "bad" and forms["2", "title"].form is None and not forms["2", "title"].changed


def brute_lines(rows, least, share):
    import re
    import unicodedata

    def key(line):
        kept = "".join(c for c in looks.plain(line).lower() if unicodedata.category(c)[0] in "LMN")
        return re.sub(r"\d+", "0", kept)

    def site(u):
        m = re.match(r"\s*[a-z]+://([^/]+)", (u or "").lower())
        return m[1] if m else None

    docs = [(i, site(u), c.split("\n")) for i, u, _, c, _ in rows if c is not None]
    out = set()
    for i, s, lines in docs:
        own = [{key(x) for x in ls} for _, t, ls in docs if t == s]
        for n, line in enumerate(lines, 1):
            k = key(line)
            count = sum(k in o for o in own)
            if s and k and count >= least and count >= share * len(own):
                out.add((i, n))
    return out


def test_frequent_lines_against_brute_force(spark):
    rng = random.Random(1)
    notes = ["Follow A for 12 stories", "Fоllоw а fоr 3 stоriеs", "осе", "oce", "FOLLOW  a, for 9 stories!", "Ｆｏｌｌｏｗ a for 3 stories", "rare", "", "---", "12"]
    rows = []
    for k in range(120):
        lines = [f"body {rng.choice('abcdef')}{k} x{'y' * k}" for _ in range(3)] + rng.choices(notes, k=2)
        rng.shuffle(lines)
        rows.append((str(k), f"https://{'hot' if k % 3 else 'few'}.example/{k}", None, "\n".join(lines), None))
    rows += [("n", None, None, "rare\nrare", None), ("m", "https://hot.example/", None, None, None), ("e", "https://hot.example/", None, "", None), rows[0]]
    df = contents(spark, rows)
    assert {(r.id, r.line_no) for r in frequent_lines.frequent_positions(df).collect()} == brute_lines(rows, 5, 0.1)
    clean = {r.id: r for r in frequent_lines.without_frequent_lines(df).collect()}
    gone = brute_lines(rows, 5, 0.1)
    for i, _, _, c, _ in rows:
        if c is not None:
            assert clean[i].content == "\n".join(x for n, x in enumerate(c.split("\n"), 1) if (i, n) not in gone)
    assert "m" not in clean and clean["n"].lines_removed == 0
    assert frequent_lines.frequent_positions(df.limit(0)).count() == 0


def heading(k):
    return f"A view of {chr(97 + k % 26) * 3}{chr(120 - k // 26)} river"


def sentence(k, j):
    return f"In town {k} the {'council mayor clerk'.split()[j]} of {heading(k)[-10:]} said that part {j} was delayed by rain."


def page(k, notice=True, layout=0):
    body = "".join(f"<p>{sentence(k, j)}</p>" for j in range(3))
    note = f"<p class=share>Follow Courier for {k} stories</p>" if notice else ""
    if layout:
        return f"<title>Story {k} of town | Courier</title><div id=top>Home · Local</div><h1>Story {k} of town</h1><div id=text><span class=author>By Ann Lee</span><br>First {heading(k)[-10:]} was told.<br><br>Second {heading(k)[-10:]} followed.<br>Follow Courier for {k} stories</div><div id=right>Story {k + 1} of town<br>Teaser text of {k} stands here.</div>"
    return f"<title>Story {k} of town | Courier</title><nav><a href=/>Home</a></nav><article><h1>Story {k} of town</h1><p class=author>Ann Lee</p>{body}<aside class=inline><p>See also: Story {k + 3} of town</p></aside><h2>{heading(k)}</h2>{note}</article><aside><p>Other news of town {k} is told here.</p></aside><section id=comments><p>Thanks, great piece {k}.</p></section><footer><p>Courier Media, company {k}.</p></footer>"


def test_main_body(spark):
    rows = [(f"p{k}", f"https://courier.example/{k}", page(k, layout=k % 3 == 0), 200) for k in range(60)]
    rows += [("null", None, None, 200), ("list", "https://courier.example/", "<title>Courier</title><ul class=list><li><a href=/1>Story 1 of town</a><p>Teaser of one stands here.</p></ul>", 200), ("err", "https://courier.example/x", page(1), 404), rows[1], ("broken", "u", "<h1>Headline<p>This one sentence is the whole body of it.", 200)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "id string, url string, raw_html string, status_code int, position int")
    stored = contents(spark, [("c1", "https://courier.example/1", "Story 1 of town", f"Story 1 of town\nFollow Courier for 99 stories\n{sentence(1, 0)}\n\nA view of bbbx river\nSee also: Story 9 of town\nThanks, great piece 5.\nAnn Lee", "Ann Lee"), ("c2", None, None, None, None), ("c3", None, None, "", None)])
    got = {}
    for r in main_body.main_paragraphs(pages, stored, with_text=True).orderBy("id", "position").collect():
        if r.paragraph not in got.setdefault(r.id, []):
            got[r.id].append(r.paragraph)
    assert got["p1"] == [sentence(1, j) for j in range(3)] + [heading(1)]
    assert got["p3"] == [f"First {heading(3)[-10:]} was told.", f"Second {heading(3)[-10:]} followed."]
    assert got["c1"] == [sentence(1, 0), "A view of bbbx river"]
    assert got["broken"] == ["This one sentence is the whole body of it."]
    assert not {"null", "list", "err", "c2", "c3"} & set(got)
    import hashlib

    found = main_body.main_paragraphs(pages, stored)
    assert found.count() == found.distinct().count() == found.groupBy("id", "para_md5").count().count()
    assert (("broken", hashlib.md5(got["broken"][0].encode()).hexdigest())) in {(r.id, r.para_md5) for r in found.collect()}
    assert main_body.main_paragraphs(pages.limit(0), stored.limit(0)).count() == 0


def test_line_model_counts_all_pages(spark, monkeypatch):
    # a word on two pages each, on more pages than any sample took
    word = lambda k: "q" + "".join(chr(97 + int(d)) for d in str(k // 2))
    rows = [(f"p{k}", f"https://courier.example/{k}", f"<article><h1>Story</h1><p>The whole body of this page is about {word(k)} and the town of rivers.</p></article>", 200) for k in range(3200)]
    bodies = main_body.page_bodies(spark.createDataFrame(rows, "id string, url string, raw_html string, status_code int"))
    weights = main_body.line_model(bodies)
    assert all(word(k) in weights for k in range(3200))
    monkeypatch.setattr(main_body, "MODEL_FEATURES", 500)
    few = main_body.line_model(bodies)
    assert len(few) < 600 and {"town", "rivers"} <= set(few)  # what is seen most is kept


def test_rendered_body():
    page = "<title>Story</title><nav><a href=/>Home</a></nav><article><h1>Story</h1><p>The council of the town met on Monday.</p><ul><li>First it spoke about the bridge.</li><li>Then about the school.</li></ul><table><tr><th>Year<th>Cost</tr><tr><td>2023<td>5</tr></table></article><footer>f</footer>"
    text = htmltree.write(main_body.lines_of_page(page, None, {}))
    assert text.split("\n") == ["The council of the town met on Monday.", "", "- First it spoke about the bridge.", "- Then about the school.", "", "Year  Cost", "2023  5"]


def test_texts_of_pages(spark):
    rows = [(f"p{k}", f"https://courier.example/{k}", page(k, layout=k % 3 == 0), 200) for k in range(40)] + [("none", None, None, 200), ("empty", None, "", 200)]
    got = {r.id: r.text for r in main_body.main_texts(spark.createDataFrame(rows, "id string, url string, raw_html string, status_code int")).collect()}
    assert got["p1"] == "\n\n".join([sentence(1, j) for j in range(3)] + [heading(1)]) and got["empty"] == "" and "none" not in got


@pytest.mark.parametrize("bad", [None, "", "<h1>x", "<p>" * 3000 + "a", "<h1>a</h1>" + "b " * 200_000])
def test_odd_pages(bad):
    main_body.body_of_page(bad, None, {})


def test_texts_with_udfs_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("a b",)], "t string").select(looks.form_udf(F.col("t")).alias("f"), looks.key_udf(F.col("t")).alias("k"))
    assert [tuple(r) for r in df.collect()] == [(None, None), ("a b", "a b")]


def test_main_body_whatever_is_broadcast(spark, monkeypatch):
    # the notice of a few pages is rarer than the features that are broadcast
    rows = [(f"p{k}", f"https://courier.example/{k}", page(k, layout=k % 3 == 0), 200) for k in range(60)]
    rows += [(f"s{k}", f"https://paper{k}.example/", page(k).replace("Follow Courier for", "Subscribe today, dear reader, at price"), 200) for k in range(3)]
    pages = spark.createDataFrame(rows, "id string, url string, raw_html string, status_code int")
    stored = contents(spark, [(f"c{k}", f"https://paper{k}.example/", None, f"{sentence(k, 0)}\nSubscribe today, dear reader, at price 5 stories\nThanks, great piece {k}.\nOther news of town {k} is told here.", None) for k in range(4)])
    shown = lambda: (sorted(map(str, main_body.main_paragraphs(pages, stored).collect())), sorted(map(str, main_body.main_texts(pages).collect())))
    whole = shown()
    for size in (40, 4):
        monkeypatch.setattr(main_body, "MODEL_FEATURES", size)
        assert shown() == whole
