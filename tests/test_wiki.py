"""Templates, plain text and entries of a dump."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import wiki as wk
from textloom.sources import files as fl

PAGE = """{{also|X}}
==English==
===Etymology===
From {{m|la|x}}.
===Verb===
{{en-verb}}

# {{lb|en|slang|UK|of {{w|people}}}} To '''go''' [[up|upwards]] {{q|like {{m|en|smoke}}}}; really.
#: {{ux|en|an example}}
# {{lb|en|dated|slang}} To [[leave]].
[[Category:English phrasal verbs]]

==French==
===Noun===
# {{lb|fr|slang}} chose
"""


def test_nested_templates():
    found = wk.parse_templates("a {{x|1|{{y|[[p|q]]|b={{z}}}}|2}} {{open|{{w}} ]] }} {{never")
    assert [(n, v, d) for n, v, _, _, d in found] == [("z", [], 2), ("y", ["[[p|q]]", "b={{z}}"], 1), ("x", ["1", "{{y|[[p|q]]|b={{z}}}}", "2"], 0), ("w", [], 1), ("open", ["{{w}} ]]"], 0)]
    assert wk.parse_templates("}} no {{ start") == [] and wk.parse_templates("{{a}}")[0][:2] == ("a", [])
    assert wk.plain_text("{{lb|en|x}} To '''go''' [[up|upwards]] {{q|like {{m|en|smoke}}}} <ref>y</ref>[[z]]") == "To go upwards like smoke yz"


def test_entries_of_a_dump(spark, tmp_path):
    rows = [
        (1, "go up", 0, PAGE, None), (2, "up", 0, PAGE.replace("===Verb===", "===Adverb==="), None), (3, "plain", 0, "==English==\n===Noun===\n# A thing.\n", None), (4, "a thing", 0, "==English==\n===Noun===\n# A thing.\n", None),
        (5, "Talk:x y", 1, PAGE, None), (6, "x y", 0, PAGE, "go up"), (7, "no part", 0, "==English==\n===Etymology===\n# a\n", None), (8, "like father like son", 0, "==English==\n===Proverb===\n# {{lb|en|idiomatic}} Sons.\n", None), (9, "b" * 30 + " " + "c" * 30, 0, PAGE, None), (10, "empty", 0, None, None),
        (11, "kick it", 0, "==English==\n===Verb===\n# To die.\n{{C|en|Idioms}}\n", None),
    ]
    pages = spark.createDataFrame([(t, ns, i, 10 * i, x, r) for i, t, ns, x, r in rows], "title string, ns int, page_id long, revision_id long, text string, redirect string")
    fl.write_wiki_dump(pages, str(tmp_path / "dump"))
    read = fl.read_wiki_dump(spark, str(tmp_path / "dump"))
    assert {(r["page_id"], r["redirect"], r["editor"], r["anonymous"]) for r in read.collect()} == {(i, r, None, False) for i, *_, r in rows}
    got = {r["title"]: tuple(r[c] for c in ("kind", "pos", "gloss", "registers", "regions", "page_id", "revision_id")) for r in wk.entries(read).collect()}
    gloss = "To go upwards like smoke; really."
    assert got == {
        "go up": ("phrasal-verb", "Verb", gloss, f"slang: {gloss.replace(';', ',')}; dated: To leave.", f"British: {gloss.replace(';', ',')}", 1, 10),
        "up": ("word", "Adverb", gloss, f"slang: {gloss.replace(';', ',')}; dated: To leave.", f"British: {gloss.replace(';', ',')}", 2, 20),
        "a thing": ("multiword", "Noun", "A thing.", "", "", 4, 40), "like father like son": ("proverb", "Proverb", "Sons.", "", "", 8, 80), "kick it": ("idiom", "Verb", "To die.", "", "", 11, 110),
    }
    french = {r["title"]: (r["kind"], r["registers"]) for r in wk.entries(read, "French", "fr").collect()}
    assert french == {"go up": ("multiword", "slang: chose"), "up": ("word", "slang: chose")}
    langs = {(r["title"], r["lang"]) for r in wk.sections(read).collect()}
    assert ("go up", "French") in langs and ("go up", "English") in langs and not any(t in ("empty", "x y", "Talk:x y") for t, _ in langs)


def test_counters_and_editors(spark):
    rows = [("a", 0, 1, 1, "x [[y]]", None, "2003-05-01 00:00:00", "kim", False), ("b", 0, 2, 2, "é", None, "2003-06-01 00:00:00", "1.2.3.4", True), ("c", 0, 3, 3, "", None, None, None, None), ("d", 0, 4, 4, None, "a", "2004-01-01 00:00:00", "kim", False), ("e", 10, 5, 5, "t", None, "2005-01-01 00:00:00", "kim", False), ("f", 0, 6, 6, "z", None, "2009-01-01 00:00:00", "kim", False)]
    pages = spark.createDataFrame(rows, "title string, ns int, page_id long, revision_id long, text string, redirect string, edited string, editor string, anonymous boolean").withColumn("edited", F.to_timestamp("edited"))
    counters = wk.dump_counters(pages)
    got = {(r["kind"], r["key"]): (r["pages"], r["redirects"], r["linked"], r["anonymous"], r["size"]) for r in counters.collect()}
    assert got == {
        ("namespace", "0"): (5, 1, 1, 1, 10), ("namespace", "10"): (1, 0, 0, 0, 1), ("year", "2003"): (2, 0, 1, 1, 9), ("year", "2009"): (1, 0, 0, 0, 1), ("year", None): (1, 0, 0, 0, 0),
        ("editor", "kim"): (2, 0, 1, 0, 8), ("editor", "1.2.3.4"): (1, 0, 0, 1, 2), ("editor", None): (1, 0, 0, 0, 0),
    }
    assert [(r["place"], r["editor"], r["pages"]) for r in wk.top_editors(counters, 5).orderBy("place").collect()] == [(1, "kim", 2), (2, "1.2.3.4", 1)]
