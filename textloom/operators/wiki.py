"""Jobs over a wiki dump: counters of a dump, sections by language, templates, and dictionary entries with labels."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Headings that are parts of speech.
PARTS = ("Noun", "Proper noun", "Verb", "Adjective", "Adverb", "Pronoun", "Preposition", "Conjunction", "Interjection", "Numeral", "Phrase", "Prepositional phrase", "Proverb", "Idiom")
#: Labels that tell a register, and those that tell a region by the region's name.
REGISTERS = ("slang", "informal", "colloquial", "formal", "literary", "poetic", "humorous", "derogatory", "vulgar", "dated", "archaic", "obsolete", "euphemistic")
REGIONS = {"uk": "British", "british": "British", "us": "American", "american": "American", "australia": "Australian", "ireland": "Irish", "scotland": "Scottish", "canada": "Canadian"}
#: Templates that label a sense, and templates that show their last value as text.
LABELS, SHOWN = ("lb", "lbl", "label"), ("l", "link", "m", "mention", "w", "gloss", "non-gloss", "n-g", "q", "qualifier")


def dump_counters(pages: DataFrame) -> DataFrame:
    """``(kind, key, pages, redirects, linked, anonymous, size)``: counters of all pages by ``namespace``, and of the
    articles (namespace 0, no redirect) by ``year`` of the last edit and by ``editor``.

    One pass fills all: a page is a row for each counter that it belongs to, counted before anything is shuffled.
    ``linked`` pages have a link; ``size`` is in bytes. What a page doesn't say counts under a null key.
    """
    article = (F.col("ns") == 0) & F.col("redirect").isNull()
    told = F.array(F.struct(F.lit("namespace").alias("kind"), F.col("ns").cast("string").alias("key")))
    more = F.array(F.struct(F.lit("year").alias("kind"), F.year("edited").cast("string").alias("key")), F.struct(F.lit("editor").alias("kind"), F.col("editor").alias("key")))
    text = F.coalesce("text", F.lit(""))
    rows = pages.select(F.explode(F.when(article, F.concat(told, more)).otherwise(told)).alias("c"), F.col("redirect").isNotNull().alias("r"), F.contains(text, F.lit("[[")).alias("l"), F.coalesce("anonymous", F.lit(False)).alias("a"), F.octet_length(text).cast("long").alias("n"))
    return rows.groupBy("c.kind", "c.key").agg(F.count("*").alias("pages"), F.count_if("r").alias("redirects"), F.count_if("l").alias("linked"), F.count_if("a").alias("anonymous"), F.sum("n").alias("size"))


def top_editors(counters: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` editors of most articles with their place, the first name of equals."""
    top = counters.where("kind = 'editor' and key is not null").orderBy(F.desc("pages"), "key").limit(k)  # k rows
    return top.select(F.row_number().over(Window.orderBy(F.desc("pages"), "key")).alias("place"), F.col("key").alias("editor"), "pages", F.col("anonymous") > 0)


_HEAD = r"(?m)^==[ \t]*([^=\n][^\n]*?)[ \t]*==[ \t]*$"


def sections(pages: DataFrame) -> DataFrame:
    """``(page_id, revision_id, title, lang, body)``: the parts of articles under each heading of the second level."""
    articles = pages.where("ns = 0 and redirect is null and text is not null")
    heads = F.regexp_extract_all("text", F.lit(_HEAD), 1)
    bodies = F.split("text", _HEAD)
    both = F.transform(heads, lambda h, i: F.struct(h.alias("lang"), F.get(bodies, i + 1).alias("body")))
    return articles.select("page_id", "revision_id", "title", F.explode(both).alias("s")).select("page_id", "revision_id", "title", "s.lang", "s.body")


def parse_templates(text: str) -> list[tuple[str, list[str], int, int, int]]:
    """All templates of a text, inner ones too, in order of their ends: (name, values, start, end, depth). A value keeps
    the templates in it as they stand; what is opened and not closed is no template."""
    found, stack = [], []
    for m in re.finditer(r"\{\{|\}\}|\||\[\[|\]\]", text):
        mark, at = m[0], m.start()
        if mark in ("{{", "[["):
            stack.append((mark, at, []))
        elif mark == "|" and stack and stack[-1][0] == "{{":
            stack[-1][2].append(at)
        elif mark in ("}}", "]]"):
            open_ = "{{" if mark == "}}" else "[["
            while stack and stack[-1][0] != open_ and any(s[0] == open_ for s in stack):
                stack.pop()  # opened inside and not closed
            if stack and stack[-1][0] == open_:
                _, start, bars = stack.pop()
                if open_ == "{{":
                    cuts = [start + 1, *bars, at]
                    parts = [text[a + 1 : b].strip() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    found.append((parts[0], parts[1:], start, at + 2, len([s for s in stack if s[0] == "{{"])))
    return found


def plain_text(line: str) -> str:
    """A line without markup: templates that show a value leave it, others go; links leave what they show."""
    while True:
        inner = [t for t in parse_templates(line) if "{{" not in line[t[2] + 2 : t[3] - 2]]
        if not inner:
            break
        for name, values, start, end, _ in sorted(inner, key=lambda t: -t[2]):
            shown = [v for v in values if not re.match(r"\w+=", v)]
            line = line[:start] + (shown[-1] if shown and name.lower() in SHOWN else "") + line[end:]
    line = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", line)
    return re.sub(r"\s+", " ", re.sub(r"''+|<[^>]*>", "", line)).strip()


def template_counts(parts: DataFrame) -> DataFrame:
    """``sections`` to ``(lang, template, n, pages)``: templates by language, nested ones too, names in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(page, lang, name.lower()) for page, lang, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for name, *_ in parse_templates(body or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["page_id", "lang", "template"])

    used = parts.select("page_id", "lang", "body").mapInArrow(run, "page_id long, lang string, template string")
    per_page = used.groupBy("lang", "template", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("lang", "template").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


def _entry(title: str, body: str, code: str, parts: Sequence[str], registers: Sequence[str], regions: Mapping[str, str]) -> tuple | None:
    multi = " " in title or sum(p.isalpha() for p in title.split("-")) >= 2
    pos, gloss, idiom, told = None, None, False, ({}, {})
    for line in map(str.strip, body.split("\n")):
        if line.startswith("==="):
            head = line.strip("=").strip()
            pos = pos or (head if head in parts else None)
        labels = [v.lower() for name, values, *_ in parse_templates(line) if name.lower() in LABELS and values[:1] == [code] for v in values[1:]]
        idiom |= "idiomatic" in labels
        if pos and line.startswith("# "):
            said = plain_text(line[2:])
            said = said if len(said) <= 160 else said[:160] + "…"
            gloss = said if gloss is None else gloss
            for label in labels:
                if label in registers:
                    told[0].setdefault(label, said)
                if label in regions:
                    told[1].setdefault(regions[label], said)
    low = body.lower()
    idiom |= bool(re.search(r"\[\[category:[^\]]* idioms|\{\{c\|" + code + r"\|idioms", low))
    if pos is None or ":" in title or len(title) > 60 or not (multi or any(told)):
        return None
    if not multi:
        kind = "word"
    elif pos == "Proverb":
        kind = "proverb"
    elif pos == "Verb" and "phrasal verb" in low:
        kind = "phrasal-verb"
    elif idiom or pos == "Idiom":
        kind = "idiom"
    else:
        kind = {"Verb": "verb-phrase", "Phrase": "phrase"}.get(pos, "multiword")
    return (kind, pos, gloss or "", *("; ".join(f"{k}: {v.replace(';', ',')}" for k, v in t.items()) for t in told))


def entries(pages: DataFrame, language: str = "English", code: str = "en", parts: Sequence[str] = PARTS, registers: Sequence[str] = REGISTERS, regions: Mapping[str, str] = REGIONS) -> DataFrame:
    """``(title, kind, pos, gloss, registers, regions, page_id, revision_id)``: the entries of one language.

    The first part of speech counts. A register or region comes with the first sense that is so labelled. Words of one
    part are entries only if a sense has a label; those of more are proverbs, phrasal verbs, idioms, verb phrases, phrases
    or others. Titles with a colon or of over 60 characters are left out. The last two columns tell where it came from.
    """
    schema = "title string, kind string, pos string, gloss string, registers string, regions string, page_id long, revision_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for title, body, page, revision in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                found = _entry(title or "", body or "", code, parts, registers, regions)
                if found:
                    rows.append((title, *found, page, revision))
            kinds = (*[pa.string()] * 6, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    return sections(pages).where(F.col("lang") == language).select("title", "body", "page_id", "revision_id").mapInArrow(run, schema)
