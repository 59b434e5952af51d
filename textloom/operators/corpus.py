"""Corpus jobs: sentences, tokens, dictionaries, collocations, duplicates and gates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import content_key, death_years, normal_text, personal_token, words
from textloom.operators.products import shared_best
from textloom.operators.sequences import interval_union
from textloom.plans.materialize import materialize


def sentences(docs: DataFrame, least: int = 3, most: int = 60) -> DataFrame:
    """``(doc_id, n, sentence)``: paragraphs cut at closing punctuation, of ``least`` to ``most`` words, numbered."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para", "line"))
    cut = lines.select("doc_id", "para", F.posexplode(F.regexp_extract_all("line", F.lit(r"[^.!?]+[.!?]*"), 0)).alias("at", "sentence")).withColumn("sentence", F.trim("sentence"))
    full = cut.where(F.size(F.split("sentence", " +")).between(least, most))
    w = Window.partitionBy("doc_id").orderBy("para", "at")
    return full.select("doc_id", F.row_number().over(w).cast("long").alias("n"), "sentence")


TOKEN = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|[^\p{L}\p{N} \n]"


def tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, i, token, kind)``: words with inner hyphens or apostrophes, numbers, and single marks."""
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("i", "token"))
    kind = F.when(F.col("token").rlike(r"^\p{N}+$"), "number").when(F.col("token").rlike(r"^[\p{L}\p{N}]"), "word").otherwise("mark")
    return cut.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "token", kind.alias("kind"))


#: What is cut off a word as a token of its own, with the apostrophe.
CLITICS = ("n't", "'s", "'m", "'re", "'ve", "'ll", "'d")
_CLITIC = r"(?i)(\p{L})(n't|'(?:s|m|re|ve|ll|d))\b"
_CUT = r"(\x01(?:[nN]'[tT]|'[a-zA-Z]+)|[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s\x01])(\s*)"


def token_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, i, token, kind, space_after)``: words with inner hyphens and apostrophes, the clitics at their ends, numbers
    and single marks, numbered from 1; ``space_after`` tells whether white space follows, so that the text can be put
    together again but for the kind of space. A null text has no tokens."""
    marked = F.regexp_replace("text", _CLITIC, "$1\x01$2")
    both = F.arrays_zip(F.regexp_extract_all(marked, F.lit(_CUT), 1).alias("t"), F.regexp_extract_all(marked, F.lit(_CUT), 2).alias("s"))
    cut = docs.select(key, F.posexplode(both).alias("i", "x")).select(key, (F.col("i") + 1).cast("long").alias("i"), F.col("x.t").alias("t"), (F.col("x.s") != "").alias("space_after"))
    t = F.col("t")
    kind = F.when(t.startswith("\x01"), "clitic").when(t.rlike(r"^\p{N}+$"), "number").when(t.rlike(r"^[\p{L}\p{N}]"), "word").otherwise("mark")
    return cut.select(key, "i", F.translate("t", "\x01", "").alias("token"), kind.alias("kind"), "space_after")


OPEN_CLASSES = ("NOUN", "VERB", "ADJ", "ADV")
_LEMMA = r"^\p{L}+(?:['-]\p{L}+)*$"


def dictionary_layer(units: DataFrame, base: DataFrame, top: int, companions: int = 5, examples: int = 3) -> DataFrame:
    """``units(id, doc, class, text, words array<struct<form, lemma, upos>>)`` to a dictionary of the ``top`` content lemmas:
    ``(lemma, uses, docs, pos, classes, companions, examples, meaning)``.

    Counted are nouns, verbs, adjectives and adverbs, by lower-case lemmas of two letters and more, with hyphens and
    apostrophes inside; the most used come first, then those of most documents, then by the lemma. ``pos``: parts of speech
    with their shares in percent; ``classes``: how many documents of each class have the lemma; ``companions``: the lemmas
    that share most units with it, a unit counted once; ``examples``: texts of 20 to 220 characters, one of each document
    before a second of any; ``meaning`` from ``base(lemma, meaning)``. Only the chosen lemmas are followed beyond their
    counts, and of companions and examples tasks keep the first few before they meet.
    """
    w = units.select("id", "doc", "class", F.explode("words").alias("w")).select("id", "doc", "class", F.lower("w.lemma").alias("lemma"), F.col("w.upos").alias("upos"))
    w = materialize(w.where(F.col("upos").isin(*OPEN_CLASSES) & F.col("lemma").rlike(_LEMMA) & (F.length("lemma") >= 2)), "dictionary-words")
    per_doc = w.groupBy("lemma", "doc", "class").agg(F.count("*").alias("n"))
    sizes = per_doc.groupBy("lemma", "doc").agg(F.sum("n").alias("n")).groupBy("lemma").agg(F.sum("n").alias("uses"), F.count("*").alias("docs"))
    chosen = materialize(sizes.orderBy(F.desc("uses"), F.desc("docs"), "lemma").limit(top), "dictionary-lemmas")
    mine = lambda df: df.join(chosen.select("lemma"), "lemma", "left_semi")
    listed = lambda df, order, say, name: df.groupBy("lemma").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, say.alias("say")))), lambda x: x["say"]), ", ").alias(name))

    parts = mine(w).groupBy("lemma", "upos").agg(F.count("*").alias("n")).join(chosen.select("lemma", "uses"), "lemma")
    parts = listed(parts.withColumn("down", -F.col("n")), ["down", "upos"], F.format_string("%s %.1f", "upos", F.round(100.0 * F.col("n") / F.col("uses"), 1)), "pos")
    classes = mine(per_doc).groupBy("lemma", "class").agg(F.count("*").alias("n"))
    classes = listed(classes.withColumn("down", -F.col("n")), ["down", "class"], F.format_string("%s %d", "class", "n"), "classes")

    in_unit = w.select("id", "lemma").distinct()
    pairs = mine(in_unit).join(in_unit.withColumnRenamed("lemma", "other"), "id").where("lemma <> other").groupBy("lemma", "other").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lemma")
    near = pairs.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "other"))).where(F.col("r") <= companions)
    near = listed(near, ["r"], F.col("other"), "companions")

    short = units.where(F.length("text").between(20, 220)).select("id", "text")
    seen = mine(w.select("id", "doc", "lemma").distinct()).join(short.select("id"), "id", "left_semi")
    in_doc = seen.withColumn("in_doc", F.row_number().over(Window.partitionBy("lemma", "doc").orderBy("id"))).where(F.col("in_doc") <= examples)
    picked = in_doc.withColumn("r", F.row_number().over(by.orderBy("in_doc", "doc", "id"))).where(F.col("r") <= examples).join(short, "id")
    picked = picked.groupBy("lemma").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("examples"))

    out = chosen
    for part in (parts, classes, near, picked, base.groupBy("lemma").agg(F.min("meaning").alias("meaning"))):
        out = out.join(part, "lemma", "left")
    return out.withColumns({"companions": F.coalesce("companions", F.lit("")), "examples": F.coalesce("examples", F.array().cast("array<string>"))})


def chunks(docs: DataFrame, most: int = 25, least: int = 3) -> DataFrame:
    """Sentences cut at ``most`` words; pieces under ``least`` words go."""
    cut = sentences(docs, 1, (1 << 31) - 1).select("doc_id", "n", F.split("sentence", " +").alias("w"))
    pieces = cut.select("doc_id", "n", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / most).cast("int"))).alias("k"))
    part = F.slice("w", F.col("k") * most + 1, F.lit(most))
    return pieces.select("doc_id", "n", F.col("k").cast("long").alias("k"), F.array_join(part, " ").alias("chunk"), F.size(part).cast("long").alias("words")).where(F.col("words") >= least)


#: Tags, then notes in brackets of up to 60 characters, are cut out.
_TAG, _NOTE = r"<[^<>]*>", r"\([^()]{0,60}\)|\[[^\[\]]{0,60}\]|\{[^{}]{0,60}\}"


def clean_text(text: Column) -> Column:
    """A text without tags, entities of spaces, and short notes in brackets, on one line with single spaces."""
    plain = F.regexp_replace(F.regexp_replace(text, _TAG, " "), "&nbsp;|&thinsp;", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("&amp;"), F.lit("&")), _NOTE, ""), r"[ \t\r\n]+", " "))


def clean_chunks(docs: DataFrame, most: int = 25, least: int = 3) -> DataFrame:
    """``(doc_id, k, chunk, words)``: cleaned texts cut after a word that ends in . : ? ! ; and after ``most`` words at the
    latest, numbered from 1; pieces with fewer than ``least`` words that have a letter are left out."""
    piece = rf"(?:[^ ]+ ){{0,{most - 1}}}?[^ ]*[.:?!;](?: |$)|(?:[^ ]+(?: |$)){{1,{most}}}"
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all(clean_text(F.col("text")), F.lit(piece), 0)).alias("k", "chunk"))
    n = F.size(F.regexp_extract_all("chunk", F.lit(r"[^ ]*\p{L}[^ ]*"), 0)).cast("long")
    return cut.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), F.trim("chunk").alias("chunk"), n.alias("words")).where(F.col("words") >= least)


def book_sentences(books: DataFrame, least: int = 3, most: int = 60, shortest: int = 20) -> DataFrame:
    """``books(doc_id, text)`` to ``(id, doc_id, n, sentence)`` with ids ``doc_id:n``: what stands between the lines
    ``*** START OF`` and ``*** END OF`` (the whole text where a marker is missing), in paragraphs between blank lines,
    with lines of CR LF as others. Paragraphs under ``shortest`` characters, or with more capitals than half of them,
    are left out; sentences end in . ! ? and have ``least`` to ``most`` words."""
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\*\*\* END OF.*$", ""), r"(?s)^.*?\*\*\* START OF[^\n]*\n", "")
    para = books.select("doc_id", F.posexplode(F.split(body, "\n\n")).alias("p", "para")).withColumn("para", F.trim(F.regexp_replace("para", r"[ \t\r\n]+", " ")))
    capitals = F.length(F.regexp_replace("para", r"[^\p{Lu}]", ""))
    para = para.where((F.length("para") >= shortest) & (2 * capitals <= F.length("para")))
    cut = para.select("doc_id", "p", F.posexplode(F.regexp_extract_all("para", F.lit(r"[^.!?]+[.!?]*"), 0)).alias("k", "sentence")).withColumn("sentence", F.trim("sentence"))
    kept = cut.where(F.size(F.split("sentence", " ")).between(least, most))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("p", "k")).cast("long")
    return kept.select("doc_id", n.alias("n"), "sentence").select(F.concat_ws(":", "doc_id", "n").alias("id"), "doc_id", "n", "sentence")


def register_lexicon(left: DataFrame, right: DataFrame, prior: float = 1000.0, least: int = 5, z_least: float = 2.0) -> DataFrame:
    """Words of ``left(word, n)`` against ``right``: log odds with an informative Dirichlet prior, and their z."""
    both = left.withColumnRenamed("n", "ya").join(right.withColumnRenamed("n", "yb"), "word", "full_outer").fillna(0, ["ya", "yb"])
    totals = F.broadcast(both.agg(F.sum("ya").alias("na"), F.sum("yb").alias("nb")))
    c = F.col
    alpha = prior * (c("ya") + c("yb")) / (c("na") + c("nb"))
    odds = lambda y, n: F.ln((y + alpha) / (n + prior - y - alpha))
    z = (odds(c("ya"), c("na")) - odds(c("yb"), c("nb"))) / F.sqrt(1 / (c("ya") + alpha) + 1 / (c("yb") + alpha))
    return both.join(totals).withColumn("z", z).where((c("z") >= z_least) & (c("ya") >= least)).select("word", "ya", "yb", "z")


def collocations(pairs: DataFrame, least: int = 3, least_docs: int = 2) -> DataFrame:
    """``(doc_id, a, b)`` pairs to pointwise mutual information with counts and documents, from the marginals."""
    per_doc = pairs.groupBy("a", "b", "doc_id").agg(F.count("*").alias("n"))
    cells = materialize(per_doc.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "pairs")  # read four times
    one, two = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = F.broadcast(cells.agg(F.sum("n").alias("total")))
    kept = cells.where((F.col("n") >= least) & (F.col("docs") >= least_docs)).join(one, "a").join(two, "b").join(total)
    return kept.select("a", "b", "n", "docs", F.log2(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("pmi"))


#: Verbs that carry little meaning of their own beside a noun.
LIGHT_VERBS = ("make", "take", "give", "have", "do", "pay", "get", "put")


def merge_entries(layers: Sequence[DataFrame], ranks: Sequence[str] = ("idiom", "verb-phrase", "phrase")) -> DataFrame:
    """Dictionary layers ``(a, b, title, kind)`` to one entry a pair with its layer, from 1: an idiom of any layer comes before
    other kinds, then the earlier layer, then the kind that stands first in ``ranks``, then the title."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ranks)), F.lit(len(ranks)))
    every = None
    for i, layer in enumerate(layers, 1):
        one = layer.select("a", "b", F.struct((F.col("kind") != ranks[0]).alias("plain"), F.lit(i).alias("layer"), rank.alias("rank"), "title", "kind").alias("e"))
        every = one if every is None else every.union(one)
    return every.groupBy("a", "b").agg(F.min("e").alias("e")).select("a", "b", "e.title", "e.kind", "e.layer")


def collocation_kinds(pairs: DataFrame, entries: DataFrame, odd: DataFrame, light: Sequence[str] = LIGHT_VERBS, floor: int = 3, least: int = 5, least_docs: int = 2, odd_pmi: float = 3.0, free_pmi: float = 5.0) -> DataFrame:
    """``pairs(doc_id, a, b)`` to ``(a, b, kind, n, docs, pmi, title)``: the pairs that are more than their words.

    A pair needs ``floor`` uses, and ``least`` uses in ``least_docs`` documents unless ``entries(a, b, title, kind)`` knows
    it. ``odd(a, b, score)`` tells pairs that make little sense taken word by word (2 and more). kind: idiom if the entry
    says so, or if the pair is odd with a pmi of ``odd_pmi``; light-verb for one of ``light`` with an odd or known pair;
    collocation for other known pairs, and for unknown ones that aren't odd from ``free_pmi`` on. Others are left out.
    """
    cells = collocations(pairs, floor, 1).join(entries.select("a", "b", "title", F.col("kind").alias("known")), ["a", "b"], "left").join(odd.select("a", "b", "score"), ["a", "b"], "left")
    known, is_odd, is_light = F.col("known").isNotNull(), F.coalesce(F.col("score") >= 2, F.lit(False)), F.col("a").isin(*light)
    kind = (
        F.when(F.col("known") == "idiom", "idiom")
        .when(is_light & (is_odd | known), "light-verb")
        .when(is_odd & ~is_light & (F.col("pmi") >= odd_pmi), "idiom")
        .when(known | (~is_odd & (F.col("pmi") >= free_pmi)), "collocation")
    )
    kept = cells.where(known | ((F.col("n") >= least) & (F.col("docs") >= least_docs))).withColumn("kind", kind)
    return kept.where("kind is not null").select("a", "b", "kind", "n", "docs", "pmi", "title")


def select_catalogue(works: DataFrame, groups: Sequence[tuple[str, Sequence[str]]], excluded: dict[str, Sequence[str]], max_died: int, held: DataFrame) -> DataFrame:
    """``works(id, subjects, authors, ...)`` to ``(id, grp, died)``: those of the first group with a keyword in the subjects
    and none of the group's ``excluded`` words, all of whose authors died by ``max_died``, and that aren't in ``held(id)``.
    ``died`` is the last year. Works with an undated author are left out."""
    hay = F.lower(F.coalesce("subjects", F.lit("")))
    has = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(hay, w)) if words else F.lit(False)
    group = F.coalesce(*(F.when(has(words), F.lit(name)) for name, words in groups))
    out = works.select("id", group.alias("grp"), death_years(F.col("authors")).alias("years"), hay.alias("hay")).where("grp is not null and years is not null")
    for name, words in excluded.items():
        out = out.where(~((F.col("grp") == name) & F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains("hay", w))))
    out = out.select("id", "grp", F.array_max("years").alias("died")).where(F.col("died") <= max_died)
    return out.join(held.select("id"), "id", "left_anti")


def redact_lexicon(lemmas: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lemmas(number, lemma, flag)`` with personal ones as ``<redacted-N>`` under their numbers, and ``forms(form, number,
    ...)`` without personal forms and without forms of such lemmas. Once more changes nothing."""
    gone = personal_token(F.col("lemma"))
    clean = lemmas.withColumns({"lemma": F.when(gone, F.format_string("<redacted-%d>", "number")).otherwise(F.col("lemma")), "flag": F.when(gone, "-").otherwise(F.col("flag"))})
    # Redacted before counts too, so that forms may come later than the lemmas were cleaned.
    out = lemmas.where(gone | F.col("lemma").rlike("^<redacted-[0-9]+>$")).select("number")
    return clean, forms.where(~personal_token(F.col("form"))).join(out, "number", "left_anti").select(forms.columns)


def dedup_by_content(docs: DataFrame) -> DataFrame:
    """One row for each content key, the smallest doc_id, with the number of copies."""
    return docs.groupBy(content_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def without_held_out(train: DataFrame, held: DataFrame, text: str = "sentence") -> DataFrame:
    """Rows whose text, with white space and case normalised, isn't one of the held-out texts."""
    key = lambda df, c: F.xxhash64(normal_text(df[c]))
    known = held.select(key(held, text).alias("__key"), normal_text(held[text]).alias("__text")).distinct()
    kept = train.withColumns({"__key": key(train, text), "__text": normal_text(train[text])})
    return kept.join(known, ["__key", "__text"], "left_anti").drop("__key", "__text")


def shared_runs(docs: DataFrame, sources: DataFrame, n: int = 6) -> DataFrame:
    """``(doc_id, item_id, longest)``: the longest run of words of a document that stands in a source as it is.

    Word n-grams meet by equi-join; runs are islands of equal differences between the places. Shorter runs than ``n``
    words aren't seen.
    """

    def grams(df: DataFrame, key: str, at: str) -> DataFrame:
        w = df.select(key, words(F.col("text"), "[\\p{L}\\p{N}]+").alias("w")).where(F.size("w") >= n)
        each = w.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias(at))
        return each.select(key, at, F.array_join(F.slice("w", F.col(at) + 1, F.lit(n)), " ").alias("gram"))

    met = grams(docs, "doc_id", "p").join(grams(sources, "item_id", "q"), "gram")
    w = Window.partitionBy("doc_id", "item_id", "d").orderBy("p")
    marked = met.select("doc_id", "item_id", "p", (F.col("p") - F.col("q")).alias("d")).withColumn("island", F.col("p") - F.row_number().over(w))
    runs = marked.groupBy("doc_id", "item_id", "d", "island").agg((F.count("*") + n - 1).alias("length"))
    return runs.groupBy("doc_id", "item_id").agg(F.max("length").alias("longest"))


def _digests(w: list[str], n: int) -> list[bytes]:
    return [md5(" ".join(w[p : p + n]).encode()).digest() for p in range(len(w) - n + 1)]


def _winnowed(w: list[str], n: int, window: int) -> Iterator[tuple[int, bytes]]:
    h, last = _digests(w, n), -1
    for s in range(max(len(h) - window + 1, min(len(h), 1))):
        p = min(range(s, min(s + window, len(h))), key=h.__getitem__)
        if p != last:
            yield p, h[p]
        last = p


def _placed(df: DataFrame, key: str, cut: Callable[[list[str]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """``(key, p, h)`` for what ``cut`` makes of the words of each row of ``df(key, w)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                keys, rows = [], []
                for k, w in zip(b.column(0)[at : at + 100].to_pylist(), b.column(1)[at : at + 100].to_pylist(), strict=True):
                    found = list(cut(w))
                    rows += found
                    keys += [k] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.types[0]), pa.array([p for p, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.binary())], [key, "p", "h"])

    return df.select(key, "w").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, p long, h binary")


def word_grams(df: DataFrame, key: str, n: int) -> DataFrame:
    """``(key, p, h)``: the runs of ``n`` words of ``df(key, w)`` by place (from 0) and digest."""
    return _placed(df, key, lambda w: enumerate(_digests(w, n)))


def winnowed(df: DataFrame, key: str, n: int = 3, window: int = 4) -> DataFrame:
    """Fingerprints ``(key, p, h)`` of ``df(key, w)``: of each ``window`` consecutive n-grams the least digest and its place
    (from 0), the first of equals. Two texts that share ``n + window - 1`` words in a row share a fingerprint."""
    return _placed(df, key, lambda w: _winnowed(w, n, window))


def originality(docs: DataFrame, sources: DataFrame, run: int = 13, shingle: int = 6, least: int = 24, share: int = 20, span: int = 24, near: int = 60, few: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` against ``sources(item_id, text)``: ``(doc_id, words, exact, covered, near, state)``.

    ``exact``: places at which ``run`` words stand in a source as they are. ``covered``: words inside the union of all
    shared runs of ``shingle`` words. ``near``: places from which on, for ``span`` words, ``near`` percent of the text's
    fingerprints, and ``few`` at least, are those of one source, so that a copy with a word changed now and then is
    seen. A text is blocked by an exact run, by a near window, or by ``least`` covered words that are ``share`` percent
    of it; pending if less is covered or if it has no words to check; else clear. doc_ids are unique.

    Texts meet sources on digests that are asked for once each (semi-joins), so that a phrase of many sources makes no
    pairs; a source is told apart only for fingerprints in windows that all sources together make near.
    """
    said = lambda df, key: df.select(key, words(F.col("text"), r"[\p{L}\p{N}]+").alias("w"))
    texts, known = materialize(said(docs, "doc_id"), "gate-texts"), said(sources, "item_id")
    kinds = lambda n: word_grams(known, "item_id", n).select("h").distinct()

    hits = materialize(word_grams(texts, "doc_id", shingle).join(kinds(shingle), "h", "left_semi").select("doc_id", "p"), "gate-hits")
    cover = interval_union(hits.select("doc_id", "p", (F.col("p") + shingle).alias("q")), ["doc_id"], "p", "q").groupBy("doc_id").agg(F.sum("length").alias("covered"))
    # A run holds run - shingle + 1 shingles one after the other.
    w = Window.partitionBy("doc_id").orderBy("p")
    starts = hits.withColumn("to", F.lead("p", run - shingle).over(w)).where(F.col("to") - F.col("p") == run - shingle)
    long = starts.groupBy("doc_id").agg(F.collect_list("p").alias("ps")).join(texts, "doc_id")
    long = long.select("doc_id", F.explode("ps").alias("p"), "w").select("doc_id", F.unhex(F.md5(F.array_join(F.slice("w", F.col("p") + 1, F.lit(run)), " ").cast("binary"))).alias("h"))
    exact = long.join(kinds(run), "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("exact"))

    mine, theirs = winnowed(texts, "doc_id"), materialize(winnowed(known, "item_id").select("h", "item_id").distinct(), "gate-prints")
    met = mine.join(theirs.select("h", F.lit(1).alias("known")).distinct(), "h", "left")
    ahead = Window.partitionBy("doc_id").orderBy("p").rangeBetween(0, span - 1)
    near_enough = lambda n: (n >= few) & (100 * n >= near * F.col("all"))
    counted = met.select("doc_id", "h", "p", "known", F.count("*").over(ahead).alias("all"), F.count("known").over(ahead).alias("n"))
    opens = F.when(F.col("known").isNotNull() & near_enough(F.col("n")), F.col("p"))
    inside = F.max(opens).over(Window.partitionBy("doc_id").orderBy("p").rangeBetween(-(span - 1), 0))
    maybe = counted.withColumn("inside", inside).where("known is not null and inside is not null").select("doc_id", "h", "p", "all")
    by_item = maybe.join(theirs, "h").withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "item_id").orderBy("p").rangeBetween(0, span - 1)))
    windows = by_item.where(near_enough(F.col("n"))).select("doc_id", "p").distinct().groupBy("doc_id").agg(F.count("*").alias("near"))

    out = texts.select("doc_id", F.size("w").cast("long").alias("words"))
    for part in (exact, cover, windows):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0, ["exact", "covered", "near"])
    much = (F.col("covered") >= least) & (100 * F.col("covered") >= share * F.col("words"))
    state = F.when((F.col("exact") > 0) | (F.col("near") > 0) | much, "blocked").when((F.col("covered") > 0) | (F.col("words") == 0), "pending").otherwise("clear")
    return out.withColumns({"covered": F.col("covered").cast("long"), "state": state})


def near_duplicate_words(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """``(doc_id, class_id, links)``: texts of equal word sets are one class, known by its smallest doc_id; ``links`` is how
    many other classes, of four words or more each, reach a Jaccard of ``share`` with it. Texts without a word are left out.

    Words become numbers in order from rare to frequent. A pair that reaches the share has one of the first
    n - ceil(share * n) + 1 words of each side in common, so only those are joined, with ids, sizes and places: from the
    first word in common on, enough words must be left on both sides. The whole sets of the few pairs left decide.
    """
    sets = docs.select("doc_id", F.array_sort(F.array_distinct(words(F.col("text"), "\\p{L}{3,}"))).alias("w")).where("size(w) > 0")
    keyed = materialize(sets.select("doc_id", F.md5(F.array_join("w", " ")).alias("key"), "w"), "word-sets")
    classes = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    each = keyed.where("size(w) >= 4").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("w").alias("word"))
    # Written in order, so that a word's number tells its rank and stays the same.
    ranked = each.groupBy("word").agg(F.count("*").alias("df")).orderBy("df", "word").select("word", F.monotonically_increasing_id().alias("v"))
    reps = each.join(materialize(ranked, "word-ranks"), "word").groupBy("doc_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    reps = materialize(reps.withColumn("n", F.size("v")), "ranked-sets")
    # The smaller set of a pair needs fewer first words: the larger one makes the number that they must share larger.
    short = F.col("n") - F.ceil(F.col("n") * (2 * share / (1 + share)) - 1e-9) + 1
    first = reps.select("doc_id", "n", short.alias("short"), F.posexplode(F.slice("v", F.lit(1), (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int"))).alias("at", "word"))
    side = lambda df, x: df.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), (F.col("n") - F.col("at")).alias(f"left_{x}"), "word")
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    enough = F.least("left_a", "left_b") >= share / (1 + share) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = side(first, "a").join(side(first.where("at < short"), "b"), "word").where(larger & (F.col("nb") >= F.col("na") * share - 1e-9) & enough).select("a", "b").distinct()
    one, two = (reps.select(F.col("doc_id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    both = F.size(F.array_intersect("va", "vb"))
    linked = pairs.join(one, "a").join(two, "b").where(both >= share * (F.size("va") + F.size("vb") - both)).select("a", "b")
    links = linked.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    placed = keyed.select("doc_id", "key").join(classes, "key")
    return placed.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def ability_table(uses: DataFrame, least: int = 2, top: int = 6) -> DataFrame:
    """``uses(relation, head, action)`` to ``(name, n, words)``: an action with the heads that it is a top action of.

    A (relation, action, head) counts from ``least`` times on; a head keeps its ``top`` most frequent actions (the least
    of equals), and an action stays with ``least`` heads. ``words`` are the heads in order.
    """
    counted = uses.dropna().groupBy("relation", "action", "head").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("relation", "head").orderBy(F.desc("n"), "action")
    best = counted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    per = best.groupBy("relation", "action").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("head")), " ").alias("words"))
    return per.where(F.col("n") >= least).select(F.concat_ws("_", "relation", "action").alias("name"), "n", "words")


def companions(units: DataFrame, top: int = 5) -> DataFrame:
    """``(doc_id, word)`` to the words that share most units with each word, ``top`` of them."""
    best = shared_best(units.select(F.col("word").alias("a"), F.col("doc_id").alias("f")).distinct().withColumn("v", F.lit(1.0)), top)
    w = Window.partitionBy("word").orderBy(F.desc("n"), "other")
    pairs = best.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("s").cast("long").alias("n"))
    return pairs.withColumn("r", F.row_number().over(w).cast("long"))


def page_licence(html: Column) -> Column:
    """The licence a page states: a rel=license link, a Creative Commons link, a meta tag, or reserved rights."""
    link = F.nullif(F.regexp_extract(html, r'rel="license"[^>]*href="([^"]*)"', 1), F.lit(""))
    cc = F.nullif(F.regexp_extract(html, r'(https?://creativecommons\.org/[^"\' <>]*)', 1), F.lit(""))
    meta = F.nullif(F.regexp_extract(html, r'<meta name="license" content="([^"]*)"', 1), F.lit(""))
    return F.coalesce(link, cc, meta, F.when(F.lower(html).contains("all rights reserved"), "all rights reserved"))
