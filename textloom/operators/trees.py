"""Trees agreed by witnesses: a word of a base tree changes only by a written rule, and the edit names its rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize

#: The rules in order of priority.
RULES = ("R1-cc-next", "R2-punct-next", "R3-conj-first", "R4-particle", "R5-strong", "R6-punct-agree", "R7-rel-agree", "R8-pos-agree")
#: Relations that no rule overrides.
FROZEN = ("flat", "flat:foreign", "fixed", "goeswith", "reparandum")
#: The universal relations; subtypes of a language are added by its users.
UNIVERSAL = (
    "acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc", "ccomp", "clf", "compound", "conj", "cop", "csubj", "dep", "det", "discourse", "dislocated", "expl",
    "fixed", "flat", "goeswith", "iobj", "list", "mark", "nmod", "nsubj", "nummod", "obj", "obl", "orphan", "parataxis", "punct", "reparandum", "root", "vocative", "xcomp",
)
_KEY = ["sid", "i"]


def relation_base(rel: Column) -> Column:
    """A relation without its subtype."""
    return F.substring_index(rel, ":", 1)


def most_frequent(rows: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each key the most frequent values (the least of equally frequent ones), of rows without nulls."""
    counts = rows.dropna(subset=[*key, *values]).groupBy(*key, *values).agg(F.count("*").alias("n"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), *values)).alias("best"))
    return best.select(*key, *(F.col(f"best.{v}").alias(v) for v in values))


def next_conjunct(tokens: DataFrame) -> DataFrame:
    """``(sid, i, following)`` of the words ``(sid, i, head, rel)`` that depend on an earlier word: the first later
    conjunct of that word's coordination, conjuncts of its conjuncts included.

    Conjuncts and the words above them over conjuncts are found by doubling: a round joins what is known with itself, so
    there are as many rounds as the logarithm of the longest chain, and a cycle ends when nothing new comes.
    """
    above = materialize(tokens.where("rel = 'conj' and head > 0").select("sid", F.col("i").alias("conj"), F.col("head").alias("above")).distinct(), "conjuncts")
    known = above.count()
    while True:
        over = above.select("sid", F.col("conj").alias("above"), F.col("above").alias("far"))
        above = materialize(above.union(above.join(over, ["sid", "above"]).select("sid", "conj", F.col("far").alias("above"))).distinct(), "conjuncts")
        before, known = known, above.count()
        if known == before:
            break
    asked = tokens.where("(rel = 'cc' or rel = 'punct') and head > 0 and head < i").select("sid", "i", F.col("head").alias("above"))
    return asked.join(above, ["sid", "above"]).where("conj > i").groupBy(*_KEY).agg(F.min("conj").alias("following"))


def _parents(tokens: DataFrame, *values: str) -> DataFrame:
    """Values of each token's head, as ``parent_<value>``."""
    return tokens.select("sid", F.col("i").alias("head"), *(F.col(v).alias(f"parent_{v}") for v in values))


def agreed_edits(base: DataFrame, one: DataFrame, two: DataFrame, third: DataFrame | None = None, relations: Sequence[str] = UNIVERSAL) -> DataFrame:
    """Edits ``(sid, i, rule, head, rel, upos, tag, feats, lemma)`` of a base tree, one a word at most.

    ``base(sid, i, form, lemma, upos, tag, feats, head, rel)`` and two witnesses ``(sid, i, upos, tag, head, rel)`` hold
    the same words; ``third(sid, i, head, rel)``, if given, sees trees by other rules, so a ``pobj`` is lifted to the head
    of its preposition. A word takes the edit of the first rule whose case it is:

    R1 a ``cc`` on an earlier word goes to the next conjunct of that word, R2 so does a comma or semicolon, if one witness
    has that head; R3 a conjunct of a conjunct goes to the first one, if both have that head; R4 a ``compound`` adposition,
    particle or adverb after its verb is ``compound:prt``; R5 both witnesses and the third have another head, and the
    relation is the one both give; R6 both give a punctuation mark another head; R7 under an undisputed head both give
    another relation; R8 both give other tags, which the base uses elsewhere. R8 comes with a word's other edit, or alone
    if both keep the relation but for its subtype. A moved word keeps its subtype; a conjunct with its own ``cc`` stays
    one; foreign words and the frozen relations stay. ``upos`` to ``lemma`` are null where a word keeps its tags.

    Words that a witness lacks, and words without a head or relation, get no edit. Every step is a join or grouping
    inside a sentence.
    """
    said = lambda df, n: df.select(*_KEY, *(F.col(c).alias(f"{c}{n}") for c in ("head", "rel", "upos", "tag")))
    words = base.join(said(one, 1), _KEY).join(said(two, 2), _KEY)
    words = words.join(_parents(base, "head", "rel", "upos"), ["sid", "head"], "left").join(next_conjunct(base), _KEY, "left")
    own = base.where(relation_base(F.col("rel")) == "cc").select("sid", F.col("head").alias("i"), F.lit(True).alias("has_cc")).distinct()
    words = words.join(own, _KEY, "left")
    if third is None:
        words = words.withColumn("head3", F.lit(None).cast("long"))
    else:
        lifted = third.join(_parents(third, "head"), ["sid", "head"], "left")
        words = words.join(lifted.select(*_KEY, F.when((F.col("rel") == "pobj") & (F.col("head") > 0), F.col("parent_head")).otherwise(F.col("head")).alias("head3")), _KEY, "left")
    for_form = most_frequent(base, ["form", "upos", "tag"], ["feats", "lemma"])
    for_tags = most_frequent(base, ["upos", "tag"], ["feats"])
    new = [F.col("upos").alias("upos1"), F.col("tag").alias("tag1")]
    words = words.join(for_form.select("form", *new, F.col("feats").alias("feats_form"), F.col("lemma").alias("lemma_form")), ["form", "upos1", "tag1"], "left")
    words = words.join(for_tags.select(*new, F.col("feats").alias("feats_tags")), ["upos1", "tag1"], "left")

    c = F.col
    known = lambda rel: F.when(rel.isin(*relations), rel).when(relation_base(rel).isin(*relations), relation_base(rel))
    r1, r2 = known(c("rel1")), known(c("rel2"))
    both = F.when(r1 == r2, r1).when(relation_base(r1) == relation_base(r2), relation_base(r1))
    words = words.withColumns({"both": both, "kept": (relation_base(r1) == relation_base(c("rel"))) & (relation_base(r2) == relation_base(c("rel")))})
    left = (c("head") > 0) & (c("head") < c("i"))
    picked = (c("head1") == c("following")) | (c("head2") == c("following"))
    same_head = c("head1") == c("head2")
    moved = same_head & (c("head1") != c("head"))
    stays_conj = (c("rel") == "conj") & c("has_cc").isNotNull()
    target = F.when(c("head1") == 0, "root").when(relation_base(c("both")) == relation_base(c("rel")), c("rel")).otherwise(c("both"))
    strong = (c("both") != "dep") & ~(stays_conj & (relation_base(c("both")) != "conj")) & ((c("head1") == 0) == (target == "root"))
    renamed = (relation_base(c("both")) != relation_base(c("rel"))) & ~c("both").isin("dep", "root", "punct") & ~stays_conj
    # The case of a rule, whether it then makes an edit, and the new head and relation.
    cases = [
        ((c("rel") == "cc") & left, picked, c("following"), F.lit("cc")),
        ((c("rel") == "punct") & c("form").isin(",", ";") & left & picked, F.lit(True), c("following"), F.lit("punct")),
        ((c("rel") == "conj") & (c("parent_rel") == "conj") & (c("parent_head") > 0) & same_head & (c("head1") == c("parent_head")), F.lit(True), c("parent_head"), F.lit("conj")),
        ((c("rel") == "compound") & c("upos").isin("ADP", "PART", "ADV") & left & (c("parent_upos") == "VERB"), F.lit(True), c("head"), F.lit("compound:prt")),
        ((c("rel") != "punct") & moved & (c("head3") == c("head1")), strong, c("head1"), target),
        ((c("rel") == "punct") & moved & (c("head1") > 0) & (c("rel1") == "punct") & (c("rel2") == "punct"), F.lit(True), c("head1"), F.lit("punct")),
        ((c("head") > 0) & (c("head1") == c("head")) & (c("head2") == c("head")) & (c("rel") != "punct"), renamed, c("head"), c("both")),
    ]
    chain = None
    for name, (case, holds, head, rel) in zip(RULES, cases, strict=False):
        edit = F.when(holds, F.struct(F.lit(name).alias("rule"), head.cast("long").alias("head"), rel.alias("rel")))
        chain = F.when(case, edit) if chain is None else chain.when(case, edit)
    retag = (c("upos1") == c("upos2")) & (c("tag1") == c("tag2")) & ~(c("upos1").eqNullSafe(c("upos")) & c("tag1").eqNullSafe(c("tag"))) & c("feats_tags").isNotNull()
    alone = F.struct(F.lit(RULES[7]).alias("rule"), c("head").cast("long").alias("head"), c("rel").alias("rel"))
    free = ~c("upos").eqNullSafe("X") & ~c("rel").isin(*FROZEN)
    retag = F.coalesce(retag, F.lit(False))
    edit = F.coalesce(chain, F.when(retag & c("kept"), alone))
    # Exploded, not filtered: a filter on the chain would be copied into the joins below, with all that it is made of.
    found = words.where(free).select("*", retag.alias("retag"), F.explode(F.array_compact(F.array(edit))).alias("edit"))
    if_new = lambda v, n: F.when(c("retag"), v).alias(n)
    return found.select(
        *_KEY, "edit.rule", "edit.head", "edit.rel", if_new(c("upos1"), "upos"), if_new(c("tag1"), "tag"), if_new(F.coalesce("feats_form", "feats_tags"), "feats"), if_new(F.coalesce("lemma_form", "lemma"), "lemma")
    )


def rule_counts(edits: DataFrame) -> DataFrame:
    """``(rule, edits, retagged)`` of each rule that made an edit."""
    return edits.groupBy("rule").agg(F.count("*").alias("edits"), F.count("upos").alias("retagged"))


def match_mentions(gold: DataFrame, system: DataFrame, key: Sequence[str]) -> DataFrame:
    """System mentions matched one to one to gold mentions ``(*key, mention, first, last)`` (places, both included):
    ``(*key, system, gold, exact)``.

    Mentions of equal spans come first, in order of their numbers. Of the others of a key, the pair with the most common
    places goes first, then the least system and gold number. A pair that is the best of both its mentions is one that
    this order takes before any other pair of theirs, so rounds take all such pairs at once until none is left; every
    round takes at least the best pair of each key. Overlaps are counted by places that both cover, with no pairs of
    mentions that don't touch. Empty tables give an empty result; a mention without a place is matched with nothing.
    """
    key = list(key)
    span = [*key, "first", "last"]
    ranked = lambda df, name: df.select(*span, F.col("mention").alias(name)).withColumn("rank", F.row_number().over(Window.partitionBy(*span).orderBy(name)))
    exact = ranked(system, "system").join(ranked(gold, "gold"), [*span, "rank"]).select(*key, "system", "gold")
    exact = materialize(exact, "mentions-exact")
    places = lambda df, name: df.select(*key, F.col("mention").alias(name), F.explode(F.sequence("first", "last")).alias("place")).join(exact.select(*key, name), [*key, name], "left_anti")
    pairs = places(system, "system").join(places(gold, "gold"), [*key, "place"]).groupBy(*key, "system", "gold").agg(F.count("*").alias("common"))
    pairs, taken = materialize(pairs, "mentions-pairs"), exact.withColumn("exact", F.lit(True))
    while not pairs.isEmpty():
        best = lambda name: F.min(F.struct((-F.col("common")).alias("less"), "system", "gold")).over(Window.partitionBy(*key, name))
        marked = pairs.withColumns({"by_system": best("system"), "by_gold": best("gold")})
        now = materialize(marked.where("by_system = by_gold and by_system.system = system and by_system.gold = gold").select(*key, "system", "gold"), "mentions-taken")
        taken = taken.union(now.withColumn("exact", F.lit(False)))
        pairs = materialize(pairs.join(now.select(*key, "system"), [*key, "system"], "left_anti").join(now.select(*key, "gold"), [*key, "gold"], "left_anti"), "mentions-pairs")
    return taken


def matched_entities(gold: DataFrame, system: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mentions ``(doc, mention, gold, system)`` for coreference scores, from mentions with an ``entity`` each: a matched
    pair is one mention of both sides, an unmatched mention has no entity on the other."""
    key = list(key)
    pairs = match_mentions(gold.drop("entity"), system.drop("entity"), key).select(*key, "system", "gold")
    one = system.select(*key, F.col("mention").alias("system"), F.col("entity").alias("s"))
    two = gold.select(*key, F.col("mention").alias("gold"), F.col("entity").alias("g"))
    rows = one.join(pairs, [*key, "system"], "left").join(two, [*key, "gold"], "full")
    return rows.select(*key, F.coalesce("gold", F.lit(-1) - F.col("system")).alias("mention"), F.col("g").alias("gold"), F.col("s").alias("system"))
