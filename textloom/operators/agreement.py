"""Agreement and evaluation between annotations of the same tokens, labels of the same items, and sets of spans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two annotations ``(sid, i, form, head, rel, tag)`` side by side, columns of the second with ``_b``."""
    other = b.select("sid", "i", *(F.col(c).alias(f"{c}_b") for c in ("form", "head", "rel", "tag")))
    return a.join(other, ["sid", "i"])


def compare_annotators(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sentence of equal forms: words, different heads or relations, different tags."""
    both = pair_annotations(a, b)
    per = both.groupBy("sid").agg(
        F.count("*").alias("words"), F.count_if((F.col("head") != F.col("head_b")) | (F.col("rel") != F.col("rel_b"))).alias("tree_diff"), F.count_if(F.col("tag") != F.col("tag_b")).alias("tag_diff"), F.bool_and(F.col("form") == F.col("form_b")).alias("same_forms")
    )
    return per.where("same_forms").drop("same_forms")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sentence and ``origin`` of the second annotation ``(sid, origin, i, form, head, rel, tag)``, where all forms are
    equal: words, different heads or relations, different tags, and what differs in the tree in order of the words."""
    other = b.select("sid", "i", "origin", *(F.col(c).alias(f"{c}_b") for c in ("form", "head", "rel", "tag")))
    both = a.join(other, ["sid", "i"])
    tree = ~F.col("head").eqNullSafe(F.col("head_b")) | (F.col("rel") != F.col("rel_b"))
    said = F.format_string("%s %d:%s→%d:%s", "form", "head", "rel", "head_b", "rel_b")
    listed = F.array_sort(F.collect_list(F.when(tree, F.struct("i", said.alias("said")))))
    per = both.groupBy("sid", "origin").agg(F.count("*").alias("words"), F.count_if(tree).alias("tree_diff"), F.count_if(F.col("tag") != F.col("tag_b")).alias("tag_diff"), F.bool_and(F.col("form") == F.col("form_b")).alias("same"), F.array_join(F.transform(listed, lambda x: x["said"]), "; ").alias("tree"))
    return per.where("same").drop("same")


def agreement_by_origin(per: DataFrame) -> DataFrame:
    """``compared`` by origin: pairs, pairs that differ in anything, and the share of words with equal trees and tags, in
    percent with one decimal."""
    share = lambda c: F.round(100.0 * F.sum(F.col("words") - F.col(c)) / F.sum("words"), 1)
    return per.groupBy("origin").agg(F.count("*").alias("pairs"), F.count_if((F.col("tree_diff") > 0) | (F.col("tag_diff") > 0)).alias("disagree"), share("tree_diff").alias("las"), share("tag_diff").alias("tags"))


def largest_differences(per: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` pairs of ``compared`` whose trees differ most, shorter sentences first among equals, then by id."""
    top = per.where("tree_diff > 0").orderBy(F.desc("tree_diff"), "words", "sid", "origin").limit(k)
    return top.select("sid", "origin", "words", "tree_diff", F.left("tree", F.lit(80)).alias("tree"))


def judge_trees(sentences: DataFrame, tokens: DataFrame, witness: DataFrame, least: float = 0.6) -> DataFrame:
    """``(sid, why)`` of the sentences ``(sid)`` to refuse, by ``tokens(sid, i, head, tag)``: ``no_words``; ``roots`` if not
    exactly one word is the root; ``head_outside`` if a head is no word of the sentence, and then no more is asked;
    ``witness`` if fewer than ``least`` of the words that aren't punctuation have the head of ``witness(sid, i, head)``,
    where that has as many words."""
    w = witness.select("sid", "i", F.col("head").alias("seen"))
    sizes = witness.groupBy("sid").agg(F.count("*").alias("w_n"))
    told = tokens.join(w, ["sid", "i"], "left").groupBy("sid").agg(
        F.count("*").alias("n"), F.count_if(F.col("head") == 0).alias("roots"), F.max("head").alias("most"), F.count_if(F.col("tag") != "PUNCT").alias("asked"), F.count_if((F.col("tag") != "PUNCT") & (F.col("head") == F.col("seen"))).alias("agreed")
    )
    per = sentences.select("sid").join(told, "sid", "left").join(sizes, "sid", "left")
    empty, outside = F.col("n").isNull(), F.col("most") > F.col("n")
    low = ~outside & (F.col("w_n") == F.col("n")) & (F.col("asked") > 0) & (F.col("agreed") < least * F.col("asked"))
    why = F.concat_ws(" ", F.when(empty, "no_words"), F.when(F.col("roots") != 1, "roots"), F.when(outside, "head_outside"), F.when(low, "witness"))
    return per.select("sid", why.alias("why")).where("why <> ''")


def compare_tallies(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two tallies ``(layer, class, items, bits)`` side by side: items and bits of each, and by how much they changed."""
    sides = [df.select("layer", "class", *(F.when(F.lit(k == at), F.col(c)).otherwise(0).alias(f"{c}_{name}") for at, name in enumerate(("before", "after")) for c in ("items", "bits"))) for k, df in enumerate((before, after))]
    wide = sides[0].unionByName(sides[1]).groupBy("layer", "class").agg(*(F.sum(f"{c}_{n}").alias(f"{c}_{n}") for n in ("before", "after") for c in ("items", "bits")))
    return wide.withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("items", "bits")})


def parser_agreement(votes: DataFrame) -> DataFrame:
    """``votes(file, sid, i, parser, head, rel, tag)`` to ``(file, a, b, words, uas, las)``: for each file and two parsers the
    share of words, punctuation left out, with equal heads, and with equal heads and relations, in percent."""
    words = votes.where("tag <> 'PUNCT'").groupBy("file", "sid", "i").agg(F.array_sort(F.collect_list(F.struct("parser", "head", "rel"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["parser"] > x["parser"]), lambda y: F.struct(x["parser"].alias("a"), y["parser"].alias("b"), x["head"].eqNullSafe(y["head"]).alias("h"), (x["head"].eqNullSafe(y["head"]) & x["rel"].eqNullSafe(y["rel"])).alias("r")))))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2)
    return words.select("file", F.explode(pairs).alias("p")).groupBy("file", "p.a", "p.b").agg(F.count("*").alias("words"), share("p.h").alias("uas"), share("p.r").alias("las"))


def suspects(votes: DataFrame, reference: DataFrame, least: float = 0.75) -> DataFrame:
    """Words of ``reference(sid, i, head)`` whose head ``least`` of the voters at least don't give:
    ``(sid, i, head, voters, against, best, votes)`` with the head that most of them give, the least of equals."""
    given = votes.groupBy("sid", "i", F.col("head").alias("given")).agg(F.count("*").alias("n"))
    per = given.join(reference.select("sid", "i", "head"), ["sid", "i"]).groupBy("sid", "i").agg(
        F.first("head").alias("head"), F.sum("n").alias("voters"), F.sum(F.when(~F.col("given").eqNullSafe(F.col("head")), F.col("n")).otherwise(0)).alias("against"),
        F.max_by(F.struct("given", "n"), F.struct("n", -F.col("given"))).alias("top"),
    )
    return per.where(F.col("against") >= least * F.col("voters")).select("sid", "i", "head", "voters", "against", F.col("top.given").alias("best"), F.col("top.n").alias("votes"))


def agree_labels(base: DataFrame, one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """``base(id, label)`` and two witnesses ``(id, label, p)`` to ``(id, label, new, rule)``.

    The label changes only if both witnesses give the same other one and both are sure of it (``p`` of ``least`` or more):
    ``changed``. Else it stays: ``confirmed`` if both give it, ``unsure`` if they agree on another one but not both are sure,
    ``split`` if they give different ones, ``alone`` if a witness says nothing.
    """
    a, b = (w.select("id", F.col("label").alias(f"l{k}"), F.col("p").alias(f"p{k}")) for k, w in ((1, one), (2, two)))
    met = base.select("id", "label").join(a, "id", "left").join(b, "id", "left")
    same, sure = F.col("l1") == F.col("l2"), (F.col("p1") >= least) & (F.col("p2") >= least)
    rule = F.when(F.col("l1").isNull() | F.col("l2").isNull(), "alone").when(~same, "split").when(F.col("l1").eqNullSafe(F.col("label")), "confirmed").when(sure, "changed").otherwise("unsure")
    return met.select("id", "label", F.when(rule == "changed", F.col("l1")).otherwise(F.col("label")).alias("new"), rule.alias("rule"))


def label_moves(agreed: DataFrame) -> DataFrame:
    """``agree_labels`` by rule and move: ``(rule, label, new, n)``."""
    return agreed.groupBy("rule", "label", "new").agg(F.count("*").alias("n"))


def scores(a: DataFrame, b: DataFrame, content: Sequence[str]) -> DataFrame:
    """Tags, UAS, LAS and CLAS (content relations only) of ``b`` against ``a``, in percent."""
    both = pair_annotations(a, b)
    head = F.col("head") == F.col("head_b")
    full = head & (F.col("rel") == F.col("rel_b"))
    gold, system = F.col("rel").isin(*content), F.col("rel_b").isin(*content)
    pct = lambda n, m: F.round(100.0 * n / m, 4)
    return both.agg(
        pct(F.count_if(F.col("tag") == F.col("tag_b")), F.count("*")).alias("tags"), pct(F.count_if(head), F.count("*")).alias("uas"), pct(F.count_if(full), F.count("*")).alias("las"), pct(2 * F.count_if(full & gold & system), F.count_if(gold) + F.count_if(system)).alias("clas")
    )


def full_scores(a: DataFrame, b: DataFrame, content: Sequence[str], functional: Sequence[str]) -> DataFrame:
    """All scores of ``b`` against ``a`` in percent: tags, features, lemmas, UAS, LAS, and over content words CLAS, MLAS and BLEX.

    Both have ``(sid, i, head, rel, tag, xpos, feats, lemma)``. MLAS also wants the functional words below a word to agree.
    """
    base = lambda df: df.withColumn("rel", F.substring_index("rel", ":", 1))
    a, b = base(a), base(b)
    fields = ["head", "rel", "tag", "xpos", "feats", "lemma"]
    below = lambda df, name: df.where(F.col("rel").isin(*functional)).groupBy("sid", F.col("head").alias("i")).agg(F.array_sort(F.collect_list(F.struct("rel", "tag", "feats"))).alias(name))
    both = a.select("sid", "i", *fields).join(b.select("sid", "i", *(F.col(c).alias(f"{c}_b") for c in fields)), ["sid", "i"])
    both = both.join(below(a, "kids"), ["sid", "i"], "left").join(below(b, "kids_b"), ["sid", "i"], "left")
    same = {c: F.col(c) == F.col(f"{c}_b") for c in fields}
    las, gold, system = same["head"] & same["rel"], F.col("rel").isin(*content), F.col("rel_b").isin(*content)
    pct = lambda hit: F.round(100.0 * F.count_if(hit) / F.count("*"), 4)
    f1 = lambda hit: F.round(200.0 * F.count_if(las & gold & hit) / (F.count_if(gold) + F.count_if(system)), 4)
    return both.agg(
        F.count("*").alias("words"), pct(same["tag"]).alias("upos"), pct(same["xpos"]).alias("xpos"), pct(same["feats"]).alias("ufeats"), pct(same["tag"] & same["xpos"] & same["feats"]).alias("alltags"), pct(same["lemma"]).alias("lemmas"),
        pct(same["head"]).alias("uas"), pct(las).alias("las"), f1(F.lit(True)).alias("clas"), f1(same["tag"] & same["feats"] & F.col("kids").eqNullSafe(F.col("kids_b"))).alias("mlas"), f1(same["lemma"]).alias("blex"),
    )


def match_spans(system: DataFrame, gold: DataFrame, verbs: DataFrame) -> DataFrame:
    """``(right, wrong, gold)`` of groups of words ``(sid, ord, members)``: a group is right if it shares two words, a verb
    ``(sid, i)`` among them, with a gold group that no earlier one took. Groups go in order; a sentence is one step."""
    parts = lambda df, name: df.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "members"))), lambda x: x["members"]).alias(name))
    sentences = parts(system, "s").join(parts(gold, "g"), "sid", "full_outer").join(verbs.groupBy("sid").agg(F.collect_set("i").alias("v")), "sid", "left")

    def judge(batches):
        import pandas as pd

        for rows in batches:
            right = wrong = held = 0
            for s, g, v in zip(rows["s"], rows["g"], rows["v"], strict=True):
                verbs_, left = set(v) if v is not None else set(), [set(x) for x in g] if g is not None else []
                held += len(left)
                for own in s if s is not None else ():
                    hit = next((k for k, x in enumerate(left) if len(x & {*own}) >= 2 and x & {*own} & verbs_), None)
                    right, wrong = right + (hit is not None), wrong + (hit is None)
                    if hit is not None:
                        left[hit] = set()
            yield pd.DataFrame({"right": [right], "wrong": [wrong], "gold": [held]})

    found = sentences.select("s", "g", "v").mapInPandas(judge, "right long, wrong long, gold long")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("right", "wrong", "gold")))


def tree_judge(tokens: DataFrame) -> DataFrame:
    """Sentences with something wrong: not one root, or a head outside."""
    per = tokens.groupBy("sid").agg(F.count("*").alias("n"), F.count_if(F.col("head") == 0).alias("roots"), F.max("head").alias("most"), F.min("head").alias("least"))
    why = F.when(F.col("roots") != 1, "roots").when((F.col("most") > F.col("n")) | (F.col("least") < 0), "outside")
    return per.select("sid", "n", "roots", why.alias("why")).where("why is not null")


def weighted_vote(votes: DataFrame, item: str, value: str, weight: str) -> DataFrame:
    """The value of the greatest summed weight for each item, the least value of equals."""
    total = votes.groupBy(item, value).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(item).orderBy(F.desc("weight"), value)
    return total.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def class_report(pairs: DataFrame, gold: str, system: str, classes: Sequence[str]) -> DataFrame:
    """The confusion matrix, a row for each gold class, with its accuracy."""
    wide = pairs.groupBy(gold).pivot(system, list(classes)).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(c) for c in classes), F.lit(0))
    right = F.coalesce(*(F.when(F.col(gold) == c, F.col(c)) for c in classes), F.lit(0))
    return wide.withColumn("accuracy", F.round(right / total, 4))


def span_f1(gold: DataFrame, system: DataFrame, key: Sequence[str]) -> DataFrame:
    """Multiset overlap of labelled spans: matched, gold, system, F1."""
    counts = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    both = counts(gold, "g").join(counts(system, "s"), list(key), "full_outer").fillna(0, ["g", "s"])
    return both.agg(F.sum(F.least("g", "s")).alias("matched"), F.sum("g").alias("gold"), F.sum("s").alias("system")).withColumn("f1", F.round(2.0 * F.col("matched") / (F.col("gold") + F.col("system")), 6))


def precision_recall(gold: DataFrame, system: DataFrame, key: str) -> DataFrame:
    """Items in gold, in system and in both."""
    both = gold.select(key, F.lit(1).alias("g")).distinct().join(system.select(key, F.lit(1).alias("s")).distinct(), key, "full_outer")
    hit = F.sum(F.col("g") * F.col("s"))
    return both.agg(F.coalesce(hit, F.lit(0)).alias("hit"), F.sum("g").alias("gold"), F.sum("s").alias("system")).select("hit", F.round(F.col("hit") / F.col("system"), 6).alias("precision"), F.round(F.col("hit") / F.col("gold"), 6).alias("recall"))


def poisson_weight(*of: str | Column) -> Column:
    """A Poisson number of mean 1, drawn from a hash (the chance of more than 8 is 1e-6)."""
    u = F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)
    weight, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        weight = weight + (u >= total).cast("int")
        p /= k
    return weight


def shifted(gold: DataFrame, items: DataFrame, key: str, places: int) -> DataFrame:
    """Control for rules: the gold of the item ``places`` later (``items`` are numbered from 0 on, in a ring)."""
    size = F.broadcast(items.agg(F.count("*").alias("__size")))
    return gold.join(size).withColumn(key, F.pmod(F.col(key) - places, "__size")).drop("__size")


def paired_bootstrap(differences: DataFrame, item: str, value: str, replicates: int, salt: int = 1) -> DataFrame:
    """Mean and 95 per cent interval of a mean difference over resampled items.

    Every item has a Poisson weight in each replicate, drawn from a hash of both, so a replicate is one sum.
    """
    each = differences.select(item, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    weight = poisson_weight(item, "rep", F.lit(salt))
    per = each.select("rep", value, weight.alias("w")).groupBy("rep").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))
    ranked = per.withColumn("r", F.row_number().over(Window.orderBy("mean")) - 1)  # one row a replicate
    low, high = int(0.025 * replicates), -(-975 * replicates // 1000) - 1
    return ranked.agg(F.avg("mean").alias("mean"), F.max(F.when(F.col("r") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("mean"))).alias("high"))


def tally(rows: DataFrame, group: str, right: Column, known: Column) -> DataFrame:
    """Right, unknown and wrong for each group and in all."""
    state = F.when(~known, "unknown").when(right, "correct").otherwise("wrong")
    return rows.withColumn("__s", state).rollup(group).agg(*(F.count_if(F.col("__s") == s).alias(s) for s in ("correct", "unknown", "wrong")))


def agree_trees(base: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Edits that two witnesses agree on against a base tree, the first rule that holds for each token.

    Rules in order: both say the root is here, the same other head, the same other relation under the same head, the
    same other tag.
    """
    said = lambda df, n: df.select("sid", "i", *(F.col(c).alias(f"{c}{n}") for c in ("head", "rel", "tag")))
    all_three = base.join(said(one, 1), ["sid", "i"]).join(said(two, 2), ["sid", "i"])
    both = lambda c: (F.col(f"{c}1") == F.col(f"{c}2")) & (F.col(f"{c}1") != F.col(c))
    rule = F.when(both("head") & (F.col("head1") == 0), "root").when(both("head"), "head").when(both("rel") & (F.col("head1") == F.col("head2")), "relation").when(both("tag"), "tag")
    return all_three.select("sid", "i", rule.alias("rule"), F.when(rule.isin("root", "head"), F.col("head1").cast("string")).when(rule == "relation", F.col("rel1")).otherwise(F.col("tag1")).alias("value")).where("rule is not null")


def coref_scores(mentions: DataFrame) -> DataFrame:
    """MUC and B-cubed recall and precision over ``mentions(doc, mention, gold, system)``, from overlap counts."""
    cells = mentions.groupBy("doc", "gold", "system").agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy("doc", c).agg(F.sum("n").alias("size"), F.count("*").alias("parts"))
    gold, system = side("gold"), side("system")
    muc = lambda df: F.sum(F.col("size") - F.col("parts")) / F.nullif(F.sum(F.col("size") - 1), F.lit(0))
    b3 = lambda df, c: cells.join(df, ["doc", c]).agg((F.sum(F.col("n") ** 2 / F.col("size")) / F.sum("n")).alias("v"))
    parts = [gold.agg(muc(gold).alias("muc_recall")), system.agg(muc(system).alias("muc_precision")), b3(gold, "gold").withColumnRenamed("v", "b3_recall"), b3(system, "system").withColumnRenamed("v", "b3_precision")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def select_candidate(gains: DataFrame, replicates: int = 200) -> DataFrame:
    """Candidates ``(candidate, item, held, gain)`` with mean gains on both parts and a bootstrap share at or below 0;
    ``chosen`` marks the best on the open part of those with a held-out gain of 0 or more and a share under 0.05."""
    weight = poisson_weight("item", "rep")
    open_part = gains.where("not held")
    means = gains.groupBy("candidate").agg(F.avg(F.when(~F.col("held"), F.col("gain"))).alias("dev"), F.avg(F.when(F.col("held"), F.col("gain"))).alias("held_gain"))
    per = open_part.groupBy("candidate", "item").agg(F.sum("gain").alias("gain"))
    sums = per.select("candidate", "gain", "item", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).groupBy("candidate", "rep").agg(F.sum(weight * F.col("gain")).alias("s"))
    p = sums.groupBy("candidate").agg(F.avg((F.col("s") <= 0).cast("int")).alias("p"))
    scored = means.join(p, "candidate")
    fits = (F.col("dev") > 0) & (F.col("held_gain") >= 0) & (F.col("p") < 0.05)
    best = scored.agg(F.min_by("candidate", F.when(fits, F.struct(-F.col("dev"), F.col("candidate")))).alias("best"))
    return scored.join(F.broadcast(best)).select("candidate", "dev", "held_gain", "p", F.coalesce(F.col("candidate") == F.col("best"), F.lit(False)).alias("chosen"))


def best_assignment(gain: np.ndarray) -> float:
    """The greatest sum of entries of which no two share a row or column (shortest augmenting paths over potentials)."""
    cost = -(gain if gain.shape[0] <= gain.shape[1] else gain.T)
    rows, columns = cost.shape
    u, v, row_of = np.zeros(rows + 1), np.zeros(columns + 1), np.zeros(columns + 1, int)
    for r in range(1, rows + 1):
        row_of[0], j = r, 0
        least, seen, back = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool), np.zeros(columns + 1, int)
        while row_of[j]:
            seen[j] = True
            i = row_of[j]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j
            free = np.flatnonzero(~seen[1:]) + 1
            to = free[np.argmin(least[free])]
            step = least[to]
            u[row_of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = to
        while j:
            row_of[j] = row_of[back[j]]
            j = back[j]
    return float(sum(-cost[row_of[j] - 1, j - 1] for j in range(1, columns + 1) if row_of[j]))


def ceaf_e(mentions: DataFrame) -> DataFrame:
    """CEAF-e of ``mentions(doc, gold, system)``: ``(recall, precision)``, entities of a document matched one to one for the
    greatest sum of 2 * common / (size + size). A mention without an entity on one side counts for the other alone."""
    sizes = lambda c: mentions.where(F.col(c).isNotNull()).groupBy("doc", c).agg(F.count("*").alias(f"n_{c}"))
    gold, system = sizes("gold"), sizes("system")
    cells = mentions.dropna().groupBy("doc", "gold", "system").agg(F.count("*").alias("both")).join(gold, ["doc", "gold"]).join(system, ["doc", "system"])
    per = cells.groupBy("doc").agg(F.collect_list(F.struct(F.col("gold").cast("string").alias("g"), F.col("system").cast("string").alias("s"), (2 * F.col("both") / (F.col("n_gold") + F.col("n_system"))).alias("phi"))).alias("cells"))

    def match(batches):
        for b in batches:
            out = []
            for row in b["cells"]:
                g, s = (sorted({c[k] for c in row}) for k in "gs")
                gain = np.zeros((len(g), len(s)))
                for c in row:
                    gain[g.index(c["g"]), s.index(c["s"])] = c["phi"]
                out.append(best_assignment(gain))
            yield b[["doc"]].assign(phi=out)

    total = per.select("doc", "cells").mapInPandas(match, f"doc {dict(mentions.dtypes)['doc']}, phi double").agg(F.coalesce(F.sum("phi"), F.lit(0.0)).alias("phi"))
    counts = gold.agg(F.count("*").alias("g")).join(system.agg(F.count("*").alias("s")))  # one row each
    return total.join(counts).select((F.col("phi") / F.nullif(F.col("g"), F.lit(0))).alias("recall"), (F.col("phi") / F.nullif(F.col("s"), F.lit(0))).alias("precision"))
