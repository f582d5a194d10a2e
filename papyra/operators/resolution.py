"""Resolving mentions to canonical entities: exact, alias, longer person name, fuzzy, new.

The cascade is a chain of equi-joins on (category, key), each on what the one
before left over. Every document sees the registry as it was at the start. Within
a document a canonical made for one group is a candidate for the groups after it;
only person names and fuzzy matches can profit, so just those leftovers are folded
in order of first mention, one document and category at a time. For a registry
that grows over documents, resolve them in batches and apply `registered`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import fixed as X
from papyra.functions import names as N
from papyra.functions.text import collapse, words
from papyra.operators import rules
from papyra.plans.durable import checkpointed

DOC = "document_id"
DETAILS = "preferred_name string, comparison_key string, strategy string, reason string, base_match_type string, rule string, source_name string, document_anchors array<string>"


def new_id(category: Column, name: Column) -> Column:
    """The id of a canonical that isn't registered yet: the same name gets the same id anywhere."""
    return F.sha2(F.concat_ws("\u0001", category, name), 256)


def candidates(registry: DataFrame) -> DataFrame:
    """The registry with the features of its names."""
    return N.with_features(registry.select("id", "canonical_name", "category"), "canonical_name")


def alias_index(aliases: DataFrame, registry: DataFrame) -> DataFrame:
    """category, normalized_alias, ids: which canonicals have an alias; aliases of unknown canonicals don't count."""
    return aliases.join(registry.select(F.col("id").alias("canonical_id"), "category"), "canonical_id").groupBy("category", "normalized_alias").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))


def planned(mentions: DataFrame) -> DataFrame:
    """Mentions (document_id, mention_index, text, category) with preferred_name, comparison_key, strategy, confidence, rule, source_name, document_anchors."""
    m = mentions.withColumn("source_name", collapse("text"))
    m = N.with_features(m, "source_name")
    actor = (F.col("category") == "CHAR") & F.col("generic").isNotNull()
    # Plans that use a frame many times start from files, or the plan itself would grow out of hand.
    m = checkpointed(m.withColumn("_actor", F.coalesce(actor, F.lit(False))))
    people = person_aliases(m.where("category = 'CHAR' and not _actor and tokens is not null"))
    m = m.join(people, [DOC, "mention_index"], "left")
    person = F.col("_preferred").isNotNull()
    pick = lambda a, p, s: F.when(F.col("_actor"), a).when(person, p).otherwise(s)
    m = m.withColumn("preferred_name", pick(F.col("generic"), F.col("_preferred"), F.col("source_name")))
    m = m.withColumn("strategy", pick(F.lit("generic_actor"), F.lit("document_person"), F.lit("standard")))
    m = m.withColumn("rule", pick(F.lit("controlled_spanish_singularization"), F.lit("unique_document_name_prefix"), F.lit(None).cast("string")))
    m = m.withColumn("confidence", F.when(person & ~F.col("_actor") & (F.size("tokens") == 1), 95.0).otherwise(100.0))
    m = m.withColumn("source_name", F.when(F.col("_actor") | person, F.col("source_name")))
    key = N.with_features(m.select("preferred_name").distinct(), "preferred_name", "k_").select(F.col("preferred_name").alias("_p"), F.col("k_normalized").alias("comparison_key"))
    return m.join(key, F.col("preferred_name") == F.col("_p")).select(*mentions.columns, "normalized", "preferred_name", "comparison_key", "strategy", "confidence", "rule", "source_name", "document_anchors")


def _prefixes(tokens: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))


def family_head(key: Column) -> Column:
    """A number for a document and the first two words of a name, with which all of a family begin; others may share it."""
    return F.xxhash64(DOC, F.substring_index(key, " ", 2))


def families(forms: DataFrame) -> DataFrame:
    """document_id, key, root, times: the anchors (person names of two or more significant tokens) by family.

    Being a prefix orders the anchors of a document as a forest, so a family is
    named by the shortest anchor that is a prefix, by words of the normal forms. In
    the order of their names all that begin with an anchor follow it, as no character
    of a name sorts before the space: the last anchor of n words is the one to compare
    the first n words with. Only letters whose normal form holds spaces make names of
    more words than MOST_TOKENS; these are compared with all such before them. Forms
    that are dealt out by document and `head` already aren't dealt out again.
    """
    if "head" not in forms.columns:
        forms = forms.withColumn("head", family_head(F.col("normalized")))
    by = ["head", DOC]
    anchors = forms.where(F.col(DOC).isNotNull() & (F.col("significant") >= 2)).groupBy(*by, F.col("normalized").alias("key")).agg(F.count(F.lit(1)).alias("times"))
    anchors = anchors.withColumn("n", F.length("key") - F.length(F.replace("key", F.lit(" "))) + 1)
    before, lengths = Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow), range(2, N.MOST_TOKENS)
    last = [F.last(F.when(F.col("n") == i, F.col("key")), ignorenulls=True).over(before).alias(f"_{i}") for i in lengths]
    found = anchors.select("*", *last, F.collect_list(F.when(F.col("n") >= N.MOST_TOKENS, F.col("key"))).over(before).alias("_more"))
    shorter = [F.when(F.col(f"_{i}") == F.substring_index("key", " ", i), F.col(f"_{i}")) for i in lengths]
    longer = F.get(F.filter("_more", lambda k: F.col("key").startswith(F.concat(k, F.lit(" ")))), F.lit(0))
    return found.select(DOC, "key", F.coalesce(*shorter, longer, "key").alias("root"), "times")


def person_aliases(forms: DataFrame) -> DataFrame:
    """document_id, mention_index, _preferred, document_anchors of mentions that a fuller name of the document stands for."""
    fam = checkpointed(families(forms))
    inside = forms.join(fam.withColumnRenamed("key", "normalized"), [DOC, "normalized"])
    best = Window.partitionBy(DOC, "root").orderBy(F.desc("significant"), F.desc(F.size("tokens")), F.desc("times"), F.desc("accents"), F.desc(F.length("source_name")), "mention_index")
    preferred = inside.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(DOC, "root", F.col("source_name").alias("_preferred"), F.col("tokens").alias("_tokens"))
    texts = forms.groupBy(DOC, "normalized").agg(F.min_by("source_name", "mention_index").alias("t"))
    shown = fam.select(DOC, F.col("key").alias("normalized"), "root").join(texts, [DOC, "normalized"]).groupBy(DOC, "root").agg(F.array_sort(F.collect_set("t")).alias("document_anchors"))
    # Partial names join a family if its preferred name alone begins with them.
    starts = preferred.select(DOC, "root", F.explode(_prefixes("_tokens")).alias("path"))
    partial = forms.join(fam.select(DOC, F.col("key").alias("normalized")), [DOC, "normalized"], "left_anti").withColumn("path", F.array_join("tokens", " "))
    joined = partial.join(starts, [DOC, "path"]).groupBy(DOC, "mention_index", "normalized").agg(F.min("root").alias("root"), F.count_distinct("root").alias("n")).where("n = 1")
    members = checkpointed(inside.select(DOC, "mention_index", "normalized", "root").union(joined.select(DOC, "mention_index", "normalized", "root")))
    varied = members.groupBy(DOC, "root").agg(F.count_distinct("normalized").alias("n")).where("n >= 2").select(DOC, "root")
    return members.join(varied, [DOC, "root"]).join(preferred, [DOC, "root"]).join(shown, [DOC, "root"]).select(DOC, "mention_index", "_preferred", "document_anchors")


def grouped(plans: DataFrame) -> DataFrame:
    """One row for each document, category and key: the representative plan, and when the key is first seen."""
    rank = F.when(F.col("strategy") == "generic_actor", 2).when(F.col("strategy") == "document_person", 1).otherwise(0)
    w = Window.partitionBy(DOC, "category", "comparison_key")
    best = w.orderBy(F.desc(rank), F.desc(F.size(words("preferred_name"))), F.desc(F.length("preferred_name")), "mention_index")
    g = plans.withColumn("_r", F.row_number().over(best)).withColumn("seen", F.min("mention_index").over(w)).where("_r = 1")
    return g.select(DOC, "category", "comparison_key", "preferred_name", "strategy", "seen")


GROUP = [DOC, "category", "comparison_key"]
DECISION = [*GROUP, "canonical_id", "canonical_name", "base_match_type", "score", "second_score", "reason"]


def _decided(df: DataFrame, kind: str, score: float, reason: str) -> DataFrame:
    return df.select(*GROUP, F.col("id").alias("canonical_id"), "canonical_name", F.lit(kind).alias("base_match_type"), F.lit(score).alias("score"), F.lit(None).cast("double").alias("second_score"), F.lit(reason).alias("reason"))


def exact(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Groups whose key is a canonical's normal form; a generic actor needs the same spelling."""
    j = groups.join(known.withColumnRenamed("normalized", "comparison_key").select("comparison_key", "category", "id", "canonical_name", "accents"), ["category", "comparison_key"])
    j = j.where((F.col("strategy") != "generic_actor") | (F.col("canonical_name") == F.col("preferred_name")))
    w = Window.partitionBy(*GROUP).orderBy(*N.best_first(F.col("preferred_name")))
    return _decided(j.withColumn("_r", F.row_number().over(w)).where("_r = 1"), "exact", 100.0, "normalized_exact_name")


def by_alias(groups: DataFrame, index: DataFrame, known: DataFrame) -> DataFrame:
    """Groups whose key is the alias of one canonical; never a single word of CHAR."""
    one = index.where(F.size("ids") == 1).select("category", F.col("normalized_alias").alias("comparison_key"), F.col("ids")[0].alias("id"))
    j = groups.join(one, ["category", "comparison_key"]).where((F.col("category") != "CHAR") | (F.size(words("comparison_key")) != 1))
    return _decided(j.join(known.select("id", "canonical_name"), "id"), "stored_alias", 100.0, "unique_stored_alias")


def longer_names(groups: DataFrame, known: DataFrame) -> DataFrame:
    """For CHAR groups of two or more significant tokens: the distinct longer names (at most two) that begin with them, and the best canonical."""
    asked = N.with_features(groups.where("category = 'CHAR'").select(*GROUP, "preferred_name"), "preferred_name").where("significant >= 2").withColumn("path", F.array_join("tokens", " "))
    # Proper prefixes of the registered names, so that the join is on equality.
    proper = F.slice(_prefixes("tokens"), F.lit(1), F.size("tokens") - 1)
    longer = known.where("category = 'CHAR' and size(tokens) > 1").select("id", "canonical_name", "accents", F.array_join("tokens", " ").alias("whole"), F.explode(proper).alias("path"))
    j = asked.drop("accents").join(longer, "path")
    w = Window.partitionBy(*GROUP).orderBy(*N.best_first(F.col("preferred_name")))
    best = j.withColumn("_r", F.row_number().over(w))
    first = F.max(F.when(F.col("_r") == 1, F.struct("id", "canonical_name")))
    return best.groupBy(*GROUP).agg(F.slice(F.array_sort(F.collect_set("whole")), 1, 2).alias("p_names"), first.alias("p_best"))


def fuzzy_top2(keys: DataFrame, known: DataFrame, pruned: bool = False) -> DataFrame:
    """category, comparison_key, best, best_id, best_name, second: the two most similar canonicals of the category (ties by id).

    Every key meets every canonical of its category. With pruned=True only those
    whose length allows a score within the margin of acceptance are scored:
    decisions stay the same, scores of what is refused may be missing.
    """
    c = known.select("category", "id", "canonical_name", F.col("normalized").alias("_n"))
    j = keys.select("category", "comparison_key").distinct().join(c, "category")
    if pruned:
        least = F.create_map(*(F.lit(x) for k, t in X.THRESHOLDS.items() for x in (k, (t - X.MARGIN) / (200.0 - t + X.MARGIN))))[F.col("category")]
        a, b = F.length("comparison_key"), F.length("_n")
        j = j.where(F.least(a, b) >= least * F.greatest(a, b) - 1e-9)
    j = j.withColumn("s", N.similarity("comparison_key", "_n"))
    w = Window.partitionBy("category", "comparison_key").orderBy(F.desc("s"), "id")
    top = j.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    one, two = F.col("_r") == 1, F.col("_r") == 2
    return top.groupBy("category", "comparison_key").agg(F.max(F.when(one, F.col("s"))).alias("best"), F.max(F.when(one, F.col("id"))).alias("best_id"), F.max(F.when(one, F.col("canonical_name"))).alias("best_name"), F.max(F.when(two, F.col("s"))).alias("second"))


_FOLDED = "document_id string, category string, comparison_key string, canonical_id string, canonical_name string, base_match_type string, score double, second_score double, reason string"


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    """Leftovers of a document and category in order: each may meet what was made before it."""
    made: list[tuple[str, str, str, list[str] | None]] = []  # id, name, normal form, person tokens
    out = []
    for r in group.sort_values("seen").itertuples():
        key, name, cat = r.comparison_key, r.preferred_name, r.category
        decision = None
        if r.strategy != "generic_actor":
            tokens = N.person_tokens(name) if cat == "CHAR" else None
            if tokens and N.significant(tokens) >= 2:
                near = [m for m in made if m[3] and len(m[3]) > len(tokens) and m[3][: len(tokens)] == tokens]
                found = {*(r.p_names if r.p_names is not None else ()), *(" ".join(m[3]) for m in near)}
                if len(found) == 1:
                    options = [(m[0], m[1]) for m in near] + ([(r.p_best["id"], r.p_best["canonical_name"])] if r.p_best is not None else [])
                    best = max(options, key=lambda o: (o[1] == name, o[1].casefold() == name.casefold(), N.accents(o[1]), -len(o[1]), o[0]))
                    decision = (*best, "person_name", 98.0, None, "unique_longer_person_name")
            if decision is None:
                scores = [(N.score(key, m[2]), m[0], m[1]) for m in made]
                scores += [(r.best, r.best_id, r.best_name)] if pd.notna(r.best) else []
                scores += [(r.second, None, None)] if pd.notna(r.second) else []
                scores.sort(key=lambda s: (-s[0], s[1] is None))
                best, second = scores[0][0] if scores else 0.0, scores[1][0] if len(scores) > 1 else None
                gap = 100.0 if second is None else best - second
                if len(key) >= X.LEAST_LENGTH and best >= X.THRESHOLDS[cat] and gap >= X.MARGIN:
                    decision = (scores[0][1], scores[0][2], "fuzzy", best, second, "fuzzy_threshold_and_margin")
        if decision is None:
            plain = r.strategy == "generic_actor"
            decision = (r.new_id, name, "new", 0.0, None if plain else (best or None), "new_controlled_singular_form" if plain else "no_safe_existing_match")
            made.append((r.new_id, name, N.normalize(name), N.person_tokens(name)))
        out.append((r.document_id, cat, key, *decision))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FOLDED.split(", ")])


def decide(groups: DataFrame, known: DataFrame, index: DataFrame, pruned: bool = False) -> DataFrame:
    """One decision for each group (DECISION)."""
    hit = checkpointed(exact(groups, known))
    rest = groups.join(hit.select(*GROUP), GROUP, "left_anti")
    alias = checkpointed(by_alias(rest, index, known))
    rest = checkpointed(rest.join(alias.select(*GROUP), GROUP, "left_anti"))
    open_ = rest.where("strategy != 'generic_actor'")
    rest = rest.join(longer_names(open_, known), GROUP, "left").join(fuzzy_top2(open_, known, pruned), ["category", "comparison_key"], "left")
    rest = rest.withColumn("new_id", new_id(F.col("category"), F.col("preferred_name")))
    folded = rest.groupBy(DOC, "category").applyInPandas(_fold, _FOLDED)
    return hit.select(*DECISION).union(alias.select(*DECISION)).union(folded.select(*DECISION))


def resolve(mentions: DataFrame, registry: DataFrame, aliases: DataFrame, pruned: bool = False) -> DataFrame:
    """Mentions with canonical_id, canonical_name, match_type, scores, version and details; broken mentions raise RuleError."""
    rules.enforce(rules.entity_rules(mentions))
    known = checkpointed(candidates(registry))
    plans = checkpointed(planned(mentions))
    d = decide(checkpointed(grouped(plans)), known, alias_index(aliases, registry), pruned)
    r = plans.join(d, GROUP)
    moved = collapse("text") != F.col("preferred_name")
    override = F.when((F.col("strategy") == "generic_actor") & moved, "morphology").when((F.col("strategy") == "document_person") & moved, "person_alias")
    r = r.withColumn("match_type", F.coalesce(override, F.col("base_match_type")))
    r = r.withColumn("match_score", F.bround(F.when(override.isNotNull(), F.col("confidence")).otherwise(F.col("score")), 2)).withColumn("second_match_score", F.bround("second_score", 2))
    details = F.struct("preferred_name", "comparison_key", "strategy", "reason", "base_match_type", "rule", "source_name", "document_anchors")
    return r.select(*mentions.columns, "canonical_id", "canonical_name", "match_type", "match_score", "second_match_score", F.lit(X.VERSION).alias("resolution_version"), details.alias("resolution_details"), "normalized")


def statistics(resolved: DataFrame) -> DataFrame:
    """match_type, mentions: every type, zero included."""
    types = resolved.sparkSession.createDataFrame([(t,) for t in X.MATCH_TYPES], "match_type string")
    return types.join(resolved.groupBy("match_type").count(), "match_type", "left").select("match_type", F.coalesce("count", F.lit(0)).alias("mentions"))


def new_aliases(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """Aliases to append: the first mention of each (canonical, alias) that isn't stored."""
    w = Window.partitionBy("canonical_id", "normalized").orderBy(DOC, "mention_index")
    a = resolved.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    a = a.select("canonical_id", collapse("text").alias("alias_text"), F.col("normalized").alias("normalized_alias"), F.col("match_type").alias("resolution_method"), F.col(DOC).alias("source_document_id"))
    return a.join(stored.select("canonical_id", "normalized_alias"), ["canonical_id", "normalized_alias"], "left_anti").select("canonical_id", "alias_text", "normalized_alias", "resolution_method", "source_document_id")


def registered(resolved: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with the canonicals that the resolution made."""
    made = resolved.where("resolution_details.base_match_type = 'new'").select(F.col("canonical_id").alias("id"), "canonical_name", "category").distinct()
    return registry.select("id", "canonical_name", "category").union(made.join(registry.select("id"), "id", "left_anti"))
