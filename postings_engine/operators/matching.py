"""Scoring many profiles against many postings without pairing every one with every other.

A posting meets a profile only through a skill the posting's text contains.  Each distinct skill is looked up
by one gram of its characters.  Where a text has a gram that may be some skill's, the gram travels with the stretch of
text around it that the longest skill can cover: this decides whether the skill is there, so whole texts are
read once and never shuffled.  The hits join the profiles on the skill.

A score depends on the words a posting holds alone, so it is computed once per profile and set of words that some
posting holds, and only the sets that a least score or a number of best postings leave are turned into pairs.  With
a least score, a profile's frequent skills meet no set as long as all of them together cannot reach it: every set that can
has a rarer skill, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bind, strings
from ..session import materialise
from .dedup import cap_per_group
from .places import home_cells, posting_cells, within_radius
from .scoring import (
    ADJACENT_WEIGHT, CORE_WEIGHT, MAX_KEYWORDS, NEUTRAL_SCORE, TEXT_PENALTY, TITLE_PENALTY,
)

# Characters of a gram; a shorter word is its own gram.
GRAM = 4
# Bits of the filter of grams that the texts' own grams pass before they travel: 128 kB, whatever the dictionary.
FILTER_BITS = 1 << 20


def profile_words(profiles: DataFrame) -> DataFrame:
    """``(profile_id, kind, ordinal, word)``, lower-cased; a word may repeat within a list."""
    lists = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.coalesce(c, strings([])).alias("words"))
        for kind, c in (
            ("core", "core_skills"), ("adjacent", "adjacent_skills"),
            ("title", "negative_signals.title_excludes"),
            ("text", "negative_signals.description_excludes"),
        )
    ])
    rows = profiles.select("profile_id", F.explode(lists).alias("l"))
    return rows.select(
        "profile_id", "l.kind", F.posexplode("l.words").alias("ordinal", "word")
    ).withColumn("word", F.lower("word"))


def _overlapping(text: Column) -> Column:
    """All runs of ``GRAM`` characters of a text in order, one per character that starts one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))


def _anchors(words: DataFrame) -> DataFrame:
    """``(word, gram, before)``: of the grams of a word the one that the fewest words have, and the characters before it."""
    whole = F.length("word") < GRAM
    grams = words.select("word", F.posexplode(F.when(whole, F.array("word")).otherwise(_overlapping(F.col("word")))).alias("before", "gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_words"))
    return grams.join(shared, "gram").groupBy("word").agg(
        F.min_by(F.struct("gram", "before"), F.struct("_words", "gram", "before")).alias("a")).select("word", "a.*")


def _place(gram: str) -> tuple[Column, Column]:
    """Slot and bit of a gram in the filter."""
    at = F.pmod(F.xxhash64(gram), F.lit(FILTER_BITS))
    return F.floor(at / 64).cast("int"), (at % 64).cast("int")


def _filter_bits(anchors: DataFrame) -> Column:
    """The filter: an array of 64-bit slots with the bits of all anchors set, as a scalar subquery."""
    slot, bit = _place("gram")
    slots = anchors.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
    places = anchors.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("slot"))
    listed = places.join(slots, "slot", "left").agg(
        F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("all"))
    return listed.select(F.transform("all", lambda s: s["bits"])).scalar()


def word_hits(postings: DataFrame, words: DataFrame) -> DataFrame:
    """``(job_id, word, in_title)`` for every distinct word contained in title or description.

    ``job_id`` is unique; empty words are left out.  A text is cut into its grams where it is read.  Those that may be a
    word's anchor travel with the characters around them, as many as the longest word has; a word is held if it
    stands there around its anchor.
    """
    distinct = words.select("word").filter(F.col("word") != "").distinct()
    anchors = _anchors(distinct)
    # Lengths of the anchors, one bit each, and of the longest word: texts are searched for grams of these lengths only.
    lengths = anchors.agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.length("gram"))), F.lit(0))).scalar()
    longest = distinct.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).scalar()
    bits = _filter_bits(anchors)

    def may_be_anchor(gram: str) -> Column:
        slot, bit = _place(gram)
        return F.getbit(F.get(bits, slot), bit) == 1

    title, description = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "description"))
    padding = F.lit("\0" * (GRAM - 1))
    texts = postings.select("job_id", F.length(title).alias("title_chars"), F.concat(title, F.lit(" "), description, padding).alias("text"))
    places = texts.select("job_id", "title_chars", "text", F.posexplode(_overlapping(F.col("text"))).alias("at", "run"))
    found = []
    for n in range(1, GRAM + 1):
        named = F.substring("run", 1, n)
        found.append(F.when((F.call_function("shiftright", lengths, F.lit(n)) % 2 == 1), named))
    runs = places.withColumns({f"g{n}": gram for n, gram in enumerate(found, 1)})
    some = None
    for n in range(1, GRAM + 1):
        test = F.coalesce(may_be_anchor(f"g{n}"), F.lit(False))
        some = test if some is None else some | test
    start = F.greatest(F.lit(0), F.col("at") - longest)
    hit = runs.filter(some).select(
        "job_id", "title_chars", "at", start.alias("start"), F.substring("text", start + 1, F.col("at") - start + longest).alias("around"),
        F.explode(F.array_compact(F.array(*[f"g{n}" for n in range(1, GRAM + 1)]))).alias("gram"))
    met = hit.join(anchors, "gram").withColumn("first", F.col("at") - F.col("before"))
    there = (F.col("first") >= F.col("start")) & (F.substring("around", F.col("first") - F.col("start") + 1, F.length("word")) == F.col("word"))
    in_title = F.col("first") + F.length("word") <= F.col("title_chars")
    return met.filter(there).groupBy("job_id", "word").agg(F.max(in_title).alias("in_title"))


def _skill_weights(words: DataFrame) -> DataFrame:
    """``(profile_id, word, weight)`` of the skills that are not empty."""
    core, adjacent = F.count_if(F.col("kind") == "core"), F.count_if(F.col("kind") == "adjacent")
    return words.filter(F.col("kind").isin("core", "adjacent") & (F.col("word") != "")).groupBy("profile_id", "word").agg(
        (core * CORE_WEIGHT + adjacent * ADJACENT_WEIGHT).alias("weight"))


def _reaching(hits: DataFrame, spread: DataFrame, words: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """``(profile_id, first_id)``: the sets of words that can reach the score ``least``, by the profile's rarer skills alone.

    A profile's skills are taken from the most frequent on; as long as all taken so far would score less than ``least``
    together, they meet nothing.
    """
    frequency = hits.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    weights = _skill_weights(words).join(frequency, "word").join(facts, "profile_id")
    taken = F.sum("weight").over(Window.partitionBy("profile_id").orderBy(F.desc("times"), "word").rowsBetween(Window.unboundedPreceding, 0))
    top = F.round(F.least(F.lit(10.0), (taken + _empty_points()) / _most_points() * 10.0), 2)
    rarer = weights.withColumn("_top", top).filter(F.col("_top") >= least).select("profile_id", "word")
    return spread.join(rarer, "word").select("profile_id", "first_id").distinct()


def _empty_points() -> Column:
    return F.col("empty_core") * CORE_WEIGHT + F.col("empty_adjacent") * ADJACENT_WEIGHT


def _most_points() -> Column:
    return F.col("n_core") * CORE_WEIGHT + F.col("n_adjacent") * ADJACENT_WEIGHT


def profiles_x_postings(
    profiles: DataFrame, postings: DataFrame, min_score: float | None = None, best: int | None = None,
    in_reach: bool = False, facts_of_postings: DataFrame | None = None, facts_of_profiles: DataFrame | None = None,
) -> DataFrame:
    """``(profile_id, job_id, score, keywords)`` for pairs sharing at least one skill that is not empty.

    Scores equal :func:`postings_engine.operators.scoring.keyword_prescore`; an empty word counts as in every
    text.  Other pairs of a profile with skills score 0 or less than its empty words give, and are not listed.  A profile without
    skills gives every posting the neutral 5 less penalties: it has one row, without a posting.
    ``min_score`` and ``best`` (postings per profile, ties by id) bound what is listed, and which pairs are made.
    With ``in_reach``, postings outside a profile's home radius make no pair (see :mod:`.places`; the columns of both sides
    are those it reads).  What is to be known of a pair, ``facts`` by ``job_id`` and by ``profile_id``, then joins both sides before
    pairs are made: pairs outnumber them, and are not shuffled.  The words that postings hold are stored when the plan is built.
    """
    if not in_reach and (facts_of_postings is not None or facts_of_profiles is not None):
        raise ValueError("facts join pairs within reach only")
    words = profile_words(profiles)
    def empty(kind: str) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("word") == ""))

    facts = words.groupBy("profile_id").agg(
        F.count_if(F.col("kind") == "core").alias("n_core"), F.count_if(F.col("kind") == "adjacent").alias("n_adjacent"),
        empty("core").alias("empty_core"), empty("adjacent").alias("empty_adjacent"),
        (empty("title") > 0).alias("any_title"), (empty("text") > 0).alias("any_text"),
        F.collect_list(F.when((F.col("kind") == "core") & (F.col("word") == ""), F.struct("ordinal", "word"))).alias("blanks"),
    )
    # Named by their first posting and met by all: stored once, or texts would be cut into grams for both.
    sets = materialise(word_hits(postings, words).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("word", "in_title"))).alias("held")), "sets")
    # The least posting that holds a set names it.
    first = sets.groupBy("held").agg(F.min("job_id").alias("first_id"))
    spread = first.select("first_id", F.explode("held").alias("h")).select("first_id", "h.*")
    met = spread.join(words, "word")
    if min_score is not None:
        own = words.groupBy("profile_id").agg(F.collect_list(F.struct("kind", "ordinal", "word")).alias("own"))
        hits = sets.select(F.explode("held.word").alias("word"))
        listed = (_reaching(hits, spread, words, facts, float(min_score)).join(own, "profile_id").join(first, "first_id")
                  .select("profile_id", "first_id", "own", F.explode("held").alias("h")))
        met = listed.select("profile_id", "first_id", "h.*", F.explode(F.filter("own", lambda o: o["word"] == F.col("h.word"))).alias("o")).select(
            "profile_id", "first_id", "word", "in_title", "o.kind", "o.ordinal")
    # A set meets at most the profile's own words: a short list, whatever the table's size.  The few sets of many
    # postings meet many profiles, so they are dealt out anew.
    pairs = met.repartition("profile_id", "first_id").groupBy("profile_id", "first_id").agg(
        F.count_if(F.col("kind") == "core").alias("core"),
        F.count_if(F.col("kind") == "adjacent").alias("adjacent"),
        F.max((F.col("kind") == "title") & F.col("in_title")).alias("bad_title"),
        F.max(F.col("kind") == "text").alias("bad_text"),
        F.collect_list(F.when(F.col("kind") == "core", F.struct("ordinal", "word"))).alias("matched"),
    ).filter((F.col("core") > 0) | (F.col("adjacent") > 0))
    scored = pairs.join(facts, "profile_id")

    points = F.col("core") * CORE_WEIGHT + F.col("adjacent") * ADJACENT_WEIGHT + _empty_points()
    base = F.least(F.lit(10.0), points / _most_points() * 10.0)

    def penalised(score: Column) -> Column:
        bad_title, bad_text = F.col("bad_title") | F.col("any_title"), F.col("bad_text") | F.col("any_text")
        after = F.when(bad_title, F.greatest(F.lit(0.0), score - TITLE_PENALTY)).otherwise(score)
        return F.when(bad_text, F.greatest(F.lit(0.0), after - TEXT_PENALTY)).otherwise(after)

    matched = F.array_sort(F.concat("matched", "blanks"))
    out = scored.select(
        "profile_id", "first_id",
        F.round(bind(base, penalised), 2).alias("score"),
        F.slice(F.transform(matched, lambda m: m["word"]), 1, MAX_KEYWORDS).alias("keywords"),
    )
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    named = sets.join(first, "held").select("first_id", "job_id")
    if in_reach:
        # Postings of a set meet profiles by the cells of their place.
        homes = home_cells(profiles)
        placed = named.join(posting_cells(postings, homes, ["job_id"]), "job_id")
        known = []
        if facts_of_postings is not None:
            placed = placed.join(facts_of_postings, "job_id")
            known += [c for c in facts_of_postings.columns if c != "job_id"]
        if facts_of_profiles is not None:
            homes = homes.join(facts_of_profiles, "profile_id")
            known += [c for c in facts_of_profiles.columns if c != "profile_id"]
        met = out.join(homes, "profile_id").join(placed, ["first_id", "cell"]).filter(within_radius())
        out = met.select("profile_id", "job_id", "score", "keywords", *known)
    elif best is None:
        out = out.join(named, "first_id").select("profile_id", "job_id", "score", "keywords")
    else:
        # A set stands for its first posting: one that has ``best`` sets before it has nothing among the best.
        out = cap_per_group(out, ["profile_id"], [F.desc("score"), "first_id"], best)
        out = out.join(named, "first_id").select("profile_id", "job_id", "score", "keywords")
    if best is not None:
        out = cap_per_group(out, ["profile_id"], [F.desc("score"), "job_id"], best)
    size = lambda c: F.size(F.coalesce(c, strings([])))
    neutral = profiles.filter((size("core_skills") == 0) & (size("adjacent_skills") == 0)).select(
        "profile_id", F.lit(None).cast(postings.schema["job_id"].dataType).alias("job_id"),
        F.lit(NEUTRAL_SCORE).alias("score"), strings([]).alias("keywords"))
    return out.unionByName(neutral, allowMissingColumns=True)
