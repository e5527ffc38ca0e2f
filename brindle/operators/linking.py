"""Dictionary linking over DataFrames: a lexicon of name forms, n-gram candidates by joins, and greedy longest matches without overlaps.

A text's words are numbered; runs of words that begin with a known first word are looked up by a hash join, so neither the lexicon nor the texts
are held in one place.  Only hits are sent on, and a text's hits pass by in order to keep the greedy ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import carries_capitalization, collapse_spaces, fold, loose_name, normalize_name, split_faces, stated_rules
from .cuts import cut

MAX_NAME_WORDS = 12
MAX_QUERY_WORDS = 8
#: Kinds of a name's forms, in order of right.
KINDS = ("exact", "loose", "single")
#: First words of a lexicon that are looked up within a text's row; a lexicon with more is joined by whole runs alone.
MOST_FIRST_WORDS = 10_000
#: Words of a text that are one row at a time.
STRETCH = 256
#: Tasks over which the texts that hold a name of one word are dealt: it can be a word of nearly every text.
DEALT = 32
#: Layouts that are no rules entities (fixed values of the card data).
NON_RULES_LAYOUTS = ("art_series", "token", "double_faced_token", "emblem")


def rules_entities(cards: DataFrame, layout: str = "layout") -> DataFrame:
    """Cards that a question can be about; an unknown layout is kept."""
    return cards.where(~F.coalesce(F.col(layout).isin(*NON_RULES_LAYOUTS), F.lit(False)))


def lexicon(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(kind, key, target, words, face) from names (name, id): the whole name and each face, by exact, loose and single-word forms.

    Names of one word are only in ``single``; aliases (alias, id) only in ``loose``, as they are never an exact match.  ``face`` says that the form
    is a part of a longer name.
    """
    forms = names.select("id", "name", F.explode(F.array_union(F.array("name"), split_faces(F.col("name")))).alias("form"))
    forms = forms.select("id", normalize_name(F.col("form")).alias("norm"), (F.col("form") != F.col("name")).alias("face"))
    keyed = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    longer = F.array(keyed("exact", F.col("norm")), keyed("loose", collapse_spaces(F.regexp_replace("norm", "[^a-z0-9 ]+", ""))))
    # One pass over the names, whatever kinds their forms are of.
    out = forms.select("id", "face", F.explode(F.when(F.col("norm").contains(" "), longer).otherwise(F.array(keyed("single", F.col("norm"))))).alias("k")).select("k.kind", "k.key", "id", "face")
    if aliases is not None:
        out = out.unionByName(aliases.select(F.lit("loose").alias("kind"), loose_name(F.col("alias")).alias("key"), "id", F.lit(False).alias("face")))
    out = out.where("key <> ''").groupBy("kind", "key", F.col("id").alias("target")).agg(F.min("face").alias("face"))
    return out.withColumn("words", F.size(F.split("key", " ")))


def words_of(c: Column) -> Column:
    """Words as they stand, parted by white space."""
    return F.filter(F.split(collapse_spaces(c), " "), lambda w: w != "")


def trimmed(c: Column) -> Column:
    """A surface without the punctuation that ends a clause."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[,.;:!?]+", ""), r"[,.;:!?]+$", ""))


def folded_words(c: Column) -> Column:
    """A text's words as (s, n, l): as they stand, normalised, and without all but letters and digits.

    Each word is folded once, and has no space to collapse; a run's folded form is its words' forms in a row.
    """
    folded = F.transform(words_of(c), lambda w: F.struct(w.alias("s"), F.lower(fold(w)).alias("n")))
    return F.transform(folded, lambda w: F.struct(w["s"].alias("s"), w["n"].alias("n"), F.regexp_replace(w["n"], "[^a-z0-9]+", "").alias("l")))


def word_forms(c: Column) -> list[Column]:
    """A text's words as they stand (s), normalised (n) and without all but letters and digits (l), as three arrays of one length: the text is folded as a whole, which neither makes nor takes a blank."""
    one = collapse_spaces(c)
    norm = F.lower(fold(one))
    return [F.split(x, " ").alias(a) for a, x in (("s", one), ("n", norm), ("l", F.regexp_replace(norm, "[^a-z0-9 ]+", "")))]


def stretches(longest: int) -> Column:
    """Columns s, n, l of a text's words in stretches of at most ``STRETCH``: (base, from, s, n, l) with the number of words before, where the first one begins in characters of the text with single spaces, and the words with those that a run may go on to."""
    at = lambda base, start, of: F.struct(base.alias("base"), start.alias("from"), *[of(F.col(x)).alias(x) for x in "snl"])
    some = lambda b: lambda c: F.slice(c, b * STRETCH + 1, F.lit(STRETCH + longest - 1))
    size = lambda b: F.length(F.array_join(F.slice("s", b * STRETCH + 1, F.lit(STRETCH)), " ")) + 1
    none = F.array().cast("array<struct<base:int,from:int,s:array<string>,n:array<string>,l:array<string>>>")
    add = lambda acc, b: F.struct(F.concat(acc["a"], F.array(at(b * STRETCH, acc["p"], some(b)))).alias("a"), (acc["p"] + size(b)).alias("p"))
    several = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / STRETCH).cast("int")), F.struct(none.alias("a"), F.lit(0).alias("p")), add, lambda acc: acc["a"])
    return F.when(F.size("s") <= STRETCH, F.array(at(F.lit(0), F.lit(0), lambda c: c))).otherwise(several)


def runs(texts: DataFrame, doc: str, text: str, firsts: DataFrame, longest: int, *carried: str) -> DataFrame:
    """(doc, carried, at, width, start, surface, norm, loose): runs as of :func:`windows` that hold a capital, with where they begin in characters of the text with single spaces.

    Only a word that names begin with meets those behind it.  After the stretches no step has a function over an array's elements, so they are one compiled loop that copies
    no words; explodes are outer ones, as of others Spark infers a filter that would build the array twice.
    """
    words = texts.select(doc, *carried, *word_forms(F.col(text))).select(doc, *carried, F.explode_outer(stretches(longest)).alias("_s")).select(doc, *carried, "_s.*")
    near = words.select(doc, *carried, "base", "from", "s", "n", "l", F.posexplode_outer(F.slice("l", 1, STRETCH)).alias("_i", "first")).where("first <> ''")
    behind = F.length(F.array_join(F.slice("s", F.lit(1), F.col("_i")), " ")) + (F.col("_i") > 0).cast("int")
    near = near.select(doc, *carried, "first", (F.col("base") + F.col("_i")).alias("at"), (F.col("from") + behind).alias("start"), *[F.slice(x, F.col("_i") + 1, F.lit(longest)).alias(x) for x in "snl"])
    near = near.join(_at_hand(firsts), "first").select(doc, *carried, "at", "start", "s", "n", "l", "counts", F.explode_outer(F.sequence(F.lit(1), F.least("longest", F.size("s")))).alias("width"))
    said = lambda x: F.slice(x, F.lit(1), F.col("width"))
    bare = F.size(F.array_remove(said("l"), ""))
    fits = F.array_contains("counts", F.col("width")) | (bare < F.col("width")) & F.arrays_overlap("counts", F.sequence(bare, F.greatest(bare, F.col("width") - 1)))
    found = near.where(fits).select(doc, *carried, "at", "width", "start", "n", "l", F.array_join(said("s"), " ").alias("surface")).where(capitalised(F.col("surface")))
    return found.select(doc, *carried, "at", "width", "start", "surface", *[F.array_join(F.array_remove(said(x), ""), " ").alias(name) for x, name in (("n", "norm"), ("l", "loose"))])


def joined(words: Column, field: str) -> Column:
    """A field of a run's words in a row; words that folding leaves empty are none."""
    said = F.transform(words, lambda x: x[field])
    return F.array_join(said if field == "s" else F.filter(said, lambda x: x != ""), " ")


def windows(words: DataFrame, doc: str, firsts: DataFrame, longest: int, *carried: str) -> DataFrame:
    """(doc, carried, at, width, run): runs of ``words`` (doc, _w as :func:`folded_words`) that may be names by their first word and the number of their words, no longer than the longest name with that first word.

    A run whose loose form has fewer words than stand there may be a name of any number in between.  Words are exploded with the few that follow, not with the whole text.
    """
    around = F.transform("_w", lambda x, i: F.slice(F.col("_w"), i + 1, longest)) if longest > 1 else F.transform("_w", lambda x: F.array(x))
    near = words.select(doc, *carried, F.posexplode(around).alias("at", "_next"))
    near = near.withColumn("first", F.get("_next", F.lit(0))["l"]).where("first <> ''").join(_at_hand(firsts), "first")
    bare = lambda w: F.size(F.filter(F.slice(F.col("_next"), F.lit(1), w), lambda x: x["l"] != ""))
    fits = lambda w: F.array_contains("counts", w) | F.exists("counts", lambda k: (k < w) & (k >= bare(w)))
    widths = F.filter(F.sequence(F.lit(1), F.least("longest", F.size("_next"))), fits)
    return near.select(doc, *carried, "at", F.explode(widths).alias("width"), "_next").select(doc, *carried, "at", "width", F.slice("_next", F.lit(1), F.col("width")).alias("run"))


def first_words(lex: DataFrame, longest: int) -> DataFrame:
    """(first, longest, counts): of the names that begin with a word, how many words the longest has, and all numbers of words."""
    first = F.regexp_replace(F.split_part("key", F.lit(" "), F.lit(1)), "[^a-z0-9]", "")
    return lex.groupBy(first.alias("first")).agg(F.least(F.max("words"), F.lit(longest)).alias("longest"), F.collect_set("words").alias("counts")).where("first <> ''")


def _at_hand(firsts: DataFrame) -> DataFrame:
    """First words as a broadcast table where they are few (a job of its own finds that out), so that texts aren't shuffled by words that nearly all hold."""
    rows = firsts.limit(MOST_FIRST_WORDS + 1).collect()
    return F.broadcast(firsts.sparkSession.createDataFrame(rows, firsts.schema)) if len(rows) <= MOST_FIRST_WORDS else firsts


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document, at, width, fits, ...) in order, without those that begin within the last one kept of their document; of several rows for one place and width only the first counts, whether it fits or not.

    A row that begins behind the ends of all before it is kept; one by one are looked at only those that begin within another.
    """
    last, free, place = None, 0, None  # of the batches before: the last document, as an array of one, where its last kept row ends, and the last place and width
    for batch in batches:
        if not batch.num_rows:
            continue
        docs = batch.column(0)
        at, width = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        new = np.ones(len(at), bool)
        new[1:] = _differ(docs[1:], docs[:-1])
        new[0] = last is None or _differ(docs[:1], last)[0]
        again = ~new
        again[1:] &= (at[1:] == at[:-1]) & (width[1:] == width[:-1])
        again[0] &= place == (at[0], width[0])
        number = np.cumsum(new)  # 0 is the document of the batch before
        rows = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False).astype(bool) & ~again)
        begin = (number[rows] << 32) + at[rows]
        end = begin + width[rows]
        taken = np.maximum.accumulate(np.concatenate([[free], end]))[:-1]
        within = begin < taken
        kept = ~within
        before = -2
        for i in np.flatnonzero(within).tolist():
            if i != before + 1:
                free = end[i - 1] if i else free
            if begin[i] >= free:
                kept[i], free = True, end[i]
            before = i
        keep = np.zeros(len(at), bool)
        keep[rows[kept]] = True
        ends = end[kept & (number[rows] == number[-1])]
        free = int(ends[-1] - (number[-1] << 32)) if len(ends) else int(free) if number[-1] == 0 else 0
        last, place = docs[-1:], (at[-1], width[-1])
        yield batch.filter(pa.array(keep))


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; null is like null alone."""
    either = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), either).to_numpy(zero_copy_only=False)


def without_overlaps(hits: DataFrame, doc: str, *cols: str, fits: Column | None = None, rank: Column | None = None) -> DataFrame:
    """Greedy longest matches: from the left, at each place the widest hit that fits, whose words are then used up.

    Of the hits (doc, at, width, ...) for one place and width only the one of the least ``rank`` counts.  A document's hits pass by in order, and only the end of the last one kept is remembered: linear, however many hits a document has.
    """
    rows = hits.select(doc, "at", "width", (F.lit(True) if fits is None else F.coalesce(fits, F.lit(False))).alias("_fits"), *cols, (F.lit(0) if rank is None else rank).alias("_rank"))
    return rows.repartition(doc).sortWithinPartitions(doc, "at", F.desc("width"), "_rank").mapInArrow(_greedy, rows.schema).drop("_fits", "_rank")


def _by_key(lex: DataFrame) -> DataFrame:
    """(key, and for each kind its ids and whole): one row for a key, so a run meets one row however many targets it has."""
    cols = []
    for kind in KINDS:
        own = F.col("kind") == kind
        cols += [F.sort_array(F.collect_set(F.when(own, F.col("target")))).alias(f"{kind}_ids"), F.sort_array(F.collect_set(F.when(own & ~F.col("face"), F.col("target")))).alias(f"{kind}_whole")]
    return lex.groupBy("key").agg(*cols)


def _looked_up(found: DataFrame, lex: DataFrame, *carried: str) -> DataFrame:
    """(carried, rank, method, ids, whole, only): targets of each run (carried, norm, loose), exact before loose before single; ``only`` says that the run has no other row.

    A run whose two forms differ is looked up by both and may have two rows, of which the one of lesser rank is meant; most have one form and go through one exchange in one row.
    Runs of one word are dealt over ``DEALT`` copies of its targets, by the first of ``carried``.
    """
    by = lambda key, *kinds: F.struct(F.col(key).alias("key"), F.lit(sum(1 << KINDS.index(k) for k in kinds)).alias("by"))
    either = F.when(F.col("norm") == F.col("loose"), F.array(by("norm", *KINDS))).otherwise(F.array(by("norm", "exact", "single"), by("loose", "loose")))
    hits = found.select(*carried, F.explode(either).alias("_k")).select(*carried, "_k.*").where("key <> ''")
    several = F.col("key").contains(" ")
    hits = hits.withColumn("deal", F.when(several, 0).otherwise(F.pmod(F.xxhash64(carried[0]), F.lit(DEALT)).cast("int")))
    hits = hits.join(_by_key(lex).withColumn("deal", F.explode(F.when(several, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(DEALT - 1))))), ["key", "deal"])
    best = F.coalesce(*[
        F.when((F.col("by").bitwiseAND(1 << i) > 0) & (F.size(f"{kind}_ids") > 0), F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("method"), F.col(f"{kind}_ids").alias("ids"), F.col(f"{kind}_whole").alias("whole")))
        for i, kind in enumerate(KINDS)
    ])
    return hits.select(*carried, best.alias("_b"), (F.col("by") == sum(1 << i for i in range(len(KINDS)))).alias("only")).where("_b is not null").select(*carried, "_b.*", "only")


def capitalised(c: Column) -> Column:
    """Whether a word has a capital before any other letter or digit; a blank is no letter, so a match that begins at an earlier word ends at one that has its own."""
    return c.rlike(r"(^| )\W*\p{Lu}")


def link_mentions(docs: DataFrame, lex: DataFrame, doc: str, text: str = "text", host: DataFrame | str | None = None, longest: int = MAX_NAME_WORDS) -> DataFrame:
    """(doc, at, width, start, surface, method, id, candidates): names that texts mention, by greedy longest match; ``start`` counts characters of the text with single spaces.

    A name of several words needs a capital in it and exactly one target, or else a shorter run is tried; a single word needs a capital and stays
    pending (null id) with its candidates.  ``host``, a table (doc, host) or a column of ``docs``, is the card that a text belongs to: it is never its own mention, and a
    match within the host's name as the text has it is none either (give ``host_names`` to :func:`not_within_host`).
    """
    texts = docs if host is None else docs.drop("host").join(host, doc, "left") if isinstance(host, DataFrame) else docs.withColumnRenamed(host, "host")
    own = [doc, "at", "width", "start", "surface", *(() if host is None else ("host",))]
    lex = cut(lex)
    hits = _looked_up(runs(texts, doc, text, first_words(lex, longest), longest, *own[5:]), lex, *own)
    if host is not None:
        hits = hits.withColumn("ids", F.when(F.col("host").isNull(), F.col("ids")).otherwise(F.filter("ids", lambda x: x != F.col("host"))))
    one = (F.col("width") > 1) & F.col("method").isin("exact", "loose") & (F.size("ids") == 1)
    pending = (F.col("width") == 1) & (F.col("method") == "single") & (F.size("ids") > 0)
    # What doesn't fit counts only against another row of its run.
    hits = hits.where(one | pending | ~F.col("only")).withColumns({"id": F.when(one, F.get("ids", F.lit(0))), "candidates": F.when(one, F.slice("ids", 1, 0)).otherwise(F.col("ids"))})
    return without_overlaps(hits, doc, "start", "surface", "method", "id", "candidates", fits=one | pending, rank=F.col("rank"))


def not_within_host(mentions: DataFrame, docs: DataFrame, names: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Mentions but those strictly inside an occurrence of a face of the host's name; ``names`` is (doc, name) of the hosts."""
    faces = names.select(doc, F.explode(split_faces(F.col("name"))).alias("_face"))
    faces = faces.select(doc, F.split(normalize_name(F.col("_face")), " ").alias("_f"))
    words = docs.select(doc, F.transform(words_of(F.col(text)), normalize_name).alias("_w"))
    spans = words.join(faces, doc).select(doc, F.size("_f").alias("_n"), F.explode(F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("_w") - F.size("_f"), F.lit(0))), lambda i: F.array_join(F.slice("_w", i + 1, F.size("_f")), " ") == F.array_join("_f", " ")
    )).alias("_from"))
    inside = (F.col("at") >= F.col("_from")) & (F.col("at") + F.col("width") <= F.col("_from") + F.col("_n")) & (F.col("width") < F.col("_n"))
    lost = mentions.join(spans, doc).where(inside).select(doc, "at").distinct()
    return mentions.join(lost, [doc, "at"], "left_anti")


def asked_words(questions: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text, _w) of questions, dealt by question: a table of many short texts is one file's split, and all that follows would be one task."""
    return questions.select(doc, text).repartition(doc).select(doc, text, folded_words(F.col(text)).alias("_w"))


def link_vocabulary(words: DataFrame, names: DataFrame, doc: str, kind: str, longest: int) -> DataFrame:
    """(doc, at, width, kind, key) for a closed vocabulary (name) in :func:`asked_words`: greedy longest match, as written or without a clause's punctuation."""
    lex = names.select(normalize_name(F.col("name")).alias("key"), F.col("name").alias("target")).where("key <> ''").groupBy("key").agg(F.min("target").alias("target"))
    firsts = first_words(lex.withColumn("words", F.size(F.split("key", " "))), longest)
    found = windows(words, doc, firsts, longest)
    forms = F.array_distinct(F.array(joined(F.col("run"), "n"), normalize_name(trimmed(joined(F.col("run"), "s")))))
    hits = found.select(doc, "at", "width", F.explode(forms).alias("key")).join(lex, "key")
    return without_overlaps(hits.select(doc, "at", "width", F.col("target").alias("key")), doc, "key", rank=F.col("key")).select(doc, "at", "width", F.lit(kind).alias("kind"), "key")


def free_of(hits: DataFrame, claimed: DataFrame, doc: str) -> DataFrame:
    """Hits that share no word with claimed spans (doc, at, width)."""
    taken = _taken(claimed, doc)
    rows = hits.join(taken, doc, "left")
    return rows.where(~F.coalesce(F.arrays_overlap(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1), "_taken"), F.lit(False))).drop("_taken")


def _taken(claimed: DataFrame, doc: str) -> DataFrame:
    """(doc, _taken): the words that a question's claimed spans cover."""
    cover = claimed.select(doc, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1)).alias("_word"))
    return cover.groupBy(doc).agg(F.collect_set("_word").alias("_taken"))


def link_cards(words: DataFrame, lex: DataFrame, claimed: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, at, width, key, method, candidates): cards that questions (:func:`asked_words`) name, where nothing else is claimed.

    Where a question uses capitals a name of several words needs one; where it uses none, nothing is asserted and all matches are ambiguous.  A
    whole name outranks a face; a single word that is only a face doesn't count.  Several targets are ambiguous: no key, but candidates.
    """
    gated = words.select(doc, "_w", carries_capitalization(F.col(text)).alias("gate")).join(_taken(claimed, doc), doc, "left")
    flagged = F.transform("_w", lambda x, i: F.struct(x["s"].alias("s"), x["n"].alias("n"), x["l"].alias("l"), F.coalesce(F.array_contains("_taken", i), F.lit(False)).alias("taken")))
    found = windows(gated.select(doc, "gate", flagged.alias("_w")), doc, first_words(lex, MAX_QUERY_WORDS), MAX_QUERY_WORDS, "gate").where(~F.exists("run", lambda x: x["taken"]))
    said = joined(F.col("run"), "s")
    tries = found.select(doc, "gate", "at", "width", F.explode(F.array_distinct(F.array(said, trimmed(said)))).alias("surface"))
    several = F.size(F.split(normalize_name(F.col("surface")), " ")) > 1
    tries = tries.where(~(F.col("gate") & several & ~capitalised(F.col("surface")))).withColumns({"norm": normalize_name(F.col("surface")), "loose": loose_name(F.col("surface"))})
    own = [doc, "gate", "at", "width", "surface"]
    # Dealt by question once: the choices among a place's rows and the pass over a question's hits need no exchange of their own.
    hits = _looked_up(tries, lex, *own).repartition(doc).groupBy(*own).agg(F.min_by(F.struct("method", "ids", "whole"), "rank").alias("b")).select(*own, "b.*")
    ids = F.when(F.size("whole") > 0, F.col("whole")).when(several, F.col("ids"))
    hits = hits.withColumn("ids", ids).where("ids is not null")
    # The surface as written goes before the trimmed one, which is shorter.
    hits = hits.groupBy(doc, "at", "width").agg(F.max_by(F.struct("method", "ids", "gate"), F.length("surface")).alias("b")).select(doc, "at", "width", "b.*")
    sure = (F.size("ids") == 1) & F.col("gate")
    hits = hits.withColumns({"key": F.when(sure, F.get("ids", F.lit(0))), "candidates": F.when(sure, F.slice("ids", 1, 0)).otherwise(F.col("ids"))})
    return without_overlaps(hits, doc, "key", "method", "candidates")


def link_questions(questions: DataFrame, lex: DataFrame, keywords: DataFrame, formats: DataFrame, doc: str, text: str = "question") -> DataFrame:
    """(doc, kind, at, width, key, candidates): what questions name, in this order of right: rules, formats, keywords, cards; no word twice.

    Rules have the word that holds them as their place.  Questions are folded once, and what a kind claims is kept before the next is looked for (jobs of their own).
    """
    asked = cut(asked_words(questions, doc, text))
    words = asked.select(doc, F.posexplode(F.transform("_w", lambda x: x["s"])).alias("at", "_w"))
    dotted = words.select(doc, "at", F.lit(1).alias("width"), F.regexp_extract("_w", r"\b([0-9]{3}\.[0-9]+[a-z]?)\b", 1).alias("key")).where("key <> ''")
    cued = asked.select(doc, F.explode(stated_rules(F.col(text))).alias("r"), F.col(text).alias("_t")).where(~F.col("r.number").contains("."))
    before = F.size(words_of(F.concat(F.expr("substring(_t, 1, r.start)"), F.lit("x"))))
    cued = cued.select(doc, (before - 1).alias("at"), F.lit(1).alias("width"), F.col("r.number").alias("key"))
    none = F.array().cast(lex.select(F.array("target").alias("a")).schema["a"].dataType)
    found = cut(dotted.unionByName(cued).select(doc, F.lit("rule").alias("kind"), "at", "width", "key"))
    for kind, names, longest in (("format", formats, 2), ("keyword", keywords, 4)):
        hits = free_of(link_vocabulary(asked, names, doc, kind, longest), found, doc)
        found = found.unionByName(cut(hits.select(*found.columns)))
    cards = link_cards(asked, lex, found, doc, text)
    cards = cards.select(doc, F.lit("card").alias("kind"), "at", "width", F.col("key").cast("string").alias("key"), "candidates")
    return found.withColumn("candidates", none).unionByName(cards)


def has_graph_seed(entities: DataFrame, with_keywords: DataFrame, doc: str) -> DataFrame:
    """(doc, seeded): whether a question names a rule, a keyword, or a card (key) that has keywords."""
    carded = entities.join(with_keywords.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("_has")).distinct(), "key", "left")
    seed = F.col("kind").isin("rule", "keyword") | (F.col("kind") == "card") & F.coalesce("_has", F.lit(False))
    return carded.groupBy(doc).agg(F.max(seed).alias("seeded"))


def mention_stratum(mentions: DataFrame, cited: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(doc, stratum): explicit (cites a rule), else homonym (a pending word), else multiword (a longer name), else plain."""
    flags = mentions.groupBy(doc).agg(F.max(F.col("id").isNull()).alias("_p"), F.max(F.col("width") > 1).alias("_m"))
    rows = docs.select(doc).distinct().join(flags, doc, "left").join(cited.select(doc).distinct().withColumn("_c", F.lit(True)), doc, "left")
    return rows.select(doc, F.when(F.col("_c"), "explicit").when(F.col("_p"), "homonym").when(F.col("_m"), "multiword").otherwise("plain").alias("stratum"))


def draft(mentions: DataFrame, doc: str) -> DataFrame:
    """(doc, mentions): resolved and pending mentions of a text together, in order of place."""
    entry = F.struct("at", "width", "surface", F.col("id").cast("string").alias("id"))
    return mentions.groupBy(doc).agg(F.array_sort(F.collect_list(entry)).alias("mentions"))


def ngram_mentions(docs: DataFrame, lexicon: DataFrame, doc: str, item: str, n: int) -> DataFrame:
    """(doc, item, start_word) wherever the words of a surface of ``n`` words follow one another.

    A run is built where a surface's first word stands, from the few words behind it, so only likely places leave the row and meet the lexicon.  The first words are a set within the plan where they are few (a job of its own finds that out);
    otherwise every run is built.
    """
    w = docs.select(doc, F.split(collapse_spaces(F.col("text")), " ").alias("_w")).where(F.size("_w") >= n)
    firsts = [r["f"] for r in lexicon.select(F.split_part("surface", F.lit(" "), F.lit(1)).alias("f")).distinct().limit(MOST_FIRST_WORDS + 1).collect()]
    starts = F.slice("_w", F.lit(1), F.size("_w") - n + 1)
    run = lambda x, i: F.struct(i.alias("start_word"), F.array_join(F.slice(F.col("_w"), i + 1, n), " ").alias("surface"))
    if len(firsts) <= MOST_FIRST_WORDS:
        places = F.filter(F.transform(starts, lambda x, i: F.when(x.isin(*firsts), run(x, i))), lambda r: r.isNotNull())
    else:
        places = F.transform(starts, run)
    # An outer explode: of an inner one Spark infers a filter on the array's size, which would build it twice.
    found = w.select(doc, F.explode_outer(places).alias("_r")).where("_r is not null").select(doc, "_r.start_word", "_r.surface")
    return found.join(lexicon, "surface").select(doc, item, F.col("start_word").cast("long").alias("start_word"))
