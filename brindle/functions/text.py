"""Text functions as Column expressions: names, symbols, references, terms, sentences, citation markers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .words import CITATION_BODY, LIGATURES, QUESTION_WORDS, STOPWORDS, TYPOGRAPHY

#: Rule numbers such as 613, 613.4 or 613.4a.
RULE_NUMBER = r"[0-9]{3}(?:\.[0-9]+[a-z]?)?"
_DOTTED = r"\b([0-9]{3}\.[0-9]+[a-z]?)\b"


def _accented() -> dict[str, str]:
    """Latin letters with marks and the letter each decomposes to; by the compatibility decomposition, where that is one ASCII letter and marks."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFKD", chr(code))
        if parts != chr(code) and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            out[chr(code)] = parts[0]
    return out


ACCENTED, PLAIN = ("".join(x) for x in zip(*_accented().items(), strict=True))


def fold(c: Column) -> Column:
    """Ligatures and typographic marks replaced, accents of Latin letters dropped, whether part of the letter or combining marks of their own.

    Texts of ASCII alone, nearly all, stay as they are and pass none of the steps.
    """
    plain, text = c.rlike(r"^[\x00-\x7F]*$"), c
    for a, b in (*LIGATURES, *TYPOGRAPHY):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(plain, text).otherwise(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", ""))


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)) for x in s], dtype=object)


def fold_any(c: Column) -> Column:
    """``fold`` for any script: compatibility decomposition without combining marks, as the standard library has it (full-width letters, ligatures, syllables).

    Spark SQL has no such function, so this runs on Arrow batches; texts of ASCII alone, nearly all names, reach Python as nulls.  Unlike ``fold`` it can't stand within a function over an array's elements.
    """
    for a, b in (*LIGATURES, *TYPOGRAPHY):
        c = F.replace(c, F.lit(a), F.lit(b))
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(_decomposed(F.when(~plain, c)))


def normalize_any(c: Column) -> Column:
    return collapse_spaces(F.lower(fold_any(c)))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space (any in Unicode) become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_name(c: Column) -> Column:
    return collapse_spaces(F.lower(fold(c)))


def loose_name(c: Column) -> Column:
    """A normalised name without anything but letters, digits and spaces."""
    return collapse_spaces(F.regexp_replace(normalize_name(c), "[^a-z0-9 ]+", ""))


def split_faces(c: Column) -> Column:
    """Parts of a name between ``//``; the whole name where that leaves none."""
    parts = F.filter(F.transform(F.split(c, "//"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(c)))


def parse_symbols(c: Column) -> Column:
    """Bodies of ``{...}`` symbols, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"\{([^}]+)\}"), F.lit(1)), F.array().cast("array<string>"))


def _part_value(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]+$"), s.cast("double")).when(F.upper(s).isin("X", "Y", "Z"), F.lit(0.0)).otherwise(F.lit(1.0))


def symbol_value(c: Column) -> Column:
    """Sum of a cost's symbols: numbers count themselves, X, Y, Z nothing, others one, and a hybrid its dearest part."""
    values = F.transform(parse_symbols(c), lambda s: F.array_max(F.transform(F.split(s, "/"), _part_value)))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(c.contains("//"), F.raise_error(F.lit("a cost of two faces has no one value"))).otherwise(total)


def stable_id(*cols: Column, length: int = 32) -> Column:
    """The first hexadecimal digits of the SHA-256 of the columns, joined by bars; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, length)


def parent_number(c: Column) -> Column:
    """613.4a is under 613.4, 613.4 under 613; a chapter has no parent."""
    return F.when(c.rlike("[a-z]$"), F.regexp_replace(c, "[a-z]$", "")).when(c.contains("."), F.split_part(c, F.lit("."), F.lit(1)))


def level_of(c: Column) -> Column:
    return F.when(c.rlike("[a-z]$"), 3).when(c.contains("."), 2).otherwise(1)


def rule_family(c: Column) -> Column:
    """A rule number without its trailing subrule letters (which skip l and o)."""
    return F.regexp_replace(c, "[a-km-np-z]+$", "")


def extract_references(c: Column) -> Column:
    """Numbers named after the word ``rule`` or ``rules``, lists included; first seen first."""
    one = r"[0-9]{3}(?:\.[0-9]+[a-z]?)?"
    runs = F.regexp_extract_all(c, F.lit(rf"(?i)\brules?\s+({one}(?:(?:,\s*(?:and\s+)?|\s+and\s+)(?:rules?\s+)?{one})*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(f"({one})"), F.lit(1)))))


def explicit_citations(c: Column) -> Column:
    """Dotted rule numbers of a text, in order, repeats included."""
    return F.regexp_extract_all(c, F.lit(r"\b([0-9]{3}\.[0-9]+[a-z]?)\b"), F.lit(1))


def spans(c: Column, pattern: str) -> Column:
    """(number, start, end) of each match of a pattern with one group around all of it.

    Matches and what stands between them add up to offsets, so the text is passed over a fixed number of times.
    """
    found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.split(c, pattern)
    pairs = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("number")))
    none = F.array().cast("array<struct<number:string,start:int,end:int>>")
    add = lambda s, p: F.struct(
        (s["at"] + p["gap"] + F.length(p["number"])).cast("int").alias("at"),
        F.concat(s["out"], F.array(F.struct(p["number"].alias("number"), (s["at"] + p["gap"]).cast("int").alias("start"), (s["at"] + p["gap"] + F.length(p["number"])).cast("int").alias("end")))).alias("out"),
    )
    return F.aggregate(F.filter(pairs, lambda p: p["number"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"])


def located(c: Column, pattern: str, width: int = 60) -> Column:
    """(number, start, end, context) of each match as of :func:`spans`; context reaches ``width`` characters to both sides."""
    lead = lambda m: F.greatest(m["start"] - width, F.lit(0))
    around = lambda m: collapse_spaces(F.substring(c, lead(m) + 1, m["end"] + width - lead(m)))
    return F.transform(spans(c, pattern), lambda m: F.struct(m["number"].alias("number"), m["start"].alias("start"), m["end"].alias("end"), around(m).alias("context")))


def located_citations(c: Column) -> Column:
    """Dotted rule numbers with their offsets and the text around them."""
    return located(c, _DOTTED)


def citation_spans(c: Column) -> Column:
    """Dotted rule numbers with their offsets."""
    return spans(c, _DOTTED)


def stated_rules(c: Column) -> Column:
    """Rule numbers that a question states, in order of place: dotted ones, and chapters after a cue word; a stated span isn't taken twice.

    A chapter's three digits must not go on into a dotted number, so no dotted number is overlapped.
    """
    return located(c, r"((?:\b[0-9]{3}\.[0-9]+[a-z]?\b)|(?:(?i)(?<=\brule\s|\bcr\s|\bcomprehensive rules?\s)[0-9]{3}\b(?!\.[0-9])))")


def fold_term(t: Column) -> Column:
    """A light plural stem."""
    n = F.length(t)
    cut = lambda k: F.substring(t, 1, n - k)
    return (
        F.when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(t.rlike("(ses|xes|zes|ches|shes)$") & (n > 4), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss") & (n > 3), cut(1))
        .otherwise(t)
    )


def _words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z']+)"), F.lit(1)), F.array().cast("array<string>"))


def _searched(words: Column) -> Column:
    return F.transform(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)), fold_term)


def terms(c: Column) -> Column:
    """Search terms with repeats: folded words of more than two letters that are no stop words."""
    return _searched(_words(c))


def distinct_terms(c: Column) -> Column:
    """Search terms, each once: repeated words go before they are looked at one by one."""
    return F.array_distinct(_searched(F.array_distinct(_words(c))))


def question_terms(c: Column) -> Column:
    """A question's words but its interrogatives, as they are written; unchanged where nothing would be left."""
    words = F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z'-]+)"), F.lit(1))
    left = F.filter(words, lambda w: ~F.lower(w).isin(*QUESTION_WORDS))
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(c)


def known_references(c: Column, known: Column) -> Column:
    """References of a text that an array of numbers holds, first seen first."""
    return F.array_intersect(extract_references(c), known)


def carries_capitalization(c: Column) -> Column:
    """Whether a word after the first begins with a capital."""
    words = F.split(F.trim(c), r"(?U)\s+")
    return F.exists(F.slice(words, F.lit(2), F.size(words)), lambda w: w.rlike(r"^\p{Lu}"))


def surface_variants(c: Column) -> Column:
    """A surface form, and the form without punctuation at its ends."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"^\p{Punct}+|\p{Punct}+$", "")))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def citation_handles(c: Column) -> Column:
    """Handles of ``[kind:key; ...]`` markers, first seen first."""
    bodies = F.regexp_extract_all(c, F.lit(CITATION_BODY), F.lit(1))
    parts = F.flatten(F.transform(bodies, lambda b: F.transform(F.split(b, ";"), lambda x: F.trim(x))))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def normalize_spacing(c: Column) -> Column:
    """No doubled blanks, none before closing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\s+([.,;:!?])", "$1"))


def strip_citations(c: Column) -> Column:
    return normalize_spacing(F.regexp_replace(c, CITATION_BODY, ""))


def split_sentences(c: Column) -> Column:
    """Sentences: cut at white space after a full stop, question or exclamation mark and before a capital or digit."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"), lambda s: s != "")


def uncited_sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: (s != "") & ~s.rlike(CITATION_BODY))


def parse_indices(c: Column) -> Column:
    """``0,2,5`` or ``0-4`` as an array of integers."""
    ends = lambda p: F.split(p, "-")
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.sequence(ends(p)[0].cast("int"), F.element_at(ends(p), -1).cast("int"))))


def price_for_model(model: Column, prices: list[tuple[str, float, float]]) -> Column:
    """(input, output) price of the first prefix that a model's name begins with; the dearest for others."""
    pair = lambda p: F.struct(F.lit(p[1]).alias("input"), F.lit(p[2]).alias("output"))
    out = F.when(F.lit(False), pair(prices[0]))
    for p in prices:
        out = out.when(model.startswith(p[0]), pair(p))
    return out.otherwise(pair(max(prices, key=lambda p: (p[1], p[2]))))


def json_block(c: Column) -> Column:
    """The outermost object or array in a reply, or null."""
    found = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


def locate_quote(text: Column, quote: Column) -> Column:
    """(start, end) of a quote's first place in a text; null where it isn't there verbatim."""
    at = F.position(quote, text)
    return F.when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(quote)).cast("int").alias("end")))
