from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_names(spark):
    assert values(spark, ["  Ærn   Hall ", "Mar-Tûn’s Gate", "Straße"], T.normalize_name) == ["aern hall", "mar-tun's gate", "strasse"]
    assert values(spark, ["Mar-Tûn’s Gate", "A+ B"], T.loose_name) == ["martuns gate", "a b"]


def test_faces(spark):
    assert values(spark, ["Wind // Rain", "Solo", "//"], T.split_faces) == [["Wind", "Rain"], ["Solo"], ["//"]]


def test_symbols(spark):
    assert values(spark, ["{2}{W/U}{X}", None, ""], T.parse_symbols) == [["2", "W/U", "X"], [], []]
    assert values(spark, ["{2}{W}{W}", "{X}{R}", "{2/W}{G/P}", "{10}", ""], T.symbol_value) == [4.0, 1.0, 3.0, 10.0, 0.0]
    with pytest.raises(Exception, match="two faces"):
        values(spark, ["{1} // {2}"], T.symbol_value)


def test_rule_numbers(spark):
    assert values(spark, ["613.4a", "613.4", "613"], T.parent_number) == ["613.4", "613", None]
    assert values(spark, ["613.4a", "613.4", "613"], T.level_of) == [3, 2, 1]
    assert values(spark, ["613.4a", "613.4l"], T.rule_family) == ["613.4", "613.4l"]


def test_references(spark):
    said = ["See rules 101.1, 102.2a and 103, then rule 101.1. Not 999.9."]
    assert values(spark, said, T.extract_references) == [["101.1", "102.2a", "103"]]
    assert values(spark, ["a 702.9b b 702.9b"], T.explicit_citations) == [["702.9b", "702.9b"]]


def test_terms(spark):
    assert values(spark, ["The studies of dragons, boxes and glass", None], T.terms) == [["study", "dragon", "box", "glass"], []]
    assert values(spark, ["What is the stack?", "Who?"], T.question_terms) == ["the stack", "Who?"]


def test_sentences_and_markers(spark):
    assert values(spark, ["Rule 613.4 applies. It wins! 2 more"], T.split_sentences) == [["Rule 613.4 applies.", "It wins!", "2 more"]]
    assert values(spark, ["It is [rule:1; card:x] so [rule:1] ."], T.citation_handles) == [["rule:1", "card:x"]]
    assert values(spark, ["It is [rule:1]  so ."], T.strip_citations) == ["It is so."]
    assert values(spark, ["One [rule:1]. Two."], T.uncited_sentences) == [["Two."]]


def test_small_ones(spark):
    assert values(spark, ["abc", "x" * 9, ""], T.estimate_tokens) == [1, 2, 1]
    assert values(spark, ["0,2,5", "0-3"], T.parse_indices) == [[0, 2, 5], [0, 1, 2, 3]]
    assert values(spark, ["What does Bolt do", "what now"], T.carries_capitalization) == [True, False]
    assert values(spark, ["'Bolt'", "x"], T.surface_variants) == [["'Bolt'", "Bolt"], ["x"]]


def test_replies(spark):
    assert values(spark, ['Sure: {"a": [1]} ok', "none"], T.json_block) == ['{"a": [1]}', None]
    got = values(spark, ["see rule 1 here", "no"], lambda c: T.locate_quote(c, F.lit("rule 1")))
    assert got[0]["start"] == 4 and got[0]["end"] == 10 and got[1] is None
    prices = [("small-mini", 0.1, 0.2), ("small", 1.0, 2.0), ("large", 9.0, 9.5)]
    got = values(spark, ["small-mini-2", "small-3", "other"], lambda c: T.price_for_model(c, prices))
    assert [tuple(r) for r in got] == [(0.1, 0.2), (1.0, 2.0), (9.0, 9.5)]


def test_fold_for_any_script(spark):
    """Equal to the standard library on code points of all planes, and on texts of ASCII alone, empty and null ones."""
    import unicodedata

    codes = [c for c in (*range(0x20, 0x3000, 7), *range(0x3000, 0x10000, 53), *range(0xAC00, 0xD7A4, 97), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF60), *range(0x10000, 0x2FFFF, 4099)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b" for c in codes] + ["plain", "", None, "ＡＢＣ ﬁ 각 é e\u0301", "Æther ‘x’"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fold_any(F.col("t")).alias("f")).collect()
    table = str.maketrans(dict(T.LIGATURES + T.TYPOGRAPHY))
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.translate(table)) if not unicodedata.combining(c))
    assert {r["i"]: r["f"] for r in got} == {i: None if t is None else fold(t) for i, t in enumerate(texts)}


def test_spans_are_those_of_located_matches(spark):
    texts = ["by 100.1, not 702.19b or 12.3", "", None, "é 100.2 é", "100.1100.2 100.3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", T.citation_spans(F.col("t")).alias("s"), T.located_citations(F.col("t")).alias("l")).collect()
    plain = lambda c: None if c is None else [(x["number"], x["start"], x["end"]) for x in c]
    assert [plain(r["s"]) for r in sorted(got)] == [plain(r["l"]) for r in sorted(got)]
    assert plain(min(got)["s"]) == [("100.1", 3, 8), ("702.19b", 14, 21)]
