"""Graph queries: the nine templates, trees, neighbourhoods, upserts and checks, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import graph as G
from ..operators import templates as T
from .binding import Tables, sql
from .catalogue import register


@register("card_core", sql("cards", "SELECT normalized_name AS asked, card_id, name, type_line, cmc FROM cards"))
def card_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of every asked name; here all names are asked for."""
    cards = Tables(spark, sf_dir).cards()
    return T.card_core(cards.select(F.col("normalized_name").alias("asked")).distinct(), cards)


def keyword_subtrees(t: Tables, keywords: DataFrame) -> DataFrame:
    """(keyword, number, n_sub, first_sub): the rule that defines a keyword, how many descendants it has and the first of them.

    A rule may have very many descendants, so they are counted before the shuffle and not put into arrays.
    """
    tree = G.descendants(t.rules(), 2)
    sub = tree.groupBy(F.col("root").alias("number")).agg(F.count_distinct("number").alias("n_sub"), F.min("number").alias("first_sub"))
    out = keywords.select("keyword").distinct().join(t.defined_by(), "keyword").join(sub, "number", "left")
    return out.select("keyword", "number", F.coalesce("n_sub", F.lit(0)).cast("long").alias("n_sub"), F.coalesce("first_sub", F.lit("")).alias("first_sub"))


_TREE = "tree AS (SELECT parent AS root, number, 1 AS distance FROM rules WHERE parent IS NOT NULL UNION ALL SELECT tree.root, rules.number, distance + 1 FROM tree JOIN rules ON rules.parent = tree.number WHERE distance < {d})"
_SUBS = "SELECT d.keyword, d.number, count(DISTINCT t.number) AS n_sub, coalesce(min(t.number), '') AS first_sub FROM defined_by d LEFT JOIN tree t ON t.root = d.number "


_DEFINED = (
    ", " + _TREE.format(d=3) + ", subs AS (SELECT t.root AS number, count(*) AS n_sub, md5(string_agg(t.number || ':' || r.text, chr(10) ORDER BY t.number || ':' || r.text)) AS subrules FROM tree t JOIN rules r USING (number) GROUP BY 1), "
    "defined AS (SELECT d.keyword, d.number, r.text, coalesce(n_sub, 0) AS n_sub, coalesce(subrules, md5('')) AS subrules FROM defined_by d JOIN rules r USING (number) LEFT JOIN subs USING (number)) "
)


def definitions(t: Tables) -> DataFrame:
    """(keyword, number, text, n_sub, subrules): full definitions, with their subrules as a digest of all numbers and texts."""
    d = T.keyword_definition(t.card_keywords().select("keyword").distinct(), t.defined_by(), t.rules())
    lines = F.transform("subrules", lambda r: F.concat_ws(":", r["number"], r["text"]))
    return d.select("keyword", "number", "text", F.size("subrules").cast("long").alias("n_sub"), F.md5(F.array_join(F.array_sort(lines), "\n")).alias("subrules"))


@register("keyword_definition", sql("card_keywords defined_by rules", _DEFINED + "SELECT * FROM defined"))
def keyword_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions(Tables(spark, sf_dir))


@register("card_legality", sql("cards legal", "SELECT card_id, name, format, status FROM cards JOIN legal USING (card_id)"))
def card_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return T.card_legality(t.cards(), t.legalities())


@register("card_legality_in_format", sql("cards legal", "SELECT card_id, name, format, status FROM cards JOIN legal USING (card_id) WHERE format = 'A'"))
def card_legality_in_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return T.card_legality(t.cards(), t.legalities(), format="A")


@register(
    "deck_legality_violations",
    sql("cards legal", ", decks AS (SELECT DISTINCT l_orderkey AS deck_id, l_partkey AS card_id FROM lineitem) SELECT deck_id, card_id, name, status FROM decks JOIN cards USING (card_id) JOIN legal USING (card_id) WHERE format = 'R' AND status <> 'legal'"),
)
def deck_legality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a deck of its parts: the cards in it that a format doesn't allow."""
    t = Tables(spark, sf_dir)
    decks = t.order_parts().select(F.col("ruling_id").alias("deck_id"), "card_id")
    return T.deck_legality(decks, t.cards(), t.legalities(), "R")


@register("card_keyword_rules", sql("card_keywords defined_by rules", _DEFINED + "SELECT card_id, keyword, number, text, n_sub, subrules FROM card_keywords JOIN defined USING (keyword)"))
def card_keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each card and keyword with the keyword's whole definition, which is made once for each keyword."""
    t = Tables(spark, sf_dir)
    return t.card_keywords().join(definitions(t), "keyword").select("card_id", "keyword", "number", "text", "n_sub", "subrules")


@register(
    "card_rulings",
    sql("hosts rulings cites", ", c AS (SELECT ruling_id, string_agg(DISTINCT number, ';' ORDER BY number) AS cited FROM cites GROUP BY 1) SELECT card_id, ruling_id, text, published_at, coalesce(cited, '') AS cited FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY published_at DESC, ruling_id) AS rn FROM rulings LEFT JOIN c USING (ruling_id)) WHERE rn <= 3"),
)
def card_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest three rulings of each card with the rules that they cite."""
    t = Tables(spark, sf_dir)
    out = T.card_rulings(t.cards().select("card_id"), t.rulings(), t.cites(), limit=3)
    return out.select("card_id", "ruling_id", "text", "published_at", F.array_join("cited", ";").alias("cited"))


@register(
    "card_interaction",
    sql(
        "card_keywords defined_by rules hosts rulings mentions",
        ", m AS (SELECT r.card_id AS host, m.card_id, string_agg(DISTINCT r.ruling_id || ':' || r.text, ';' ORDER BY r.ruling_id || ':' || r.text) AS said FROM rulings r JOIN mentions m USING (ruling_id) GROUP BY 1, 2), pairs AS (SELECT DISTINCT host AS a, card_id AS b FROM m), "
        "sh AS (SELECT a, b, string_agg(DISTINCT x.keyword || ':' || d.number, ';' ORDER BY x.keyword || ':' || d.number) AS shared FROM pairs JOIN card_keywords x ON x.card_id = a JOIN card_keywords y ON y.card_id = b AND x.keyword = y.keyword JOIN defined_by d ON d.keyword = x.keyword GROUP BY 1, 2) "
        "SELECT a, b, coalesce(m1.said, '') AS a_rulings, coalesce(m2.said, '') AS b_rulings, coalesce(shared, '') AS shared FROM pairs LEFT JOIN m m1 ON m1.host = a AND m1.card_id = b LEFT JOIN m m2 ON m2.host = b AND m2.card_id = a LEFT JOIN sh USING (a, b)",
    ),
)
def card_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a ruling's host and a card it mentions: the rulings of each about the other, and shared keywords with their rules."""
    t = Tables(spark, sf_dir)
    about = T.rulings_about(t.rulings(), t.mentions())
    pairs = about.select(F.col("host").alias("a"), F.col("card_id").alias("b"))
    out = T.card_interaction(pairs, about, t.card_keywords(), t.defined_by())
    said = lambda c: F.array_join(F.array_sort(F.transform(c, lambda r: F.concat_ws(":", r["ruling_id"].cast("string"), r["text"]))), ";").alias(c)
    shared = F.array_join(F.array_sort(F.transform("shared", lambda r: F.concat_ws(":", r["keyword"], r["number"]))), ";").alias("shared")
    return out.select("a", "b", said("a_rulings"), said("b_rulings"), shared)


@register("rule_subtree", sql("rules", ", " + _TREE.format(d=3) + " SELECT root, t.number, distance, text FROM tree t JOIN rules USING (number)"))
def rule_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Tables(spark, sf_dir).rules()
    return G.descendants(rules, 3).join(rules.select("number", "text"), "number").select("root", "number", "distance", "text")


@register(
    "rule_neighbourhood",
    sql("rules refs", ", o AS (SELECT src AS number, string_agg(dst || ':' || text, ';' ORDER BY dst || ':' || text) AS outgoing FROM refs JOIN rules ON number = dst GROUP BY 1), i AS (SELECT dst AS number, string_agg(src || ':' || text, ';' ORDER BY src || ':' || text) AS incoming FROM refs JOIN rules ON number = src GROUP BY 1) "
        "SELECT number, text, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming FROM rules LEFT JOIN o USING (number) LEFT JOIN i USING (number)"),
)
def rule_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = T.rule_neighbourhood(t.rules(), t.references())
    said = lambda c: F.array_join(F.array_sort(F.transform(c, lambda r: F.concat_ws(":", r["number"], r["text"]))), ";").alias(c)
    return out.select("number", "text", said("outgoing"), said("incoming"))


def _ball_sql(k: int) -> str:
    return sql(
        "rules refs",
        ", e AS (SELECT src, dst FROM refs UNION SELECT dst, src FROM refs UNION SELECT number, parent FROM rules WHERE parent IS NOT NULL UNION SELECT parent, number FROM rules WHERE parent IS NOT NULL), "
        f"b AS (SELECT number AS seed, number AS node, 0 AS distance FROM rules WHERE level = 2 UNION SELECT seed, dst, distance + 1 FROM b JOIN e ON src = node WHERE distance < {k}) "
        "SELECT seed, node, min(distance) AS distance FROM b GROUP BY 1, 2",
    )


def rule_ball(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    """Balls around the rules of level 2, a stated set of seeds, over all rules."""
    t = Tables(spark, sf_dir)
    rules = t.rules()
    adjacency = G.undirected(t.references(), rules.where("parent is not null").select(F.col("number").alias("src"), F.col("parent").alias("dst")))
    return G.ball(rules.where("level = 2").select(F.col("number").alias("seed")), adjacency, hops)


for _k in (1, 2, 3):
    register(f"khop_ball_{_k}", _ball_sql(_k))(lambda spark, sf_dir, k=_k: rule_ball(spark, sf_dir, k))


@register(
    "reachability_by_stratum",
    "WITH RECURSIVE " + _ball_sql(2).split("WITH RECURSIVE ", 1)[1].rsplit("SELECT seed, node, min", 1)[0]
    + ", d AS (SELECT DISTINCT seed, node FROM b), s AS (SELECT seed, count(*) AS size FROM d GROUP BY 1), j AS (SELECT split_part(seed, '.', 1) AS stratum, size, row_number() OVER (PARTITION BY split_part(seed, '.', 1) ORDER BY size) - 1 AS rn, count(*) OVER (PARTITION BY split_part(seed, '.', 1)) AS n FROM s) "
    "SELECT stratum, max(n) AS n_seeds, sum(CASE WHEN size >= 10 THEN 1 ELSE 0 END) AS n_wide, max(CASE WHEN rn = n // 2 THEN size END) AS median_size FROM j GROUP BY 1",
)
def reachability_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = rule_ball(spark, sf_dir, 2).groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    rows = size.withColumn("stratum", F.split_part("seed", F.lit("."), F.lit(1)))
    wide = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_seeds"), F.count_if(F.col("size") >= 10).alias("n_wide"))
    middle = V.order_statistics(rows, "stratum", "size", {"median_size": lambda n: F.floor(n / 2)}).select("stratum", "median_size")
    return wide.join(middle, "stratum").select("stratum", "n_seeds", "n_wide", "median_size")


@register(
    "graph_stats",
    sql("cards card_keywords rules refs legal", "SELECT 'node' AS kind, 'card' AS name, count(*) AS n FROM cards UNION ALL SELECT 'node', 'rule', count(*) FROM rules UNION ALL SELECT 'edge', 'has_keyword', count(*) FROM card_keywords UNION ALL SELECT 'edge', 'references', count(*) FROM refs UNION ALL SELECT 'edge', 'has_legality', count(*) FROM legal"),
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return G.Graph({"card": t.cards(), "rule": t.rules()}, {"has_keyword": t.card_keywords(), "references": t.references(), "has_legality": t.legalities()}).stats()


@register(
    "withdrawn_rules",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'withdrawn' ELSE 'reworded' END AS change FROM customer WHERE c_custkey % 7 = 0 OR c_mktsegment = 'BUILDING'",
)
def withdrawn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Tables(spark, sf_dir).t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), "c_mktsegment")
    reworded = F.when(F.col("c_mktsegment") == "BUILDING", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = old.where("id % 7 <> 0").withColumn("text", reworded)
    return G.version_diff(old, new, "id", "text")


@register("merge_last_wins", "SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (WHERE value >= 20), 'none') AS event_type, coalesce(max(event_id) FILTER (WHERE value >= 20), -1) AS event_id FROM events WHERE user_id % 2 = 0 OR value >= 20 GROUP BY 1")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onto a snapshot of half of the users: some are replaced, some stay, some are new."""
    e = Tables(spark, sf_dir).t("events").select("user_id", "event_type", "event_id", "value")
    old = e.where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit("none").alias("event_type"), F.lit(-1).cast("long").alias("event_id"))
    return G.merge_last(old, e.where("value >= 20").drop("value"), "user_id", "event_id")


@register("merge_first_wins", "SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type FROM events GROUP BY 1")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).t("events").select("user_id", "event_type", "event_id")
    return G.merge_first(e.where("false").select("user_id", "event_type"), e, "user_id", "event_id", "event_type")


@register("insert_only_edges", "SELECT src, dst, arg_min(ord, (k, ord)) AS ord FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey AS ord, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS k FROM lineitem) GROUP BY 1, 2")
def insert_only_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Tables(spark, sf_dir).t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("ord"), "l_returnflag")
    cols = ["src", "dst", "ord"]
    old = li.where("l_returnflag = 'A'").groupBy("src", "dst").agg(F.min("ord").alias("ord")).select(*cols)
    return G.insert_only(old, li.where("l_returnflag <> 'A'").select(*cols), ["src", "dst"], "ord")


@register("valid_edges", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' JOIN part ON l_partkey = p_partkey AND p_size < 10")
def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    edges = t.t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return G.valid_edges(edges, t.t("orders").where("o_orderstatus = 'F'"), "o_orderkey", t.t("part").where("p_size < 10"), "p_partkey")


@register("prune_stale", "SELECT p_partkey AS id FROM part WHERE p_brand IS NULL OR p_brand = 'Brand#11' OR p_size IS NULL")
def prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).t("part")
    return G.prune(part, "Brand#11", "p_brand").select(F.col("p_partkey").alias("id"))


@register("ruling_sample", sql("hosts rulings", "SELECT card_id, count(*) AS n, min(ruling_id) AS first_id FROM rulings GROUP BY 1"))
def ruling_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Tables(spark, sf_dir).rulings()
    return r.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), F.min("ruling_id").alias("first_id"))
