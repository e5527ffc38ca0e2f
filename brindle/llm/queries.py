"""Driver queries of the training-data operators: thin, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii

    found = find_pii(_table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_language

    good = _table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return score_language(_table(spark, sf_dir, "documents"), good)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"), digest=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import grades_of, score_toxicity, train

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, grades_of(_table(spark, sf_dir, "labels"))))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

#: Exact similarity join by prefix filtering: two sets of similarity 0.8 or more share one of their rarest shingles.
NEAR_DUPLICATES_SQL = (
    f"WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents), "
    "s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0))), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT s, count(*) AS df FROM s GROUP BY 1), "
    "r AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS rn FROM s JOIN f USING (s) JOIN n USING (doc_id)), "
    "p AS (SELECT * FROM r WHERE rn <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1), "
    "c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)), "
    "l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))), "
    "e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a AS doc_id, b AS x FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.x), "
    "m AS (SELECT doc_id, min(x) AS x FROM reach GROUP BY 1) "
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.x, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.x, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"
)

SUBSTRING_DEDUP_SQL = (
    f"WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), "
    "i AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35), v AS (SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM i), "
    "g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS at FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)), "
    "a AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS at FROM w), "
    "k AS (SELECT a.r, count(g.at) AS n_removed, string_agg(CASE WHEN g.at IS NULL THEN a.x END, ' ' ORDER BY a.at) AS kept FROM a LEFT JOIN g ON g.r = a.r AND g.at = a.at GROUP BY 1) "
    "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)"
)


#: CRC-32 of a text's bytes, eight steps a byte.
_CRC32 = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda j: CAST(ascii(substr({0}, CAST(j AS INTEGER), 1)) AS BIGINT))), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)

#: Every conversation's beginnings as rows; a node's subtree is found through the beginnings of its descendants' smallest members.
PREFIX_TRIE_SQL = (
    "WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL), "
    f"h AS (SELECT c, c - c % 100 AS r, {_CRC32.format('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM o)), "
    "b AS (SELECT h.c, 0 AS part, p, role, text FROM h JOIN o ON o.c = r WHERE p <= h UNION ALL SELECT h.c, 1, p, role, text FROM h JOIN o ON o.c = h.c WHERE p > h), "
    "l AS (SELECT h.c, coalesce(ts, []) AS ts, coalesce(ns, []) AS ns FROM h LEFT JOIN (SELECT c, list(md5(length(role) || ':' || role || text) ORDER BY part, p) AS ts, list(length(text) ORDER BY part, p) AS ns FROM b GROUP BY 1) USING (c)), "
    "x AS (SELECT c, d, len(ts) AS n, md5(array_to_string(ts[1:d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ts[1 : d - 1], '')) END AS up, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS chars FROM (SELECT c, ts, ns, unnest(range(0, len(ts) + 1)) AS d FROM l)), "
    "v AS (SELECT d, k, min(up) AS up, min(c) AS lo, count(*) AS n, (count(*) - 1) * min(chars) AS own, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM x GROUP BY 1, 2), "
    "y AS (SELECT d, up AS k, count(*) AS kids FROM v WHERE up IS NOT NULL GROUP BY 1, 2), "
    "w AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN y ON y.d = v.d + 1 AND y.k = v.k), "
    "s AS (SELECT a.d, a.k, count(*) FILTER (WHERE w.kids = 0) AS leaves, sum(w.own) AS saved FROM w JOIN x a ON a.c = w.lo AND a.d <= w.d GROUP BY 1, 2) "
    "SELECT w.lo AS conv_id, w.d AS depth, u.lo AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256 "
    "FROM w JOIN s ON s.d = w.d AND s.k = w.k LEFT JOIN w u ON u.d = w.d - 1 AND u.k = w.up"
)

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH_SQL = (
    f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents), q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark), "
    "c AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0), "
    "p AS (SELECT r, doc_id, n, x, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS x FROM d) GROUP BY ALL), "
    "w AS (SELECT x, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY x, nn), "
    "a AS (SELECT q, item_id, x, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS x FROM q) GROUP BY ALL), "
    "s AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM a JOIN p USING (x) JOIN w USING (x), c GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rn FROM s WHERE score > 0) "
    "SELECT item_id, CAST(rn AS INTEGER) AS rank, doc_id, score FROM k WHERE rn <= 10"
)


def oracle_sql() -> dict[str, str]:
    """SQL where it gives a query's whole result: not for tokenizers, trained models, tilings and fingerprints."""
    return {"op4_near_duplicates": NEAR_DUPLICATES_SQL, "op9_substring_dedup": SUBSTRING_DEDUP_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL, "op13_ranked_search": RANKED_SEARCH_SQL}
