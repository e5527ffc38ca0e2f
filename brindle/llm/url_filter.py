"""URL filter by a ratio of character Markov models, after explicit host and path rules.  Native: no Python on executors.

Two smoothed variable-order models (orders 0 to ``ORDER``, interpolated as Witten and Bell do, so a context never seen leaves the
word to the shorter one) are counted from labelled URLs: accepted ones fit an ``allow`` rule; rejected ones fit a ``block`` rule, or no
rule and a word of ``seeds`` in the host.  Training, calibration and judging all see the same text, the whole URL behind its scheme, so what the rules say about
domains and paths carries over to URLs that no rule fits.  Characters are folded to ``ALPHABET`` (digits to ``0``, others to ``*``): a model
is a dense table of exactly ``len(ALPHABET) ** (ORDER + 1)`` rows of 12 bytes, whatever the input: the proven bound under which it is broadcast.

A URL's score is the mean over its characters (without the scheme) of log P(accepted) - log P(rejected); repeated texts are scored once.  Every fifth labelled text,
by its hash, is held out of the counts.  The threshold lies where the shares of held-out accepted URLs below it and of held-out rejected URLs above it are least together, in the
middle of the gap between scores there; with fewer than ``LEAST_HELD_OUT`` held-out URLs of a kind it is 0, where both models are equally likely.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and the score of all its
characters (a null or empty one scores 0); without labelled URLs of both kinds every verdict without a rule is
``allow``; of equally long rules the first wins; a score at the threshold is allowed; of equally good thresholds the lowest is taken; repeated rows and ids stay repeated; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, pick, written

#: Letters, any digit, three marks, any other character, start and end.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-*^$"
ORDER = 3
SIZE = len(ALPHABET)
HELD_OUT = 5
LEAST_HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Words that mark a host as rejected for training where no rule fits: gambling, drugs, adult content, piracy and fraud.
DEFAULT_SEEDS = (
    "casino", "bets", "betting", "poker", "roulette", "jackpot", "slots", "lotto",
    "pills", "pharma", "viagra", "cialis", "tramadol", "steroid",
    "porn", "xxx", "escort", "camgirl", "hookup", "nude",
    "torrent", "warez", "cracked", "keygen", "serialkey",
    "payday", "quickloan", "replica", "clickbait", "phish", "malware",
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = after_scheme(url)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_index(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Index of the longest rule that fits, -1 for none; of two rules of one length the first in order wins."""
    out = None
    for i, r in sorted(enumerate(rules), key=lambda x: (-len(x[1].name), x[0])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def _folded(text: Column) -> Column:
    """Folded to the alphabet, after ``ORDER`` start marks and before an end mark; empty for an empty text."""
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(text), "[0-9]", "0"), "(?s)[^a-z0./\\-]", "*")
    return F.when(plain == "", plain).otherwise(F.concat(F.lit("^" * ORDER), plain, F.lit("$")))


def _codes(folded: Column) -> Column:
    """Places in the alphabet of the characters of a folded text."""
    table = F.array(*[F.lit(max(ALPHABET.find(chr(i)), 0)) for i in range(128)])
    return F.transform(F.slice(F.split(folded, ""), F.lit(1), F.length(folded)), lambda c: F.get(table, F.ascii(c)))


def _grams(codes: Column) -> Column:
    """Numbers of the runs of ``ORDER + 1`` characters."""
    n = F.greatest(F.size(codes) - ORDER, F.lit(0))
    out = F.slice(codes, F.lit(1), n)
    for k in range(1, ORDER + 1):  # neighbours side by side: no look-up by place within a lambda, which would make the array anew each time
        out = F.zip_with(out, F.slice(codes, F.lit(k + 1), n), lambda a, b: a * SIZE + b)
    return out


def _ratios(counts: DataFrame) -> DataFrame:
    """The dense table of log ratios: a row (g, ratio) for each of ``SIZE ** (ORDER + 1)`` runs of characters."""
    out = counts.sparkSession.range(SIZE ** (ORDER + 1)).select(F.col("id").cast("int").alias("g"))
    for k in range(ORDER + 1):  # of the last k + 1 characters
        key, ctx = (F.col("g") % SIZE ** (k + 1)).alias(f"g{k}"), F.floor((F.col("g") % SIZE ** (k + 1)) / SIZE).cast("int").alias(f"c{k}")
        cells = counts.groupBy(key).agg(F.sum("acc").alias(f"acc{k}"), F.sum("rej").alias(f"rej{k}"))
        sums = [f(F.col(f"{x}{k}")).alias(f"{x}{k}_{tag}") for x in ("acc", "rej") for tag, f in (("n", F.sum), ("t", lambda c: F.count_if(c > 0)))]
        totals = cells.groupBy(F.floor(F.col(f"g{k}") / SIZE).cast("int").alias(f"c{k}")).agg(*sums)
        # Both have at most one row for each number of the table.
        out = out.withColumns({f"g{k}": key, f"c{k}": ctx}).join(F.broadcast(cells), f"g{k}", "left").join(F.broadcast(totals), f"c{k}", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    logs = {}
    for x in ("acc", "rej"):
        p = F.lit(1.0 / SIZE)
        for k in range(ORDER + 1):
            den = zero(f"{x}{k}_n") + zero(f"{x}{k}_t")
            p = F.when(den > 0, (zero(f"{x}{k}") + zero(f"{x}{k}_t") * p) / den).otherwise(p)
        logs[x] = F.log(p)
    both = (zero("acc0_n") > 0) & (zero("rej0_n") > 0)
    return out.select("g", F.round(F.when(both, logs["acc"] - logs["rej"]).otherwise(F.lit(0.0)), 9).alias("ratio"))


def _scores(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(key, score) of folded texts ``s``: a row of a few bytes for each character, taken together again within the task that made it."""
    # Outer explodes: of an inner one Spark infers a filter on the array's size, which would make the array twice.
    rows = texts.select(_key(F.col("s")).alias("key"), F.explode_outer(_grams(_codes(F.col("s")))).alias("g")).where("g is not null")
    total = F.sum(F.col("ratio").cast("decimal(28,9)")).cast("double")
    return rows.join(F.broadcast(ratios), "g").groupBy("key").agg(F.round(total / F.count(F.lit(1)), 9).alias("score"))


def _key(s: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(1), s).alias("b"))


@dataclass(frozen=True)
class Calibration:
    """A threshold (null without labelled URLs of both kinds), and the shares of held-out URLs of each kind that it puts on the wrong side."""

    threshold: float | None
    accepted_blocked: float | None = None
    rejected_allowed: float | None = None


def calibrate(held_out: DataFrame, both: bool) -> Calibration:
    """From held-out (acc, rej, score); scores are thousandths, so a bounded number of values reaches the driver.  ``both``: there are trained URLs of both kinds."""
    if not both:
        return Calibration(None)
    rows = held_out.groupBy(F.round("score", 3).alias("score")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")).orderBy("score").collect()
    accepted, rejected = sum(r["acc"] for r in rows), sum(r["rej"] for r in rows)

    def wrong(cut: float) -> tuple[float, float]:
        return sum(r["acc"] for r in rows if r["score"] < cut) / max(accepted, 1), sum(r["rej"] for r in rows if r["score"] >= cut) / max(rejected, 1)

    if min(accepted, rejected) < LEAST_HELD_OUT:
        return Calibration(0.0, *wrong(0.0))
    below, above, best = 0, rejected, None
    for i, r in enumerate(rows):
        error = below / accepted + above / rejected
        if best is None or error < best[0]:
            best = error, (rows[max(i - 1, 0)]["score"] + r["score"]) / 2
        below, above = below + r["acc"], above - r["rej"]
    if below / accepted + above / rejected < best[0]:
        best = 0.0, rows[-1]["score"] + 0.001
    return Calibration(best[1], *wrong(best[1]))


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    id_col: str = "page_id",
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    seeds: tuple[str, ...] = DEFAULT_SEEDS,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, score, the threshold used (null without one) and its held-out errors of both kinds."""
    base = pick(pages, id=id_col, url=url_col)
    host, path = split_url(F.col("url"))
    base = base.select("id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("k", rule_index(F.col("host"), F.col("path"), rules))
    named = lambda values: F.when(F.col("k") >= 0, F.get(F.array(*[F.lit(v) for v in values]), F.col("k"))) if values else F.lit(None)
    base = base.withColumns({"rule": named([r.name for r in rules]).cast("string"), "ruled": named([r.verdict for r in rules]).cast("string")})
    seeded = F.lit(False)
    for w in seeds:
        seeded = seeded | F.col("host").contains(w)
    label = F.when(F.col("ruled") == "allow", "acc").when((F.col("ruled") == "block") | (F.col("k") < 0) & seeded, "rej")
    whole = F.when(F.instr("url", "://") > 0, after_scheme(F.col("url"))).otherwise(F.coalesce("url", F.lit("")))
    base = base.withColumn("s", _folded(whole))
    labelled = base.where(label.isNotNull() & (F.col("s") != "")).select((label == "acc").cast("int").alias("acc"), (label == "rej").cast("int").alias("rej"), "s")
    # A row for each distinct text: hot texts are counted before the shuffle.
    labelled = written(labelled.groupBy("s").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")))
    held_out = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    trained = labelled.where(~held_out)
    counts = trained.select("acc", "rej", F.explode_outer(_grams(_codes(F.col("s")))).alias("g")).where("g is not null").groupBy("g").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    ratios = written(_ratios(written(counts)))
    texts = base.where("s <> ''").select("s").distinct()
    # Written before it is joined: a text of very many URLs is then one large partition of its side, which Spark can split.
    scores = written(_scores(texts, ratios))
    kinds = trained.agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")).first()
    found = calibrate(labelled.where(held_out).select("acc", "rej", _key(F.col("s")).alias("key")).join(scores, "key"), bool(kinds["acc"] and kinds["rej"]))
    out = base.withColumn("key", _key(F.col("s"))).join(scores, "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cut = found.threshold
    method = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score", F.lit(cut).cast("double").alias("threshold"),
        F.lit(found.accepted_blocked).cast("double").alias("accepted_blocked"), F.lit(found.rejected_allowed).cast("double").alias("rejected_allowed"),
    )
