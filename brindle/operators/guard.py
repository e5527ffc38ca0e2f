"""Guard for generated SQL: read-only, one statement, no parameters left, bounded, with citable columns.

Text is looked at only for what never reaches a plan (comments, several statements, the opening word).  Everything else is asked of Spark's own trees: the parsed plan, before names are looked up, and the analysed one, before anything runs.  Each node and expression
has to be on a list, so what nobody thought of is refused, and a name, an alias or a string that looks like a clause isn't.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
CITABLE = ("key", "text")
#: Functions that a query may call; nothing that reaches classes, files or the session.
FUNCTIONS = frozenset(
    "abs array array_contains array_distinct array_join array_sort array_union avg cast ceil char_length coalesce collect_list collect_set concat concat_ws contains count count_if date_format "
    "dense_rank element_at endswith exists explode explode_outer filter first first_value flatten floor format_string greatest if ifnull initcap instr isnull lag last last_value lead least left "
    "length levenshtein like lower lpad ltrim map max max_by mean median min min_by mod named_struct nullif nvl percentile posexplode power rank range regexp_count regexp_extract regexp_extract_all regexp_like "
    "regexp_replace replace reverse right rlike round row_number rpad rtrim size sort_array split split_part sqrt startswith string struct substr substring sum to_date to_timestamp transform translate trim upper year month day "
    "int bigint double float decimal date timestamp boolean".split()
)
#: Nodes of a parsed plan: queries and what they are made of, names not yet looked up.
PARSED = frozenset(
    "UnresolvedWith UnresolvedRelation UnresolvedTableValuedFunction UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedHaving SubqueryAlias Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct "
    "Union Intersect Except Window WithWindowDefinition Generate OneRowRelation LocalRelation Pivot Unpivot LateralJoin Sample".split()
)
#: Nodes of an analysed plan.  Tables must have been given to the session by name; a view's own plan is its owner's matter and isn't looked into.
ANALYSED = frozenset(
    "WithCTE CTERelationDef CTERelationRef SubqueryAlias Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Window Generate OneRowRelation LocalRelation View LogicalRelation HiveTableRelation Range LateralJoin Expand Sample".split()
)
TABLE_FUNCTIONS = frozenset({"range"})
#: Expressions that queries are made of besides function calls.
GRAMMAR = frozenset(
    "Alias MultiAlias AttributeReference OuterReference Literal TypedNullLiteral Cast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual IsNull IsNotNull In InSubquery ListQuery ScalarSubquery Exists LateralSubquery Between Like LikeAll LikeAny "
    "NotLikeAll ILike RLike Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive CaseWhen If SortOrder AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ "
    "LambdaFunction NamedLambdaVariable GetStructField GetArrayItem GetArrayStructFields GetMapValue ElementAt CreateNamedStruct CreateStruct Explode PosExplode GeneratorOuter RowFrame$ RangeFrame$ Grouping GroupingID Concat VirtualColumn NamedExpression NamePlaceholder$".split()
)
_SUBQUERIES = frozenset({"ListQuery", "ScalarSubquery", "Exists", "LateralSubquery"})
_WRITES = {"InsertIntoStatement": "insert", "MergeIntoTable": "merge", "DeleteFromTable": "delete", "UpdateTable": "update"}


#: Readers of files by path.
FORMATS = frozenset("parquet csv json orc text avro binaryfile delta jdbc xml".split())


@dataclass(frozen=True)
class Refusal(Exception):
    reason: str

    def __str__(self) -> str:
        return self.reason


def _bare(query: str) -> str:
    """The query without the bodies of its string literals."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", query)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _each(sequence) -> Iterator:
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _is(spark: SparkSession, node, name: str) -> bool:
    return spark._jvm.java.lang.Class.forName(name, False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()).isInstance(node)


def _expressions(spark: SparkSession, e, see: Callable, into: Callable) -> None:
    """Every expression below ``e``, and the plans of its subqueries.  Of one that Spark rewrites later what it was called with counts, not what it is rewritten to."""
    see(e)
    if _kind(e) in _SUBQUERIES:
        into(e.plan())
    rewritten = _is(spark, e, "org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules")
    for child in _each(e.parameters() if rewritten else e.children()):
        _expressions(spark, child, see, into)


def _walk(spark: SparkSession, plan, node: Callable, see: Callable) -> None:
    """Every node of a plan, its named and nested subqueries included; ``node`` says whether to go on below."""
    into = lambda p: _walk(spark, p, node, see)
    if not node(plan):
        return
    for e in _each(plan.expressions()):
        _expressions(spark, e, see, into)
    for child in _each(plan.children()):
        into(child)
    if _kind(plan) == "UnresolvedWith":
        for child in _each(plan.innerChildren()):
            into(child)


def check_parsed(spark: SparkSession, plan) -> None:
    """Refuse statements that aren't queries, functions that aren't allowed, parameters, and relations that are files."""

    def node(p) -> bool:
        kind = _kind(p)
        if kind in _WRITES:
            raise Refusal(f"write clause {_WRITES[kind]}")
        if "Command" in kind or kind not in PARSED:
            raise Refusal("command" if "Command" in p.getClass().getName() else f"clause {kind}")
        if kind == "UnresolvedRelation":
            parts = list(_each(p.multipartIdentifier()))
            if any(re.search(r"[/\\:]", x) for x in parts) or (len(parts) == 2 and parts[0].lower() in FORMATS):
                raise Refusal("direct file")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_each(p.name()))
            if name.lower() not in TABLE_FUNCTIONS | FUNCTIONS:
                raise Refusal(f"function {name}")
        return True

    def see(e) -> None:
        kind = _kind(e)
        if kind in ("NamedParameter", "PosParameter"):
            raise Refusal("unbound parameter")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = list(_each(e.nameParts())) if kind == "UnresolvedFunction" else [e.name().unquotedString()]
            if len(parts) > 1 or parts[0].lower() not in FUNCTIONS:
                raise Refusal(f"function {'.'.join(parts)}")

    _walk(spark, plan, node, see)


def _allowed_classes(spark: SparkSession) -> frozenset[str]:
    """Classes of the allowed functions, as the session's registry has them."""
    catalog, name = spark._jsparkSession.sessionState().catalog(), spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    out = set()
    for f in FUNCTIONS:
        try:
            out.add(catalog.lookupFunctionInfo(name(f)).getClassName().rsplit(".", 1)[-1].removesuffix("ExpressionBuilder"))
        except Exception:  # noqa: BLE001, S112 - a word that isn't a function of this version
            continue
    return frozenset(out)


def check_analysed(spark: SparkSession, plan, tables: frozenset[str] | None = None) -> None:
    """Refuse nodes and expressions that aren't on the lists, tables without a name, and with ``tables`` those of other names."""
    classes = GRAMMAR | _allowed_classes(spark)

    def node(p) -> bool:
        kind = _kind(p)
        if kind not in ANALYSED:
            raise Refusal(f"clause {kind}")
        if kind == "View":
            if tables is not None and p.desc().identifier().table().lower() not in tables:
                raise Refusal(f"table {p.desc().identifier().table()}")
            return False
        if kind == "LogicalRelation":
            if not p.catalogTable().isDefined():
                raise Refusal("direct file")
            if tables is not None and p.catalogTable().get().identifier().table().lower() not in tables:
                raise Refusal(f"table {p.catalogTable().get().identifier().table()}")
        return True

    def see(e) -> None:
        if _kind(e) not in classes:
            raise Refusal(f"function {e.prettyName()}")

    _walk(spark, plan, node, see)


def validated(spark: SparkSession, query: str, tables: frozenset[str] | None = None) -> DataFrame:
    """The query's result, lazily, or a ``Refusal`` with a named reason; nothing is run before every check has passed.

    Commands would run at once in ``spark.sql``, so the parsed plan is checked before it is analysed.
    """
    body = _bare(query).strip()
    if "--" in body or "/*" in body:
        raise Refusal("comment")
    if ";" in body.rstrip(";"):
        raise Refusal("several statements")
    body, query = body.rstrip(";").strip(), query.strip().rstrip(";").strip()
    if not re.match(r"(?is)^(select|with)\b", body):
        raise Refusal("opener")
    if re.search(r"(?<!:)[$:][A-Za-z_]\w*|\?", body):
        raise Refusal("unbound parameter")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise Refusal("syntax") from e
    check_parsed(spark, plan)
    try:
        df = spark.sql(query)
    except Exception as e:
        raise Refusal("analysis") from e
    check_analysed(spark, df._jdf.queryExecution().analyzed(), tables)
    if missing := set(CITABLE) - set(df.columns):
        raise Refusal(f"no column {sorted(missing)[0]}")
    tail = re.search(r"(?is)\blimit\s+(\d+)\s*$", body)
    return df.limit(min(int(tail[1]), MAX_LIMIT) if tail else DEFAULT_LIMIT)


def evidence(spark: SparkSession, query: str, question_id: str) -> DataFrame:
    """The rows of a checked query as evidence rows."""
    rows = validated(spark, query)
    return rows.select(
        F.lit(question_id).alias("question_id"), F.monotonically_increasing_id().alias("arrival"), F.lit("rule").alias("kind"), F.col("key").cast("string").alias("key"),
        F.col("text").cast("string").alias("text"), F.lit("generated").alias("template"), F.lit("generated").alias("path"), F.lit(1).alias("distance"),
    )
