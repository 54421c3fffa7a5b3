"""Raw SQL as an entry: one SELECT over registered tables, with Spark's own functions. Spark's parser reads the text, and
what it makes of it is walked before anything is resolved: so comments, quotes and names put together of literals can't
hide what would run. Whatever is not known to be harmless is refused."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans.errors import QueryError

#: What a SELECT is parsed to. No command, script, name by expression or table function is among it.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases
    UnresolvedRelation UnresolvedWith CTERelationDef Union Except Intersect OneRowRelation WithWindowDefinition UnresolvedHaving
    UnresolvedInlineTable LocalRelation Generate Pivot Unpivot Sample LateralSubquery Window""".split()
)
#: Groups of Spark's functions that compute from their arguments alone, and harmless ones of other groups.
GROUPS = frozenset(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs
    hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs
    window_funcs xml_funcs""".split()
)
FUNCTIONS = frozenset("typeof equal_null kll_sketch_get_quantile_double kll_sketch_get_n_double hll_sketch_estimate hll_union theta_sketch_estimate theta_union".split())
#: Table functions that may stand in FROM.
TABLES = frozenset("range explode explode_outer inline inline_outer posexplode posexplode_outer stack".split())


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _walk(x) -> Iterator:
    """The nodes of a plan and of its expressions, those of subqueries among them."""
    todo = [x]
    while todo:
        x = todo.pop()
        yield x
        todo += _seq(x.children())
        todo += _seq(x.innerChildren())  # those of WITH
        if _is(x, "plans.logical.LogicalPlan"):
            todo += _seq(x.expressions())
        elif _is(x, "expressions.SubqueryExpression"):
            todo.append(x.plan())


def _is(x, name: str) -> bool:
    kind = x.getClass()
    while kind is not None:
        if kind.getName().endswith(f"catalyst.{name}"):
            return True
        kind = kind.getSuperclass()
    return False


def _function(spark: SparkSession, parts: list[str]) -> None:
    name = parts[-1].lower()
    if len(parts) > 1 and [p.lower() for p in parts[:-1]] not in (["builtin"], ["system", "builtin"]):
        raise QueryError(f"the function {'.'.join(parts)} is not allowed")
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    registry = spark._jsparkSession.sessionState().functionRegistry()
    info = registry.lookupFunction(identifier)
    # Functions that a session has registered have another class, or hide one of Spark's.
    if info.isEmpty() or not info.get().getClassName().startswith("org.apache.spark.sql.catalyst.expressions.") or info.get().getGroup() not in GROUPS and name not in FUNCTIONS:
        raise QueryError(f"the function {name} is not allowed")


def _relation(spark: SparkSession, parts: list[str], known: set[str]) -> None:
    if len(parts) == 1 and parts[0].lower() in known:
        return
    if any(c in p for p in parts for c in "/:\\*?") or len(parts) > 2 or len(parts) == 2 and not spark.catalog.databaseExists(parts[0]):
        raise QueryError("files can't be read by path")
    if not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts)):
        raise QueryError(f"there is no table {'.'.join(parts)}")


def checked(spark: SparkSession, text: str) -> str:
    """The statement, once all that it is made of is allowed."""
    text = text.strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # whatever the parser says of it
        raise QueryError(f"not a single SELECT: {str(e).splitlines()[0][:200]}") from None
    nodes = list(_walk(plan))
    known = {x.alias().lower() for x in nodes if x.getClass().getSimpleName() == "SubqueryAlias"}
    for x in nodes:
        kind = x.getClass().getSimpleName()
        if _is(x, "plans.logical.LogicalPlan"):
            if kind == "UnresolvedTableValuedFunction":
                if [p.lower() for p in _seq(x.name())][-1] not in TABLES or x.name().size() > 1:
                    raise QueryError(f"the table function {x.name().last()} is not allowed")
            elif kind == "UnresolvedRelation":
                _relation(spark, _seq(x.multipartIdentifier()), known)
            elif kind not in NODES:
                raise QueryError(f"a SELECT can't have {kind}")
        elif kind == "UnresolvedFunction":
            _function(spark, _seq(x.nameParts()))
        elif kind == "UnresolvedGenerator":
            _function(spark, [x.name().funcName()])
        elif "Identifier" in kind and "Unresolved" in kind or kind.startswith("Python") or "UDF" in kind or "Parameter" in kind:
            raise QueryError("names can't be put together, and parameters are not given")
    return text.rstrip("; \n\t")


def guarded(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """The rows of a SELECT over registered tables; of at most limit rows, if one is given."""
    out = spark.sql(checked(spark, text))
    return out if limit is None else out.limit(limit)


def page(spark: SparkSession, text: str, limit: int = 10_000, offset: int = 0) -> DataFrame:
    """A page of a SELECT's rows. Its own limits stay what they are, as the page is taken of the whole result."""
    out = guarded(spark, text)
    return out.offset(offset).limit(limit)
