"""Safe ad-hoc SQL (Q2 to Q7, P16): one SELECT over allowed tables, run on one tenant's rows, bounded in rows and time.

Isolation is structural.  A statement is parsed once; its plan may hold only queries, relations of allowed names and
functions of a list; then it runs in a session of its own, whose only views are the tenant's rows of those tables under
those names, so nothing else can be named, whatever the text says.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Allowed tables and the column that names the tenant.
ALLOWED = {"items": "user_id", "highlights": "user_id", "lists": "owner_id", "membership": None, "entities": "user_id", "mentions": "user_id", "records": "owner_id"}
HIDDEN = {"embedding", "norm"}
ROWS, SECONDS = 50, 0.5
#: Plan nodes of queries; whatever else a plan holds (commands, table functions, scripts, hints of files) is refused.
NODES = frozenset(
    """Project Filter Aggregate Sort Join Union Intersect Except Distinct Limit GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedHaving
    UnresolvedSubqueryColumnAliases WithWindowDefinition OneRowRelation UnresolvedOrdinal UnresolvedInlineTable LateralJoin CTERelationRef""".split()
)
#: Functions that compute from their arguments only.
FUNCTIONS = frozenset(
    """abs acos approx_count_distinct array array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_sort array_union arrays_overlap avg
    between like ilike bool_and bool_or bround cardinality cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if cume_dist current_date current_timestamp date date_add
    date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exists exp explode extract filter first first_value float floor format_number forall
    from_unixtime get greatest hour if ifnull initcap instr int isnan isnotnull isnull lag last last_day last_value lcase lead least left length levenshtein ln locate log log10 log2 lower lpad ltrim make_date max max_by
    mean median min min_by minute mod month months_between now ntile nullif nvl nvl2 percent_rank percentile percentile_approx position pow power quarter rand rank regexp_count regexp_extract
    regexp_like regexp_replace rlike repeat replace reverse right rlike round row_number rpad rtrim second sequence sign size slice some sort_array split split_part sqrt startswith std stddev string struct substr
    substring sum to_date to_timestamp transform translate trim trunc try_cast ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear when year bigint boolean double""".split()
) - {"rand"}


class Rejected(ValueError):
    pass


class TimedOut(RuntimeError):
    pass


def unfenced(text: str) -> str:
    """Q7: without a code fence."""
    m = re.fullmatch(r"\s*```(?:sql)?\s*(.*?)\s*```\s*", text, re.S | re.I)
    return (m[1] if m else text).strip()


def _some(seq) -> list:
    out, it = [], seq.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def _walk(spark: SparkSession, plan) -> tuple[list[tuple[str, object]], set[str]]:
    """All plan nodes by name, with those of common table expressions and subqueries, and names of functions called."""
    kind_of = spark._jvm.java.lang.Class.forName
    logical = kind_of("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    subquery = kind_of("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    nodes, functions, plans, expressions = [], set(), [plan], []
    while plans or expressions:
        if plans:
            p = plans.pop()
            name = p.nodeName().replace("'", "").split()[0]
            nodes.append((name, p))
            plans += _some(p.children()) + [x for x in _some(p.innerChildren()) if logical.isInstance(x)]
            if name == "UnresolvedWith":
                plans += [r._2() for r in _some(p.cteRelations())]
            expressions += _some(p.expressions())
        else:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                functions.add(".".join(_some(e.nameParts())).lower())
            elif kind == "UnresolvedGenerator":
                functions.add(e.name().funcName().lower())
            elif "Reflect" in kind or kind in ("JavaMethod", "PythonUDF", "ScalaUDF", "ScalaUDAF"):
                functions.add(kind.lower())
            if subquery.isInstance(e):
                plans.append(e.plan())
            expressions += [c for c in _some(e.children()) if not logical.isInstance(c)]
    return nodes, functions


def _cte_names(nodes) -> set[str]:
    return {r._1().lower() for name, p in nodes if name == "UnresolvedWith" for r in _some(p.cteRelations())}


def validate(spark: SparkSession, sql: str) -> set[str]:
    """Q3: names of the tables used; raises Rejected unless it is one SELECT over allowed tables and functions.

    Common table expressions are told from the parsed plan and may not take the name of an allowed table.
    """
    text = sql.strip().rstrip("; \n")
    if not text:
        raise Rejected("one statement only")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Rejected("not one statement of SQL") from e
    nodes, functions = _walk(spark, plan)
    ctes, names = _cte_names(nodes), set()
    if ctes & set(ALLOWED):
        raise Rejected("a common table expression has the name of a table")
    for name, p in nodes:
        if name == "Generate":
            continue  # a lateral view; its function is looked at like others
        if name not in NODES:
            raise Rejected(f"{name} is not allowed")
        if name == "UnresolvedRelation":
            parts = [x.lower() for x in _some(p.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in ctes | set(ALLOWED):
                raise Rejected(f"unknown table: {'.'.join(parts)}")
            names.add(parts[0])
    if wrong := functions - FUNCTIONS:
        raise Rejected(f"functions that are not allowed: {', '.join(sorted(wrong))}")
    return names - ctes


def _own_rows(tables: dict[str, DataFrame], name: str, user_id: int) -> DataFrame:
    df, owner = tables[name], ALLOWED[name]
    if owner:
        own = df.where(F.col(owner) == user_id)
    else:
        own = df.join(tables["lists"].where(F.col("owner_id") == user_id).select(F.col("id").alias("list_id")), "list_id", "left_semi")
    return own.drop(*HIDDEN)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], user_id: int, rows: int = ROWS) -> DataFrame:
    """Validated, on the tenant's rows, with :user_id bound, at most ``rows`` rows.

    The answer's session holds the tenant's views and no others; views of the caller's session are out of its reach.
    """
    text = unfenced(sql).rstrip("; \n")
    used = validate(spark, text)
    alone = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        alone.conf.set(key, spark.conf.get(key))
    alone.conf.set("spark.sql.runSQLOnFiles", "false")
    from pyspark.sql import DataFrame as Frame

    for name in used:
        own = _own_rows(tables, name, user_id)
        # the analysed plan enters the other session as it is: no name of this one is looked up again
        plan = own._jdf.queryExecution().analyzed()
        Frame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(alone._jsparkSession, plan), alone).createOrReplaceTempView(name)
    return alone.sql(text, args={"user_id": user_id} if ":user_id" in text else None).limit(rows)


def fetch(answer: DataFrame, seconds: float = SECONDS, *, patience: float = 60) -> list:
    """Q6: the rows of an answer, or TimedOut once its jobs ran longer than ``seconds``.

    Jobs carry a group of their own, which is cancelled until none of them is active: a query that ran out of time holds
    no core when this returns.  Only tasks that ignore being interrupted for ``patience`` seconds are left behind.
    """
    sc, group, got, wrong = answer.sparkSession.sparkContext, f"ad-hoc-{uuid.uuid4().hex}", [], []

    def work() -> None:
        sc.setJobGroup(group, "ad-hoc query", interruptOnCancel=True)
        try:
            got.extend(answer.collect())
        except Exception as e:
            wrong.append(e)

    t = InheritableThread(target=work, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        until = time.monotonic() + patience
        while (t.is_alive() or active(sc, group)) and time.monotonic() < until:
            sc.cancelJobGroup(group)  # again: a query may have begun its next job
            t.join(0.1)
        raise TimedOut(f"longer than {seconds} s")
    if wrong:
        raise wrong[0]
    return got


def active(sc, group: str) -> list[int]:
    """Jobs of a group that run."""
    tracker = sc.statusTracker()
    infos = {job: tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(group)}
    return [job for job, info in infos.items() if info is not None and info.status == "RUNNING"]
