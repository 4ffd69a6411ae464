"""Stored inputs: financial statements in two times, a table by key, golden cases with a table of rejected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.joins import STATEMENTS_SQL, statements, text_day
from marlstone.registry import query
from marlstone.sources import golden, stores
from marlstone.sources import statements as S
from marlstone.sources.keyed import KeyedTable
from marlstone.sources.tables import table

C = F.col

REPORTS_SQL = f"""{STATEMENTS_SQL}, open AS (SELECT o_custkey AS symbol, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS period_end, round(sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END), 2) AS closed, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1, 2),
rp AS (SELECT symbol, period_end, disclosed AS announced, revenue FROM st UNION ALL SELECT symbol, period_end, (disclosed + (60 + k % 90)::INT)::DATE, closed FROM st JOIN open USING (symbol, period_end) WHERE n_open > 0)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Each quarter's statement, and where it counted open orders, a later restatement without them: both reports come from
    one row by an explode, so no table is read twice."""
    quarter = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    is_open = C("o_orderstatus") == "O"
    restated = table(spark, sf, "orders").groupBy(C("o_custkey").alias("symbol"), quarter.alias("period_end")).agg(
        F.round(F.sum(F.when(is_open, 0.0).otherwise(C("o_totalprice"))), 2).alias("closed"), F.count_if(is_open).alias("n_open")
    )
    both = statements(spark, sf).join(restated, ["symbol", "period_end"])
    first = F.struct(C("disclosed").alias("announced"), C("revenue"))
    later = F.struct(F.date_add("disclosed", (60 + C("k") % 90).cast("int")).alias("announced"), C("closed").alias("revenue"))
    each = F.explode(F.when(C("n_open") > 0, F.array(first, later)).otherwise(F.array(first))).alias("r")
    return both.select("symbol", "period_end", each).select("symbol", "period_end", "r.*")


_REVISIONS_SQL = "rv AS (SELECT *, row_number() OVER w AS revision, lead(announced) OVER w AS superseded FROM rp WINDOW w AS (PARTITION BY symbol, period_end ORDER BY announced))"


@query("scan_financial", f"WITH {REPORTS_SQL}, {_REVISIONS_SQL} SELECT symbol, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(announced, '%Y-%m-%d') AS announced, strftime(superseded, '%Y-%m-%d') AS superseded, revision, revenue FROM rv")
def scan_financial(spark: SparkSession, sf: str) -> DataFrame:
    """Every report with its number among those of its period and the days on which it was the known one."""
    return S.scan(reports(spark, sf)).select("symbol", text_day("period_end"), text_day("announced"), text_day("superseded"), C("revision").cast("long").alias("revision"), "revenue")


@query(
    "jn_statement_growth",
    f"""WITH {REPORTS_SQL}, q AS (SELECT o_orderkey AS asked, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders),
a AS (SELECT asked, q.symbol, d, max(period_end) AS period_end, arg_max(revenue, (period_end, announced)) AS revenue FROM q LEFT JOIN rp ON rp.symbol = q.symbol AND announced <= d GROUP BY 1, 2, 3)
SELECT asked, any_value(strftime(a.period_end, '%Y-%m-%d')) AS period_end, any_value(a.revenue) AS revenue, arg_max(b.revenue, b.announced) AS year_before FROM a LEFT JOIN rp b ON b.symbol = a.symbol AND b.period_end = last_day((a.period_end - INTERVAL 12 MONTH)::DATE) AND b.announced <= d GROUP BY 1""",
)
def jn_statement_growth(spark: SparkSession, sf: str) -> DataFrame:
    """On each order's day the customer's newest statement, and that of the quarter a year before, both as known that day."""
    r = reports(spark, sf)
    asked = table(spark, sf, "orders").select(C("o_orderkey").alias("asked"), C("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("d"))
    now = S.known(asked, r, "d", ["revenue"]).withColumn("before", F.last_day(F.add_months("period_end", -12)))
    out = S.known_of_period(now, r, "before", "d", {"revenue": "year_before"})
    return out.select("asked", text_day("period_end"), "revenue", "year_before")


def customers_by_key(spark: SparkSession, sf: str) -> KeyedTable:
    """Customers, then corrections of those in one segment, the second version written twice."""
    t = KeyedTable(spark, stores.shared_path(spark, "keyed"), "c_custkey long, c_name string, c_acctbal double", "c_custkey")
    given = table(spark, sf, "customer")
    t.upsert(given, 1)
    corrected = given.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.round(C("c_acctbal") + 1, 2))
    for _ in range(2):
        t.upsert(corrected, 2)
    return t


_KEYED_SQL = "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer"


@query("crud_upsert", _KEYED_SQL)
def crud_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return customers_by_key(spark, sf).rows()


@query("crud_point", f"{_KEYED_SQL} WHERE c_custkey IN (1, 77, 150, -5)")
def crud_point(spark: SparkSession, sf: str) -> DataFrame:
    """Four keys, one of which no customer has."""
    return customers_by_key(spark, sf).get([1, 77, 150, -5])


@query(
    "src_jsonl_golden",
    """SELECT CASE WHEN item_id % 6 <> 4 THEN 'g' || item_id END AS case_id,
CASE item_id % 6 WHEN 2 THEN 'category is unknown' WHEN 3 THEN 'query is missing|as_of is no time' WHEN 4 THEN 'no case of this form' WHEN 5 THEN 'a grade is unknown' ELSE '' END AS reasons,
CASE item_id % 6 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE END AS gain FROM benchmark""",
)
def src_jsonl_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Cases written from the benchmark's texts, four of six with a fault; cases that hold have their gains summed."""
    k = C("item_id") % 6
    name, ids = F.concat(F.lit("g"), "item_id"), F.array(F.lit("a"), F.lit("b"))
    line = (
        F.when(k == 0, F.to_json(F.struct(name.alias("case_id"), C("text").alias("query"), ids.alias("expected_ids"))))
        .when(k == 1, F.concat(F.lit('{"id": "'), name, F.lit('", "query": '), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(', "graded_labels": {"a": "highly_relevant", "b": 2, "c": "expired"}}')))
        .when(k == 2, F.to_json(F.struct(name.alias("case_id"), C("text").alias("query"), F.lit("other").alias("category"))))
        .when(k == 3, F.to_json(F.struct(name.alias("case_id"), F.lit("soon").alias("as_of"))))
        .when(k == 4, F.concat(F.lit('{"case_id": "'), name))
        .otherwise(F.to_json(F.struct(name.alias("case_id"), C("text").alias("query"), F.create_map(F.lit("a"), F.lit("superb")).alias("graded_labels"))))
    )
    path = stores.shared_path(spark, "golden")
    table(spark, sf, "benchmark").select(line.alias("value")).write.text(path)
    cases, rejected = golden.load(spark, path)
    total = F.aggregate(F.map_values("gains"), F.lit(0.0), lambda a, x: a + x)
    held = cases.select("case_id", F.lit("").alias("reasons"), total.alias("gain"))
    return held.unionByName(rejected.select("case_id", F.array_join("reasons", "|").alias("reasons"), F.lit(None).cast("double").alias("gain")))
