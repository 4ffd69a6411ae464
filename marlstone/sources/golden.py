"""Golden cases of retrieval, one JSON object a line: those that hold, and a table of the others with their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "case_id string, id string, query string, task_type string, category string, expected_ids array<string>, "
    "expected_subjects array<string>, expected_memory_types array<string>, expected_regime string, forbidden_ids array<string>, "
    "must_not_return array<string>, as_of string, tags array<string>, graded_labels map<string,string>, superseded map<string,string>, "
    "contradictions array<struct<winner_id: string, loser_id: string>>, _bad string"
)

# Categories of questions, gains of graded labels, and labels that have none.
CATEGORIES = ("当前市场方向", "历史主题逻辑", "个股研究", "决策经验", "用户偏好", "视频最新观点", "冲突知识", "已过期知识")
GAINS = {"relevant": 2.0, "highly_relevant": 3.0, "partially_relevant": 1.0, "irrelevant": 0.0}
WITHOUT_GAIN = ("expired", "contradictory")


def _gain(label):
    """The gain of a label or of a grade from 0 to 3; null for what is neither."""
    names = {**GAINS, **dict.fromkeys(WITHOUT_GAIN, 0.0), **{str(k): float(k) for k in range(4)}}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, label)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (``value``) as cases with ``gains`` (id to gain, 1 at least) and ``reasons``, empty for a case that holds.

    Blank lines are no cases. Of two names of a field the first that is given counts. Grades may be numbers or their texts.
    A case that is no JSON, or has a field of another form, has that as its one reason.
    """
    c = lines.where(F.trim("value") != "").withColumn("c", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    c = c.select("value", "c.*").withColumn("case_id", F.coalesce("case_id", "id")).withColumn("forbidden_ids", F.coalesce("forbidden_ids", "must_not_return"))
    c = c.drop("id", "must_not_return")
    labels = F.coalesce(F.col("graded_labels"), F.create_map().cast("map<string,string>"))
    graded = F.map_filter(F.transform_values(labels, lambda _, label: _gain(label)), lambda _, gain: gain >= 1)
    ids = F.when(F.size("expected_ids") > 0, F.col("expected_ids")).otherwise(F.coalesce(F.col("expected_subjects"), F.array().cast("array<string>")))
    plain = F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i, F.lit(2.0))))
    faults = F.array_compact(
        F.array(
            F.when(F.col("case_id").isNull(), "case_id is missing"),
            F.when(F.col("query").isNull(), "query is missing"),
            F.when(~F.col("category").isin(*CATEGORIES), "category is unknown"),
            F.when(F.exists(F.map_values(labels), lambda x: _gain(x).isNull()), "a grade is unknown"),
            F.when(F.col("as_of").isNotNull() & F.expr("try_cast(as_of AS timestamp)").isNull(), "as_of is no time"),
        )
    )
    c = c.withColumn("gains", F.when(F.size(labels) > 0, graded).otherwise(plain))
    return c.withColumn("reasons", F.when(F.col("_bad").isNotNull(), F.array(F.lit("no case of this form"))).otherwise(faults)).drop("_bad")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected): cases that hold, and (value, case_id, reasons) of the other lines."""
    every = parsed(spark.read.text(path))
    return every.where(F.size("reasons") == 0).drop("value", "reasons"), every.where(F.size("reasons") > 0).select("value", "case_id", "reasons")
