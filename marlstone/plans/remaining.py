"""Smaller operators: point ids, limit cells and their daily counts, hints, bands, filter names, golden checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from marlstone.functions import parsing as P
from marlstone.operators import portfolio as PF
from marlstone.operators import rules
from marlstone.plans.joins import text_day
from marlstone.plans.scores import SCORED_SQL, scored_days
from marlstone.registry import query
from marlstone.sources import stores
from marlstone.sources.tables import BARS_SQL, bars, table

C = F.col

#: The namespace of URLs for name-based UUIDs (a fixed value of RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


@query("sc_uuid5", f"WITH h AS (SELECT item_id, sha1(unhex('{URL_NAMESPACE}') || encode('chunk:' || item_id::VARCHAR)) AS h FROM benchmark) SELECT item_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id FROM h")
def sc_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", uuid5(F.concat(F.lit("chunk:"), C("item_id").cast("string"))).alias("point_id"))


@query("sc_limit_cell", f"WITH {BARS_SQL} SELECT symbol, strftime(d, '%Y-%m-%d') AS d, CASE day(d) % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'INVALID' ELSE 'VALID' END AS status, CASE WHEN day(d) % 4 = 3 THEN close END AS upper FROM bars")
def sc_limit_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Panel cells: NaN is missing, what is not positive is invalid."""
    k = F.dayofmonth("d") % 4
    cell = F.when(k == 1, float("nan")).when(k == 2, -1.0).when(k == 3, C("close"))
    p = P.parse_price(F.when(~F.isnan(cell), cell))
    return bars(spark, sf).select("symbol", text_day("d"), p["status"].alias("status"), p["value"].alias("upper"))


@query("ag_daily_limit_delta", f"WITH {BARS_SQL} SELECT strftime(d, '%Y-%m-%d') AS d, count(*) FILTER (day(d) % 4 = 2) AS invalid_upper, count(*) FILTER (day(d) % 4 < 2) AS missing_upper FROM bars GROUP BY 1")
def ag_daily_limit_delta(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.sum(F.when(C("status") == s, 1).otherwise(0))
    return sc_limit_cell(spark, sf).groupBy("d").agg(n("INVALID").alias("invalid_upper"), n("MISSING").alias("missing_upper"))


@query("sc_llm_hint", f"WITH {SCORED_SQL} SELECT strftime(d, '%Y-%m-%d') AS d, coalesce(trend, 0) AS trend, breadth, coalesce(crowding, 0) AS crowding, coalesce(rotation, 0) AS rotation, drawdown_risk FROM scored")
def sc_llm_hint(spark: SparkSession, sf: str) -> DataFrame:
    """Five sub-scores as one struct, a missing one as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    hint = F.struct(zero("trend"), zero("breadth"), zero("crowding"), zero("rotation"), zero("drawdown_risk"))
    return scored_days(spark, sf).select(text_day("d"), hint.alias("hint")).select("d", "hint.*")


@query("sc_band", "SELECT p_partkey, CASE WHEN p_size * 2 >= 85 THEN 'high_conviction' WHEN p_size * 2 >= 72 THEN 'normal' WHEN p_size * 2 >= 60 THEN 'starter' ELSE 'watch' END AS band, CASE WHEN p_size * 2 >= 85 THEN 800 WHEN p_size * 2 >= 72 THEN 450 WHEN p_size * 2 >= 60 THEN 200 ELSE 0 END::BIGINT AS middle FROM part")
def sc_band(spark: SparkSession, sf: str) -> DataFrame:
    score = C("p_size") * 2
    return table(spark, sf, "part").select("p_partkey", PF.band_of(score).alias("band"), PF.first_target(F.when(score >= 60, score), F.when(score >= 60, 0).otherwise(0)).alias("middle"))


@query("sc_skill_golden", "SELECT o_custkey, round(avg((o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW')::INT), 6) AS pass_share FROM orders GROUP BY 1")
def sc_skill_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cases whose required items are all there and none forbidden is."""
    have = F.array("o_orderstatus", "o_orderpriority")
    needed = F.size(F.array_intersect(have, F.array(F.lit("F"), F.lit("O")))) > 0
    passes = needed & ~F.array_contains(have, "5-LOW")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.avg(passes.cast("double")), 6).alias("pass_share"))


#: Plural filter names and the columns they stand for.
ALIASES = {"langs": "lang", "sources": "source", "max_chars": "n_chars"}


@query("pr_filter_alias", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2')")
def pr_filter_alias(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.plans.retrieval import filter_clause

    asked = {"langs": ["en", "fr"], "sources": ["src1", "src2"]}
    return table(spark, sf, "documents").where(filter_clause({ALIASES.get(k, k): v for k, v in asked.items()})).select("doc_id")


LEVELS = ("rejected", "single_source", "supported", "verified")


def strictest(policy: dict, asked: dict) -> dict:
    """Two filter sets merged so that the stricter of each holds: common values, and the higher least level."""
    out = dict(policy)
    for k, v in asked.items():
        if k not in out:
            out[k] = v
        elif k == "least_level":
            out[k] = max(out[k], v, key=LEVELS.index)
        else:
            out[k] = [x for x in out[k] if x in v]
    return out


@query("pr_policy_merge", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 4 >= 2")
def pr_policy_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a support level by their id, under a policy and a request merged strictest first."""
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (C("doc_id") % 4 + 1).cast("int"))
    f = strictest({"lang": ["en", "de"], "least_level": "single_source"}, {"lang": ["en", "fr"], "least_level": "supported"})
    allowed = LEVELS[LEVELS.index(f["least_level"]) :]
    return table(spark, sf, "documents").where(C("lang").isin(*f["lang"]) & level.isin(*allowed)).select("doc_id")


#: Columns that the packs of the table may name.
FRAME = {"close", "ma5", "ma20", "ma60", "dif", "dea", "volume_ratio20"}
_PACK = "struct<version:string,rules:map<string,struct<expression:string,score:double>>>"


def packs(spark: SparkSession, sf: str) -> DataFrame:
    """A rule pack, as JSON, for every part: a comparison whose faults follow from the part's numbers."""
    k, size = C("p_partkey"), C("p_size")
    name = F.when(k % 7 == 0, "near").otherwise("gt")
    left = F.when(k % 5 == 0, "ma7").otherwise("close")
    given = F.when(k % 11 == 0, F.format_string('["%s"]', left)).otherwise(F.format_string('["%s", %s]', left, size.cast("string")))
    rule = F.format_string('{"all": [{"%s": %s}, {"cross_up": ["ma5", "ma20"]}]}', name, given)
    score = F.when(k % 13 == 0, size + 100).otherwise(size)
    version = F.when(k % 17 == 0, "1.0").otherwise("1.0.0")
    return table(spark, sf, "part").select(k.alias("pack_id"), F.to_json(F.struct(version.alias("version"), F.struct(F.struct(rule.alias("expression"), score.alias("score")).alias("r")).alias("rules"))).alias("pack"))


@F.pandas_udf(ArrayType(StringType()))
def _problems(given: pd.Series) -> pd.Series:
    """``rules.problems`` of packs as JSON; a text that is no pack is one problem."""

    def of(text: str | None) -> list[str]:
        try:
            x = json.loads(text or "")
            own = {k: (json.loads(r["expression"]), float(r["score"])) for k, r in x["rules"].items()}
            return rules.problems(rules.RulePack("given", own, x["version"]), FRAME)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return [f"no rule pack: {type(e).__name__}"]

    return given.map(of)


_FAULTS = "(p_partkey % 17 = 0)::INT + (p_partkey % 13 = 0)::INT + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE (p_partkey % 11 = 0)::INT + (p_partkey % 5 = 0)::INT END"


@query("rule_validate", f"SELECT p_partkey AS pack_id, ({_FAULTS})::BIGINT AS problems, CASE WHEN p_partkey % 17 = 0 THEN 'version' WHEN p_partkey % 13 = 0 THEN 'score' WHEN p_partkey % 7 = 0 THEN 'operator' WHEN p_partkey % 11 = 0 THEN 'arguments' WHEN p_partkey % 5 = 0 THEN 'column' END AS first FROM part")
def rule_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Problems of every pack of a table, and what the first of them is about."""
    found = packs(spark, sf).select("pack_id", _problems("pack").alias("p"))
    about = {"version": "version ", "score": "score ", "operator": "no operator", "arguments": " arguments", "column": "no column"}
    first = F.coalesce(*(F.when(F.element_at("p", 1).contains(text), name) for name, text in about.items()))
    return found.select("pack_id", F.size("p").cast("long").alias("problems"), F.when(F.size("p") > 0, first).alias("first"))


@query("src_theme_json", "SELECT p_brand AS theme, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS symbols FROM part GROUP BY 1")
def src_theme_json(spark: SparkSession, sf: str) -> DataFrame:
    """A theme index written and read as JSON with its member lists."""
    path = stores.shared_path(spark, "themes")
    p = table(spark, sf, "part").groupBy(C("p_brand").alias("theme")).agg(F.array_sort(F.collect_list("p_partkey")).alias("symbols"))
    p.write.json(path)
    t = stores.read_json(spark, path, "theme string, symbols array<bigint>")
    return t.select("theme", F.size("symbols").cast("long").alias("n"), F.array_join(F.transform("symbols", lambda s: s.cast("string")), ",").alias("symbols"))


@query("sink_calendar_upsert", "SELECT strftime(d, '%Y-%m-%d') AS d, CASE WHEN dayofweek(d) IN (0, 6) THEN false ELSE true END AS is_open FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def sink_calendar_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All days as open, then the weekends corrected."""
    path = stores.shared_path(spark, "calendar")
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    stores.append_version(days.withColumn("is_open", F.lit(True)), path, 1)
    stores.append_version(days.where(F.dayofweek("d").isin(1, 7)).withColumn("is_open", F.lit(False)), path, 2)
    return stores.current(spark, path, ["d"]).select(text_day("d"), "is_open")


@query("reg_indicators", f"WITH {BARS_SQL} SELECT symbol, strftime(d, '%Y-%m-%d') AS d, floor(CASE WHEN n >= 10 THEN avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END * 1e4 + 0.5003717) / 1e4 AS sma10, floor(CASE WHEN n >= 5 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END * 1e4 + 0.5003717) / 1e4 AS volume_ma5 FROM bars")
def reg_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators by name and parameters from the registry."""
    from marlstone.functions.indicators import INDICATORS

    made = {"sma10": INDICATORS.get("sma").build(window=10), "volume_ma5": INDICATORS.get("volume_ma").build(window=5)}
    off = lambda c: F.floor(c * 1e4 + 0.5003717) / 1e4
    return bars(spark, sf).select("symbol", text_day("d"), *(off(c).alias(k) for k, c in made.items()))
