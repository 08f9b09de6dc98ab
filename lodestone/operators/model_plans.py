"""Plans that a model wrote as JSON, checked value by value: what is allowed stays, what isn't is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.formats import model_json
from lodestone.operators.planning import listed_metrics

#: Ways to compare periods, and the most values of each list.
COMPARE_MODES = ("generic", "latest", "yoy", "qoq", "point_in_time")
MOST = {"metrics": 16, "form_filters": 8, "period_end_dates": 8, "period_years": 6}
FORM = r"^(10-[KQ]|8-K)(/A)?$"
DATE = r"^20[0-9]{2}-[0-9]{2}-[0-9]{2}$"
YEARS = (1990, 2100)


def _kind(value: Column) -> Column:
    """The JSON type of a VARIANT in capitals; null for a field that isn't there."""
    return F.upper(F.schema_of_variant(value))


def checked(answers: DataFrame, text: str = "answer") -> DataFrame:
    """answers with plan (struct) and faults (array of texts): the plan that the outermost JSON object of a model's answer stands for.

    Lists are cleaned item by item: names without namespace that are known, forms in one
    spelling, dates of this century, years in YEARS; each once and as many as MOST says. Exact
    metrics and hints stand in for one another. An unknown mode is `generic`, a preference that
    is no truth value is true. A null plan has the fault `no object`. Faults name the field and
    what is wrong: `not a list`, so many items `dropped`, `unknown`, `not a truth value`, or that
    it is `missing`.
    """
    v = F.try_parse_json(model_json(F.col(text)))
    field = lambda name, kind: F.try_variant_get(F.col("__v"), f"$.{name}", kind)
    empty = F.array().cast("array<string>")
    read = answers.withColumn("__v", v).withColumns({
        f"__{name}": field(name, "variant") for name in ("metric_sql_hints", "metric_exact_keys", "form_filters", "period_end_dates", "period_years", "compare_mode", "prefer_recent")
    })
    listed = {name: F.coalesce(F.try_variant_get(f"__{name}", "$", "array<string>"), empty) for name in ("metric_sql_hints", "metric_exact_keys", "form_filters", "period_end_dates", "period_years")}
    spelt = F.transform(listed["form_filters"], lambda x: F.replace(F.replace(F.upper(F.replace(F.trim(x), F.lit(" "), F.lit(""))), F.lit("10K"), F.lit("10-K")), F.lit("10Q"), F.lit("10-Q")))
    whole = F.transform(listed["period_years"], lambda x: F.trim(x).try_cast("double").try_cast("int"))
    clean = {
        "metric_sql_hints": listed_metrics(F.array_compact(listed["metric_sql_hints"]), MOST["metrics"]),
        "metric_exact_keys": listed_metrics(F.array_compact(listed["metric_exact_keys"]), MOST["metrics"]),
        "form_filters": F.slice(F.array_distinct(F.filter(spelt, lambda x: x.rlike(FORM))), 1, MOST["form_filters"]),
        "period_end_dates": F.slice(F.array_distinct(F.filter(F.transform(listed["period_end_dates"], lambda x: F.trim(x)), lambda x: x.rlike(DATE))), 1, MOST["period_end_dates"]),
        "period_years": F.slice(F.array_distinct(F.filter(whole, lambda y: y.between(*YEARS))), 1, MOST["period_years"]),
    }
    kept = read.withColumns({f"__c_{name}": column for name, column in clean.items()})
    own = lambda name: F.col(f"__c_{name}")
    either = lambda one, other: F.when(F.size(own(one)) > 0, own(one)).otherwise(own(other))
    mode, recent = F.try_variant_get("__compare_mode", "$", "string"), F.try_variant_get("__prefer_recent", "$", "boolean")
    mode_known = (_kind(F.col("__compare_mode")) == "STRING") & mode.isin(*COMPARE_MODES)
    recent_known = _kind(F.col("__prefer_recent")) == "BOOLEAN"
    plan = F.struct(
        either("metric_sql_hints", "metric_exact_keys").alias("metric_sql_hints"), either("metric_exact_keys", "metric_sql_hints").alias("metric_exact_keys"),
        F.when(F.size(own("form_filters")) > 0, own("form_filters")).alias("form_filters"), own("period_end_dates").alias("period_end_dates"), own("period_years").alias("period_years"),
        F.when(mode_known, mode).otherwise("generic").alias("compare_mode"), F.when(recent_known, recent).otherwise(True).alias("prefer_recent"),
    )
    faults = []
    for name in clean:
        kind = _kind(F.col(f"__{name}"))
        is_list = kind.startswith("ARRAY")
        absent = F.col(f"__{name}").isNull() | ((kind == "VOID") & F.lit(name == "form_filters"))
        dropped = F.size(listed[name]) - F.size(own(name))
        faults.append(F.when(absent, F.when(F.lit(name != "form_filters"), F.lit(f"{name}: missing"))).when(~is_list, F.lit(f"{name}: not a list")).when(dropped > 0, F.concat(F.lit(f"{name}: dropped "), dropped.cast("string"))))
    faults.append(F.when(F.col("__compare_mode").isNull(), F.lit("compare_mode: missing")).when(~mode_known, F.lit("compare_mode: unknown")))
    faults.append(F.when(F.col("__prefer_recent").isNull(), F.lit("prefer_recent: missing")).when(~recent_known, F.lit("prefer_recent: not a truth value")))
    told = F.when(F.col("__v").isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*faults)))
    return kept.select(*answers.columns, F.when(F.col("__v").isNotNull(), plan).alias("plan"), told.alias("faults"))
