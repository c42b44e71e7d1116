"""Rule checks on generated complaints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grievaline.functions.text import KEYWORD, LINK_PREFIX
from grievaline.plans.complaints import MAX_CHARS

Rules = dict[str, Column]


def complaint_rules() -> Rules:
    return {
        "text_not_empty": F.col("formatted_complaint") != "",
        "link_prefix": F.col("sms_uri").startswith("sms:139"),
        "length_or_truncated": (F.col("char_count") <= MAX_CHARS) | F.col("truncated"),
    }


def link_rules() -> Rules:
    link = F.col("sms_uri")
    return {
        "body_prefix": link.startswith(LINK_PREFIX),
        "holds_keyword": F.contains(link, F.lit(KEYWORD)),
        "pnr_when_given": (F.col("pnr") == "") | F.contains(link, F.lit("PNR")),
        "no_blank": ~F.contains(link, F.lit(" ")),
    }


def length_rules() -> Rules:
    return {
        "translation_over_10": F.col("translation_length") > 10,
        "reply_over_20": F.col("reply_length") > 20,
        "reply_over_10": F.col("reply_length") > 10,
        "language_not_empty": F.col("detected_language") != "",
    }


def rule_counts(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rule, passed, total, ok``: counted in one pass, turned to rows afterwards."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"`{n}`") for n, c in rules.items()]
    one = rows.agg(F.count("*").alias("_total"), *[c for c in counts])
    wide = one.toDF("_total", *rules)
    long = wide.unpivot("_total", list(rules), "rule", "passed")
    return long.select(
        "rule",
        "passed",
        F.col("_total").alias("total"),
        (F.col("passed") == F.col("_total")).alias("ok"),
    )


def violations(rows: DataFrame, rules: Rules, key: str) -> DataFrame:
    """Every failing row with each rule it fails, read once."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    )
    return rows.select(key, F.explode(failed).alias("rule")).select(
        key, "rule", F.concat(F.lit("AssertionError: "), F.col("rule")).alias("error")
    )


def summary(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.bool_and("ok").alias("ok")
    )
