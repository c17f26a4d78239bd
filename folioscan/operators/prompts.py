"""Routing of prompts: short ones pass, long ones are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import text as tx
from folioscan.operators.model_calls import ModelFactory, apply_model


def route_prompts(
    prompts: DataFrame,
    text: str = "text",
    rewrite: ModelFactory | None = None,
    model: str = "",
    threshold: int = settings.PROMPT_WORD_THRESHOLD,
) -> DataFrame:
    """Add the routing report to a table of prompts.

    Only prompts above the threshold reach the rewriter. A failed rewrite, or none
    given, sends the prompt unchanged.
    """
    counted = prompts.withColumn("original_words", tx.word_count(F.col(text)))
    short = counted.filter(F.col("original_words") <= threshold).withColumn(
        "_answer", F.lit(None).cast("string")
    ).withColumn("error", F.lit(None).cast("string"))
    long = counted.filter(F.col("original_words") > threshold)
    if rewrite:
        long = apply_model(long, text, "_answer", "string", rewrite, model)
    else:
        long = long.withColumn("_answer", F.lit(None).cast("string")).withColumn(
            "error", F.lit("no rewriter")
        )
    method = (
        F.when(F.col("original_words") <= threshold, "passthrough")
        .when(F.col("error").isNull(), "llm-rewrite")
        .otherwise("passthrough (rewrite failed)")
    )
    reason = F.format_string(
        f"%d words %s {threshold} threshold%s", "original_words",
        F.when(F.col("original_words") <= threshold, "<=").otherwise(">"),
        F.when(F.col("original_words") <= threshold, "; sent unchanged").otherwise(""),
    )
    return report(
        short.unionByName(long)
        .withColumn("method", method)
        .withColumn("reason", reason)
        .withColumn("final", F.coalesce(tx.strip(F.col("_answer")), F.col(text)))
        .drop("_answer", "error"),
        text,
    )


def report(routed: DataFrame, text: str) -> DataFrame:
    """Token counts before and after, and the saving in percent."""
    before, after = tx.approx_tokens(F.col(text)), tx.approx_tokens(F.col("final"))
    saving = (1 - F.try_divide(F.col("final_tokens"), F.col("original_tokens"))) * 100
    return (
        routed.withColumn("original_tokens", before)
        .withColumn("final_words", tx.word_count(F.col("final")))
        .withColumn("final_tokens", after)
        .withColumn("reduction_pct", F.round(F.coalesce(saving, F.lit(0.0)), 1))
    )


def report_text(text: str = "final") -> Column:
    """Printable report of one routed prompt."""
    line = "=" * 60
    return F.format_string(
        f"{line}\nMETHOD : %s  (%s)\nBEFORE : %d words, ~%d tokens\n"
        f"AFTER  : %d words, ~%d tokens\nSAVED  : %s%%\n{line}\n"
        f"PROMPT ACTUALLY SENT:\n{line}\n%s\n{line}",
        "method", "reason", "original_words", "original_tokens", "final_words",
        "final_tokens", F.col("reduction_pct").cast("string"), text,
    )
