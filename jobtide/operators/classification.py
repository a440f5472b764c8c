"""Open/closed classification of posting texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.functions import phrases as P
from jobtide.functions.status import VERDICT_TYPE, build_prompt, keyword_status, parse_response, text_gate

SURE = 0.8


def build_prompts(texts: DataFrame) -> DataFrame:
    """Prompts for the texts that need a model, ready for a batch inference job: those long enough to judge
    that keywords do not already settle."""
    unsettled = text_gate("text").isNull() & (keyword_status("text")["confidence"] <= F.lit(SURE))
    return texts.filter(unsettled).select("posting_id", build_prompt("text").alias("prompt"))


def _answers(responses: DataFrame) -> DataFrame:
    """One row per posting with the verdict of each provider; only HTTP 200 counts, and of several answers the first: by ``answered_at`` where that column is there, else by text.

    The text of an answer sits in ``response`` (first provider) or ``generated_text`` (second, possibly as
    item 0 of a list). A missing field reads as '', an unreadable body as no answer.
    """
    first, second = P.PROVIDER_METHODS
    body = responses.filter(F.col("http_status") == 200).withColumn("json", F.try_parse_json("body"))
    kind = F.schema_of_variant("json")
    empty_list = kind.startswith("ARRAY") & (F.size(F.try_variant_get("json", "$", "array<variant>")) == 0)
    is_list = kind.startswith("ARRAY") & ~empty_list
    item = F.when(is_list, F.try_variant_get("json", "$[0]", "variant")).when(kind.startswith("OBJECT"), F.col("json"))

    def field(value, name):
        got = F.try_variant_get(value, f"$.{name}", "variant")
        # variants spell "no such field" as SQL null and an explicit JSON null or other type by its own name
        usable = F.schema_of_variant(got) == "STRING"
        return (
            F.when(~F.schema_of_variant(value).startswith("OBJECT") | value.isNull(), F.lit(None).cast("string"))
            .when(got.isNull(), F.lit(""))
            .when(usable, F.try_variant_get(value, f"$.{name}", "string"))
        )

    answer = F.when(F.col("provider") == first, field(F.col("json"), "response")).when(
        F.col("provider") == second, field(item, "generated_text")
    )
    parsed = body.withColumn("answer", answer).filter(F.col("answer").isNotNull())

    moment = [F.col("answered_at").isNull(), "answered_at"] if "answered_at" in responses.columns else []

    def of(provider):
        return F.min_by("answer", F.when(F.col("provider") == provider, F.struct(*moment, "answer")))

    return (
        parsed.groupBy("posting_id")
        .agg(of(first).alias("a1"), of(second).alias("a2"))
        .select("posting_id", parse_response("a1", first).alias("v1"), parse_response("a2", second).alias("v2"))
    )


def classify(texts: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Verdict per posting: too short, sure by keywords, first provider, second provider, keywords.

    Texts are reduced to verdicts before the join, so no text is shuffled.
    """
    gate, keyword = F.col("gate"), F.col("keyword")
    sure = F.when(keyword["confidence"] > F.lit(SURE), keyword)
    local = texts.select("posting_id", text_gate("text").alias("gate"), keyword_status("text").alias("keyword"))
    if responses is None:
        pick = F.coalesce(gate, keyword)
    else:
        local = local.join(_answers(responses), "posting_id", "left")
        pick = F.coalesce(gate, sure, F.col("v1"), F.col("v2"), keyword)
    return local.select("posting_id", pick.cast(VERDICT_TYPE).alias("verdict")).select("posting_id", "verdict.*")
