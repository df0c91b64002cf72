"""A table of replies read as semi-structured values, and questions asked from tasks.

replies    annotator, keyword_set, asked, reply       asked orders an annotator's replies
keywords   keyword_set, keyword

The rules are those of protocol.parse_reply, but for objects that repeat a key, which Spark does not take for JSON: they are
left out. A null keyword is no keyword, a null rationale an empty one. Null and empty replies have no entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.functions.order import numbered
from gapspark.sources.tables import materialized
from gapspark.validation.annotators import Annotator
from gapspark.validation.metrics import LABELS
from gapspark.validation.protocol import build_prompt

_NONE = "cast(array() as array<variant>)"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def entries(reply: Column) -> Column:
    """array of variant: the objects that a reply lists, fenced or not; else every readable {...} with a keyword, trailing commas mended."""
    text = F.regexp_replace(_stripped(F.coalesce(reply, F.lit(""))), r"^```\w*\s*|\s*```$", "")
    whole = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    listed = lambda path: F.try_variant_get(whole, path, "array<variant>")
    found = F.when(F.try_variant_get(whole, "$.annotations", "variant").isNotNull(), listed("$.annotations")).otherwise(listed("$.results"))
    objects = F.filter(found, lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda p: F.try_parse_json(F.regexp_replace(p, r",\s*\}", "}")))
    saved = F.filter(pieces, lambda e: e.isNotNull() & F.try_variant_get(e, "$.keyword", "variant").isNotNull())
    return F.coalesce(objects, saved, F.expr(_NONE))


def judgements(replies: DataFrame, keywords: DataFrame) -> DataFrame:
    """annotator, keyword_set, keyword, label, novelty, rationale: the first entry with a valid label of each known keyword.

    Keywords match without case and outer white space; of those that differ in nothing else the last is taken. A novelty that is no number
    is 1, others are brought to 1 to 10. Keywords that no reply judges stay missing.
    """
    known = keywords.groupBy("keyword_set", F.lower(_stripped(F.col("keyword"))).alias("_key")).agg(F.max("keyword").alias("keyword"))
    each = replies.select("annotator", "keyword_set", "asked", F.posexplode(entries(F.col("reply"))).alias("at", "e"))
    told = lambda name, kind: F.try_variant_get("e", f"$.{name}", kind)
    number = told("novelty", "double")
    novelty = F.when(number.isNull() | F.isnan(number), 1.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(1.0), number)))
    rows = each.select(
        "annotator", "keyword_set", "asked", "at", F.lower(_stripped(told("keyword", "string"))).alias("_key"),
        F.replace(F.upper(_stripped(told("label", "string"))), F.lit("_"), F.lit(" ")).alias("label"), novelty.alias("novelty"), F.substring(F.coalesce(told("rationale", "string"), F.lit("")), 1, 500).alias("rationale"))
    # the first entry of each key is found before keywords are met: entries are many and are neither shuffled nor broadcast, keys are few
    first = rows.where(F.col("label").isin(*LABELS) & F.col("_key").isNotNull()).groupBy("annotator", "keyword_set", "_key").agg(F.min_by(F.struct("label", "novelty", "rationale"), F.struct("asked", "at")).alias("x"))
    first = first.join(known.hint("merge"), ["keyword_set", "_key"])  # sizes are guessed before entries are listed, so no side is broadcast by a guess
    return first.select("annotator", "keyword_set", "keyword", "x.label", "x.novelty", "x.rationale")


def asked(keywords: DataFrame, annotator: Annotator, domain: str, problem: str | None = None, evidence: DataFrame | None = None, turn: int = 0) -> DataFrame:
    """replies of an annotator to questions about its batch_size keywords each, a question a row; a table, since asking costs.

    evidence is keyword, n, titles. Questions are asked by tasks; a task that is lost asks its questions again.
    """
    rows = keywords.select("keyword_set", "keyword").distinct()
    rows = numbered(rows, ["keyword_set", "keyword"], "_i")
    if evidence is not None:
        rows = rows.join(evidence.select("keyword", "n", "titles"), "keyword", "left")
    else:
        rows = rows.withColumns({"n": F.lit(None).cast("long"), "titles": F.lit(None).cast("array<string>")})
    batch = F.floor((F.col("_i") - 1) / annotator.batch_size).cast("long")
    questions = rows.groupBy("keyword_set", batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_i", "keyword", "n", "titles"))).alias("ks"))  # batch_size keywords
    name = annotator.name

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                known = {k["keyword"]: (int(k["n"]), [t for t in (k["titles"] if k["titles"] is not None else [])]) for k in row.ks if k["n"] is not None}
                reply = annotator.reply(build_prompt([k["keyword"] for k in row.ks], domain, problem, known))
                yield pd.DataFrame({"annotator": [name], "keyword_set": [row.keyword_set], "asked": [turn * 2**40 + row.batch], "reply": [reply]})

    return materialized(questions.mapInPandas(ask, "annotator string, keyword_set string, asked long, reply string"), "replies")


def annotate(keywords: DataFrame, annotator: Annotator, domain: str, problem: str | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Judgements of all keywords by an annotator; what replies leave out is asked for once more, then stays missing."""
    first = asked(keywords, annotator, domain, problem, evidence)
    left = keywords.select("keyword_set", "keyword").distinct().join(judgements(first, keywords), ["keyword_set", "keyword"], "left_anti")
    again = asked(left, annotator, domain, problem, evidence, turn=1)
    return judgements(first.unionByName(again), keywords)
