"""What annotators are asked and how their replies are read."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.validation.metrics import LABELS

ANNOTATIONS = "annotator string, keyword_set string, keyword string, label string, novelty double, rationale string"
SYSTEM = "You review literature surveys. Judge each keyword by the rubric alone and reply with one JSON object and nothing else."
RUBRIC = """For each keyword give a label and a novelty from 1 (thoroughly studied) to 10 (hardly studied):
GAP: relevant to the problem and clearly under-studied.
EXPLORED: relevant, and already well covered.
LOW IMPORTANCE: little bearing on the problem.
METHOD: a method, tool or design, not a topic.
NOISE: no meaningful topic."""


@dataclass(frozen=True)
class Annotation:
    annotator: str
    keyword_set: str
    keyword: str
    label: str
    novelty: float
    rationale: str = ""

    def __post_init__(self) -> None:
        if self.label not in LABELS:
            raise ValueError(f"{self.label!r} is not one of {', '.join(LABELS)}")
        if not 1 <= self.novelty <= 10:
            raise ValueError(f"novelty must be from 1 to 10, not {self.novelty}")


def annotations_frame(spark: SparkSession, items: Sequence[Annotation]) -> DataFrame:
    return spark.createDataFrame([(a.annotator, a.keyword_set, a.keyword, a.label, float(a.novelty), a.rationale) for a in items], ANNOTATIONS)


def checked(judgements: DataFrame) -> DataFrame:
    """The same rows; a wrong label or novelty is an error when the rows are read."""
    ok = F.col("label").isin(*LABELS) & F.col("novelty").between(1, 10)
    return judgements.withColumn("label", F.when(F.coalesce(ok, F.lit(False)), F.col("label")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not a valid judgement:"), "keyword", "label", F.col("novelty").cast("string"))).cast("string")))


def build_prompt(keywords: Sequence[str], domain: str, problem: str | None = None, evidence: Mapping[str, tuple[int, Sequence[str]]] | None = None) -> str:
    """The question about these keywords; evidence adds how often a keyword occurs and in which records."""
    lines = [f"Field: {domain}."]
    if problem:
        lines.append(f"Problem: {problem}")
    lines += ["Judge whether each keyword marks a gap in this field's literature.", RUBRIC, "Keywords:"]
    for i, k in enumerate(keywords, 1):
        line = f"{i}. {k}"
        if evidence and k in evidence:
            n, titles = evidence[k]
            line += f" (in {n} record(s)" + (": " + "; ".join(titles) if titles else "") + ")"
        lines.append(line)
    lines.append('Reply as {"annotations": [{"keyword": "...", "label": "...", "novelty": 1, "rationale": "..."}]} with one entry for each keyword.')
    return "\n".join(lines)


def extract_entries(reply: str) -> list[dict]:
    """The entries of a reply: its JSON object, fenced or not; else every readable {...} in it, trailing commas mended."""
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", reply.strip())
    first, last = text.find("{"), text.rfind("}")
    if first >= 0 and last > first:
        try:
            whole = json.loads(text[first : last + 1])
            found = whole.get("annotations", whole.get("results"))
            if isinstance(found, list):
                return [x for x in found if isinstance(x, dict)]
        except ValueError:
            pass
    out = []
    for piece in re.findall(r"\{[^{}]*\}", text):
        try:
            entry = json.loads(re.sub(r",\s*}", "}", piece))
        except ValueError:
            continue
        if isinstance(entry, dict) and "keyword" in entry:
            out.append(entry)
    return out


def parse_reply(reply: str, keywords: Sequence[str], annotator: str, keyword_set: str) -> list[Annotation]:
    """Judgements of the known keywords (matched without case); entries with unknown keywords or labels are left out."""
    known = {k.strip().lower(): k for k in keywords}
    out: dict[str, Annotation] = {}
    for e in extract_entries(reply):
        keyword = known.get(str(e.get("keyword", "")).strip().lower())
        label = str(e.get("label", "")).strip().upper().replace("_", " ")
        try:
            novelty = float(e.get("novelty", 1))
        except (TypeError, ValueError):
            novelty = 1.0
        if keyword is not None and keyword not in out and label in LABELS:
            out[keyword] = Annotation(annotator, keyword_set, keyword, label, min(10.0, max(1.0, novelty)), str(e.get("rationale", ""))[:500])
    return list(out.values())
