"""Secret scans over an incremental blob ledger. DataFrame functions only.

Every version of a document is content-addressed by the SHA-256 of its text. The ledger holds which (blob, rule,
rule version) were scanned and what was found; a scan reads only the blobs that some rule version has not seen, each
distinct text once however many documents carry it, and joins the findings back to all documents ("paths").

A rule is a pattern whose leftmost non-overlapping matches count if the whole match (group 0) or one of its groups has
a least number of characters. Spans are code points, end exclusive.

Null texts are scanned as empty ones and have no spans; null ids are kept; repeated rows each get a row. Columns other
than doc_id and text are not read, so clashing names cannot matter. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.utils import AnalysisException

from gapspark.llm.common import new_path, packed_rows, table, written


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: Fixed values of the base rules: kind, pattern, the group that is measured and its least length.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

_FOUND = "blob string, rule string, version int, ord int, start long, end long"


def _matches(text: Column, rule: Rule) -> Column:
    """array of (gap before the match, match, whether it counts); the gaps come from splitting at the matches."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    cut = F.split(text, rule.pattern, -1)
    length = F.length if not rule.group else (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)))
    pairs = F.zip_with(every, F.slice(cut, 1, F.size(every)), lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), (length(m) >= rule.least).alias("ok")))
    return F.when(text.rlike(rule.pattern), pairs).otherwise(F.expr("array()").cast("array<struct<gap:bigint,len:bigint,ok:boolean>>"))


def scan(blobs: DataFrame, rules=BASE_RULES) -> DataFrame:
    """(blob, rule, version, ord, start, end) of every counting match in blobs(blob, text)."""
    kinds = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(i).alias("ord"), _matches(F.col("text"), r).alias("m")) for i, r in enumerate(rules)])
    each = blobs.select("blob", F.explode(F.filter(kinds, lambda k: F.size(k["m"]) > 0)).alias("k"))
    each = each.select("blob", "k.rule", "k.version", "k.ord", F.posexplode("k.m").alias("i", "m"))
    each = each.dropDuplicates(["blob", "rule", "i"])  # where a blob has two holders that are alike in every way
    ends = F.sum(F.col("m.gap") + F.col("m.len")).over(Window.partitionBy("blob", "rule").orderBy("i"))
    return each.withColumn("end", ends).where("m.ok").select("blob", "rule", "version", "ord", (F.col("end") - F.col("m.len")).alias("start"), "end")


def _table_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def update_ledger(docs: DataFrame, ledger: str, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger folder has not seen, add it there, and return the paths: (doc_id, blob).

    ledger/seen has (blob, rule, version), ledger/found the findings. A rerun with the same rules scans nothing;
    a rule with a new version is run over all blobs again, the other rules are not. Findings are written before their blobs
    are marked as seen. A run that is lost in between is done again by the next one; what both found is the same, because a
    finding depends on nothing but the blob and the rule's version, and is read once (`findings`).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text"), 256))
    paths = written(rows.select("doc_id", "blob"), "paths")
    distinct = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    seen = _table_or_none(spark, f"{ledger}/seen")
    by_rules: dict[tuple[Rule, ...], DataFrame] = {}
    if seen is None:
        by_rules[tuple(rules)] = distinct
    else:
        for rule in rules:
            old = seen.where((F.col("rule") == rule.name) & (F.col("version") == rule.version)).select("blob")
            by_rules[(rule,)] = distinct.join(old, "blob", "left_anti")
    for part, unseen in by_rules.items():
        # One holder of each unseen blob is scanned: a semi-join whose key is spread evenly even where a blob is hot.
        unseen = unseen.select(F.col("blob").alias("b"), F.col("holder").alias("h"))
        if seen is not None:
            unseen = written(unseen, "unseen")
        holders = rows.join(unseen.hint("merge"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("h")), "left_semi")
        scan(holders.select("blob", "text"), part).write.mode("append").parquet(f"{ledger}/found")
        marks = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in part])).alias("k")
        unseen.select(F.col("b").alias("blob"), marks).select("blob", "k.rule", "k.version").write.mode("append").parquet(f"{ledger}/seen")
    return paths


def findings(spark, ledger: str, rules=BASE_RULES) -> DataFrame:
    """The ledger's distinct findings by the given rule versions."""
    found = spark.read.schema(_FOUND).parquet(f"{ledger}/found")
    keep = reduce(lambda a, r: a | ((F.col("rule") == r.name) & (F.col("version") == r.version)), rules, F.lit(False))
    return found.where(keep).distinct()


def _by_blob(spark, ledger: str, rules) -> DataFrame:
    """(blob, spans), a table: the spans of each blob that has any, in order of start, then rule."""
    listed = F.array_sort(F.collect_list(F.struct("start", "ord", "end", "rule")))
    return written(findings(spark, ledger, rules).groupBy("blob").agg(listed.alias("spans")), "spans")


def scan_documents(docs: DataFrame, ledger: str | None = None, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, blob) with spans an array of (start, ord, end, rule), in order, one row per document."""
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    paths = update_ledger(docs, ledger, rules, id_col, text_col)
    none = F.expr("array()").cast("array<struct<start:bigint,ord:int,end:bigint,rule:string>>")
    return paths.join(_by_blob(spark, ledger, rules), "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"), "blob")


def redacted(docs: DataFrame, mask: str = "[secret]", rules=BASE_RULES, ledger: str | None = None) -> DataFrame:
    """docs with every counting match masked in text and n_chars made to fit, all other columns as they were.

    Documents are joined to their findings by content address. Matches of one kind do not overlap; kinds are masked
    in order of start, and a match that overlaps one already masked is covered with it. Null texts stay null. An empty table
    stays one; repeated rows are all kept, and no name of a column of docs can clash.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    update_ledger(docs, ledger, rules)
    text = F.col("doc").getField("text")
    rows = packed_rows(docs).withColumn("key", F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))
    joined = rows.join(_by_blob(spark, ledger, rules).hint("merge"), F.col("key") == F.col("blob"), "left")
    # fold over the spans in order of start: what is kept before a span, then the mask, unless it starts inside the last one
    step = F.aggregate(
        "spans",
        F.struct(F.expr("array()").cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    out = joined.withColumn("masked", F.when(F.col("spans").isNotNull(), step).otherwise(text))
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("masked")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in columns.items()])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, digest and list of spans of every document.

    Null texts count as empty and have no spans; null ids and repeated rows are kept; spans that start together are in order of
    kind. An empty table gives no rows.
    """
    out = scan_documents(table(spark, sf_dir, "documents"))
    base = [r.name for r in BASE_RULES]

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select("doc_id", *[of(k) for k in base], F.sha2(joined(F.filter("spans", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


OP2_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as (
  select doc_id, 'assign' as kind, 0 as ord, regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as ms, regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as gs, regexp_split_to_array(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as ps, 6 as least from d
  union all
  select doc_id, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), 20 from d
  union all
  select doc_id, 'hex', 2, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}'), 24 from d),
e as (select doc_id, kind, ord, unnest(range(1, len(ms) + 1)) as i, ms, gs, ps, least from m),
s as (
  select doc_id, kind, ord,
    list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as start,
    length(ms[i]) as n
  from e where length(gs[i]) >= least),
a as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint), ',' order by start, ord) as spans
  from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)
"""
