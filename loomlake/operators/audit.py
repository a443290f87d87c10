"""Audit analytics over stage events: funnels, drop-offs, quality, reasons and drill-downs.

Events: id, run_id, source_type, source_instance, document_id, document_uri,
document_title, stage, status, reason_code, message, input_count, output_count,
chunk_count, created_at, extra_json.  Each report is one aggregation; the funnel
feeds drop-offs and quality without reading the events again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stages, statuses and the reasons that mean an unchanged document.
STAGES = ["discover", "load", "transform", "filter", "chunk", "embed", "index"]
STATUSES = ["ok", "warning", "skipped", "error"]
UNCHANGED = ["unchanged_incremental", "unchanged_source"]
EMPTY = ["no_chunks_created", "no_text_after_cleanup", "empty_after_transform"]
FLAG_REASONS = ["unsupported_macro", "complex_table"]

c = F.col


def extra(events: DataFrame, key: str) -> Column:
    """A key of the events' extra JSON object; null where it is missing or the JSON is no object."""
    return F.get_json_object("extra_json", f"$.{key}") if "extra_json" in events.columns else F.lit(None).cast("string")


def has_extra(events: DataFrame, key: str) -> Column:
    """Whether the events' extra JSON object has a key, with whatever value."""
    return F.coalesce(F.array_contains(F.json_object_keys("extra_json"), key), F.lit(False)) if "extra_json" in events.columns else F.lit(False)


def unchanged(events: DataFrame) -> Column:
    reason = c("reason_code")
    return (c("stage") == "filter") & (c("status") == "skipped") & F.coalesce(reason.isin(UNCHANGED) | (reason.isNull() & (extra(events, "changed_flag") == "false")), F.lit(False))


def good(stage: str) -> Column:
    return (c("stage") == stage) & c("status").isin("ok", "warning")


def funnel(events: DataFrame) -> DataFrame:
    docs = lambda when: F.count_distinct(F.when(when, c("document_id")))
    total = lambda when, n: F.coalesce(F.sum(F.when(when, c(n))), F.lit(0)).cast("long")
    per_doc = events.withColumn("_same", unchanged(events))
    # a document filtered for another reason counts only if it is nowhere unchanged in its run
    doc = per_doc.groupBy("run_id", "document_id").agg(
        F.max(c("_same").cast("int")).alias("same"), F.max(((c("stage") == "filter") & (c("status") == "skipped")).cast("int")).alias("out"),
        *[F.max(good(s).cast("int")).alias(f"ok_{s}") for s in ("discover", "load", "transform", "chunk")],
        F.max(((c("stage") == "transform") & (c("status") == "error")).cast("int")).alias("failed"),
        total(good("chunk"), "chunk_count").alias("chunks"), total(good("embed"), "output_count").alias("embedded"), total(good("index"), "output_count").alias("indexed"),
    )
    known = lambda flag: F.count_if(c("document_id").isNotNull() & (flag == 1))
    f = doc.groupBy("run_id").agg(
        known(c("ok_discover")).alias("discovered"), known(c("ok_load")).alias("loaded"), known(c("same")).alias("unchanged_skipped"),
        F.count_if(c("document_id").isNotNull() & (c("out") == 1) & (c("same") == 0)).alias("filtered_skipped"), known(c("failed")).alias("transform_failed"),
        known(c("ok_transform")).alias("transformed_ok"), known(c("ok_chunk")).alias("chunked_docs"),
        F.sum("chunks").alias("chunks_created"), F.sum("embedded").alias("embedded_chunks"), F.sum("indexed").alias("indexed_chunks"),
    )
    f = f.withColumn("candidate_for_transform", F.greatest(F.lit(0), c("loaded") - c("unchanged_skipped")))
    return f.withColumns({"expected_dropoff": F.greatest(F.lit(0), c("loaded") - c("candidate_for_transform")), "problematic_dropoff": F.greatest(F.lit(0), c("candidate_for_transform") - c("transformed_ok"))})


def drop_offs(f: DataFrame) -> DataFrame:
    steps = [("loaded", "candidate_for_transform"), ("candidate_for_transform", "transformed_ok"), ("transformed_ok", "chunked_docs")]
    rows = F.array(*[F.struct(F.lit(a).alias("from_step"), F.lit(b).alias("to_step"), F.greatest(F.lit(0), c(a) - c(b)).alias("drop_count")) for a, b in steps])
    return f.select("run_id", F.inline(rows))


def run_types(runs: DataFrame, events: DataFrame) -> DataFrame:
    """The kind of each run by the stages it reached; runs without events are mixed."""
    seen = events.groupBy("run_id").agg(F.collect_set("stage").alias("s"))
    has = lambda x: F.coalesce(F.array_contains("s", x), F.lit(False))
    kind = F.when(has("index") & ~has("transform"), "index").when(has("embed") & ~has("transform"), "ingest").when(has("transform"), "transform").when(has("chunk"), "chunk").otherwise("mixed")
    return runs.select("run_id").distinct().join(seen, "run_id", "left").select("run_id", kind.alias("run_type"))


def quality(f: DataFrame, types: DataFrame) -> DataFrame:
    rows = f.join(types, "run_id", "left").withColumn("run_type", F.coalesce("run_type", F.lit("mixed")))
    ratio = lambda a, b: c(a) / F.greatest(F.lit(1), c(b)).cast("double")
    text = c("run_type").isin("transform", "chunk", "mixed")
    return rows.select(
        "run_id", "run_type", "candidate_for_transform", "expected_dropoff", "problematic_dropoff",
        F.when(c("unchanged_skipped") >= c("filtered_skipped") + c("transform_failed"), "loaded->candidate_for_transform").otherwise("candidate_for_transform->transformed_ok").alias("largest_loss"),
        F.when(text, ratio("transformed_ok", "loaded")).alias("transform_quote"), F.when(text, ratio("chunked_docs", "transformed_ok")).alias("chunk_quote"),
        F.when(c("run_type").isin("index", "mixed") & (c("chunks_created") > 0), c("indexed_chunks") / c("chunks_created")).alias("index_quote"),
    )


def stage_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(*[F.count_if(c("status") == s).alias(s) for s in STATUSES])


def reasons(events: DataFrame) -> DataFrame:
    """Counts of reasons over all events, by stage and by run, in one pass: (reason_code, by, value, n)."""
    g = events.where("reason_code IS NOT NULL").groupingSets([["reason_code"], ["reason_code", "stage"], ["reason_code", "run_id"]], "reason_code", "stage", "run_id").agg(F.grouping("stage").alias("gs"), F.grouping("run_id").alias("gr"), F.count("*").alias("n"))
    return g.select("reason_code", F.when(c("gs") == 0, "stage").when(c("gr") == 0, "run").otherwise("all").alias("by"), F.coalesce("stage", "run_id", F.lit("")).alias("value"), "n")


def reason_examples(events: DataFrame, k: int = 5) -> DataFrame:
    """Up to k documents of each reason in event order: (reason_code, n, examples)."""
    own = events.where("reason_code IS NOT NULL")
    first = own.where("document_id IS NOT NULL").groupBy("reason_code", "document_id", "document_title").agg(F.min(F.struct("created_at", "id")).alias("at"))
    first = first.withColumn("rn", F.row_number().over(W.partitionBy("reason_code").orderBy("at"))).where(c("rn") <= k)
    best = first.groupBy("reason_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "document_id"))), lambda x: x["document_id"]), "|").alias("examples"))
    return own.groupBy("reason_code").agg(F.count("*").alias("n")).join(best, "reason_code", "left")


def problem_documents(events: DataFrame) -> DataFrame:
    """The last event of each document that is not ok."""
    bad = events.where(c("status").isin("warning", "skipped", "error") & c("document_id").isNotNull())
    last = F.max_by(F.struct("document_title", "stage", "status", "reason_code", "message"), F.struct("created_at", "id")).alias("e")
    return bad.groupBy("document_id").agg(last).select("document_id", F.col("e.document_title").alias("title"), "e.stage", "e.status", "e.reason_code", "e.message")


def drilldown(events: DataFrame, only_problematic: bool = False, pages: str = "confluence") -> DataFrame:
    """One row for each run and document: its latest event, last known metrics, flags, and whether it is a problem.

    ``pages`` is the source type whose documents are pages.
    """
    at = F.struct("created_at", "id")
    rows = events.where(c("document_id").isNotNull())
    flags = F.array_union(F.coalesce(F.from_json(extra(events, "warning_flags"), "array<string>"), F.array().cast("array<string>")), F.when(c("reason_code").isin(FLAG_REASONS), F.array("reason_code")).otherwise(F.array().cast("array<string>")))
    when_set = lambda col, cond=None: F.max_by(col, F.when(col.isNotNull() if cond is None else col.isNotNull() & cond, at))
    # the last event that has a key counts, even with a null
    last_of = lambda key: F.max_by(F.struct(extra(events, key).alias("v")), F.when(has_extra(events, key), at))["v"]
    g = rows.groupBy("run_id", "document_id").agg(
        F.max_by(F.struct("source_type", "source_instance", "document_title", "stage", "status", "reason_code", "message", "document_uri"), at).alias("e"),
        last_of("is_dirty").alias("is_dirty"), last_of("content_id").alias("content_id"), F.max(has_extra(events, "changed_flag")).alias("told"),
        when_set(c("input_count")).alias("raw_text_length"), when_set(c("output_count"), c("stage") == "transform").alias("transformed_text_length"), when_set(c("chunk_count")).alias("chunk_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(flags)))), "|").alias("flags"),
        last_of("changed_flag").alias("changed"), F.max(F.coalesce(c("reason_code").isin(UNCHANGED), F.lit(False))).alias("any_same"),
    )
    flag = F.when(c("told"), F.when(c("changed") == "true", F.lit(True)).when(c("changed") == "false", F.lit(False))).when(c("any_same"), F.lit(False))
    rows = g.select(
        "run_id", "e.source_type", F.col("e.source_instance").alias("source_name"), "document_id", F.col("e.document_title").alias("title"), "e.stage", "e.status", "e.reason_code", "e.message", flag.alias("changed_flag"),
        "is_dirty", F.coalesce(flag == F.lit(False), F.lit(False)).alias("unchanged_flag"), "raw_text_length", "transformed_text_length", "chunk_count", F.when(c("flags") != "", c("flags")).alias("warning_flags"),
        F.col("e.document_uri").alias("source_path"), F.when(c("e.source_type") == "filesystem", c("e.document_uri")).alias("file_path"), F.when(c("e.source_type") == pages, c("document_id")).alias("page_id"), "content_id",
    )
    same = c("reason_code").isin(UNCHANGED) | (c("reason_code").isNull() & F.coalesce(~c("changed_flag"), F.lit(False)))
    bad = c("status").isin("warning", "error") | ((c("status") == "skipped") & ~F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("is_problematic", bad)
    return rows.where("is_problematic") if only_problematic else rows


def loaded_not_chunked(events: DataFrame) -> DataFrame:
    loaded = events.where("stage = 'load' AND status = 'ok' AND document_id IS NOT NULL").select("document_id").distinct()
    return loaded.join(events.where(good("chunk")).select("document_id"), "document_id", "left_anti")


def ok_but_empty(events: DataFrame, reasons_: list[str] = EMPTY) -> DataFrame:
    ok = events.where("stage = 'transform' AND status = 'ok' AND document_id IS NOT NULL").select("document_id")
    return events.where(c("reason_code").isin(reasons_)).join(ok, "document_id", "left_semi")


def select_runs(runs: DataFrame, day: str | None = None, run_id: str | None = None, source_type: str | None = None, source_instance: str | None = None) -> DataFrame:
    """Runs that all given filters hold for, the day that of their start."""
    given = {"run_id": run_id, "source_type": source_type, "source_instance": source_instance}
    if day:
        runs = runs.where(F.to_date("started_at") == F.lit(day).cast("date"))
    for name, value in given.items():
        if value:
            runs = runs.where(c(name) == value)
    return runs


def of_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The events of some runs."""
    return events.join(runs.select("run_id"), "run_id", "left_semi")


def run_overview(runs: DataFrame, types: DataFrame) -> DataFrame:
    """Runs with their type and place, the latest start first."""
    rows = runs.join(types, "run_id", "left").withColumn("run_type", F.coalesce("run_type", F.lit("mixed")))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("started_at"), "run_id")))


def top_reasons(events: DataFrame, by: str | None = None, k: int = 10) -> DataFrame:
    """The k most frequent reasons, in all or of each value of ``by``; equal counts in the order in which they first came."""
    own = events.where("reason_code IS NOT NULL").groupBy(*([by] if by else []), "reason_code").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("_at"))
    order = W.partitionBy(by).orderBy(F.desc("n"), "_at") if by else W.orderBy(F.desc("n"), "_at")
    return own.withColumn("place", F.row_number().over(order)).where(c("place") <= k).drop("_at")


def in_report_order(rows: DataFrame) -> DataFrame:
    """Drill-down rows in their order: problems first, then what is not ok, then by run and document."""
    return rows.orderBy(~c("is_problematic"), c("status") == "ok", "run_id", "document_id")


def instance_reasons(events: DataFrame, source_type: str) -> DataFrame:
    """Reasons of one source type by instance; a missing instance is unknown."""
    own = events.where((c("source_type") == source_type) & c("reason_code").isNotNull())
    return own.groupBy(F.coalesce(F.when(c("source_instance") != "", c("source_instance")), F.lit("unknown")).alias("instance"), "reason_code").agg(F.count("*").alias("n"))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%.1f%%", x * 100))


def largest_drop(f: DataFrame, metric: str, runs: DataFrame) -> DataFrame:
    """The run with the largest drop; of equal ones the first in report order, which is by latest start, then run id."""
    f = f.join(runs.select("run_id", "started_at"), "run_id", "left")
    first = F.struct(-c(metric), c("started_at").isNull(), -F.unix_micros(c("started_at").cast("timestamp")), "run_id")
    return f.agg(F.min_by(F.struct("run_id", c(metric).alias("drop")), first).alias("r")).select("r.*")


def report(runs: DataFrame, events: DataFrame, source_type: str = "confluence", **filters: str | None) -> dict[str, DataFrame]:
    """All parts of the report as frames, over the selected runs."""
    runs = select_runs(runs, **filters)
    events = of_runs(events, runs)
    types, f = run_types(runs, events), funnel(events)
    own = events.where(c("source_type") == source_type)
    return {
        "runs": run_overview(runs, types), "funnel": f, "quality": quality(f, types), "drop_off": drop_offs(f), "stage_stats": stage_stats(events),
        "reason_codes": reason_examples(events), "top_reasons": top_reasons(events), "top_reasons_by_stage": top_reasons(events, "stage", 5), "top_reasons_by_run": top_reasons(events, "run_id", 5),
        "problem_documents": problem_documents(events), "instance_reasons": instance_reasons(events, source_type), "loaded_not_chunked": loaded_not_chunked(own), "ok_but_empty": ok_but_empty(own),
        "largest_expected": largest_drop(f, "expected_dropoff", runs), "largest_problematic": largest_drop(f, "problematic_dropoff", runs),
    }


def render(parts: dict[str, DataFrame], markdown: bool = False) -> str:
    """The report as text: rows of runs, stages and top reasons only, a few for each run."""
    rows = lambda name, *order: [r.asDict() for r in parts[name].orderBy(*order).collect()]
    runs, dash = rows("runs", "place"), lambda x: "-" if x is None else str(x)
    columns = ["run_id", "started_at", "finished_at", "source_type", "source_instance", "mode", "run_type", "status", "total_events"]
    top = [f"{r['reason_code']}: {r['n']}" for r in rows("top_reasons", "place")]
    funnels = [(r.pop("run_id"), ", ".join(f"{k}={v}" for k, v in r.items())) for r in rows("funnel", "run_id")]
    if markdown:
        lines = ["# Audit-Report", "", "## Run-Übersicht", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(dash(r[x]) for x in columns) + " |" for r in runs)]
        return "\n".join([*lines, "", "## Funnel pro Run", *(f"- **{k}**: {v}" for k, v in funnels), "", "## Top-Reason-Codes", *(f"- {t}" for t in top)])
    quotes = {r["run_id"]: r for r in parts["quality"].select("run_id", "run_type", *[percent(c(q)).alias(q) for q in ("transform_quote", "chunk_quote", "index_quote")]).collect()}
    lines = ["=== Audit-Report ===", "", "Runs:", *("- " + " | ".join(dash(r[x]) for x in columns) for r in runs), "", "Funnel pro Run:"]
    for run, values in funnels:
        q = quotes[run]
        lines += [f"- {run}: {values}", f"  run_type={q.run_type} | Transform-Quote={q.transform_quote} | Chunk-Quote={q.chunk_quote} | Index-Quote={q.index_quote}"]
    lines += ["", "Stage-Statistiken:", *(f"- {r['stage']}: " + " ".join(f"{x}={r[x]}" for x in STATUSES) for r in rows("stage_stats", "stage")), "", "Top-Reason-Codes (gesamt):", *(f"- {t}" for t in top)]
    for title, name, key in (("je Stage", "top_reasons_by_stage", "stage"), ("je Run", "top_reasons_by_run", "run_id")):
        own: dict[str, list[str]] = {}
        for r in rows(name, key, "place"):
            own.setdefault(r[key], []).append(f"{r['reason_code']}={r['n']}")
        lines += ["", f"Top-Reason-Codes {title}:", *(f"- {k}: {', '.join(v)}" for k, v in own.items())]
    for title, name in (("Größter erwarteter Drop-Off (loaded -> candidate_for_transform)", "largest_expected"), ("Größter problematischer Drop-Off (candidate_for_transform -> transformed_ok)", "largest_problematic")):
        if (r := parts[name].first()) and r.run_id is not None:
            lines += [f"{title}: {r.run_id} = {r.drop}"]
    return "\n".join(lines)


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes a report frame as CSV with a header, or as JSON lines."""
    w = rows.write.mode("overwrite")
    w.option("header", True).option("escape", '"').csv(path) if kind == "csv" else w.option("ignoreNullFields", False).json(path)
