"""Reports: invariants, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwatch.functions.folds import gathered
from longwatch.functions.horizon import format_claim, format_instant
from longwatch.functions.nested import DROP, rewritten
from longwatch.functions.pricing import round_places
from longwatch.functions.text import escape_markdown, inline_code, markdown_fence
from longwatch.functions.urls import redact_url
from longwatch.operators.findings import assurance_label, assurance_status, report_scope

# Versions of the stored form, and fields that older ones lack.
VERSIONS = ("0.1.0", "0.2.0", "0.3.0", "0.4.0", "0.5.0", "0.6.0")
BATCHING = ("request_batching", "analysis_request_count", "repair_request_count", "chunk_section_counts", "coverage_complete")
RECOVERY = (
    "analysis_status", "sections_succeeded", "succeeded_chars", "sections_failed", "failed_chars", "failed_section_ids", "unanalyzed_sections", "recovery_split_count",
    "recovery_request_count", "total_provider_request_count",
)


def violations(runs: DataFrame) -> DataFrame:
    """One row for each rule that a run breaks: (run_id, rule). (V1 to V3)

    Batching rules hold from version 0.5.0, recovery rules from 0.6.0, and none
    before. A missing field breaks the rule "missing <field>" and no other: a
    comparison with it decides nothing.
    """
    c = F.col
    rank = F.array_position(F.array(*map(F.lit, VERSIONS)), c("schema_version"))
    counts, partial = c("chunk_section_counts"), c("analysis_status") == "partial"
    aware = c("analysis_mode") == "section_aware"
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    ones, some = F.forall(counts, lambda x: x == 1), F.exists(counts, lambda x: x > 1)
    batching = {f"missing {k}": c(k).isNull() for k in BATCHING} | {
        "missing sections_analyzed": aware & c("sections_analyzed").isNull(),
        "counts are not negative": (c("analysis_request_count") < 0) | (c("repair_request_count") < 0),
        "repairs within analysis": c("repair_request_count") > c("analysis_request_count"),
        "chunks hold sections": F.exists(counts, lambda x: x.isNull() | (x < 1)),
        "batching fits mode": c("request_batching").isNotNull() & (c("analysis_mode") != F.when(c("request_batching") == "whole_document", "whole_document").otherwise("section_aware")),
        "per section is one section": (c("request_batching") == "per_section") & ~ones,
        "chunks of several sections": (c("request_batching") == "section_chunks") & ~some,
        "chunks add up": aware & (total != c("sections_analyzed")),
    }
    first = {"a chunk for each request": c("analysis_request_count") != F.size(counts)}
    failed = c("sections_failed")
    recovery = {f"missing {k}": c(k).isNull() for k in RECOVERY} | {
        "total is the sum": c("total_provider_request_count") != c("analysis_request_count") + c("repair_request_count"),
        "failed ids are counted": failed != F.size("failed_section_ids"),
        "unanalyzed are counted": failed != F.size("unanalyzed_sections"),
        "failed ids in order": c("failed_section_ids") != c("unanalyzed_sections")["section_id"],
        "partial has failures": partial & (failed < 1),
        "complete has none": ~partial & ((failed != 0) | (F.size("failed_section_ids") > 0)),
        "covered is complete": c("coverage_complete") & (partial | (failed != 0)),
        "sections add up": c("sections_succeeded") + failed != c("sections_analyzed"),
        "chars add up": c("succeeded_chars") + c("failed_chars") != c("analyzed_chars"),
        "recovery is not negative": (c("recovery_split_count") < 0) | (c("recovery_request_count") < 0),
        "recovery within total": c("recovery_request_count") > c("total_provider_request_count"),
    }
    gates = [(batching, rank >= 5), (first, rank == 5), (recovery, rank >= 6)]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(gate & hit, F.lit(False)), F.lit(name)) for rules, gate in gates for name, hit in rules.items()]))
    return runs.select("run_id", F.explode(broken).alias("rule"))


def for_version(runs: DataFrame) -> DataFrame:
    """Runs without the fields that their version does not have; those of the current version get what they leave out. (V3)

    No version is the current one. A total left out is the sum; a run without a
    status is complete, and what else it leaves out about recovery is nothing.
    """
    c = F.col
    runs = runs.withColumn("schema_version", F.coalesce("schema_version", F.lit(VERSIONS[-1])))
    rank = F.array_position(F.array(*map(F.lit, VERSIONS)), c("schema_version"))
    for names, since in ((BATCHING, 5), (RECOVERY, 6)):
        runs = runs.withColumns({n: F.when(rank >= since, c(n)) for n in names if n in runs.columns})
    kinds = dict(runs.dtypes)
    silent = (rank == 6) & c("analysis_status").isNull()
    whole = {
        "sections_succeeded": F.coalesce("sections_analyzed", F.lit(0)), "succeeded_chars": F.coalesce("analyzed_chars", F.lit(0)), "analysis_status": F.lit("complete"),
        **dict.fromkeys(("sections_failed", "failed_chars", "recovery_split_count", "recovery_request_count"), F.lit(0)), **dict.fromkeys(("failed_section_ids", "unanalyzed_sections"), F.array()),
    }
    filled = {n: F.coalesce(n, F.when(silent, v.cast(kinds[n]))) for n, v in whole.items()}
    total = F.when(rank == 6, c("analysis_request_count") + c("repair_request_count"))
    return runs.withColumns(filled | {"total_provider_request_count": F.coalesce("total_provider_request_count", total)})


#: Fields that hold addresses, wherever they are.
ADDRESSES = ("source_uri", "retrieved_uri", "uri", "url")


def _address(url: Column) -> Column:
    return F.when(url.isNotNull(), redact_url(url))


def _stored_form(path, value, kind, siblings, without: tuple[str, ...], plain_claims: bool, hide_retrieved: bool):
    """The rule that gives a report the form of its version. (K1)"""
    name = path[-1]
    if name in without and path[:-1] in ((), ("run",)) or (hide_retrieved and name == "retrieved_uri"):
        return DROP
    if name in ADDRESSES and isinstance(kind, T.StringType):
        return _address(value)
    if plain_claims and name == "claimed_horizon" and isinstance(kind, T.StructType):
        return value["value"]
    return None


def _has_field(kind: T.DataType, name: str) -> bool:
    if isinstance(kind, T.StructType):
        return any(f.name == name or _has_field(f.dataType, name) for f in kind.fields)
    return _has_field(kind.elementType, name) if isinstance(kind, T.ArrayType) else False


def report_json(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, json): each run with its findings in order, nulls included. (K1)

    Addresses at any depth lose user, query and fragment; document.retrieved_uri
    is left out where it is null or, so redacted, the source's own. A run of an
    older schema_version has no fields of later ones, and the first two write
    claimed horizons as plain texts.
    """
    own = findings.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct(*[c for c in findings.columns if c not in ("run_id", "ord")]).alias("f")))).alias("_f"))
    rows = runs.join(own, "run_id", "left")
    every = F.struct(*runs.columns, F.coalesce(F.col("_f.f"), F.array().cast(own.select("_f.f").schema[0].dataType)).alias("findings"))
    rows = rows.select("run_id", every.alias("report"))
    kind = rows.schema["report"].dataType
    version = F.col("report.schema_version") if "schema_version" in runs.columns else F.lit(None).cast("string")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERSIONS)), F.coalesce(version, F.lit(VERSIONS[-1]))), F.lit(len(VERSIONS)))
    if _has_field(kind, "document") and _has_field(kind["document"].dataType, "retrieved_uri"):
        there = _address(F.col("report.document.retrieved_uri"))
        same = F.coalesce(there == _address(F.col("report.document.source_uri")), there.isNull(), F.lit(False))
        hides = ((same, True), (~same, False))
    else:
        hides = ((F.lit(True), False),)
    forms = (((rank <= 2), (*BATCHING, *RECOVERY), True), (rank <= 4, (*BATCHING, *RECOVERY), False), (rank == 5, RECOVERY, False), (rank >= 6, (), False))
    text = None
    for of_version, without, plain in forms:
        for of_address, hide in hides:
            shape = rewritten(F.col("report"), kind, lambda *x, w=without, p=plain, h=hide: _stored_form(*x, w, p, h))
            made = F.to_json(shape, {"ignoreNullFields": "false"})
            text = F.when(of_version & of_address, made) if text is None else text.when(of_version & of_address, made)
    return rows.select("run_id", text.alias("json"))


# Lines of a report's head; two spaces break a line.
INCOMPLETE = (
    "**This report is incomplete.** One or more planned sections could not be analyzed. Failed sections contribute no findings "
    "and must not be treated as evidence of absence. Human review is required.  "
)
RELATIVE = "_Coverage is relative to eligible text after front-matter/Index skips and any caps — not a claim that every semantic aspect was assessed._  "
CAP_WORDS = ("capped", "trimmed", "stopped at", "max_")


def _comma(n: Column) -> Column:
    return F.format_number(n, 0)


def _lines(*lines: Column) -> Column:
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def status_lines() -> Column:
    """Lines that tell whether a run is complete, from its columns; a field that it lacks gives no line."""
    c = F.col
    partial = F.coalesce(c("analysis_status") == "partial", F.lit(False))
    part = lambda n, chars, words: F.when(n.isNotNull(), F.concat(F.lit(words), F.lit(" "), n.cast("string"), F.lit(" sections"), F.when(chars.isNotNull(), F.concat(F.lit(", "), _comma(chars), F.lit(" chars"))).otherwise("")))
    bits = F.concat_ws("; ", part(c("sections_succeeded"), c("succeeded_chars"), "successfully analyzed"), part(c("sections_failed"), c("failed_chars"), "unanalyzed/failed"))
    name = lambda x: inline_code(escape_markdown(x))
    ids = F.array_join(F.transform("failed_section_ids", name), ", ")
    lost = F.array_join(F.transform("unanalyzed_sections", lambda u: F.concat(name(u["section_id"]), F.lit(" ("), escape_markdown(u["category"]), F.lit(")"))), "; ")
    splits, extra = (F.coalesce(x, F.lit(0)) for x in ("recovery_split_count", "recovery_request_count"))
    return _lines(
        F.when(partial, "**Analysis status:** PARTIAL  ").when(c("analysis_status") == "complete", "**Analysis status:** COMPLETE  "), F.when(partial, INCOMPLETE),
        F.when(bits != "", F.concat(F.lit("**Execution coverage:** "), bits, F.lit("  "))), F.when(F.size("failed_section_ids") > 0, F.concat(F.lit("**Failed section ids:** "), ids, F.lit("  "))),
        F.when(F.size("unanalyzed_sections") > 0, F.concat(F.lit("**Unanalyzed sections:** "), lost, F.lit("  "))),
        F.when((splits > 0) | (extra > 0) | partial, F.concat(F.lit("**Adaptive recovery:** "), splits.cast("string"), F.lit(" splits, "), extra.cast("string"), F.lit(" extra model requests  "))),
    )


def coverage_lines(coverage_percent: Column) -> Column:
    """Lines that tell how much of a document was in scope, from a run's columns."""
    c = F.col
    cut = F.coalesce(c("scope_truncated"), F.lit(False))
    share = F.concat(F.lit("**Coverage:** "), F.format_string("%.1f", round_places(coverage_percent, 1)), F.lit("% of eligible text analyzed  "))
    of_sections = F.when(c("sections_analyzed").isNotNull() & (c("eligible_sections") > 0), F.concat(F.lit("sections "), c("sections_analyzed").cast("string"), F.lit("/"), c("eligible_sections").cast("string"), F.lit(" eligible"))).when(
        c("sections_analyzed").isNotNull() & c("sections_total").isNotNull(), F.concat(F.lit("sections analyzed "), c("sections_analyzed").cast("string"), F.lit(" (parsed total "), c("sections_total").cast("string"), F.lit(")"))
    )
    of_chars = F.when(c("analyzed_chars").isNotNull() & c("eligible_chars").isNotNull(), F.concat(F.lit("chars "), _comma(c("analyzed_chars")), F.lit("/"), _comma(c("eligible_chars")), F.lit(" eligible")))
    bits = F.concat_ws("; ", of_sections, of_chars)
    caps = lambda note: F.lower(note).rlike("|".join(CAP_WORDS))
    note = F.get(F.filter("scope_notes", caps), 0)
    return _lines(
        F.when(cut, "**Analysis scope:** PARTIAL  ").otherwise("**Analysis scope:** COMPLETE  "),
        F.when(coverage_percent.isNotNull(), share).when(cut, "**Coverage:** truncated (eligible/analyzed char totals unavailable)  ").otherwise("**Coverage:** eligible text under current scope filters (char totals unavailable in this report)  "),
        F.when(bits != "", F.concat(F.lit("**Scope detail:** "), bits, F.lit("  "))), F.lit(RELATIVE), F.when(cut & note.isNotNull(), F.concat(F.lit("**Scope note:** "), escape_markdown(note), F.lit("  "))),
    )


# How a horizon's state is told, and the lines around it.
HORIZON_STATES = {
    "verified": "Verified", "contradicted": "Contradicted", "insufficient_parameters": "Insufficient parameters", "not_applicable": "Not applicable", "unsupported": "Unsupported",
    "ambiguous_signedness": "Ambiguous signedness", "error": "Error",
}
ARITHMETIC_ONLY = "Arithmetic verification only — does **not** confirm a standards defect or change human disposition."
UNFINISHED = ("insufficient_parameters", "unsupported", "not_applicable", "ambiguous_signedness")


def _item(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"- **{label}:** "), value))


def _thousands(number: Column) -> Column:
    """A whole number of any length, as text, with commas."""
    return F.regexp_replace(number, r"(?<=\d)(?=(?:\d{3})+$)", ",")


def _moment(at: Column) -> Column:
    return F.when(at.isNotNull(), escape_markdown(format_instant(at)))


def horizon_lines(version: Column, rollover: Column, notes: Column) -> Column:
    """Lines of a finding's deterministic validation, from the columns that validate() gives.

    rollover is the stated behaviour, notes an array of which the first three
    are shown; a value that is not known gives no line.
    """
    c = F.col
    h, status = c("horizon"), c("horizon.status")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in HORIZON_STATES.items() for x in kv]), status)
    unsure = status == "ambiguous_signedness"
    signedness = F.when(c("signed").isNotNull(), F.when(c("signed"), "Signed").otherwise("Unsigned")).when(unsure, "unresolved (both interpretations below)")
    rate = F.when(c("ticks_per_second") == F.floor("ticks_per_second"), F.floor("ticks_per_second").cast("string")).otherwise(c("ticks_per_second").cast("string"))
    unit = F.concat(inline_code(c("unit")), F.when(c("ticks_per_second").isNotNull(), F.concat(F.lit(" ("), rate, F.lit(" ticks/second)"))).otherwise(""))
    head = [
        F.lit("#### Deterministic validation"), F.lit(""), F.concat(F.lit("Status: "), F.coalesce(F.concat(F.lit("**"), known, F.lit("**")), escape_markdown(status)), F.lit(" ("), inline_code(status), F.lit(")")), F.lit(""), F.lit(ARITHMETIC_ONLY), F.lit(""),
        _item("Width", F.when(c("width_bits").isNotNull(), F.concat(c("width_bits").cast("string"), F.lit(" bits")))), _item("Signedness", signedness), _item("Epoch kind", F.when(c("epoch_kind").isNotNull(), inline_code(c("epoch_kind")))),
        _item("Epoch", _moment(c("epoch"))), _item("Unit", F.when(c("unit").isNotNull(), unit)), _item("Rollover behavior (stated)", F.when(rollover != "", escape_markdown(rollover))),
    ]
    branches = []
    for label, branch in (("Signed interpretation", c("signed_branch")), ("Unsigned interpretation", c("unsigned_branch"))):
        there = unsure & branch.isNotNull()
        spread = F.concat(F.lit("  - Range: "), _thousands(branch["minimum_value"]), F.lit(" … "), _thousands(branch["maximum_value"]))
        branches += [F.when(there, f"- **{label}:**"), F.when(there, spread), F.when(there, F.concat(F.lit("  - Last representable: "), _moment(branch["last"]))), F.when(there, F.concat(F.lit("  - First out-of-range: "), _moment(branch["first_out_of_range"])))]
    own = [
        F.when(~unsure, x) for x in (
            _item("Minimum value", _thousands(h["minimum_value"])), _item("Maximum value", _thousands(h["maximum_value"])), _item("Earliest representable instant", _moment(h["earliest"])), _item("Last representable instant", _moment(h["last"])),
            _item("First wrapped/out-of-range instant", _moment(h["first_out_of_range"])),
        )
    ]
    old = F.coalesce(version.isin("0.1.0", "0.2.0"), F.lit(False))
    claim = format_claim(c("claim_value"), c("claim_precision"), version)
    stated = F.when(c("claim_value").isNotNull(), F.concat(F.when(old, "- **Model-stated horizon:** ").otherwise("- **Source-stated horizon:** "), claim))
    reason = F.coalesce(escape_markdown(F.get(notes, 0)), F.lit("required parameters unavailable"))
    result = (
        F.when(h["claim_consistent"], "- Result: **Consistent** with deterministic calculation").when(~h["claim_consistent"], "- Result: **Inconsistent** with deterministic calculation")
        .when((status != "insufficient_parameters") & ~old & c("claim_precision").isin("year", "month") & c("claim_value").isNotNull(), "- Result: not compared as an exact instant (partial source precision)")
        .when(status.isin(*UNFINISHED), F.concat(F.lit("- **Result:** validation not completed ("), reason, F.lit(")")))
    )
    told = F.transform(F.slice(F.coalesce(notes, F.array().cast("array<string>")), 1, 3), lambda n: F.concat(F.lit("- **Note:** "), escape_markdown(n)))
    return F.concat(_lines(*head, *branches, *own, stated, result), told)


def _finding_lines(c: Column) -> Column:
    status = assurance_status(F.col("disposition"), F.col("validation_status"), F.col("source_verified"))
    quotes = F.array_join(F.transform("evidence", lambda e: markdown_fence(e["quote"])), "\n\n")
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), escape_markdown(F.concat_ws(" ", "id", "title"))), F.lit(""),
        F.concat(F.lit("- Type: "), "finding_type"), F.concat(F.lit("- Severity: "), "severity"), F.concat(F.lit("- Confidence: "), "confidence"),
        F.concat(F.lit("- Status: "), assurance_label(status)), F.lit(""), escape_markdown(c), F.lit(""), quotes,
    )


def report_markdown(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, markdown): a header, counts, primary findings, then incidental ones; out-of-scope ones are left out. (K2)"""
    shown = report_scope(findings).withColumn("block", _finding_lines(F.col("description")))
    parts = shown.groupBy("run_id").agg(*[
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("ord", "block"))))["block"], "\n\n").alias(p) for p in ("primary", "incidental")
    ], F.count_if(F.col("part") == "primary").alias("n_primary"), F.count_if(F.col("part") == "incidental").alias("n_incidental"))
    rows = runs.join(parts, "run_id", "left").fillna({"n_primary": 0, "n_incidental": 0, "primary": "", "incidental": ""})
    head = F.concat(F.lit("# Review of "), escape_markdown(F.col("doc_id").cast("string")))
    sums = F.format_string("Findings: %d primary, %d incidental.", "n_primary", "n_incidental")
    body = F.concat_ws("\n\n", head, sums, F.when(F.col("primary") != "", F.concat(F.lit("## Findings\n\n"), "primary")), F.when(F.col("incidental") != "", F.concat(F.lit("## Incidental\n\n"), "incidental")))
    return rows.select("run_id", F.concat(body, F.lit("\n")).alias("markdown"))


def headings(markdown: DataFrame) -> DataFrame:
    """(run_id, n, line): headings outside fenced blocks. (X11)"""
    def step(a: Column, line: Column) -> tuple[dict[str, Column], Column, Column]:
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        closes = (a["fence"] != "") & (mark != "") & mark.startswith(F.substring(a["fence"], 1, 1)) & (F.length(mark) >= F.length(a["fence"])) & line.rlike(r"^ {0,3}[`~]+\s*$")
        fence = F.when(closes, "").when((a["fence"] == "") & (mark != ""), mark).otherwise(a["fence"])
        head = (a["fence"] == "") & (mark == "") & line.rlike(r"^ {0,3}#{1,6}(\s|$)")
        return {"fence": fence}, head, line

    found = gathered(F.split("markdown", "\n"), {"fence": F.lit("")}, step, "string")
    return markdown.select("run_id", F.posexplode(found).alias("n", "line"))
