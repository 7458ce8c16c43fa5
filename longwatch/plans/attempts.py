"""Two rounds of answers: what a first answer fails in decides whether, and how, its request is made once more.

An attempt is a row. The first round asks for every unit (one request of a
packed document); its answers are read once, checked natively, and kept. Units
whose answer is no findings object, or only quotes what its section does not
hold, get one second request, for which the two kinds share one slot. Nothing
is asked a third time, and no answer is read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longwatch.functions import prompts
from longwatch.operators.chunks import request_text
from longwatch.operators.findings import ENVELOPE_ERRORS, FINDING, read_answers
from longwatch.operators.grounding import quote_in
from longwatch.plans.review import numbered_findings
from longwatch.storage import computed_once

UNIT = ["doc_id", "request"]
#: What a second request asks for, by the state of the first answer.
SECOND = {"unreadable": "json_repair", "ungrounded": "evidence_correction"}
#: Asks requests (doc_id, request, attempt, kind, prompt); gives (doc_id, request, content, state), state null or ok for an answer that ended as it should.
Ask = Callable[[DataFrame], DataFrame]


def bindings(packed: DataFrame) -> DataFrame:
    """(doc_id, request, ord, ref, id, title, text): the sections that each request may name."""
    c = F.col
    return packed.select("doc_id", c("chunk_index").alias("request"), "ord", "ref", "id", "title", "text")


def first_requests(packed: DataFrame) -> DataFrame:
    """(doc_id, request, attempt, kind, prompt): one request for each chunk."""
    refs = packed.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("ord", "ref")))["ref"].alias("refs"))
    rows = request_text(packed).join(refs, ["doc_id", "chunk_index"])
    return rows.select("doc_id", F.col("chunk_index").alias("request"), F.lit(1).alias("attempt"), F.lit("primary").alias("kind"), prompts.section_request(F.col("refs"), F.col("text")).alias("prompt"))


def judged(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """Answers (doc_id, request, state, content) with an outcome, the class of their failure, and their findings as JSON.

    The first bad finding decides. Outcomes: ok; unreadable (no findings
    object, and asking again can help); ungrounded (a quote that its section
    does not hold); truncated; invalid for anything else, such as a reference
    that the request does not have or none.
    """
    c = F.col
    read = read_answers(answers.select(*UNIT, "state", "content"))
    of = "section_id string, evidence array<struct<quote:string>>"
    items = read.where("coalesce(state, 'ok') = 'ok'").select(*UNIT, F.posexplode("items").alias("item", "json")).select(*UNIT, "item", F.from_json("json", of).alias("f"))
    # a section's text meets all findings that name it at once
    asked = items.groupBy(*UNIT, c("f.section_id").alias("ref")).agg(F.collect_list(F.struct("item", c("f.evidence.quote").alias("quotes"))).alias("asked"))
    met = asked.join(sections.select(*UNIT, "ref", c("text").alias("source")), [*UNIT, "ref"], "left")
    quoted = lambda x: F.forall(x["quotes"], lambda q: quote_in(c("source"), q))
    fault = F.transform("asked", lambda x: F.struct(x["item"].alias("item"), F.when(c("source").isNull(), "section_id").when(~quoted(x), "quote").alias("fault")))
    first = met.select(*UNIT, F.explode(fault).alias("x")).where("x.fault IS NOT NULL").groupBy(*UNIT).agg(F.min("x").alias("first"))
    # NB: findings before a bad item only, so a fault is always the first one
    lost = c("error").isin(*ENVELOPE_ERRORS)
    outcome = (
        F.when(c("state") == "truncated", "truncated").when(F.coalesce(c("state") != "ok", F.lit(False)), "invalid")
        .when(lost, F.when(c("repairable"), "unreadable").otherwise("invalid")).when(c("first.fault") == "quote", "ungrounded")
        .when(c("first").isNotNull() | c("error").isNotNull(), "invalid").otherwise("ok")
    )
    why = F.when(F.coalesce(c("state") != "ok", F.lit(False)), c("state")).otherwise(F.coalesce(c("first.fault"), c("error")))
    out = read.join(first, UNIT, "left").withColumn("outcome", outcome)
    return out.select(*UNIT, "outcome", F.when(c("outcome") != "ok", why).alias("failure"), F.when(c("outcome") == "ok", c("items")).alias("findings"))


def recorded(answers: DataFrame) -> Ask:
    """Answers that are at hand, (doc_id, request, attempt, content) with state or not; of several to one attempt the least content counts."""
    c = F.col
    state = c("state") if "state" in answers.columns else F.lit(None).cast("string")
    rows = answers.select(*UNIT, c("attempt").cast("int").alias("attempt"), state.alias("state"), "content")

    def ask(requests: DataFrame) -> DataFrame:
        met = rows.join(requests.select(*UNIT, "attempt"), [*UNIT, "attempt"], "left_semi")
        one = Window.partitionBy(*UNIT, "attempt").orderBy(c("content").asc_nulls_last(), "state")
        return met.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "attempt")

    return ask


def attempts(packed: DataFrame, ask: Ask) -> DataFrame:
    """One row for each attempt: (doc_id, request, attempt, kind, outcome, failure, findings).

    A request without an answer has the outcome lost: a first one is not asked
    again, a second one leaves the unit failed.
    """
    c = F.col
    sections = bindings(packed)
    asked = first_requests(packed)
    answers = computed_once(ask(asked).select(*UNIT, "state", "content"))
    first = computed_once(judged(answers, sections))
    again = first.where(c("outcome").isin(*SECOND)).select(*UNIT, F.create_map(*[F.lit(x) for kv in SECOND.items() for x in kv])[c("outcome")].alias("kind"))
    wanted = again.join(answers, UNIT).join(asked.select(*UNIT, "prompt"), UNIT)
    prompt = F.when(c("kind") == "json_repair", prompts.json_repair(c("content"))).otherwise(prompts.evidence_correction(c("prompt")))
    more = computed_once(ask(wanted.select(*UNIT, F.lit(2).alias("attempt"), "kind", prompt.alias("prompt"))).select(*UNIT, "state", "content"))
    second = judged(more, sections)
    planned = sections.select(*UNIT).distinct().withColumn("kind", F.lit("primary"))
    rounds = [(1, planned, first), (2, again, second)]
    none = F.lit(None).cast("array<string>")
    rows = [
        units.join(found, UNIT, "left").select(*UNIT, F.lit(n).alias("attempt"), "kind", F.coalesce("outcome", F.lit("lost")).alias("outcome"), F.when(c("outcome").isNull(), "no_answer").otherwise(c("failure")).alias("failure"), F.coalesce("findings", none).alias("findings"))
        for n, units, found in rounds
    ]
    return computed_once(rows[0].union(rows[1]))


def outcomes(tried: DataFrame) -> DataFrame:
    """(doc_id, request, succeeded, category, requests, repair_requests): the first success of a unit counts, else its last failure."""
    last = F.max_by(F.struct("outcome", "failure"), "attempt")
    sums = tried.groupBy(*UNIT).agg(F.bool_or(F.col("outcome") == "ok").alias("succeeded"), last.alias("last"), F.count("*").cast("int").alias("requests"))
    category = F.when(~F.col("succeeded"), F.when(F.col("last.outcome") == "truncated", "truncated_output").otherwise("invalid_model_output"))
    return sums.select(*UNIT, "succeeded", category.alias("category"), "requests", (F.col("requests") - 1).alias("repair_requests"))


def attempt_findings(packed: DataFrame, tried: DataFrame) -> DataFrame:
    """Findings of the attempts that succeeded, with canonical section ids and numbers in the order of sections."""
    each = tried.where("outcome = 'ok'").select(*UNIT, F.posexplode("findings").alias("item", "json"))
    rows = each.select(*UNIT, "item", F.from_json("json", "id string, " + FINDING).alias("f")).select(*UNIT, "item", "f.*")
    bound = rows.join(bindings(packed).select(*UNIT, F.col("ref").alias("section_id"), F.col("id").alias("canonical_id")), [*UNIT, "section_id"])
    return numbered_findings(bound, packed)
