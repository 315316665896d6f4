"""The validation pipeline as one projection: verdict checks, flags, evidence, leakage, routing.

Nothing is shuffled, so a batch and a stream run the same plan. Stage order is G5, G2,
G4, G1, G3; the first that routes decides, the others still annotate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..operators import review, scanning, verdicts
from ..operators.diffs import numbered


@dataclass(frozen=True)
class Settings:
    """Which of the switchable stages run; evidence, influence and leakage always do."""

    uncertainty: bool = True
    schema_routing: bool = True
    familiarity: bool = False
    #: Whether a repaired verdict is a sign of uncertainty.
    repair_counts: bool = True

    @classmethod
    def baseline(cls) -> Settings:
        return cls(uncertainty=False, schema_routing=False)

    @classmethod
    def full(cls) -> Settings:
        return cls()

    @classmethod
    def full_with_familiarity(cls) -> Settings:
        return cls(familiarity=True)


# The texts of a verdict that are looked at for random spans, in their order.
NAMED_TEXTS = ("evidence_snippet", "pred_secret_type", "evidence_mode", "final_decision", "decision_basis", "untrusted_input_role", "untrusted_effect")
#: All texts of a verdict, which redaction goes through.
TEXTS = (*NAMED_TEXTS, "confidence")


def truth(text: Column) -> Column:
    """Whether a field counts as set: true, or any text or number but an empty one, zero and false."""
    return F.coalesce(~text.isin("false", "", "0", "0.0"), F.lit(False))


def _output(texts: dict[str, Column], flags: Column) -> tuple[Column, Column]:
    """A verdict as one JSON text, and its named texts and flags joined."""
    rest = [F.col(f"fields.{n}").alias(n) for n in ("pred_has_secret", "pred_location_start", "pred_location_end", "used_untrusted_input")]
    full = F.to_json(F.struct(*(c.alias(n) for n, c in texts.items()), *rest, flags.alias("uncertainty_flags")), {"ignoreNullFields": "false"})
    empty_to_null = lambda c: F.when(c != "", c)
    return full, F.concat_ws(" ", *(empty_to_null(texts[n]) for n in NAMED_TEXTS), flags)


def validate(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` (raw, code_context, pr_title, pr_body, gt_file_path, scanner_hit) with all stages' outcome.

    Adds the verdict's fields, original_decision, routed_by, final_decision, triggered,
    flags (reported and inferred), rule, g1_issue, g2_issues, g3_triggered, g3_flags, g3_leak
    (something is still shown after redaction) and safe_snippet. A verdict that breaks the
    schema is routed to review, and the other stages annotate what it has; one that is no
    JSON object is scanned for leaks as raw text.
    """
    step = verdicts.validated(rows)
    v = lambda n: F.col(f"fields.{n}")
    step = step.withColumns({"has_secret": truth(v("pred_has_secret")), "used": truth(v("used_untrusted_input")), "start": v("pred_location_start").try_cast("bigint"), "end": v("pred_location_end").try_cast("bigint"), "numbered": numbered(F.coalesce("code_context", F.lit("")))})
    step = step.withColumn("_g2", review.influence(F.col("used"), v("untrusted_effect"), v("untrusted_input_role"), v("decision_basis"), v("final_decision"), F.col("has_secret"), F.col("pr_title"), F.col("pr_body")))
    step = step.withColumns({"g2_valid": F.col("_g2.valid"), "g2_issues": F.col("_g2.issues"), "original_decision": F.when(F.col("has_secret"), "BLOCK").otherwise("PASS")})
    context = {
        "has_secret": F.col("has_secret"),
        "used": F.col("used"),
        "evidence_mode": v("evidence_mode"),
        "snippet": v("evidence_snippet"),
        "start": F.col("start"),
        "end": F.col("end"),
        "file_path": F.col("gt_file_path"),
        "title": F.col("pr_title"),
        "body": F.col("pr_body"),
        "code": F.col("numbered"),
        "repaired": F.col("repair_used") if settings.repair_counts else F.lit(False),
        "scanner_hit": F.col("scanner_hit"),
        "issues": F.col("g2_issues"),
        "n_familiar": F.size(scanning.familiar(F.col("code_context"))) if settings.familiarity else F.lit(0),
    }
    none = F.array().cast("array<string>")
    step = step.withColumn("flags", F.array_sort(F.array_union(review.reported(F.col("listed")), review.flags(context))) if settings.uncertainty else none)
    step = step.withColumn("rule", review.rule(F.col("flags"), context) if settings.uncertainty else F.lit(None).cast("string"))
    evidence = lambda lines: review.evidence(F.col("has_secret"), v("evidence_mode"), F.col("start"), F.col("end"), v("evidence_snippet"), lines)
    step = step.withColumn("g1_issue", bound(F.split("numbered", "\n"), evidence))
    step = _guarded(step)
    g5, g2, g4, g1, g3 = ~F.col("schema_valid"), ~F.col("g2_valid"), F.col("rule").isNotNull(), F.col("g1_issue").isNotNull(), F.col("g3_leak")
    router = F.when(g5, "G5") if settings.schema_routing else F.when(F.lit(False), "G5")
    step = step.withColumn("routed_by", router.when(g2, "G2").when(g4 & (F.col("original_decision") == "PASS"), "G4").when(g1, "G1").when(g3, "G3"))
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in (("G5", g5), ("G2", g2), ("G4", g4), ("G1", g1), ("G3", F.col("g3_triggered"))))))
    final = F.when(F.col("routed_by").isNotNull() | g5, "REVIEW").otherwise(F.col("original_decision"))
    return step.withColumns({"triggered": names, "final_decision": final}).drop("_g2", "numbered", "fields", "listed")


def annotated(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` with what the stages say of verdicts that no stage has routed: bfm_executed, bfm_g1_valid, bfm_g2_valid, bfm_g4_should_review, bfm_g4_rule.

    ``rows`` are as for ``validate``, ``raw`` being the verdict of a reviewer without stages;
    a null one is not analysed. Such a reviewer's verdict is not repaired by any stage, so a
    repair is no sign of uncertainty here. Nothing is decided by it.
    """
    found = validate(rows, replace(settings, repair_counts=False))
    done = F.col("raw").isNotNull()
    notes = {"bfm_executed": done, "bfm_g1_valid": F.when(done, F.col("g1_issue").isNull()), "bfm_g2_valid": F.when(done, F.col("g2_valid")), "bfm_g4_should_review": F.when(done, F.col("rule").isNotNull()), "bfm_g4_rule": F.when(done, F.col("rule"))}
    return found.select(*(F.col(c) for c in rows.columns), *(c.alias(n) for n, c in notes.items()))


def _guarded(step: DataFrame) -> DataFrame:
    """The leak stage: find, redact once, look again; what still shows asks for a review."""
    texts = {n: F.col(f"fields.{n}") for n in TEXTS}
    full, targeted = _output(texts, F.col("listed"))
    is_object = F.col("fields").isNotNull()
    whole = F.when(is_object, full).otherwise(F.to_json(F.struct(F.col("raw").alias("_raw_text"))))
    step = scanning.with_leaks(step, "_first", whole, F.when(is_object, targeted), F.col("code_context"), texts["evidence_snippet"])
    hidden = lambda c: scanning.redacted(c, F.col("_first.found"))
    clean = {n: hidden(c) for n, c in texts.items()}
    # the strings found come from a Python function, which no lambda may hold: they are bound beside the list
    bound = F.array(F.struct(F.col("listed").alias("listed"), F.col("_first.found").alias("found")))
    listed = F.transform(bound, lambda x: F.transform(x["listed"], lambda c: scanning.redacted(c, x["found"])))[0]
    step = step.withColumn("_safe", F.struct(*(c.alias(n) for n, c in clean.items()), listed.alias("listed"), hidden(F.col("raw")).alias("raw")))
    safe = {n: F.col(f"_safe.{n}") for n in TEXTS}
    full, targeted = _output(safe, F.col("_safe.listed"))
    whole = F.when(is_object, full).otherwise(F.to_json(F.struct(F.col("_safe.raw").alias("_raw_text"))))
    # a verdict without leaks is not looked at again: its second text is empty
    leaky = F.size("_first.found") > 0
    step = scanning.with_leaks(step, "_second", F.when(leaky, whole), F.when(leaky & is_object, targeted), F.when(leaky, F.col("code_context")), F.when(leaky, safe["evidence_snippet"]))
    kept = F.size("_second.found") > 0
    outcome = F.when(leaky, F.array(F.when(kept, F.lit("mitigation_failed")).otherwise(F.lit("mitigation_succeeded")))).otherwise(F.array().cast("array<string>"))
    found = {"g3_triggered": leaky, "g3_leak": kept, "g3_flags": F.concat(F.col("_first.flags"), outcome), "safe_snippet": F.col("_safe.evidence_snippet")}
    return step.withColumns(found).drop("_first", "_second", "_safe")
