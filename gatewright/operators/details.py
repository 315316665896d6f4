"""Detail records of the schema, influence and evidence stages: violations, warnings and what they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from . import review, verdicts

#: Issues of the influence stage that make a verdict invalid; the others are warnings.
INFLUENCE_VIOLATIONS = ("G2_EXCULPATORY", "G2_INFLUENCE")
#: Characters from which a snippet is long enough.
LONG_SNIPPET = 10


def _set(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "") != ""


def _list(*conditions: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in conditions)))


def schema_detail(errors: Column, fields: Column, raw: Column) -> Column:
    """struct(is_valid, violations, field_count, has_evidence, has_location) of a verdict that is an object."""
    whole = lambda n: fields[n].try_cast("bigint").isNotNull()
    keys = F.coalesce(F.size(F.json_object_keys(F.to_json(verdicts.parsed(raw)))), F.lit(0))
    return F.struct(
        (F.size(errors) == 0).alias("is_valid"), errors.alias("violations"), keys.alias("field_count"), _set(fields["evidence_snippet"]).alias("has_evidence"), (whole("pred_location_start") & whole("pred_location_end")).alias("has_location")
    )


def influence_detail(found: Column, used: Column, fields: Column) -> Column:
    """struct(is_valid, violations, warnings, used_untrusted_input, untrusted_effect, untrusted_input_role, decision_basis); ``found`` is what ``review.influence`` gives."""
    grave = lambda i: F.substring_index(i, ":", 1).isin(*INFLUENCE_VIOLATIONS)
    low = lambda n, default: F.lower(F.coalesce(fields[n], F.lit(default))).alias(n)
    return F.struct(
        found["valid"].alias("is_valid"),
        F.filter(found["issues"], grave).alias("violations"),
        F.filter(found["issues"], lambda i: ~grave(i)).alias("warnings"),
        used.alias("used_untrusted_input"),
        low("untrusted_effect", "none"),
        low("untrusted_input_role", "none"),
        low("decision_basis", ""),
    )


def evidence_detail(has_secret: Column, fields: Column, lines: Column) -> Column:
    """struct(is_valid, violations, warnings, evidence_mode, has_location, has_evidence).

    What is missing is named first; only a verdict that has everything is held against the
    numbered ``lines`` of the code.
    """
    start, end = (fields[n].try_cast("bigint") for n in ("pred_location_start", "pred_location_end"))
    mode, snippet = F.lower(F.coalesce(fields["evidence_mode"], F.lit("none"))), F.coalesce(fields["evidence_snippet"], F.lit(""))
    missing = _list(
        (has_secret & (mode == "none"), "no evidence mode for a secret"),
        (has_secret & start.isNull(), "no first line for a secret"),
        (has_secret & end.isNull(), "no last line for a secret"),
        (has_secret & ~_set(snippet), "no snippet for a secret"),
    )
    against = review.evidence(has_secret, fields["evidence_mode"], start, end, fields["evidence_snippet"], lines)

    def judged(x: Column) -> Column:
        violations = F.when(F.size(x["missing"]) > 0, x["missing"]).otherwise(F.array_compact(F.array(x["against"])))
        short = has_secret & _set(snippet) & (F.length(snippet) < LONG_SNIPPET)
        return F.struct(
            (F.size(violations) == 0).alias("is_valid"), violations.alias("violations"), _list((short, "snippet is short")).alias("warnings"), mode.alias("evidence_mode"), (start.isNotNull() & end.isNotNull()).alias("has_location"), _set(snippet).alias("has_evidence")
        )

    return bound(F.struct(missing.alias("missing"), against.alias("against")), judged)


def detailed(rows: DataFrame) -> DataFrame:
    """``rows`` (raw, code_context, pr_title, pr_body) with schema_detail, influence_detail and evidence_detail, null for a verdict that is no object."""
    step = verdicts.validated(rows)
    v = lambda n: F.col(f"fields.{n}")
    truth = lambda c: F.coalesce(~c.isin("false", "", "0", "0.0"), F.lit(False))
    has, used = truth(v("pred_has_secret")), truth(v("used_untrusted_input"))
    found = review.influence(used, v("untrusted_effect"), v("untrusted_input_role"), v("decision_basis"), v("final_decision"), has, F.col("pr_title"), F.col("pr_body"))
    lines = F.split(F.coalesce("code_context", F.lit("")), "\n")
    is_object = F.col("fields").isNotNull()
    details = {
        "schema_detail": schema_detail(F.col("errors"), F.col("fields"), F.col("raw")),
        "influence_detail": bound(found, lambda f: influence_detail(f, used, F.col("fields"))),
        "evidence_detail": bound(lines, lambda x: evidence_detail(has, F.col("fields"), x)),
    }
    return step.select(*(F.col(c) for c in rows.columns), *(F.when(is_object, c).alias(n) for n, c in details.items()))
