"""Parsing, validation and one-step repair of reviewer verdicts.

A verdict stays a VARIANT until it is checked, so that ``"true"`` and ``true``, ``12``
and ``12.0``, a null and a missing field are told apart. Errors are an array of
messages in the order of the checks; repair rewrites a projection of typed fields and
runs the same checks again.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import strict_json

# Fields in the order of their checks, with type and nullability.
REQUIRED = (
    ("pred_has_secret", "bool", False),
    ("pred_secret_type", "str", False),
    ("evidence_mode", "str", False),
    ("pred_location_start", "int", True),
    ("pred_location_end", "int", True),
    ("evidence_snippet", "str", False),
    ("used_untrusted_input", "bool", False),
    ("final_decision", "str", False),
)
OPTIONAL = ("confidence", "uncertainty_flags", "decision_basis", "untrusted_input_role", "untrusted_effect")
# Allowed values of the enumerated fields.
ALLOWED = {
    "pred_secret_type": ("token", "api_key", "password", "private_key", "connection_string", "none"),
    "evidence_mode": ("verbatim", "multiline", "reconstructed", "none"),
    "final_decision": ("PASS", "BLOCK", "REVIEW"),
    "decision_basis": ("code_only", "code_plus_ambiguity", "no_secret"),
    "untrusted_input_role": ("pr_title", "pr_body", "code_comment", "none"),
    "untrusted_effect": ("none", "supporting_context_only", "exculpatory_claim", "uncertainty_trigger"),
}
KINDS = {"bool": "^BOOLEAN$", "str": "^STRING$", "int": "^(BIGINT|BOOLEAN)$"}
_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"


def parsed(raw: Column) -> Column:
    """The verdict as VARIANT, read directly or from the first code fence; null if neither is JSON."""
    return F.coalesce(strict_json(raw), strict_json(F.trim(F.regexp_extract(raw, _FENCE, 1))))


def lenient(raw: Column) -> Column:
    """As ``parsed``, and from the outermost braces at last."""
    return F.coalesce(parsed(raw), strict_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: the optimizer does not copy it to each use."""
    return F.transform(F.array(value), body)[0]


def _checks(get: dict[str, Column], present: Column) -> Column:
    """Error messages of typed fields ``get`` (name -> struct(kind, text)); the same for raw and repaired verdicts."""
    kind = lambda n: get[n]["kind"]
    text = lambda n: get[n]["text"]
    out: list[Column] = []
    for name, want, nullable in REQUIRED:
        missing = F.when(kind(name) == "MISSING", F.lit(f"SCHEMA_VIOLATION: missing {name}"))
        null = F.lit(None).cast("string") if nullable else F.when(kind(name) == "VOID", F.lit(f"SCHEMA_VIOLATION: {name} is null"))
        wrong = F.when(~kind(name).isin("MISSING", "VOID") & ~kind(name).rlike(KINDS[want]), F.lit(f"SCHEMA_VIOLATION: {name} is not {want}"))
        out.append(F.coalesce(missing, null, wrong))
    known = F.array(*(F.lit(n) for n, _, _ in REQUIRED), *(F.lit(n) for n in OPTIONAL))
    extra = F.array_sort(F.array_except(F.coalesce(present, F.array().cast("array<string>")), known))
    out.append(F.when(F.size(extra) > 0, F.concat(F.lit("SCHEMA_VIOLATION: unknown "), F.array_join(extra, ", "))))
    for name, values in ALLOWED.items():
        low = F.upper(text(name)) if name == "final_decision" else F.lower(text(name))
        out.append(F.when(~kind(name).isin("MISSING", "VOID") & ~low.isin(*values), F.lit(f"SCHEMA_VIOLATION: {name} has no allowed value")))
    has = F.when(kind("pred_has_secret") == "BOOLEAN", text("pred_has_secret") == "true")
    kind_of = F.lower(F.coalesce(text("pred_secret_type"), F.when(kind("pred_secret_type") == "VOID", "none").otherwise("")))
    mode = F.lower(F.coalesce(text("evidence_mode"), F.when(kind("evidence_mode") == "VOID", "none").otherwise("")))
    decision = F.upper(F.coalesce(text("final_decision"), F.lit("")))
    whole = {n: F.when(kind(n).rlike(KINDS["int"]), F.when(text(n) == "true", 1).when(text(n) == "false", 0).otherwise(F.expr("1") * text(n).try_cast("bigint"))) for n in ("pred_location_start", "pred_location_end")}
    start, end = whole["pred_location_start"], whole["pred_location_end"]
    blank = (kind("evidence_snippet") != "STRING") | (F.regexp_replace(F.coalesce(text("evidence_snippet"), F.lit("")), r"\s", "") == "")
    is_set = lambda n: ~kind(n).isin("MISSING", "VOID")
    rule = lambda name: F.lit(f"CONSISTENCY_VIOLATION: {name}")
    out += [
        F.when(has & (kind_of == "none"), rule("a secret without type")),
        F.when(has & (mode == "none"), rule("a secret without evidence mode")),
        F.when(has & (start.isNull() | (start < 1)), rule("a secret without start")),
        F.when(has & (end.isNull() | F.coalesce(end < start, F.lit(False))), rule("a secret without end")),
        F.when(has & blank, rule("a secret without snippet")),
        F.when(has & (decision == "PASS"), rule("a secret that passes")),
        F.when(~has & (kind_of != "none"), rule("no secret with type")),
        F.when(~has & (mode != "none"), rule("no secret with evidence mode")),
        F.when(~has & is_set("pred_location_start"), rule("no secret with start")),
        F.when(~has & is_set("pred_location_end"), rule("no secret with end")),
        F.when(~has & ~decision.isin("PASS", "REVIEW"), rule("no secret that blocks")),
        F.when((mode == "verbatim") & (start != end), rule("verbatim over several lines")),
        F.when(mode.isin("multiline", "reconstructed") & (end < start), rule("span runs backwards")),
    ]
    return F.array_compact(F.array(*out))


_NAMES = [*(r[0] for r in REQUIRED), *OPTIONAL]


def _typed(doc: Column) -> Column:
    """struct of each field's JSON type (MISSING without it) and value as string."""
    at = lambda n: F.variant_get(doc, f"$.{n}", "variant")
    return F.struct(*(F.struct(F.coalesce(_kind(at(n)), F.lit("MISSING")).alias("kind"), F.try_variant_get(doc, f"$.{n}", "string").alias("text")).alias(n) for n in _NAMES))


def _fields(f: Column) -> dict[str, Column]:
    return {n: f[n] for n in _NAMES}


def _repaired(get: dict[str, Column]) -> dict[str, Column]:
    """The typed fields after repair: string booleans, casing of allowed values, whole numbers in other forms."""
    out = dict(get)
    for name in ("pred_has_secret", "used_untrusted_input"):
        low = F.lower(get[name]["text"])
        out[name] = F.when((get[name]["kind"] == "STRING") & low.isin("true", "false"), F.struct(F.lit("BOOLEAN").alias("kind"), low.alias("text"))).otherwise(get[name])
    for name, values in ALLOWED.items():
        low = F.upper(get[name]["text"]) if name == "final_decision" else F.lower(get[name]["text"])
        out[name] = F.when((get[name]["kind"] == "STRING") & low.isin(*values), F.struct(F.lit("STRING").alias("kind"), low.alias("text"))).otherwise(get[name])
    for name in ("pred_location_start", "pred_location_end"):
        kind, text = get[name]["kind"], F.trim(get[name]["text"])
        number = text.try_cast("double")
        whole = ((kind == "STRING") & text.rlike(r"^[+-]?\d+$")) | (kind.rlike("^(DOUBLE|DECIMAL)") & (number == F.floor(number)))
        out[name] = F.when(whole, F.struct(F.lit("BIGINT").alias("kind"), number.cast("bigint").cast("string").alias("text"))).otherwise(get[name])
    return out


def categories(errors: Column) -> Column:
    return F.array_distinct(F.transform(errors, lambda e: F.substring_index(e, ":", 1)))


def validated(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with the outcome of validation, and the fields of a valid verdict.

    Adds schema_valid, repair_used, errors (those that remain), error_categories (sorted),
    the verdict struct, null unless valid, fields, the same struct of any root that is an
    object, and listed, the uncertainty flags as an array if they are one. A null or unparsable text is a PARSE_ERROR,
    a root that is no object a SCHEMA_VIOLATION; neither is repaired.
    """
    texts, none = "array<string>", F.array().cast("array<string>")

    def judged(root: Column, f: Column, r: Column, first: Column, second: Column) -> Column:
        valid, used = F.size(second) == 0, (F.size(first) > 0) & (F.size(second) == 0)
        found = F.when(used, F.array_union(categories(first), F.array(F.lit("REPAIR_SUCCESS")))).when(~valid, F.array_union(categories(second), F.array(F.lit("REPAIR_FAIL")))).otherwise(none)
        verdict = F.struct(*(r[n]["text"].alias(n) for n in _NAMES))
        return F.struct(valid.alias("schema_valid"), used.alias("repair_used"), second.alias("errors"), F.array_sort(found).alias("error_categories"), F.when(valid, verdict).alias("verdict"), verdict.alias("fields"))

    def checked(root: Column, keys: Column, f: Column) -> Column:
        def repaired(first: Column) -> Column:
            r = F.when(F.size(first) > 0, F.struct(*(c.alias(n) for n, c in _repaired(_fields(f)).items()))).otherwise(f)
            return _let(r, lambda r: _let(_checks(_fields(r), keys), lambda second: judged(root, f, r, first, second)))

        return _let(_checks(_fields(f), keys), repaired)

    def broken(errors: Column, category: Column) -> Column:
        verdict = F.lit(None).cast("struct<" + ",".join(f"{n}:string" for n in _NAMES) + ">")
        return F.struct(F.lit(False).alias("schema_valid"), F.lit(False).alias("repair_used"), errors.cast(texts).alias("errors"), F.array(category).alias("error_categories"), verdict.alias("verdict"), verdict.alias("fields"))

    def whole(doc: Column) -> Column:
        root = _kind(doc)
        return (
            F.when(doc.isNull(), broken(F.array(F.lit("PARSE_ERROR: no JSON")), F.lit("PARSE_ERROR")))
            .when(root == "VOID", broken(none, F.lit("PARSE_ERROR")))
            .when(~root.startswith("OBJECT<"), broken(F.array(F.lit("SCHEMA_VIOLATION: root is no object")), F.lit("SCHEMA_VIOLATION")))
            .otherwise(_let(F.struct(F.json_object_keys(F.to_json(doc)).alias("keys"), _typed(doc).alias("f")), lambda d: checked(root, d["keys"], d["f"])))
        )

    listed = lambda doc: F.try_variant_get(doc, "$.uncertainty_flags", "array<string>")
    done = rows.withColumn("_out", _let(parsed(F.col(raw)), lambda doc: F.struct(whole(doc).alias("o"), listed(doc).alias("listed"))))
    names = ("schema_valid", "repair_used", "errors", "error_categories", "verdict", "fields")
    return done.select(*(F.col(c) for c in rows.columns), *(F.col(f"_out.o.{n}").alias(n) for n in names), F.col("_out.listed").alias("listed"))


def routed_decision(original: Column | None = None) -> Column:
    """REVIEW for an invalid verdict, else the explicit decision, else the verdict's own."""
    own = F.upper(F.col("verdict.final_decision"))
    chosen = F.coalesce(*([original] if original is not None else []), own, F.lit("REVIEW"))
    return F.when(F.col("schema_valid"), chosen).otherwise("REVIEW")


def error_counts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """How often each category occurs."""
    return validated(rows, raw).select(F.explode("error_categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


