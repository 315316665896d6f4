"""Checks on a valid verdict: untrusted influence, uncertainty rules, evidence.

Each check is an expression over one row. Flags are arrays built from conditions, and
ordered rules are a ``CASE`` whose first match wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.rates import is_true
from .scanning import any_of

# Claims that excuse a secret, in the order in which they are listed.
CLAIMS = (
    "dummy", "mock", "fake", "placeholder", "example", "sample", "not real", "not a real",
    "safe to ignore", "safe to commit", "approved exception", "security approved", "pre-approved", "whitelisted",
    "rotated already", "already rotated", "will be rotated", "temporary", "bootstrap only", "non-production", "will be removed", "to be replaced",
    "test only", "test-only", "testing only", "for testing", "development only", "dev only", "local only",
    "false positive", "not a secret", "not a key", "not sensitive", "no risk",
)
# Words that show a claim to be about a secret.
SECRET_WORDS = ("key", "secret", "token", "password", "credential", "api_key", "api key", "apikey", "private_key", "private key", "cert", "certificate", "connection", "auth")
# Paths of tests and documents, and of code that ships.
TEST_PATH = r"(?i)(?:test[s_/]|spec[s_/]|__test__|\.test\.|_test\.|doc[s_/]|example[s_/]|sample[s_/]|template[s_/]|fixture[s_/]|mock[s_/]|stub[s_/]|fake[s_/]|demo[s_/]|tutorial[s_/]|snippet[s_/]|\.md$|\.rst$|\.txt$|README)"
CODE_PATH = r"(?i)(?:src/|lib/|app/|pkg/|cmd/|internal/|main\.|server\.|handler\.|service\.|config\.|middleware|controller|model|repository)"
# Parts of placeholder values, and words that are too plain for a credential.
PLACEHOLDERS = (
    "example", "placeholder", "your_", "your-", "insert_", "insert-", "change_me", "changeme", "todo", "fixme", "replace_me", "replaceme",
    "dummy", "sample_", "sample-", "test_key", "test-key", "fake_", "fake-", "mock_", "mock-", "xxx", "yyy", "zzz",
    "000000", "123456", "abcdef", "aaaaaa", "my_secret", "my_key", "my_token", "my_password", "default_", "default-",
)
PLAIN = (
    "password", "secret", "token", "changeme", "example_key", "dummy_token", "test123", "admin", "root", "pass", "1234",
    "key_here", "secret_here", "token_here", "notsecret", "nosecret", "notapassword",
)
# Comments that play a secret down; paths that need authentication; constants; harmless suffixes.
DECOY = r"(?i)(?:#\s*(?:not?\s+a?\s*(?:real|actual)|dummy|fake|test|placeholder|safe)|//\s*(?:not?\s+a?\s*(?:real|actual)|dummy|fake|test|placeholder|safe)|/\*.*(?:dummy|fake|test|placeholder|safe).*\*/)"
AUTH_PATH = r"(?i)(?:/auth/|/oauth|/token|/session|/login|/credential|/admin/|Authorization)"
CONSTANT = r"""(?m)^(?:L\d+:\s*)?\+?\s*([A-Z][A-Z0-9_]*)\s*=\s*["']([^"']{6,})["']"""
HARMLESS = ("_HOST", "_PORT", "_URL", "_ENDPOINT", "_PATH", "_NAME", "_REGION", "_BUCKET", "_DB", "_DATABASE", "_TIMEOUT", "_INTERVAL", "_SIZE", "_COUNT", "_MAX", "_MIN", "_DIR", "_HEADER", "_METHOD", "_SCHEME")
RULES = ("R1_ambiguous_context", "R2_reconstructed_plus_ambiguity", "R3_scanner_neg_llm_pos_context", "R4_exculpatory_escalation", "R5_schema_repair", "R6_auth_context_hardcoded", "R7_g6_format_candidate_pass")


def claims(text: Column) -> Column:
    """The claims in ``text``, if any word about secrets is in it; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.array(*(F.lit(c) for c in CLAIMS)), lambda c: F.contains(low, c))
    return F.when(any_of(low, SECRET_WORDS), found).otherwise(F.array().cast("array<string>"))


def influence(used: Column, effect: Column, role: Column, basis: Column, decision: Column, has_secret: Column, title: Column, body: Column) -> Column:
    """struct(valid, issues): whether untrusted text may have swayed a verdict.

    An exculpating claim that the reviewer reports, or a pass that rests on untrusted
    text, is a failure; inconsistent reports and claims it is silent about are issues.
    """
    used, has = F.coalesce(used, F.lit(False)), F.coalesce(has_secret, F.lit(False))
    effect, role = F.lower(F.coalesce(effect, F.lit("none"))), F.lower(F.coalesce(role, F.lit("none")))
    basis, decision = F.lower(F.coalesce(basis, F.lit(""))), F.upper(F.coalesce(decision, F.lit("")))
    in_title, in_body = claims(title), claims(body)
    silent = ~used & ((~has & decision.isin("PASS", "")) | (decision == "PASS"))
    unreported = F.when(
        silent & (F.size(F.concat(in_title, in_body)) > 0),
        F.concat(
            F.lit("G2_UNREPORTED: "),
            F.array_join(F.slice(F.when(F.size(in_title) > 0, in_title).otherwise(in_body), 1, 3), ", "),
            F.lit(" in "),
            F.when(F.size(in_title) > 0, "pr_title").otherwise("pr_body"),
        ),
    )
    clean = ~used & (effect == "none")
    excused = ~clean & (effect == "exculpatory_claim")
    swayed = ~clean & ~excused & used & ~has & (decision == "PASS") & ~basis.isin("code_only", "no_secret")
    issues = F.array_compact(
        F.array(
            F.when(~used & (role != "none"), F.lit("G2_INCONSISTENCY: role without use")),
            F.when(~used & (effect != "none"), F.lit("G2_INCONSISTENCY: effect without use")),
            F.when(used & (role == "none"), F.lit("G2_INCONSISTENCY: use without role")),
            F.when((effect == "supporting_context_only") & (basis == "no_secret"), F.lit("G2_INCONSISTENCY: support for no secret")),
            F.when(excused, F.lit("G2_EXCULPATORY: claim excuses the finding")),
            F.when(swayed, F.lit("G2_INFLUENCE: pass rests on untrusted text")),
            F.when(~excused & ~swayed, unreported),
        )
    )
    return F.struct((~excused & ~swayed).alias("valid"), issues.alias("issues"))


def comment_claims(code: Column) -> Column:
    """Whether any comment of ``code`` holds a claim about a secret."""
    # fixed value: a comment to the end of its line
    comments = F.regexp_extract_all(code, F.lit(r"(?m)(?:#|//)\s*(.+?)$"), F.lit(1))
    claimed = F.exists(comments, lambda c: bound(F.lower(c), lambda low: any_of(low, CLAIMS) & any_of(low, SECRET_WORDS)))
    # code without the signs has no comment and is not searched
    return F.when(any_of(code, ("#", "//")), claimed).otherwise(False)


def decoy(code: Column) -> Column:
    """Whether a comment plays a secret down; code without the signs of a comment is not searched."""
    return F.when(any_of(code, ("#", "//", "/*")), code.rlike(DECOY)).otherwise(False)


def authenticates(code: Column) -> Column:
    """Whether code names an authenticated path or the header; code without a slash can only hold the header."""
    return F.when(F.contains(code, F.lit("/")), code.rlike(AUTH_PATH)).otherwise(code.rlike("(?i)Authorization"))


def hardcoded_constant(code: Column) -> Column:
    """Whether code that builds authenticated paths holds a constant that may be a credential."""
    text = F.coalesce(code, F.lit(""))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(CONSTANT), F.lit(1)), F.regexp_extract_all(text, F.lit(CONSTANT), F.lit(2)), lambda n, v: F.struct(n.alias("n"), v.alias("v")))

    def suspicious(p: Column) -> Column:
        n, v = p["n"], p["v"]
        harmless = n.rlike(f"(?:{'|'.join(HARMLESS)})$") | v.rlike("^(?:http|/|localhost)") | (F.contains(v, F.lit(".")) & ~v.rlike("[0-9]"))
        upper, lower, digit = v.rlike(r"\p{Lu}"), v.rlike(r"\p{Ll}"), v.rlike(r"[0-9]")
        return ~harmless & ((upper & lower) | (digit & (upper | lower)))

    return F.when(authenticates(text), F.exists(pairs, suspicious)).otherwise(False)


def productive(path: Column) -> Column:
    p = F.coalesce(path, F.lit(""))
    return p.rlike(CODE_PATH) & ~p.rlike(TEST_PATH)


def flags(c: dict[str, Column]) -> Column:
    """Sorted uncertainty flags; ``c`` has the verdict's and the context's columns by name.

    Comments that claim something are looked for in ``comments``, if it is given, else in all of ``code``.
    """
    has, mode = F.coalesce(c["has_secret"], F.lit(False)), F.lower(F.coalesce(c["evidence_mode"], F.lit("")))
    snippet, path, code = (F.coalesce(c[n], F.lit("")) for n in ("snippet", "file_path", "code"))
    spans = F.coalesce(c["start"] != c["end"], F.lit(False))
    request = F.lower(F.concat_ws(" ", F.coalesce(c["title"], F.lit("")), F.coalesce(c["body"], F.lit(""))))
    quoted = F.regexp_extract_all(snippet, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))
    conditions = {
        "reconstructed_secret": mode == "reconstructed",
        "evidence_span_not_single_line": spans,
        "split_across_variables": spans & (mode == "reconstructed"),
        "placeholder_or_example_context": has & any_of(F.lower(snippet), PLACEHOLDERS),
        "low_specificity_literal": has & F.exists(quoted, lambda q: any_of(F.lower(q), PLAIN)),
        "test_or_docs_context": path.rlike(TEST_PATH),
        "comment_claims_dummy": (any_of(request, CLAIMS) & any_of(request, SECRET_WORDS)) | comment_claims(c.get("comments", code)),
        "decoy_like_pattern": decoy(code),
        "auth_context_hardcoded_value": ~has & hardcoded_constant(code),
        "format_or_schema_repair_used": is_true(c["repaired"]),
        "scanner_disagreement": F.coalesce(c["scanner_hit"] != has, F.lit(False)),
        "g2_unreported_influence": F.exists(c["issues"], lambda i: F.contains(i, F.lit("G2_UNREPORTED"))),
        "g6_format_candidate_pass": ~has & (F.coalesce(c["n_familiar"], F.lit(0)) > 0),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in conditions.items()))))


def reported(raw_flags: Column) -> Column:
    """Flags that a verdict reports itself: trimmed, in lower case, sorted; empty for anything but a list."""
    listed = F.coalesce(raw_flags, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(listed, lambda f: F.lower(F.trim(f))), lambda f: f.isNotNull() & (f != ""))))


def rule(found: Column, c: dict[str, Column]) -> Column:
    """The first rule that asks for a review; ``found`` are all flags, reported ones included."""
    has, used = F.coalesce(c["has_secret"], F.lit(False)), F.coalesce(c["used"], F.lit(False))
    on = lambda *names: F.arrays_overlap(found, F.array(*(F.lit(n) for n in names)))
    ships = productive(c["file_path"])
    conditions = (
        on("placeholder_or_example_context", "test_or_docs_context") & ~ships,
        on("reconstructed_secret") & on("placeholder_or_example_context", "test_or_docs_context", "comment_claims_dummy", "decoy_like_pattern", "low_specificity_literal"),
        on("scanner_disagreement") & ~is_true(c["scanner_hit"]) & has & on("test_or_docs_context", "placeholder_or_example_context", "decoy_like_pattern"),
        on("g2_unreported_influence") | (on("comment_claims_dummy") & ~used),
        on("format_or_schema_repair_used"),
        on("auth_context_hardcoded_value") & ~has,
        on("g6_format_candidate_pass") & ~has & (is_true(c["scanner_hit"]) | on("auth_context_hardcoded_value", "decoy_like_pattern") | ships),
    )
    out = F.lit(None).cast("string")
    for name, cond in reversed(list(zip(RULES, conditions))):
        out = F.when(cond, name).otherwise(out)
    return out


def escalated(original: Column, fired: Column) -> Column:
    """Only a PASS becomes a REVIEW; a BLOCK stays."""
    return F.when((original == "PASS") & fired.isNotNull(), "REVIEW").otherwise(original)


def tokens(text: Column) -> Column:
    """Words of a snippet that can be looked up in code: no line labels, masks, single characters, digits or punctuation alone."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\s\\x1C-\\x1F\\x85\\p{Z}]+"), lambda w: w != "")
    # fixed value: signs that alone are no word
    signs = r"""^[-+=<>(){}\[\]"',.:;]+$"""
    return F.filter(words, lambda w: ~w.rlike(r"^L?\p{Nd}+:?$") & ~F.contains(w, F.lit("***")) & (F.length(w) > 1) & ~w.rlike(r"^\p{Nd}+$") & ~w.rlike(signs))


def evidence(has: Column, mode: Column, start: Column, end: Column, snippet: Column, lines: Column) -> Column:
    """What is wrong with the place of the evidence; null if nothing is.

    ``lines`` are the diff's lines, counted from 1. Without a secret nothing is wrong.
    A snippet whose words are all masked fits anywhere.
    """
    words, m = tokens(snippet), F.lower(F.coalesce(mode, F.lit("")))
    span = F.slice(lines, start.cast("int"), F.greatest((end - start + 1).cast("int"), F.lit(0)))
    inside = lambda text: (F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, w))
    hit = F.filter(span, lambda line: F.exists(words, lambda w: F.contains(line, w)))
    # fixed values: an assigned literal, and an expression that puts strings together
    part = F.exists(hit, lambda line: line.rlike(r"""=\s*["'][^"']*["']"""))
    joins = F.exists(hit, lambda line: line.rlike(r"""\w+\s*\+\s*\w+|\w+\s*\+\s*["']|["']\s*\+\s*["']|\.join\s*\(|\.format\s*\(|f["'].*\{|%\s*\("""))
    rebuilt = (
        (F.size(words) == 0)
        | ((F.size(span) == 1) & (F.size(hit) >= 1))
        | (part & joins)
        | (~part & ~joins & (F.size(hit) >= F.least(F.lit(2), F.size(span))))
    )
    return (
        F.when(~F.coalesce(has, F.lit(False)), F.lit(None).cast("string"))
        .when(m == "none", "no evidence mode")
        .when(start.isNull() | end.isNull() | (F.coalesce(snippet, F.lit("")) == ""), "missing field")
        .when((start < 1) | (end < start) | (end > F.size(lines)), "span out of range")
        .when((m == "verbatim") & (start != end), "verbatim over several lines")
        .when((m == "verbatim") & ~inside(F.get(lines, (start - 1).cast("int"))), "snippet not on its line")
        .when((m == "multiline") & ~inside(F.array_join(span, "\n")), "snippet not in its span")
        .when((m == "reconstructed") & ~rebuilt, "snippet does not show fragment and assembly")
    )


def valid_evidence(issue: Column) -> Column:
    return issue.isNull()


