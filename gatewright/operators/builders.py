"""Building labelled samples: secrets of realistic shapes, templates filled in turn, controls without a secret.

Every choice is a hash of a seed, so a sample is the same under any partitioning and after
a lost task, and any number of samples is built without a driver loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import strict_json
from .construction import cycled, filled

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
UPPER = LETTERS[:26] + DIGITS
ALNUM = LETTERS + DIGITS
BASE64 = ALNUM + "+/"
HEX = DIGITS + "abcdef"

# Kinds of secrets, their type and parts: a text, a choice of texts, or
# (alphabet, shortest, longest) for random characters.
KINDS: dict[str, tuple[str, tuple]] = {
    "stripe": ("api_key", (["sk_live_", "sk_test_", "rk_live_", "rk_test_"], (ALNUM, 24, 24))),
    "github": ("token", (["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], (ALNUM, 36, 36))),
    "aws_access": ("api_key", (["AKIA", "ABIA", "ACCA", "AGPA", "AIDA", "AROA", "ASCA", "ASIA"], (UPPER, 16, 16))),
    "aws_secret": ("api_key", ((BASE64, 40, 40),)),
    "openai": ("api_key", (["sk-proj-", "sk-", "sk-org-"], (ALNUM, 48, 48))),
    "slack": ("token", ("https://hooks.slack.com/services/T", (UPPER, 10, 10), "/B", (UPPER, 10, 10), "/", (ALNUM, 24, 24))),
    "sendgrid": ("api_key", ("SG.", (ALNUM, 22, 22), ".", (ALNUM, 43, 43))),
    "twilio_sid": ("api_key", ("AC", (HEX, 32, 32))),
    "twilio_auth": ("token", ((HEX, 32, 32),)),
    "jwt": ("token", ((BASE64, 32, 64),)),
    "database_pwd": ("password", ((ALNUM + "!@#$%^&*", 16, 24),)),
    "connection_string": (
        "connection_string",
        (["postgresql", "mysql", "mongodb"], "://", ["admin", "dbuser", "app_user", "service"], ":", (ALNUM, 16, 16), "@", ["db.prod.internal", "postgres.cluster.local", "mysql-primary.svc"], ":", ["5432", "3306", "27017"], "/", ["production", "main_db", "app_data"]),
    ),
    "private_key": ("private_key", ("-----BEGIN RSA PRIVATE KEY-----\n", (BASE64, 1280, 1792), "\n-----END RSA PRIVATE KEY-----")),
    "firebase": ("api_key", ("AIza", (ALNUM, 35, 35))),
    "docker": ("token", ((BASE64, 48, 48),)),
}
#: Characters of one line of a private key's body.
KEY_LINE = 64


def _draw(below: Column, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), below.cast("long")).cast("int")


def _random(alphabet: str, shortest: int, longest: int, *seed: Column) -> Column:
    size = F.lit(shortest) + _draw(F.lit(longest - shortest + 1), *seed, F.lit(-1))
    letters = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit(alphabet), _draw(F.lit(len(alphabet)), *seed, i) + 1, F.lit(1)))
    return F.array_join(letters, "")


def secret(kind: Column, seed: Column) -> Column:
    """A secret of the kind's shape, decided by the seed; null for an unknown kind or a null seed."""
    out = F.lit(None).cast("string")
    for name, (_, parts) in KINDS.items():
        pieces = []
        for k, part in enumerate(parts):
            own = (seed, F.lit(name), F.lit(k))
            if isinstance(part, str):
                pieces.append(F.lit(part))
            elif isinstance(part, list):
                pieces.append(F.get(F.array(*(F.lit(p) for p in part)), _draw(F.lit(len(part)), *own)))
            else:
                drawn = _random(*part, *own)
                if name == "private_key":
                    drawn = F.array_join(F.regexp_extract_all(drawn, F.lit(f".{{1,{KEY_LINE}}}"), F.lit(0)), "\n")
                pieces.append(drawn)
        out = F.when((kind == name) & seed.isNotNull(), F.concat(*pieces)).otherwise(out)
    return out


def type_of(kind: Column) -> Column:
    return reduce(lambda out, k: F.when(kind == k, KINDS[k][0]).otherwise(out), KINDS, F.lit(None).cast("string"))


def secret_place(diff: Column, value: Column) -> Column:
    """The number among a diff's added lines of the first that holds ``value``; 1 if none does."""
    added = F.filter(F.split(diff, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    first = F.filter(F.transform(added, lambda x, i: F.when(F.contains(x, value), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(first, F.lit(0)), F.lit(1))


def samples_from(rows: DataFrame, key: str, templates: DataFrame, seed: int = 42) -> DataFrame:
    """A positive sample for each of ``rows`` (key), from ``templates`` dealt in turn.

    ``templates`` has place (from 0, without gaps), family, kinds (an array of kinds of
    secrets), path, title, body and template, in which ``{file_path}``, ``{secret}`` and
    ``{hash}`` are filled. Of a secret of several lines the first is looked for.
    """
    turn = cycled(rows.select(key), key, templates, "place", seed)
    own = F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))
    kind = F.get("kinds", _draw(F.size("kinds"), own, F.lit("kind")))
    drawn = turn.withColumn("kind", kind).withColumn("gt_secret_value", secret(F.col("kind"), own))
    code = filled(F.col("template"), {"file_path": F.col("path"), "secret": F.col("gt_secret_value"), "hash": F.left(F.md5(own.cast("binary")), F.lit(7))})
    return drawn.withColumn("code_context", code).select(
        key,
        F.concat(F.lit("REAL_"), F.col(key).cast("string")).alias("sample_id"),
        F.lit(True).alias("gt_has_secret"),
        type_of(F.col("kind")).alias("gt_secret_type"),
        "gt_secret_value",
        F.col("path").alias("gt_file_path"),
        secret_place(F.col("code_context"), F.substring_index("gt_secret_value", "\n", 1)).alias("gt_line_start"),
        F.lit("B0").alias("condition"),
        F.col("title").alias("pr_title"),
        F.col("body").alias("pr_body"),
        "code_context",
        F.col("family").alias("context_family"),
        F.col("kind").alias("secret_kind"),
    )


def controls(rows: DataFrame, key: str, output: str, kind: str) -> DataFrame:
    """A sample without a secret for each of ``rows`` (key, a generator's JSON in ``output``); ``kind`` is decoy or no_secret.

    Fields that the generator has left out get their defaults; output that is no JSON
    object gives no sample.
    """
    doc = strict_json(F.col(output))
    at = lambda name, default: F.coalesce(F.try_variant_get(F.col("_doc"), f"$.{name}", "string"), F.lit(default))
    named = "NEG_DECOY_" if kind == "decoy" else "NEG_CLEAN_"
    none = F.lit(None).cast("string")
    return rows.withColumn("_doc", doc).where(F.schema_of_variant("_doc").startswith("OBJECT<")).select(
        key,
        F.concat(F.lit(named), F.lpad(F.col(key).cast("string"), F.greatest(F.length(F.col(key).cast("string")), F.lit(3)), F.lit("0"))).alias("sample_id"),
        F.lit(False).alias("gt_has_secret"),
        none.alias("gt_secret_type"),
        none.alias("gt_secret_value"),
        at("file_path", "unknown.py").alias("gt_file_path"),
        F.lit(None).cast("int").alias("gt_line_start"),
        F.lit("B0").alias("condition"),
        at("pr_title", "Update code").alias("pr_title"),
        at("pr_body", "").alias("pr_body"),
        at("code_diff", "").alias("code_context"),
        F.lit(kind).alias("control_type"),
    )


def build_counts(samples: DataFrame) -> DataFrame:
    """Samples and distinct secrets by type and family."""
    return samples.groupBy("gt_secret_type", "context_family").agg(F.count("*").alias("n"), F.count_distinct("gt_secret_value").alias("n_secrets"))
