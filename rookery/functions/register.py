"""SQL names for this engine's functions: expressions as temporary SQL functions, parsers as table functions."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rookery.functions import redact, text
from rookery.session import configured
from rookery.sources.java import parse_java
from rookery.sources.settings import parse_settings


def quoted(s: str) -> str:
    """An SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scalar_functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body), in the order in which they need each other."""
    noise = ", ".join(map(quoted, text.NOISE))
    hidden = f"CASE WHEN length(text) > {redact.MOST} THEN concat(left(text, {redact.MOST}), '…') ELSE text END"
    for pattern, replacement in redact.SHAPES:
        hidden = f"regexp_replace({hidden}, {quoted(pattern)}, {quoted(replacement)})"
    return {
        "stem_plural": ("word STRING", "STRING", "CASE WHEN length(word) > 4 AND endswith(word, 'sses') THEN left(word, length(word) - 2) WHEN length(word) > 3 AND endswith(word, 's') AND NOT word RLIKE '(ss|us|is)$' THEN left(word, length(word) - 1) ELSE word END"),
        "stem_tense": ("word STRING", "STRING", "CASE WHEN length(word) > 5 AND endswith(word, 'ing') THEN left(word, length(word) - 3) WHEN length(word) > 4 AND endswith(word, 'ed') THEN left(word, length(word) - 2) ELSE word END"),
        "stem_mute": ("word STRING", "STRING", "CASE WHEN length(word) > 3 AND endswith(word, 'e') THEN left(word, length(word) - 1) ELSE word END"),
        "stem": ("word STRING", "STRING", "CASE WHEN length(word) > 4 AND endswith(word, 'ies') THEN concat(left(word, length(word) - 3), 'y') ELSE stem_mute(stem_tense(stem_plural(word))) END"),
        "split_words": ("text STRING", "ARRAY<STRING>", f"filter(transform(split(text, {quoted(text.WORD_EDGE)}), w -> lower(w)), w -> length(w) >= 2 AND NOT w RLIKE '^[0-9]+$')"),
        "is_noise": ("word STRING", "BOOLEAN", f"word IN ({noise})"),
        "norm_key": ("key STRING", "STRING", "regexp_replace(lower(key), '[-_]', '')"),
        "redact_text": ("text STRING", "STRING", hidden),
        "is_secret_key": ("key STRING", "BOOLEAN", f"key RLIKE {quoted('(?i)' + redact.SECRET_WORDS)}"),
        "version_numbers": ("version STRING", "ARRAY<BIGINT>", r"transform(split(get(split(version, '[-+]'), 0), '\\.'), p -> coalesce(try_cast(regexp_extract(p, '^\\s*(\\d{1,18})', 1) AS BIGINT), 0L))"),
        "version_key": ("version STRING", "ARRAY<BIGINT>", "slice(version_numbers(version), 1, array_max(transform(version_numbers(version), (x, i) -> IF(x > 0, i + 1, 0))))"),
    }


def register(spark: SparkSession) -> None:
    """Register stem, split_words, norm_key, redact_text, is_secret_key, version_key (JVM expressions) and the helpers they need, the
    Arrow function tokenize, and the table functions parse_java(text) and parse_config(format, text), which take a lateral join.

    parse_java gives the classes of a source, lists as JSON; parse_config gives doc_idx, ord, key, value and error, redacted row by row
    in the same query. is_secret_key does not look through full-width letters, which takes Python (redact.is_secret_key).
    """
    configured(spark)
    for name, (parameters, kind, body) in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.udtf(returnType="ord int, name string, kind string, annotations string, endpoints string, depends_on string, raw_body string, config_prefix string, config_uses string")
    class ParseJava:
        def eval(self, source: str):
            for c in parse_java(source or ""):
                yield (c["ord"], c["name"], c["kind"], *(json.dumps(c[k]) for k in ("annotations", "endpoints", "depends_on")), c["raw_body"], c["config_prefix"], json.dumps(c["config_uses"]))

    @F.udtf(returnType="doc_idx int, ord int, key string, value string, error string")
    class ParseConfig:
        def eval(self, kind: str, source: str):
            documents, error = parse_settings(kind, source or "")
            for i, (found, _) in enumerate(d for d in documents if d[0]):
                for k, (key, value) in enumerate(found):
                    yield i, k, key, value, error

    spark.udtf.register("parse_java", ParseJava)
    spark.udtf.register("parse_raw_config", ParseConfig)
    plain = r"value = '' OR trim(value) RLIKE '^\\$\\{[A-Za-z0-9_.\\-]+\\}\\z'"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_config(kind STRING, source STRING) RETURNS TABLE(doc_idx INT, ord INT, key STRING, value STRING, error STRING) RETURN "
        f"SELECT doc_idx, ord, redact_text(key), CASE WHEN is_secret_key(key) AND ({plain}) THEN value WHEN is_secret_key(key) THEN {quoted(redact.REDACTED)} ELSE redact_text(value) END, redact_text(error) FROM parse_raw_config(parse_config.kind, parse_config.source)"
    )
