"""Configuration files to documents of properties, redacted in the projection right above the parser: nothing else sees a raw value."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.redact import folded_key, is_secret_key, redact_text, redact_value
from rookery.functions.text import CONTROLS, strip_controls, truncate
from rookery.sources.tree import CONFIG_BYTES, config_name

PROPERTIES, DEPTH, DOCUMENTS, ALIASES, LINE = 5000, 20, 50, 100, 64 * 1024
#: The indents or brackets of a text from which it may come near a limit of depth.
NESTED = 60
#: Rows of properties that leave the parser at once, whatever the files' sizes.
ROWS = 50_000
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(s: str) -> str:
    return s if "\\" not in s else re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), s, flags=re.S)


def parse_properties(text: str) -> list[list[tuple[str, str]]]:
    """Documents (separated by #--- or !---) of (key, value)."""
    documents: list[list[tuple[str, str]]] = [[]]
    lines = re.split(r"\r\n|\r|\n", text)
    at = 0
    while at < len(lines):
        line = lines[at].lstrip(" \t\f")
        at += 1
        if lines[at - 1][:1] in ("#", "!") and re.fullmatch(r"[#!]---\s*", lines[at - 1]):
            documents.append([])
            continue
        if not line or line[0] in "#!":
            continue
        parts, size = [line], len(line)
        while size < LINE and at < len(lines) and (len(parts[-1]) - len(parts[-1].rstrip("\\"))) % 2:
            parts[-1] = parts[-1][:-1]
            parts.append(lines[at].lstrip(" \t\f"))
            size += len(parts[-1]) - 1
            at += 1
        m = re.match(r"((?:[^\\=: \t\f]+|\\.|\\\Z)*)[ \t\f]*[=:]?[ \t\f]*(.*)", "".join(parts), re.S)
        documents[-1].append((_unescaped(m[1]), _unescaped(m[2])))
    return documents


@cache
def core_loader(fast: bool = False):
    """A YAML 1.2 core loader: no dates, no octal without 0o, yes and no are strings; unknown tags are data.

    fast: on libyaml, whose loader counts no aliases and has no limit of depth: for texts that plain() lets through.
    """
    import yaml

    class Core(yaml.CSafeLoader if fast else yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}
        aliases = 0

        def compose_node(self, parent, index):
            if self.check_event(yaml.AliasEvent):
                self.aliases += 1
                if self.aliases > ALIASES:
                    raise yaml.YAMLError("too many aliases")
            return super().compose_node(parent, index)

    def add(tag, pattern, first):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))

    add("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF")
    add("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789")
    add("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789")
    add("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""])
    add("merge", r"^(?:<<)$", "<")
    number = lambda s: int(s, 8) if s.startswith("0o") else int(s, 16) if s.startswith("0x") else int(s)
    Core.add_constructor("tag:yaml.org,2002:int", lambda loader, node: number(loader.construct_scalar(node)))

    def other(loader, suffix, node):
        import yaml as y

        if isinstance(node, y.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, deep=True) if isinstance(node, y.SequenceNode) else loader.construct_mapping(node, deep=True)

    Core.add_multi_constructor("", other)
    return Core


def scalar_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    return str(value)


def flatten(value, prefix: str = "", depth: int = 0) -> tuple[list[tuple[str, str]], bool]:
    """(dotted keys and texts, whether a limit cut something off)."""
    out: list[tuple[str, str]] = []
    cut = False
    stack = [(value, prefix, depth)]
    while stack:
        value, prefix, depth = stack.pop()
        if len(out) >= PROPERTIES:
            return out, True
        if depth > DEPTH:
            cut = True
        elif isinstance(value, (dict, list)) and value:
            pairs = [(f"{prefix}.{k}" if prefix else str(k), v) for k, v in ((scalar_text(k), v) for k, v in value.items())] if isinstance(value, dict) else [(f"{prefix}[{i}]", v) for i, v in enumerate(value)]
            stack += [(v, k, depth + 1) for k, v in reversed(pairs)]
        elif prefix:
            out.append((prefix, "" if isinstance(value, (dict, list)) else scalar_text(value)))
    return out, cut


def plain(text: str) -> bool:
    """Whether libyaml reads a text as the loader in Python does, if it reads it without an error: ASCII without tabs, tags,
    directives and comments that touch a block's head, with fewer aliases than the limit, and nested by fewer indents and brackets than any limit of depth."""
    return bool(re.fullmatch(r"[\n -~]*", text)) and not re.search(r"!|^%|[|>][-+0-9]*#", text, re.M) and text.count("*") <= ALIASES and text.count("[") + text.count("{") <= NESTED and not re.search(rf"^[ ?:-]{{{NESTED}}}", text, re.M)


def load_yaml(text: str) -> tuple[list, Exception | None]:
    """Flattened documents, and the error that ended them; a text in which libyaml finds an error is read again in Python."""
    import yaml

    errors = (yaml.YAMLError, RecursionError, ValueError, TypeError, AttributeError)
    if yaml.__with_libyaml__ and plain(text):
        try:
            return [flatten(value) for value in yaml.load_all(text, Loader=core_loader(fast=True))], None
        except errors:
            pass
    documents: list = []
    try:
        for value in yaml.load_all(text, Loader=core_loader()):
            documents.append(flatten(value))
    except errors as problem:
        return documents, problem
    return documents, None


def parse_yaml(text: str) -> tuple[list[tuple[list[tuple[str, str]], bool]], str | None]:
    """(documents as of flatten, first error): a document in error is left out, others stay."""
    documents, error = [], None
    parts = re.split(r"(?m)^---(?=\s|$).*$" if not re.search(r"(?m)^---[ \t]+\S", text) else r"(?m)^---(?=\s|$)", text)
    parts = [p for p in parts if p.strip() and not all(line.lstrip().startswith(("#", "%")) or not line.strip() for line in p.splitlines())]
    if len(parts) > DOCUMENTS:
        error, parts = f"only the first {DOCUMENTS} documents were read", parts[:DOCUMENTS]
    for part in parts:
        found, problem = load_yaml(re.sub(r"(?m)^\.\.\.\s*$", "", part))
        documents += found
        if problem:
            error = str(problem).split("\n")[0] if not documents or not error or not error.startswith("only") else error
    return documents, error


def parse_settings(kind: str, text: str) -> tuple[list[tuple[list[tuple[str, str]], bool]], str | None]:
    if kind == "properties":
        return [(d[:PROPERTIES], len(d) > PROPERTIES) for d in parse_properties(text)], None
    return parse_yaml(text)


RAW = "repo string, file string, format string, profile string, bootstrap boolean, doc_idx int, truncated boolean, ord int, key string, value string, error string, folded string"


def config_properties(files: DataFrame) -> DataFrame:
    """files(repo, path, name, size, text) -> a row for each property of each configuration file, values redacted.

    A file without properties has one row without a key, which carries its error if it has one. Larger files than the limit aren't read;
    a smaller one without text could not be read, and says so.
    """
    named = files.select("repo", "path", "size", "text", config_name(F.col("name")).alias("n")).where("n.is_config")
    large = F.col("size") > CONFIG_BYTES

    def parsed(batches):
        for batch in batches:
            rows = []
            for i, (large, text, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("large", "text", "format")), strict=True)):
                documents, error = ([], "skipped: larger than 256 KB") if large else ([], "unreadable") if text is None else parse_settings(kind, text)
                kept = [d for d in documents if d[0]]
                rows += [(i, j, cut, k, key, value, error) for j, (found, cut) in enumerate(kept) for k, (key, value) in enumerate(found)]
                if not kept:
                    rows.append((i, None, False, None, None, None, error))
                if len(rows) >= ROWS:
                    yield made(batch, rows)
                    rows = []
            if rows:
                yield made(batch, rows)

    def made(batch, rows):
        of, doc_idx, truncated, ord_, key, value, error = zip(*rows, strict=True)
        of = pa.array(of, pa.int32())
        folded = [None if k is None or k.isascii() else folded_key(re.sub(CONTROLS, " ", k)) for k in key]
        own = [batch.column(c).take(of) for c in ("repo", "path", "format", "profile", "bootstrap")]
        found = [pa.array(x, t) for x, t in ((doc_idx, pa.int32()), (truncated, pa.bool_()), (ord_, pa.int32()), (key, pa.string()), (value, pa.string()), (error, pa.string()), (folded, pa.string()))]
        return pa.RecordBatch.from_arrays([*own, *found], names=[c.split(" ")[0] for c in RAW.split(", ")])

    raw = named.select("repo", "path", large.alias("large"), F.when(~large, F.col("text")).alias("text"), "n.format", "n.profile", F.coalesce("n.bootstrap", F.lit(False)).alias("bootstrap")).mapInArrow(parsed, RAW)
    place = ["repo", "file", "format", "profile", "bootstrap", "doc_idx", "truncated", "ord"]
    plain = raw.select(*place, strip_controls(F.col("key")).alias("key"), strip_controls(F.col("value")).alias("value"), "error", "folded")
    # A column for each cleaned text, so that the chain of expressions is not copied into each of its uses.
    clean = plain.select(*place, F.coalesce("folded", "key").alias("telling"), "value", redact_text(F.col("key")).alias("clean_key"), redact_text(F.col("value")).alias("clean_value"), redact_text(F.col("error")).alias("error"))
    safe = redact_value(F.col("telling"), F.col("value"), fold=False, clean=F.col("clean_value")).alias("safe")
    told = clean.select(*place, truncate(F.col("clean_key"), 200).alias("key"), safe, truncate(F.col("error"), 160).alias("error"))
    rows = told.select(*place, "key", "safe.value", "safe.redacted", "error")
    # One element exploded: conditions on keys and values stay above, instead of repeating the chain for each use.
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("row")).select("row.*")


__all__ = ["config_properties", "flatten", "is_secret_key", "parse_properties", "parse_settings", "parse_yaml", "scalar_text"]
