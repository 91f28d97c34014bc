"""The report as a query result: lines of styled spans with a sort key, rendered as Markdown or HTML."""

from __future__ import annotations

import functools
import html
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.functions.text import strip_controls
from rookery.operators import settings as say

# The order of kinds in the report, and their headings.
KIND_LABELS = {"controller": "Controllers", "advice": "Controller advice", "service": "Services", "repository": "Repositories", "entity": "Entities", "configuration": "Configuration classes", "component": "Components", "other": "Other"}
KIND_ORDER = list(KIND_LABELS)
GROUPS, LISTED = 10, 8
SPANS = "array<struct<style:string,text:string>>"
#: Where a line stands: section, a file's path in parts, then three numbers.
PLACE = ["section", "who", "n1", "n2", "n3"]


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_controls(text), r"\s+", " "))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def md_escape(text: Column) -> Column:
    """Prose that Markdown shows as it is: all that could start a construct is escaped."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|~-])", r"\\$1")


def code_span(text: Column) -> Column:
    """A code span whose fence is longer than any run of backticks inside."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.rpad(F.lit(""), longest + 1, F.lit("`"))
    pad = F.when(text.rlike("^`|`$|^ .* $"), " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def capped(items: Column, most: int = LISTED) -> Column:
    """The first items, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def span(text, style: str = "") -> Column:
    """One piece of a line: plain (our own words), code, i, b or cell (the end of a table cell)."""
    return F.array(F.struct(F.lit(style).alias("style"), (F.lit(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))).alias("text")))


def code(text: Column) -> Column:
    return span(text, "code")


def codes(items: Column) -> Column:
    """Code spans between commas."""
    return F.flatten(F.transform(items, lambda x, i: F.when(i == 0, code(x)).otherwise(F.concat(span(", "), code(x)))))


def _line(df: DataFrame, section: int, kind: str, *spans: Column, who: Column | None = None, n1=0, n2=0, n3=0) -> DataFrame:
    number = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("long")
    path = F.split(who, "/") if who is not None else F.array().cast("array<string>")
    text = F.concat(*spans) if len(spans) > 1 else spans[0]
    return df.select(F.lit(section).alias("section"), path.alias("who"), number(n1).alias("n1"), number(n2).alias("n2"), number(n3).alias("n3"), F.lit(kind).alias("kind"), text.cast(SPANS).alias("spans"))


def _dependency_lines(one: DataFrame, dependencies: DataFrame, findings: DataFrame, build_files: DataFrame) -> list[DataFrame]:
    read = build_files.agg(F.array_sort(F.collect_set("path")).alias("files")).crossJoin(dependencies.agg(F.count(F.lit(1)).alias("d"))).crossJoin(findings.agg(F.count(F.lit(1)).alias("f")))
    n = F.col("d").cast("string")
    state = F.when(F.size("files") == 0, span("There is no pom.xml or build.gradle(.kts) at the root, so no dependency was checked.")).when(F.col("d") == 0, F.concat(span("No dependency could be read from "), codes(F.col("files")), span(" (Gradle's map notation and Gradle builds of several projects are not read)."))).otherwise(F.concat(span(n), span(" dependencies were read from "), codes(F.col("files")), span("; none is flagged.")))
    return [
        _line(one, 1, "h2", span("Dependency risk")),
        _line(one, 1, "note", span("The check knows a few long-known problems only. It is no vulnerability database: run a scanner as well."), n1=1),
        _line(read.where("f = 0"), 1, "p", state, n1=2),
        _line(findings, 1, "li", span(F.col("severity"), "b"), span(" "), code(F.concat_ws(":", "group_id", "artifact_id")), span(" - "), span(F.col("message")), n1=3, n2=F.when(F.col("severity") == "critical", 0).otherwise(1), n3=F.pmod(F.hash("group_id", "artifact_id", "version"), F.lit(1 << 30))),
    ]


def document_labels(properties: DataFrame) -> DataFrame:
    """repo, file, doc_idx, n (documents of the file), on_profile, truncated of every document."""
    docs = properties.where("key is not null").groupBy(*say.DOC).agg(F.max("truncated").alias("truncated"))
    sizes = docs.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(sizes, ["repo", "file"]).join(say.on_profile(properties), say.DOC, "left")


def _config_lines(one: DataFrame, properties: DataFrame) -> list[DataFrame]:
    files = properties.select("repo", "file", "format", "profile", "bootstrap", "error").distinct()
    docs = document_labels(properties)
    at = F.col("doc_idx") + 1
    inside = {"who": F.col("file"), "n1": at}
    item = lambda df, place, label, *spans, **more: _line(df, 2, "li", span(label), *spans, **inside, n2=place, **more)
    told, ordered = say.scalars(properties.where("key is not null")), {"n3": F.col("ord")}
    scalar = lambda place, label, name: item(told.where(F.col(name) != ""), place, label + ": ", code(F.col(name)))
    groups = say.property_groups(properties)
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy(*say.DOC).orderBy(F.desc("n"), F.collate("name", "UNICODE")))).groupBy(*say.DOC).agg(F.count(F.lit(1)).alias("all"), F.array_sort(F.collect_list(F.when(F.col("r") <= GROUPS, F.struct("r", F.format_string("%s (%d)", "name", "n").alias("t"))))).alias("l"))
    more = F.when(F.col("all") > GROUPS, F.format_string(" and %d more", F.col("all") - GROUPS)).otherwise("")
    routes, locator = say.routes(properties), told.where("discovery_locator <> ''")
    filters = say.default_filters(properties).groupBy(*say.DOC).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "text"))), lambda x: x["text"]).alias("texts"))
    gateways = routes.select(*say.DOC).union(filters.select(*say.DOC)).union(locator.select(*say.DOC)).distinct()
    cell = lambda spans: F.concat(spans, span("", "cell"))
    listed = lambda items: cell(F.when(F.size(items) > 0, codes(F.col(items))).otherwise(span("(none)")))
    or_else = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c))
    head = F.concat(*(cell(span(x)) for x in ("Route", "Target", "Predicates", "Filters")))
    usual = F.concat(span(F.when(F.col("bootstrap"), "bootstrap").otherwise("application")), span(", "), span(F.col("format")), span(", "), F.when(F.col("profile").isNull(), span("no profile")).otherwise(F.concat(span("profile "), code(F.col("profile")))))
    return [
        _line(one, 2, "h2", span("Configuration files")),
        _line(one, 2, "note", span("Values under keys that look secret, and credentials within values, are redacted. Files are shown as they stand: profiles are not merged, and nothing is resolved from the environment or a configuration server."), n1=1),
        _line(one.join(files.limit(1), how="left_anti"), 2, "p", span("There is no application or bootstrap file (.yml, .yaml, .properties)."), n1=2),
        _line(files, 2, "h3", code(F.col("file")), who=F.col("file")),
        _line(files, 2, "p", usual, who=F.col("file"), n3=1),
        _line(files.where("error is not null"), 2, "p", span("Not read in full: "), code(F.col("error")), who=F.col("file"), n3=2),
        _line(docs.where("n > 1 or on_profile is not null"), 2, "h4", span(F.format_string("Document %d", at)), F.when(F.col("on_profile").isNull(), span(" - no profile condition")).otherwise(F.concat(span(" - profile "), code(F.col("on_profile")))), **inside),
        scalar(1, "Application name", "application_name"),
        scalar(2, "Server port", "port"),
        scalar(3, "Context path", "context_path"),
        item(say.profile_settings(properties), 4, "Profiles: ", code(F.col("key")), span(" = "), code(F.col("value")), **ordered),
        item(say.backends(properties), 5, "Data source: ", code(F.col("kind")), span(" at "), code(F.col("target")), span(" ("), code(F.col("key")), span(")"), **ordered),
        scalar(6, "Service discovery (Eureka)", "discovery"),
        item(say.config_imports(properties), 7, "Configuration import: ", code(F.col("value")), **ordered),
        item(say.config_server(properties), 8, "Configuration server: ", code(F.col("text")), **ordered),
        item(ranked, 9, "Property groups: ", codes(F.transform("l", lambda x: x["t"])), span(more)),
        _line(gateways, 2, "p", span("Gateway routing", "b"), **inside, n2=10),
        _line(routes.select(*say.DOC).distinct(), 2, "th", head, **inside, n2=11),
        _line(routes.withColumn("n", F.row_number().over(Window.partitionBy(*say.DOC).orderBy("prefix", "idx"))), 2, "tr", cell(code(or_else("id", "(no id)"))), cell(code(or_else("uri", "(none)"))), listed("predicates"), listed("filters"), **inside, n2=12, n3=F.col("n")),
        _line(filters, 2, "p", span("Filters of every route: "), codes(F.col("texts")), **inside, n2=13),
        _line(locator, 2, "p", span("Discovery locator: "), code(F.col("discovery_locator")), **inside, n2=14),
        _line(docs.where("truncated"), 2, "note", span("This document is larger or deeper than what is read; the rest is left out."), **inside, n2=15),
    ]


def _usage_lines(one: DataFrame, classes: DataFrame, properties: DataFrame) -> list[DataFrame]:
    uses = classes.select("repo", "file", "ord", "name", F.posexplode("config_uses").alias("i", "u")).select("repo", "file", "ord", "name", "i", "u.key", "u.has_default")
    missing = say.undefined_uses(uses.select("repo", "key").distinct(), properties).withColumn("missing", F.lit(True))
    reads = uses.join(missing, ["repo", "key"], "left")
    status = F.when(F.col("missing").isNull(), " (defined)").when(F.col("has_default"), " (not in the scanned files, has a default)").otherwise(" (not in the scanned files, no default)")
    reads = reads.select("repo", "file", "ord", "name", "i", F.concat(span("reads "), code(F.col("key")), span(status)).alias("part"))
    bound = classes.where("config_prefix is not null").select("repo", "file", "ord", "name", "config_prefix")
    absent = say.undefined_prefixes(bound, properties).select("repo", "config_prefix").distinct().withColumn("missing", F.lit(True))
    status = F.when(F.col("missing").isNull(), " (defined in the scanned files)").otherwise(" (not in the scanned files)")
    binds = bound.join(absent, ["repo", "config_prefix"], "left").select("repo", "file", "ord", "name", F.lit(-1).alias("i"), F.concat(span("binds "), code(F.concat("config_prefix", F.lit(".*"))), span(status)).alias("part"))
    each = reads.unionByName(binds).groupBy("repo", "file", "ord", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p).otherwise(F.concat(span("; "), p))))
    some = one.join(each.limit(1), how="left_semi")
    return [
        _line(some, 3, "h3", span("Configuration that code reads")),
        _line(each, 3, "li", code(F.col("name")), span(" - "), joined, who=F.col("file"), n1=1, n2=F.col("ord")),
        _line(some, 4, "note", span("A key that is not in the scanned files may still be set by the environment, a configuration server or a file that was not scanned.")),
    ]


def _class_lines(one: DataFrame, classes: DataFrame) -> list[DataFrame]:
    place = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")).cast("int")
    section = lambda df: df.withColumn("section", F.col("section") + F.col("n1"))
    labels = F.create_map(*(x for k, v in KIND_LABELS.items() for x in (F.lit(k), F.lit(v))))
    at = {"who": F.col("file"), "n1": place, "n2": F.col("ord")}
    marks = F.when(F.size("annotations") == 0, span("Spring Data interface")).otherwise(code(F.array_join(F.transform("annotations", lambda a: F.concat(F.lit("@"), a)), " ")))
    path = F.when(F.col("e.path") == "", "(path not static)").otherwise(F.col("e.path"))
    ends = classes.select("kind", "file", "ord", F.posexplode("endpoints").alias("i", "e"))
    some = one.join(classes.limit(1), how="left_anti")
    lines = [
        _line(some, 9, "p", span("No class with a Spring role was found. Is this a Spring Boot project, and is this the module with src/main/java?")),
        _line(classes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), 10, "h2", span(F.concat(labels[F.col("kind")], F.format_string(" (%d)", "n"))), n1=place),
        _line(classes, 10, "h3", span(F.col("name"), "prose"), **at),
        _line(classes, 10, "p", span(F.col("file"), "i"), span(" - "), marks, **at, n3=1),
        _line(classes.where(F.size("endpoints") > 0), 10, "p", span("Endpoints:"), **at, n3=3),
        _line(ends, 10, "li", code(F.concat_ws(" ", "e.http_method", path)), span(" → "), code(F.concat("e.method_name", F.lit("()"))), **at, n3=F.col("i") + 4),
        _line(classes.where(F.size("depends_on") > 0), 10, "p", span("Depends on: "), codes(F.col("depends_on")), **at, n3=LAST),
    ]
    if "narrative" in classes.columns:
        lines.append(_line(classes.where("narrative <> ''"), 10, "p", span(F.col("narrative"), "prose"), **at, n3=2))
    return [section(x) for x in lines]


LAST = 1_000_000


def report_blocks(classes: DataFrame, properties: DataFrame, dependencies: DataFrame, findings: DataFrame, build_files: DataFrame, root: str) -> DataFrame:
    """section, who, n1, n2, n3 (the order of lines), kind (h1 to h4, p, note, li, th, tr) and spans of the report.

    classes may have a column narrative. Only the name of the scanned directory is told, not its path.
    """
    one = classes.sparkSession.range(1)
    count = classes.agg(F.count(F.lit(1)).alias("n"))
    blocks = _line(one, 0, "h1", span("Architecture map"))
    for more in (
        _line(one, 0, "p", span("Scanned: "), code(F.lit(os.path.basename(os.path.abspath(root)))), n1=1),
        _line(count, 0, "p", span(F.format_string("Classes with a Spring role: %d", "n")), n1=2),
        *_dependency_lines(one, dependencies, findings, build_files),
        *_config_lines(one, properties),
        *_usage_lines(one, classes, properties),
        *_class_lines(one, classes),
    ):
        blocks = blocks.unionByName(more)
    return blocks.withColumn("spans", F.transform("spans", lambda s: F.struct(s["style"].alias("style"), F.regexp_replace(s["text"], r"[\r\n]+", " ").alias("text"))))


def _rows(blocks: DataFrame, styles: dict[str, Callable]):
    """(kind, text) in order, one partition at a time on the driver; cells end with a NUL."""
    text = lambda s: functools.reduce(lambda rest, f: F.when(s["style"] == f[0], f[1](s["text"])).otherwise(rest), styles.items(), F.lit("\0"))
    ordered = blocks.orderBy(*PLACE, "kind", "spans").select("kind", F.array_join(F.transform("spans", text), "").alias("text"))
    return ((r["kind"], r["text"]) for r in ordered.toLocalIterator())


def prose(text: Column) -> Column:
    return F.regexp_replace(md_escape(text), r"^(\s*)=", r"$1\\=")


def markdown_lines(blocks: DataFrame):
    """The report in Markdown, a line at a time: blocks are apart by a blank line, items and table rows are not."""
    plain = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    styles = {"": plain, "code": code_span, "prose": prose, "i": lambda t: F.concat(F.lit("*"), prose(t), F.lit("*")), "b": lambda t: F.concat(F.lit("**"), prose(t), F.lit("**"))}
    before = None
    for kind, text in _rows(blocks, styles):
        if before and not (kind == before == "li" or kind == "tr"):
            yield ""
        if kind in ("th", "tr"):
            cells = [c.replace("|", "\\|") for c in text.split("\0")[:-1]]
            yield f"| {' | '.join(cells)} |"
            if kind == "th":
                yield f"| {' | '.join('---' for _ in cells)} |"
        elif kind == "note":
            yield "_" + text.replace("_", "\\_") + "_"
        else:
            yield {"li": "- ", "p": ""}.get(kind) + text if kind in ("li", "p") else "#" * int(kind[1]) + " " + text
        before = kind


def html_lines(blocks: DataFrame, title: str = "Architecture map"):
    """The report as one page without scripts or requests, a line at a time."""
    tag = lambda name: lambda t: F.concat(F.lit(f"<{name}>"), html_escape(t), F.lit(f"</{name}>"))
    styles = {"": html_escape, "prose": html_escape, "code": tag("code"), "i": tag("em"), "b": tag("strong")}
    yield '<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">'
    yield """<meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'">"""
    yield '<meta name="viewport" content="width=device-width, initial-scale=1">'
    yield f"<title>{html.escape(title)}</title>\n<style>{STYLE}</style>\n</head>\n<body>"
    shut = {"li": "</ul>", "tr": "</table>", "th": "</table>"}
    before = ""
    for kind, text in _rows(blocks, styles):
        inside = "tr" if kind == "th" else kind
        if shut.get(before) and (shut.get(before) != shut.get(kind) or kind == "th"):
            yield shut[before]
            before = ""
        if kind in shut and shut.get(before) != shut[kind]:
            yield "<ul>" if kind == "li" else "<table>"
        if kind in ("th", "tr"):
            yield "<tr>" + "".join(f"<{'th' if kind == 'th' else 'td'}>{c}</{'th' if kind == 'th' else 'td'}>" for c in text.split("\0")[:-1]) + "</tr>"
        elif kind == "note":
            yield f'<p class="note">{text}</p>'
        else:
            yield f"<{inside}>{text}</{inside}>"
        before = kind
    if before in shut:
        yield shut[before]
    yield "</body>\n</html>"


STYLE = "body{font-family:sans-serif;max-width:60em;margin:2em auto;padding:0 1em}code{background:#eee}.note{font-style:italic}td,th{border:1px solid #ccc;padding:.3em;text-align:left}table{border-collapse:collapse}"


def render_markdown(blocks: DataFrame) -> str:
    return "\n".join(markdown_lines(blocks)) + "\n"


def render_html(blocks: DataFrame, title: str = "Architecture map") -> str:
    return "\n".join(html_lines(blocks, title)) + "\n"


def write_lines(lines, path: str) -> None:
    """Line by line, so that no report has to fit in memory."""
    with open(path, "w", encoding="utf-8") as f:
        for line in lines:
            f.write(line + "\n")
