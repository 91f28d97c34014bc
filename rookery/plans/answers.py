"""The answer to a question as text: the best classes and configuration files, with what is known about each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.functions.text import strip_controls
from rookery.operators import search
from rookery.operators import settings as say
from rookery.plans.report import capped, document_labels
from rookery.sources.java import used_by
from rookery.tables import settled

# Fixed value: routes listed for one document.
ROUTES = 12


def _lines(df: DataFrame, n1, n2, n3, *text) -> DataFrame:
    number = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("long")
    return df.select("rank", number(n1).alias("n1"), number(n2).alias("n2"), number(n3).alias("n3"), F.concat(*(F.lit(t) if isinstance(t, str) else F.coalesce(t, F.lit("")) for t in text)).alias("text"))


def _class_lines(hits: DataFrame, classes: DataFrame) -> list[DataFrame]:
    found = hits.where("type = 'class'").select("rank", "doc_id").join(search.with_ids(classes, "class"), "doc_id")
    users = used_by(classes).groupBy("repo", "name").agg(F.array_sort(F.collect_list("user")).alias("users"))
    found = found.join(users, ["repo", "name"], "left").withColumn("users", F.coalesce("users", F.array().cast("array<string>")))
    path = lambda e: F.when(e["path"] == "", "(path not static)").otherwise(e["path"])
    some = lambda items, other: F.when(F.size(items) == 0, other).otherwise(capped(F.col(items)))
    return [
        _lines(found, 0, 0, 0, F.col("rank").cast("string"), ". ", F.col("name"), " (", F.col("kind"), ") - ", F.col("file")),
        _lines(found.where(F.size("endpoints") > 0), 1, 0, 0, "   Endpoints: ", capped(F.transform("endpoints", lambda e: F.concat(e["http_method"], F.lit(" "), path(e), F.lit(" -> "), e["method_name"], F.lit("()"))))),
        _lines(found, 2, 0, 0, "   Depends on: ", some("depends_on", "(no other class of this repository)")),
        _lines(found, 3, 0, 0, "   Used by: ", some("users", "(no other class of this repository)")),
        _lines(found.where("config_prefix is not null"), 4, 0, 0, "   Binds config prefix: ", F.col("config_prefix")),
        _lines(found.where(F.size("config_uses") > 0), 5, 0, 0, "   Reads config: ", capped(F.transform("config_uses", lambda u: u["key"]))),
    ]


def _config_lines(hits: DataFrame, properties: DataFrame, question: str) -> list[DataFrame]:
    wanted = hits.where("type = 'config'").select("rank", "doc_id", "file")
    held = search.with_ids(properties, "config").join(wanted.select("rank", "doc_id"), "doc_id")
    rank, rows = held.select("repo", "file", "rank").distinct(), held.drop("rank", "doc_id")
    where = F.when(F.col("on_profile").isNotNull(), F.concat(F.lit(" [profile "), F.col("on_profile"), F.lit("]"))).when(F.col("n") > 1, F.format_string(" [document %d]", F.col("doc_idx") + 1)).otherwise("")
    labels = document_labels(rows).select(*say.DOC, where.alias("where")).join(rank, ["repo", "file"])
    of = lambda df: df.join(labels, say.DOC)
    told = of(say.scalars(rows.where("key is not null")))
    at, w = F.col("doc_idx") + 1, F.col("where")
    scalar = lambda place, label, name: _lines(told.where(F.col(name) != ""), at, place, 0, f"   {label}", w, ": ", F.col(name))
    name = told.where("application_name <> ''").groupBy("rank").agg(F.min_by("application_name", "doc_idx").alias("name"))
    routes = of(say.routes(rows)).withColumn("k", F.row_number().over(Window.partitionBy(*say.DOC).orderBy("prefix", "idx")))
    bits = F.array_join(F.concat("predicates", F.transform("filters", lambda f: F.concat(F.lit("filter "), f))), ", ")
    or_else = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c))
    counts = routes.groupBy("rank", "doc_idx", "where").agg(F.max("k").alias("k"))
    filters = of(say.default_filters(rows)).groupBy("rank", "doc_idx", "where").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "text"))), lambda x: x["text"]), ", ").alias("texts"))
    settings = search.matching_settings(rows, question).join(wanted.select("doc_id", "rank"), "doc_id")
    return [
        _lines(wanted, 0, 0, 0, F.col("rank").cast("string"), ". ", F.col("file"), " (config file)"),
        _lines(name, 0, 1, 0, "   Application: ", F.col("name")),
        scalar(1, "Port", "port"),
        scalar(2, "Context path", "context_path"),
        _lines(of(say.backends(rows)), at, 3, F.col("ord"), "   Data source", w, ": ", F.col("kind"), " at ", F.col("target")),
        scalar(4, "Eureka", "discovery"),
        _lines(of(say.config_imports(rows)), at, 5, F.col("ord"), "   Config import", w, ": ", F.col("value")),
        _lines(counts, at, 6, 0, "   Gateway routes", w, ":"),
        _lines(routes.where(F.col("k") <= ROUTES), at, 7, F.col("k"), "     ", or_else("id", "(no id)"), " -> ", or_else("uri", "(no uri)"), F.when(bits != "", F.concat(F.lit(" ["), bits, F.lit("]"))).otherwise("")),
        _lines(counts.where(F.col("k") > ROUTES), at, 8, 0, F.format_string("     (+%d more routes)", F.col("k") - ROUTES)),
        _lines(filters, at, 9, 0, "   Default filters", w, ": ", F.col("texts")),
        _lines(settings.select("rank").distinct(), 1000, 0, 0, "   Matching settings:"),
        _lines(settings, 1000, 1, F.col("ord"), "     ", F.col("key"), " = ", F.when(F.col("value") == "", '""').otherwise(F.col("value"))),
    ]


def answer_lines(classes: DataFrame, properties: DataFrame, hits: DataFrame, question: str) -> DataFrame:
    """rank, n1, n2, n3 (the order), text: the lines about each hit of search.answer, without control characters."""
    parts = [*_class_lines(hits, classes), *_config_lines(hits, properties, question), _lines(hits.where(F.size("matched") > 0), 2000, 0, 0, "   Matched: ", F.array_join("matched", ", "))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("text", strip_controls(F.col("text")))


def answer_text(classes: DataFrame, properties: DataFrame, hits: DataFrame, question: str, model_answer: str | None = None) -> str:
    """The whole answer; hits are few (search.answer's k), and so are the lines about each."""
    hits = settled(hits, "hits")
    n = classes.count()
    files = properties.where("key is not null").select("repo", "file").distinct().count()
    searched = f"{n} classes and {files} config files" if files else f"{n} classes"
    rows = answer_lines(classes, properties, hits, question).orderBy("rank", "n1", "n2", "n3", "text").collect()
    out = [f"Question: {' '.join(question.split())}", ""]
    if model_answer:
        out += [model_answer, ""]
    if not rows:
        out.append(f"Nothing matched ({searched} searched). Words that stand in the code help: names of classes and methods, paths, configuration keys.")
    else:
        out.append(f"The {max(r['rank'] for r in rows)} best by keyword search ({searched} searched).")
    last = 0
    for r in rows:
        out += [""] * (r["rank"] != last) + [r["text"]]
        last = r["rank"]
    return "\n".join([*out, "", "This ranking compares words: it misses a class that says the same in other words. Values that look secret are redacted."])


