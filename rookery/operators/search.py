"""Field-weighted BM25 over classes and configuration files (or any texts), as joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.functions.text import is_noise, split_words, stem, tokenize
from rookery.operators import settings as say
from rookery.tables import settled

# Weights of fields, BM25's constants, and weights of kinds of query terms.
WEIGHTS = {"name": 6.0, "kind": 6.0, "endpoint": 4.0, "annotation": 2.0, "depends_on": 1.5, "file": 1.0, "body": 1.0}
K1, B, JOINED, SYNONYM, WEAK, CAP, RESULTS, QUESTION, SETTINGS = 1.2, 0.75, 0.6, 0.4, 0.15, 3, 5, 1000, 6
# Words under which a configuration file, and what its summary holds, are found.
FILE_WORDS = "config configuration properties settings"
PORT_WORDS, PATH_WORDS, PROFILE_WORDS, BACKEND_WORDS = "server port listens", "context path", "profile profiles active", "database datasource"
DISCOVERY_WORDS, SERVER_WORDS, ROUTE_WORDS = "eureka discovery registry", "config server import", "gateway route routes routing routed"
PARTICLES = ["in", "up", "out", "on", "off"]
# Words and what they also mean; ~ marks a weaker relation.
SYNONYMS = {
    "database": "repository jpa jdbc sql entity~",
    "db": "repository jpa jdbc sql entity~",
    "sql": "repository jpa jdbc entity~",
    "persistence": "repository jpa entity~",
    "persist": "repository jpa entity~",
    "storage": "repository entity~",
    "table": "entity repository~",
    "endpoint": "controller mapping",
    "api": "controller mapping",
    "route": "controller mapping",
    "rest": "controller mapping",
    "http": "controller mapping",
    "url": "controller mapping",
    "config": "configuration bean",
    "configuration": "config bean",
    "setting": "configuration config",
    "setup": "configuration config",
    "logic": "service",
    "business": "service",
    "error": "exception advice handler",
    "exception": "advice handler",
    "failure": "exception advice handler",
    "login": "auth authenticate security password token",
    "auth": "authenticate security login token",
    "authentication": "auth security login token",
    "security": "auth authenticate token",
    "password": "auth login security",
    "store": "repository entity~",
    "save": "repository entity~",
    "saved": "repository entity~",
    "fetch": "repository~ client",
    "load": "repository~",
    "create": "controller~ post",
    "delete": "controller~",
    "update": "controller~ put",
}


def query_terms(questions: DataFrame, expand: bool = True) -> DataFrame:
    """questions(qid, question) -> qid, ord, term, weight, display: typed words, adjacent pairs joined, synonyms; the greatest weight of a stem counts, at its first place."""
    spark = questions.sparkSession
    words = questions.select("qid", split_words(F.col("question")).alias("w"))
    each = words.select("qid", F.posexplode("w").alias("at", "word"))
    typed = each.where(~is_noise(F.col("word"))).select("qid", F.lit(0).alias("part"), "at", F.lit(0).alias("sub"), "word", F.lit(1.0).alias("weight"), F.col("word").alias("display"))
    terms = typed
    if expand:
        pairs = words.select("qid", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.slice("w", i, 2))).alias("at", "p")).where("size(p) = 2").select("qid", "at", F.get("p", 0).alias("a"), F.get("p", 1).alias("b"))
        joined = pairs.where(~is_noise(F.col("a")) & (~is_noise(F.col("b")) | F.col("b").isin(PARTICLES)) & ~is_noise(F.concat("a", "b")))
        terms = terms.unionByName(joined.select("qid", F.lit(1).alias("part"), "at", F.lit(0).alias("sub"), F.concat("a", "b").alias("word"), F.lit(JOINED).alias("weight"), F.concat_ws(" ", "a", "b").alias("display")))
        rows = [(k, i, x.rstrip("~"), WEAK if x.endswith("~") else SYNONYM, n) for n, (k, v) in enumerate(SYNONYMS.items()) for i, x in enumerate(v.split())]
        related = spark.createDataFrame(rows, "head string, sub int, also string, weight double, n int").withColumn("head", stem(F.col("head")))
        last = related.groupBy("head").agg(F.max("n").alias("n"))  # of words of one stem the last listed counts
        more = typed.drop("sub", "weight").withColumn("head", stem(F.col("word"))).join(F.broadcast(related.join(last, ["head", "n"])), "head")
        terms = terms.unionByName(more.select("qid", F.lit(2).alias("part"), "at", "sub", F.col("also").alias("word"), "weight", "display"))
    place = F.struct("part", "at", "sub")
    best = terms.withColumn("term", stem(F.col("word"))).groupBy("qid", "term").agg(F.min(place).alias("place"), F.max("weight").alias("weight"), F.max_by("display", F.struct("weight", -F.col("part"), -F.col("at"), -F.col("sub"))).alias("display"))
    return best.select("qid", F.row_number().over(_by("qid", "place")).alias("ord"), "term", "weight", "display")


def _by(by: str, order: str):
    return Window.partitionBy(by).orderBy(order)


def term_frequencies(fields: DataFrame) -> DataFrame:
    """fields(doc_id, instance, text, weight, cap) -> doc_id, term, tf: in each instance of a field (a row) a term counts cap times at most (null: no limit).

    A row's terms are counted within it: they are sorted, and a run of equal ones is one entry. So one shuffle remains, of distinct terms.
    """
    rows = fields.select("doc_id", "weight", "cap", F.array_sort(tokenize(F.col("text"))).alias("all"))
    starts = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: (i == 1) | (F.get("all", i - 1) != F.get("all", i - 2)))
    rows = rows.where(F.size("all") > 0).select("doc_id", "weight", "cap", "all", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("all") + 1))
    runs = rows.select("doc_id", "weight", "cap", F.explode(F.zip_with("starts", ends, lambda a, b: F.struct(F.get("all", a - 1).alias("term"), (b - a).cast("long").alias("n")))).alias("r"))
    return runs.groupBy("doc_id", F.col("r.term").alias("term")).agg(F.sum(F.col("weight") * F.least("r.n", F.coalesce("cap", "r.n"))).alias("tf"))


def document_lengths(tf: DataFrame) -> DataFrame:
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(tf: DataFrame, terms: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, matched. One pass over tf makes a row for each document, with its length and those of its terms that are asked for.

    Documents without any term count for n and the average length if all_docs (doc_id) lists them. What is joined with tf are the
    distinct terms of the questions; how, is left to the optimiser, which knows their size.
    """
    asked = terms.select("term").distinct().withColumn("asked", F.lit(True))
    docs = tf.join(asked, "term", "left").groupBy("doc_id").agg(F.sum("tf").alias("length"), F.collect_list(F.when(F.col("asked"), F.struct("term", "tf"))).alias("hits"))
    if all_docs is not None:
        docs = all_docs.select("doc_id").distinct().join(docs, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("hits", F.array().cast("array<struct<term:string,tf:double>>")).alias("hits"))
    docs = settled(docs, "scored")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))  # one row
    hits = docs.select("doc_id", "length", F.explode("hits").alias("h")).select("doc_id", "length", "h.term", "h.tf")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(terms.join(df, "term"), "term").crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.when(F.col("mean") > 0, 1 - B + B * F.col("length") / F.col("mean")).otherwise(1.0)
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    listed = rows.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part"), "display"))).alias("parts"))  # at most one a query term
    return listed.select("qid", "doc_id", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"), F.array_distinct(F.transform("parts", lambda p: p["display"])).alias("matched"))


def exact_names(question: Column, name: Column) -> Column:
    """Whether the question holds the name as a whole word, case and all."""
    return F.array_contains(F.regexp_extract_all(question, F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)), name)


def class_fields(classes: DataFrame) -> DataFrame:
    """doc_id, instance, text, weight, cap of classes (doc_id, name, kind, annotations, endpoints, depends_on, file, raw_body)."""
    one = lambda text, weight, cap=None: F.struct(text.cast("string").alias("text"), F.lit(weight).alias("weight"), F.lit(cap).cast("long").alias("cap"))
    c, w = F.col, WEIGHTS
    many = lambda of, weight: F.transform(of, lambda x: one(x, weight))
    all_ = F.concat(
        F.array(one(c("name"), w["name"]), one(c("kind"), w["kind"]), one(c("file"), w["file"]), one(c("raw_body"), w["body"], CAP)),
        many(c("annotations"), w["annotation"]),
        F.transform("endpoints", lambda e: one(F.concat_ws(" ", e["http_method"], e["path"], e["method_name"]), w["endpoint"])),
        many(c("depends_on"), w["depends_on"]),
        F.when(F.size("endpoints") > 0, F.array(one(F.lit("endpoint"), w["endpoint"]))).otherwise(F.array().cast("array<struct<text:string,weight:double,cap:bigint>>")),
    )
    return classes.select("doc_id", F.posexplode(all_).alias("instance", "f")).select("doc_id", "instance", "f.*")


def summary_words(properties: DataFrame) -> DataFrame:
    """doc_id, text: what a configuration file's summary adds to what is searched; properties carry doc_id."""
    files = properties.select("repo", "file", "doc_id").distinct()
    d = say.DOC
    told = say.scalars(properties)
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    texts = F.array(F.when(given("port"), F.concat_ws(" ", F.lit(PORT_WORDS), "port")), F.when(given("context_path"), F.lit(PATH_WORDS)), F.when(given("discovery"), F.lit(DISCOVERY_WORDS)))
    out = told.select(*d, F.explode(texts).alias("text")).where("text is not null")
    routes, filters = say.routes(properties), say.default_filters(properties)
    once = lambda df, words: df.select(*d).distinct().withColumn("text", F.lit(words))
    out = out.unionByName(once(say.profile_settings(properties), PROFILE_WORDS))
    out = out.unionByName(say.backends(properties).select(*d, F.concat_ws(" ", F.lit(BACKEND_WORDS), "kind", "target").alias("text")))
    out = out.unionByName(once(say.config_imports(properties).select(*d).union(say.config_server(properties).select(*d)), SERVER_WORDS))
    out = out.unionByName(once(routes.select(*d).union(filters.select(*d)), ROUTE_WORDS))
    out = out.unionByName(routes.select(*d, F.concat_ws(" ", "id", "uri", "predicates", "filters").alias("text")))
    return out.join(files, ["repo", "file"]).select("doc_id", "text")


def config_fields(properties: DataFrame) -> DataFrame:
    """The same of configuration files; properties carry doc_id. Each row is an instance of its own."""
    rows = properties.where("key is not null")
    none = F.lit(None).cast("long")
    one = lambda text, weight, cap=none: F.struct(text.alias("text"), F.lit(weight).alias("weight"), cap.alias("cap"))
    each = rows.select("doc_id", F.explode(F.array(one(F.col("key"), WEIGHTS["annotation"]), one(F.col("value"), WEIGHTS["body"], F.lit(CAP).cast("long")))).alias("f")).select("doc_id", "f.*")
    files = rows.select("repo", "doc_id", "file").distinct()
    names = say.scalars(rows).where("application_name <> ''").select("repo", "file", "application_name").join(files, ["repo", "file"]).select("doc_id", F.col("application_name").alias("text"), F.lit(WEIGHTS["name"]).alias("weight"), none.alias("cap"))
    whole = files.select("doc_id", F.explode(F.array(one(F.col("file"), WEIGHTS["file"]), one(F.lit(FILE_WORDS), WEIGHTS["depends_on"]))).alias("f")).select("doc_id", "f.*")
    summary = summary_words(rows).select("doc_id", "text", F.lit(WEIGHTS["endpoint"]).alias("weight"), none.alias("cap"))
    out = each.unionByName(names).unionByName(whole).unionByName(summary)
    return out.select("doc_id", F.lit(0).alias("instance"), "text", "weight", "cap")


@dataclass
class Index:
    """docs (doc_id, type, name, file) and tf (doc_id, term, tf) of the classes and configuration files."""

    docs: DataFrame
    tf: DataFrame


def build_index(classes: DataFrame, properties: DataFrame) -> Index:
    """Tokenised once; any number of questions can be asked of it."""
    cs = with_ids(classes, "class")
    ps = with_ids(properties.where("key is not null"), "config")
    docs = cs.select("doc_id", F.lit("class").alias("type"), "name", "file").unionByName(ps.select("doc_id", F.lit("config").alias("type"), F.lit("").alias("name"), "file").distinct())
    return Index(settled(docs, "index-docs"), settled(term_frequencies(class_fields(cs).unionByName(config_fields(ps))), "index-tf"))


def answer(spark: SparkSession, classes: DataFrame, properties: DataFrame, question: str, k: int | None = RESULTS, only: str | None = None, index: Index | None = None) -> DataFrame:
    """rank, type, name, file, score, matched, exact, doc_id: the k best classes and configuration files for a question; names in the question come first.

    k: None for all of them, and none if it is not positive. only: "class" or "config" to rank those alone, in the statistics of all.
    index: that of the same classes and properties, where it exists.
    """
    index = index or build_index(classes, properties)
    tf, docs = index.tf, index.docs
    asked = spark.createDataFrame([(1, question[:QUESTION])], "qid int, question string")
    scored = bm25(tf, query_terms(asked), docs)
    exact = (F.col("type") == "class") & exact_names(F.lit(question), F.col("name"))
    ranked = docs.join(scored, "doc_id", "left").select("type", "name", "file", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), exact.alias("exact"), "doc_id").where("score > 0 or exact")
    if only:
        ranked = ranked.where(F.col("type") == only)
    order = [F.desc("exact"), F.desc("score"), F.collate("name", "UNICODE"), F.collate("file", "UNICODE"), "doc_id"]
    top = ranked if k is None else ranked.orderBy(*order).limit(max(0, k))
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "*")


def with_ids(df: DataFrame, kind: str) -> DataFrame:
    """df with doc_id: of a class its place in its file, of a configuration file the file."""
    place = [F.col("ord").cast("string")] if kind == "class" else []
    return df.withColumn("doc_id", F.concat_ws("\n", F.lit(kind), "repo", "file", *place))


def matching_settings(properties: DataFrame, question: str, most: int = SETTINGS) -> DataFrame:
    """doc_id, ord, key, value: of each configuration file the first properties whose key has a term of the question."""
    spark = properties.sparkSession
    terms = query_terms(spark.createDataFrame([(1, question[:QUESTION])], "qid int, question string")).select("term").distinct()
    rows = with_ids(properties.where("key is not null"), "config").select("doc_id", (F.col("doc_idx").cast("long") * say.LATER + F.col("ord")).alias("ord"), "key", "value")
    hit = rows.select("doc_id", "ord", F.explode(tokenize(F.col("key"))).alias("term")).join(terms, "term", "left_semi").select("doc_id", "ord").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return rows.join(hit, ["doc_id", "ord"], "left_semi").withColumn("n", n).where(F.col("n") <= most).drop("n")
