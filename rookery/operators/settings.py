"""What properties say: profiles, backends, gateway routes, groups, and whether a key that code uses is defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.functions.redact import redact_route_args
from rookery.functions.text import norm_key

DOC = ["repo", "file", "doc_idx"]
# Keys that name a backend, and its kind.
BACKENDS = {
    "spring.r2dbc.url": "r2dbc",
    "spring.data.mongodb.uri": "mongodb",
    "spring.data.redis.host": "redis",
    "spring.redis.host": "redis",
    "spring.kafka.bootstrapservers": "kafka",
    "spring.rabbitmq.host": "rabbitmq",
    "spring.elasticsearch.uris": "elasticsearch",
}
SCHEMES = {"r2dbc": "(?i)^r2dbc:", "mongodb": r"(?i)^mongodb(\+srv)?://"}
# What a gateway's keys begin with, and what may follow.
GATEWAY, FLAVOURS = "spring.cloud.gateway.", ["mvc.", "server.webflux.", "server.webmvc."]
GATEWAY_KEY = "(?i)^" + GATEWAY.replace(".", r"\.") + "(?:" + "|".join(f.replace(".", r"\.") for f in FLAVOURS) + ")?"
#: Room for places within a document: what the report lists after all that have a place of their own.
LATER = 1_000_000


def list_base(key: Column) -> Column:
    """A normalised key, up to its first bracket: all items of a list have one."""
    return F.substring_index(norm_key(key), "[", 1)


def in_order(of: Column, by: Column) -> Column:
    """The values that are not null or empty, in order: an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.when(of != "", F.struct(by.alias("by"), of.alias("of"))))), lambda x: x["of"])


def on_profile(properties: DataFrame) -> DataFrame:
    """The profile condition of each document that has one; the older key counts only without the newer."""
    base, value = list_base(F.col("key")), F.col("value")
    values = lambda k: F.array_join(in_order(F.when(base == k, value), F.col("ord")), ", ")
    both = properties.where(base.isin("spring.config.activate.onprofile", "spring.profiles")).groupBy(*DOC).agg(values("spring.config.activate.onprofile").alias("n"), values("spring.profiles").alias("o"))
    return both.select(*DOC, F.when(F.col("n") != "", F.col("n")).otherwise(F.col("o")).alias("on_profile")).where("on_profile <> ''")


def scalars(properties: DataFrame) -> DataFrame:
    """Name, port, context path, discovery and config server of each document; the first property of a key counts."""
    key = norm_key(F.col("key"))
    first = lambda k: F.min_by(F.when(key == k, F.col("value")), F.when(key == k, F.col("ord")))
    return properties.groupBy(*DOC).agg(
        first("spring.application.name").alias("application_name"),
        F.coalesce(first("server.port"), first("server.http.port")).alias("port"),
        F.coalesce(first("server.servlet.contextpath"), first("server.contextpath")).alias("context_path"),
        first("eureka.client.serviceurl.defaultzone").alias("discovery"),
        F.min_by(F.when(key.rlike(r"^spring\.cloud\.gateway.*discovery\.locator\.enabled$"), F.col("value")), F.when(key.rlike(r"^spring\.cloud\.gateway.*discovery\.locator\.enabled$"), F.col("ord"))).alias("discovery_locator"),
    )


def jdbc_backend(url: Column) -> Column:
    """struct(kind, target) of a JDBC address; null if it is none."""
    kind = F.lower(F.regexp_extract(url, r"(?i)^jdbc:([a-z0-9]+):", 1))
    rest = F.regexp_replace(url, r"(?i)^jdbc:[a-z0-9]+:", "")
    last_at = lambda s: F.regexp_replace(s, "^.*@", "")
    head = lambda s, stop: F.get(F.split(s, stop), 0)
    oracle = (kind == "oracle") & rest.contains("@")
    authority = F.when(oracle, head(F.regexp_replace(last_at(rest), "^//", ""), "[/?;]")).when(rest.startswith("//"), last_at(head(F.regexp_replace(rest, "^//", ""), "[/?;]")))
    hosts = F.array_join(F.filter(F.transform(F.split(authority, r",(?![^{\[]*[}\]])"), lambda x: F.trim(x)), lambda x: x != ""), ", ")  # no comma inside a placeholder or an address
    local = head(rest, "[;?]")
    target = F.when(authority.isNotNull() & (authority != ""), hosts).otherwise(F.when(local == "", "(unspecified)").otherwise(local))
    return F.when(url.rlike(r"(?i)^jdbc:[a-z0-9]+:"), F.struct(kind.alias("kind"), target.alias("target")))


def backends(properties: DataFrame) -> DataFrame:
    """repo, file, doc_idx, ord, kind, target, key: each JDBC address, then each other backend, whose list items are joined in order. One pass."""
    base = list_base(F.col("key"))
    source = F.col("key").rlike(r"(?i)^spring\.datasource(\.[^.]+)*\.(jdbc-?url|url)$")
    known = F.create_map(*(x for i, (k, kind) in enumerate(BACKENDS.items()) for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(LATER + i).alias("place")))))
    rows = properties.where(source | base.isin(list(BACKENDS))).select(*DOC, "ord", "key", "value", F.when(~source, known[base]).alias("named"))
    rows = rows.withColumn("place", F.coalesce("named.place", "ord"))
    joined = rows.groupBy(*DOC, "place", F.col("named.kind").alias("kind")).agg(F.min_by("key", "ord").alias("key"), F.array_join(in_order(F.col("value"), F.col("ord")), ",").alias("value"))
    found = jdbc_backend(F.col("value"))
    other = F.col("value")
    for kind, scheme in SCHEMES.items():
        other = F.when(F.col("kind") == kind, F.regexp_replace("value", scheme, F.lit(""))).otherwise(other)
    target = F.when(F.col("kind").isNull(), F.coalesce(found["target"], F.col("value"))).otherwise(other)
    out = joined.where("value <> ''").select(*DOC, F.col("place").alias("ord"), F.coalesce("kind", found["kind"], F.lit("datasource")).alias("kind"), target.alias("target"), F.regexp_replace("key", r"\[\d+\]$", "").alias("key"))
    return out.where("target <> ''")


def _shortcuts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by + (ord, text) of list items: `rest` is what follows the list's name in the key, `value` the value."""
    index = F.when(F.col("rest") == "", -1).otherwise(F.regexp_extract("rest", r"^\[(\d+)\]", 1).try_cast("int"))
    field = F.regexp_replace("rest", r"^\[\d+\]\.?", "")
    argument = F.regexp_extract(field, r"^args\.(.+)$", 1)
    shown = F.when(argument.rlike(r"^_genkey_\d+$") | (argument == ""), F.col("value")).otherwise(F.concat(argument, F.lit("="), F.col("value")))
    items = rows.select(*by, "ord", "value", index.alias("i"), field.alias("field"), shown.alias("shown")).where("i is not null").groupBy(*by, "i").agg(
        F.min_by(F.when(F.col("field") == "", F.col("value")), F.when(F.col("field") == "", F.col("ord"))).alias("direct"),
        F.min_by(F.when(F.col("field") == "name", F.col("value")), F.when(F.col("field") == "name", F.col("ord"))).alias("name"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("field").startswith("args"), F.struct("ord", "shown")))), lambda x: x["shown"]).alias("args"),
    )
    short = F.col("direct").rlike("^[^=]+=")
    pieces = F.transform(F.split(F.regexp_replace("direct", "^[^=]*=", ""), ","), lambda x: F.trim(x))
    items = items.select(*by, "i", "direct", "name", F.when(F.col("direct").isNull(), F.col("args")).when(short, pieces).otherwise(F.array().cast("array<string>")).alias("args"))
    items = items.select(*by, "i", "direct", "name", redact_route_args(F.col("args")).alias("args"))
    direct = F.when(short, F.concat(F.regexp_extract("direct", "^([^=]+)=", 1), F.lit("="), F.array_join("args", ","))).otherwise(F.col("direct"))
    mapped = F.concat("name", F.when(F.size("args") > 0, F.concat(F.lit("("), F.array_join("args", ", "), F.lit(")"))).otherwise(""))
    return items.select(*by, F.col("i").alias("ord"), F.coalesce(direct, mapped, F.lit("")).alias("text")).where("text <> ''")


def _listed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return _shortcuts(rows, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias(name))


def routes(properties: DataFrame) -> DataFrame:
    """repo, file, doc_idx, prefix, idx, id, uri, predicates, filters of gateway routes."""
    pattern = GATEWAY_KEY + r"routes\[(\d+)\]\.(.+)$"
    by = [*DOC, "prefix", "idx"]
    rows = properties.where(F.col("key").rlike(pattern)).select(*DOC, F.concat(F.substring_index("key", "routes[", 1), F.lit("routes")).alias("prefix"), F.regexp_extract("key", pattern, 1).cast("int").alias("idx"), F.regexp_extract("key", pattern, 2).alias("field"), "ord", "value")
    first = lambda f: F.coalesce(F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ord"))), F.lit(""))
    heads = rows.groupBy(*by).agg(first("id").alias("id"), first("uri").alias("uri"))
    for name in ("predicates", "filters"):
        items = rows.where(F.col("field").rlike(rf"^{name}($|\[)")).withColumn("rest", F.regexp_replace("field", f"^{name}", ""))
        heads = heads.join(_listed(items, by, name), by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return heads


def default_filters(properties: DataFrame) -> DataFrame:
    """repo, file, doc_idx, list, at (where the list begins), ord, text: two lists of one document keep apart."""
    pattern = GATEWAY_KEY + r"default-filters(\[\d+\](?:\..+)?)$"
    rows = properties.where(F.col("key").rlike(pattern)).select(*DOC, F.regexp_extract("key", "(?i)^(.*?default-filters)", 1).alias("list"), "ord", "value", F.regexp_extract("key", pattern, 1).alias("rest"))
    begins = rows.groupBy(*DOC, "list").agg(F.min("ord").alias("at"))
    return _shortcuts(rows, [*DOC, "list"]).join(begins, [*DOC, "list"]).select(*DOC, "list", "at", "ord", "text")


def config_imports(properties: DataFrame) -> DataFrame:
    """Imports in order, then the first address of the configuration server."""
    key = norm_key(F.col("key"))
    rows = properties.where(key.startswith("spring.config.import") | (key == "spring.cloud.config.uri")).select(*DOC, "ord", "key", "value", (key == "spring.cloud.config.uri").alias("uri"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*DOC, "uri").orderBy("ord")))
    return first.where("value <> '' and (n = 1 or not uri)").select(*DOC, F.when(F.col("uri"), LATER).otherwise(F.col("ord")).alias("ord"), "key", "value")


def config_server(properties: DataFrame) -> DataFrame:
    """Settings of a configuration server that say where it reads; text is the key's rest and the value."""
    rest = F.regexp_extract("key", r"(?i)^spring\.cloud\.config\.server\.(.*)$", 1)
    told = norm_key(F.col("key")).rlike("uri|searchlocations|label")
    return properties.where((rest != "") & told & (F.col("value") != "")).select(*DOC, "ord", "key", "value", F.concat_ws(": ", rest, "value").alias("text"))


def profile_settings(properties: DataFrame) -> DataFrame:
    """Active, default and included profiles, in that order; keys as written."""
    kinds = F.array(*(F.lit(f"spring.profiles.{k}") for k in ("active", "default", "include")))
    place = F.array_position(kinds, list_base(F.col("key"))).cast("int")
    return properties.where(place > 0).select(*DOC, (place * LATER + F.col("ord")).alias("ord"), "key", "value")


def property_groups(properties: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many properties stand under each first segment (two under spring)."""
    parts = F.transform(F.split("key", r"\."), lambda p: F.regexp_replace(p, r"\[\d+\]", ""))
    name = F.when((F.get(parts, 0) == "spring") & (F.size(parts) > 1), F.concat_ws(".", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, 0))
    by = DOC if by is None else by
    return properties.where("key is not null").groupBy(*by, name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def ancestors(key: Column, lists: bool = True) -> Column:
    """A normalised key and all keys above it, at dots and (if lists) at brackets: a prefix test becomes an equi-join."""
    parts = F.split(F.regexp_replace(norm_key(key), r"\[", ".[") if lists else norm_key(key), r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.transform(ups, lambda k: F.replace(k, F.lit(".["), F.lit("["))) if lists else ups


def undefined_uses(uses: DataFrame, properties: DataFrame) -> DataFrame:
    """uses(repo, …, key) whose key no scanned configuration of the repository defines."""
    defined = properties.where("key is not null").select("repo", F.explode(ancestors(F.col("key"))).alias("norm")).distinct()
    return uses.withColumn("norm", norm_key(F.col("key"))).join(defined, ["repo", "norm"], "left_anti").drop("norm")


def undefined_prefixes(classes: DataFrame, properties: DataFrame) -> DataFrame:
    defined = properties.where("key is not null").select("repo", F.explode(ancestors(F.col("key"), lists=False)).alias("norm")).distinct()
    return classes.where("config_prefix is not null").select("repo", "file", "name", "config_prefix", norm_key(F.col("config_prefix")).alias("norm")).join(defined, ["repo", "norm"], "left_anti").drop("norm")
