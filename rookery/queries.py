"""Queries over the driver's tables, one for each operator or small group, and the same in SQL.

Sources that the tables lack (Java, properties, projects) are written out from their columns and parsed; the SQL then works on the columns,
never on the text, so it checks the parser by a round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.functions import redact, text, versions
from rookery.operators import builds, search
from rookery.operators import settings as say
from rookery.plans import report
from rookery.session import configured
from rookery.sources import java, settings
from rookery.sources.tree import is_source_path
from rookery.tables import settled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: configured(spark).read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = """w as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
 '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2 and not regexp_matches(x, '^[0-9]+$'))) as word from documents)"""
NOISE = "(" + ", ".join(f"'{w}'" for w in sorted({*text.NOISE})) + ")"
S1 = "case when length(word) > 4 and word like '%sses' then left(word, length(word) - 2) when length(word) > 3 and word like '%s' and not regexp_matches(word, '(ss|us|is)$') then left(word, length(word) - 1) else word end"
STEMMED = f"""{WORDS}, k as (select doc_id, word, case when length(word) > 4 and word like '%ies' then left(word, length(word) - 3) || 'y' end as y, {S1} as a from w where word not in {NOISE}),
 b as (select doc_id, y, case when length(a) > 5 and a like '%ing' then left(a, length(a) - 3) when length(a) > 4 and a like '%ed' then left(a, length(a) - 2) else a end as b from k),
 s as (select doc_id, coalesce(y, case when length(b) > 3 and b like '%e' then left(b, length(b) - 1) else b end) as term from b)"""
TF = f"{STEMMED}, tf as (select doc_id, term, cast(count(*) as double) as tf from s group by all)"

def _fields(t):
    return t("documents").select("doc_id", F.lit(0).alias("instance"), "text", F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("cap"))


@query(f"with {WORDS} select word, count(*) as n from w group by word")
def split_words_counts(t):
    return t("documents").select(F.explode(text.split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TF} select doc_id, term, tf from tf")
def tokenize_stem_tf(t):
    return search.term_frequencies(_fields(t))


@query(f"with {TF} select term, count(*) as df from tf group by term")
def document_frequency(t):
    return search.document_frequencies(search.term_frequencies(_fields(t)))


@query(f"with {TF} select doc_id, sum(tf) as length from tf group by doc_id")
def document_length(t):
    return search.document_lengths(search.term_frequencies(_fields(t)))


@query(f"""with {TF}, q(term) as (values ('tion'), ('her'), ('ent'), ('th')), l as (select doc_id, sum(tf) as length from tf group by doc_id),
 z as (select count(*) as n, avg(length) as mean from l), f as (select term, count(*) as df from tf where term in (select term from q) group by term),
 r as (select tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from tf join f using (term) join l using (doc_id), z group by tf.doc_id)
 select doc_id, round(score, 6) as score from r order by round(score, 6) desc, doc_id limit 10""")
def bm25_topk(t):
    spark = t("documents").sparkSession
    terms = spark.createDataFrame([(1, i, w, 1.0, w) for i, w in enumerate(["tion", "her", "ent", "th"])], "qid int, ord int, term string, weight double, display string")
    scored = search.bm25(search.term_frequencies(_fields(t)), terms)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def _stem_sql(word):
    """The stem of an SQL expression, as nested conditions."""
    plural = f"case when length({word}) > 4 and {word} like '%sses' then left({word}, length({word}) - 2) when length({word}) > 3 and {word} like '%s' and not regexp_matches({word}, '(ss|us|is)$') then left({word}, length({word}) - 1) else {word} end"
    tense = f"(select case when length(x) > 5 and x like '%ing' then left(x, length(x) - 3) when length(x) > 4 and x like '%ed' then left(x, length(x) - 2) else x end from (select {plural} as x))"
    return f"case when length({word}) > 4 and {word} like '%ies' then left({word}, length({word}) - 3) || 'y' else (select case when length(z) > 3 and z like '%e' then left(z, length(z) - 1) else z end from (select {tense} as z)) end"


RELATED = ", ".join(f"({n}, '{k}', {i}, '{x.rstrip('~')}', {search.WEAK if x.endswith('~') else search.SYNONYM})" for n, (k, v) in enumerate(search.SYNONYMS.items()) for i, x in enumerate(v.split()))


@query(f"""with l as (select item_id as qid, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
 '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2 and not regexp_matches(x, '^[0-9]+$')) as w from benchmark),
 e as (select qid, generate_subscripts(w, 1) as pos, unnest(w) as word, w from l), typed as (select * from e where word not in {NOISE}),
 related as (select * from (values {RELATED}) r(n, head, sub, also, weight)), heads as (select n, {_stem_sql('head')} as head, sub, also, weight from related), last as (select head, max(n) as n from heads group by head),
 terms as (select qid, 0 as part, pos, 0 as sub, word, 1.0::double as weight, word as display from typed
  union all select qid, 1, pos, 0, word || w[pos + 1], {search.JOINED}, word || ' ' || w[pos + 1] from typed where pos < len(w) and (w[pos + 1] not in {NOISE} or w[pos + 1] in ('in', 'up', 'out', 'on', 'off')) and word || w[pos + 1] not in {NOISE}
  union all select qid, 2, pos, sub, also, weight, word from (select *, {_stem_sql('word')} as head from typed) join (select heads.* from heads join last using (head, n)) using (head)),
 s as (select *, {_stem_sql('word')} as term from terms), best as (select qid, term, min((part, pos, sub)) as place, max(weight) as weight, arg_max(display, (weight, -part, -pos, -sub)) as display from s group by qid, term)
 select qid, cast(row_number() over (partition by qid order by place) as integer) as ord, term, weight, display from best""")
def query_terms_expand(t):
    asked = t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return search.query_terms(asked)


@query("select p_partkey, list_contains(regexp_extract_all('where is ' || split_part(p_name, ' ', 1) || ' used', '[A-Za-z0-9_$]+'), split_part(p_name, ' ', 1)) as pinned from part")
def exact_name_pin(t):
    first = F.get(F.split("p_name", " "), 0)
    return t("part").select("p_partkey", search.exact_names(F.concat(F.lit("where is "), first, F.lit(" used")), first).alias("pinned"))


@query("select c_custkey, 'db://u' || c_custkey || ':[redacted]@h/x' as url, 'https://[redacted]@h' || c_custkey as lone, '?user=' || c_custkey || '&token=[redacted]&z=1' as param, 'Bearer [redacted]' as auth, '${DB_PASSWORD:[redacted]}' as placeholder, '[redacted]' as opaque, 'hooks.slack.com/services/[redacted]' as slack, '[redacted] end' as pem from customer")
def redact_round_trip(t):
    k = F.col("c_custkey").cast("string")
    say_ = lambda *parts: redact.redact_text(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)))
    return t("customer").select("c_custkey", say_("db://u", k, ":pw", k, "@h/x").alias("url"), say_("https://t", k, "@h", k).alias("lone"), say_("?user=", k, "&token=abc", k, "&z=1").alias("param"), say_("Bearer abcdef", k).alias("auth"), say_("${DB_PASSWORD:x", k, "}").alias("placeholder"), redact.redact_text(F.sha2(k, 256)).alias("opaque"), say_("hooks.slack.com/services/T", k, "/B1").alias("slack"), say_("-----BEGIN A-----", k, "-----END A----- end").alias("pem"))


@query()
def redact_documents(t):
    """Every row, of any length and with secrets of any shape."""
    return t("documents").select("doc_id", redact.redact_text(F.col("text")).alias("text"))


@query(f"select p_partkey, regexp_matches(lower(p_name), '{redact.SECRET_WORDS}') as secret, regexp_replace(lower(p_name), '[-_]', '', 'g') as norm from part")
def secret_and_normal_keys(t):
    return t("part").select("p_partkey", redact.is_secret_key(F.col("p_name")).alias("secret"), text.norm_key(F.col("p_name")).alias("norm"))


@query("select doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]+', ' ', 'g') as flat, case when length(text) > 300 then left(text, 300) || '…' else text end as cut from documents")
def strip_and_truncate(t):
    return t("documents").select("doc_id", text.strip_controls(F.col("text")).alias("flat"), text.truncate(F.col("text")).alias("cut"))


def _versions(t):
    v = F.concat_ws(".", (F.col("l_partkey") % 4).cast("string"), (F.col("l_suppkey") % 20).cast("string"), F.col("l_linenumber").cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", v.alias("version"), "l_partkey")


@query("select l_orderkey, l_linenumber, cast(sign((l_partkey % 4 - 2) * 1000000 + (l_suppkey % 20 - 17) * 1000 + l_linenumber - 1) as integer) as c from lineitem")
def version_compare(t):
    return _versions(t).select("l_orderkey", "l_linenumber", versions.compare_versions(F.col("version"), F.lit("2.17.1-x")).alias("c"))


@query("""select l_orderkey, l_linenumber, case when l_partkey % 2 = 0 then 'critical' when m = 1 then 'critical' else 'advisory' end as severity from (select *, l_partkey % 4 as m, l_suppkey % 20 as n from lineitem)
 where case when l_partkey % 2 = 0 then (m * 1000000 + n * 1000 + l_linenumber) < 2017001 and not (m = 2 and ((n = 12 and l_linenumber >= 4) or (n = 3 and l_linenumber >= 2))) else m in (1, 2) end""")
def risk_findings(t):
    log = F.col("l_partkey") % 2 == 0
    rows = _versions(t).select("l_orderkey", "l_linenumber", F.when(log, "org.apache.logging.log4j").otherwise("org.springframework.boot").alias("group_id"), F.when(log, "log4j-core").otherwise("spring-boot-gradle-plugin").alias("artifact_id"), "version")
    return builds.risk_findings(rows).select("l_orderkey", "l_linenumber", "severity")


@query("select n_name, cast(count(*) as bigint) as classes, cast(sum(2) as bigint) as endpoints from customer join nation on c_nationkey = n_nationkey group by n_name")
def java_endpoints(t):
    k = F.col("c_custkey").cast("string")
    code = F.concat(F.lit('@RestController @RequestMapping("/'), F.col("n_name"), F.lit('")\nclass C'), k, F.lit(' { // class No {\n String s = "}"; @GetMapping("/{id}") X get(long id) { return null; }\n @PostMapping({"/p'), k, F.lit('"}) void put() { } }'))
    files = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"), F.concat(k, F.lit(".java")).alias("path"), code.alias("text"))
    found = java.java_classes(files).where("kind = 'controller'").select("repo", "name", F.explode("endpoints").alias("e")).where(F.startswith("e.path", F.concat(F.lit("/"), F.col("repo"), F.lit("/"))))
    return found.groupBy(F.col("repo").alias("n_name")).agg(F.countDistinct("name").alias("classes"), F.count(F.lit(1)).alias("endpoints"))


@query("select 'N' || r.r_name as target, 'S' || n.n_nationkey as user from nation n join region r on n.n_regionkey = r.r_regionkey")
def used_by(t):
    services = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("r").alias("repo"), F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("name"), F.replace("r_name", F.lit(" "), F.lit("")).alias("region"))
    code = F.concat(F.lit("@Service class "), F.col("name"), F.lit(" { "), F.col("name"), F.lit("(N"), F.col("region"), F.lit(" a, List<Unknown> b) { } }"))
    targets = t("region").select(F.lit("r").alias("repo"), F.replace("r_name", F.lit(" "), F.lit("")).alias("region"))
    files = services.select("repo", F.concat("name", F.lit(".java")).alias("path"), code.alias("text")).unionByName(targets.select("repo", F.concat("region", F.lit(".java")).alias("path"), F.concat(F.lit("interface N"), F.col("region"), F.lit(" extends JpaRepository<A, B> { }")).alias("text")))
    return java.used_by(java.resolved(java.java_classes(files))).select(F.col("name").alias("target"), "user")


SQL["used_by"] = SQL["used_by"].replace("r.r_name", "replace(r.r_name, ' ', '')")


def _config(t):
    k = F.col("c_custkey").cast("string")
    body = F.concat_ws("\n", F.concat(F.lit("spring.application.name=app"), k), F.concat(F.lit("server.port = "), k), F.concat(F.lit("spring.datasource.url: jdbc:mysql://u:p@db"), k, F.lit(":3306/x?y=1")), F.concat(F.lit("spring.cloud.gateway.routes[0].id=r"), k), F.concat(F.lit("spring.cloud.gateway.routes[0].predicates[0]=Path=/"), k, F.lit("/**")), F.lit("spring.kafka.bootstrap-servers[0]=a:1\nspring.kafka.bootstrap-servers[1]=b:2\n#---\nspring.config.activate.on-profile=p\nown.key=1"))
    files = t("customer").select(F.lit("r").alias("repo"), F.concat(k, F.lit("/application.properties")).alias("path"), F.lit("application.properties").alias("name"), F.length(body).alias("size"), body.alias("text"))
    return settings.config_properties(files)


@query("select c_custkey || '/application.properties' as file, 'app' || c_custkey as application_name, cast(c_custkey as varchar) as port from customer")
def config_scalars(t):
    return say.scalars(_config(t)).where("doc_idx = 0").select("file", "application_name", "port")


@query("select c_custkey || '/application.properties' as file, kind, case when kind = 'mysql' then 'db' || c_custkey || ':3306' else 'a:1,b:2' end as target from customer, (values ('mysql'), ('kafka')) k(kind)")
def config_backends(t):
    return say.backends(_config(t)).select("file", "kind", "target")


@query("select c_custkey || '/application.properties' as file, 'r' || c_custkey as id, 'Path=/' || c_custkey || '/**' as predicates from customer")
def gateway_routes(t):
    return say.routes(_config(t)).select("file", "id", F.array_join("predicates", "|").alias("predicates"))


@query("select name, n * (select count(*) from customer) as n from (values ('spring.application', 1), ('server', 1), ('spring.datasource', 1), ('spring.cloud', 2), ('spring.kafka', 2), ('spring.config', 1), ('own', 1)) g(name, n)")
def config_groups(t):
    return say.property_groups(_config(t), []).select("name", "n")


@query("select c_custkey || '/application.properties' as file, 'p' as on_profile from customer")
def on_profile(t):
    return say.on_profile(_config(t)).select("file", "on_profile")


@query("select 'other.' || p_partkey as key from part where p_partkey % 2 = 0")
def undefined_keys(t):
    uses = t("part").select(F.lit("r").alias("repo"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("other."), F.col("p_partkey").cast("string"))).otherwise("spring.KAFKA.bootstrapServers").alias("key"))
    return say.undefined_uses(uses, _config(t)).select("key")


def _poms(t):
    n = t("nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string"), F.lit("/pom.xml")).alias("path"), F.concat(F.lit("<project><parent><groupId>g</groupId><artifactId>top</artifactId><version>1</version></parent><artifactId>m"), F.col("n_nationkey").cast("string"), F.lit("</artifactId><properties><own>"), F.col("n_nationkey").cast("string"), F.lit("</own></properties><dependencies><dependency><groupId>d</groupId><artifactId>a</artifactId><version>${base}.${own}</version></dependency><dependency><groupId>d</groupId><artifactId>pin</artifactId></dependency></dependencies></project>")).alias("text"))
    top = t("nation").agg(F.lit("pom.xml").alias("path"), F.concat(F.lit("<project><groupId>g</groupId><artifactId>top</artifactId><version>1</version><properties><base>b</base></properties><dependencyManagement><dependencies><dependency><groupId>d</groupId><artifactId>pin</artifactId><version>${own}</version></dependency></dependencies></dependencyManagement><modules>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<module>m"), F.col("n_nationkey").cast("string"), F.lit("</module>")))), ""), F.lit("</modules></project>")).alias("text"))
    return builds.poms(n.unionByName(top).select(F.lit("r").alias("repo"), "path", "text"))


@query("select 'm' || n_nationkey || '/pom.xml' as path, artifact_id, case artifact_id when 'a' then 'b.' || n_nationkey when 'pin' then cast(n_nationkey as varchar) else '1' end as version from nation, (values ('a'), ('pin'), ('top')) x(artifact_id)")
def pom_dependencies(t):
    return builds.resolved_dependencies(_poms(t)).select("path", "artifact_id", "version")


@query("select 'pom.xml' as path, 0 as depth union all select 'm' || n_nationkey || '/pom.xml', 1 from nation")
def module_closure(t):
    return builds.module_closure(_poms(t)).select("path", "depth")


@query("select s_suppkey, 'a' || s_suppkey as artifact_id, case when s_suppkey % 2 = 0 then '1.' || s_suppkey end as version from supplier")
def gradle_dependencies(t):
    k = F.col("s_suppkey").cast("string")
    script = F.concat(F.lit("// implementation 'no:no:1'\ndependencies { implementation 'g:a"), k, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(":1."), k)).otherwise(""), F.lit("' }"))
    found = builds.gradle_dependencies(t("supplier").select(F.lit("r").alias("repo"), k.alias("path"), script.alias("text")))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), "artifact_id", "version")


@query("select p_partkey, p_partkey % 4 in (0, 2) as kept from part")
def scan_exclusions(t):
    k = F.col("p_partkey") % 4
    path = F.concat(F.when(k == 0, "src/build/").when(k == 1, "target/").when(k == 2, "m/src/main/").otherwise("src/test/"), F.col("p_partkey").cast("string"), F.lit(".java"))
    return t("part").select("p_partkey", is_source_path(path).alias("kept"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped from pages")
def html_escape(t):
    return t("pages").select("page_id", report.html_escape(F.col("html")).alias("escaped"))


@query("select doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_{}\\[\\]()#+!|~-])', '\\\\\\1', 'g') as escaped from documents")
def md_escape(t):
    return t("documents").select("doc_id", report.md_escape(F.col("text")).alias("escaped"))



def _dealt(rows, key):
    """Only a key, dealt over all tasks: one row group of a table is read by one task, however much is made of its rows."""
    return rows.select(key).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("""select p_partkey, method as http_method, path, 'm' || i as method_name from (select p_partkey, case when p_partkey % 2 = 0 then '/p' || p_partkey else '' end as prefix from part),
 (values (0, 'GET', 1, ''), (1, 'GET', 1, ''), (2, 'POST', 0, '/a'), (3, 'GET', 0, '/late'), (4, 'PUT', 0, '/x'), (4, 'PUT', 0, '/y'), (5, 'ANY', 0, ''), (6, 'GET', 0, '/q'), (6, 'POST', 0, '/q')) c(i, method, unresolved, tail),
 lateral (select case when unresolved = 1 then '' when prefix || tail = '' then '/' else prefix || tail end as path)""")
def java_mappings(t):
    """Literals, braces, named arguments in any order, several methods; expressions and constants are unresolved."""
    k = F.col("p_partkey").cast("string")
    prefix = F.when(F.col("p_partkey") % 2 == 0, _text('@RequestMapping(path = "/p', k, '/")')).otherwise("")
    body = ['@GetMapping(BASE + "/y")', '@GetMapping(produces = "a/b", value = BASE + "/z")', '@RequestMapping(value = "/a", method = RequestMethod.POST)', '@GetMapping(produces = "application/json", path = "late")', '@PutMapping({"/x", "y/"})', "@RequestMapping", '@RequestMapping(method = {RequestMethod.GET, RequestMethod.POST}, path = "/q")']
    code = _text("@RestController ", prefix, " class C { ", " ".join(f'{b} @Deprecated(since = "1") public R<A, B> m{i}(@P("id") Long id) throws E {{ }}' for i, b in enumerate(body)), " }")
    found = java.java_classes(t("part").select(F.lit("r").alias("repo"), F.concat(k, F.lit(".java")).alias("path"), code.alias("text")))
    return found.select(F.replace("file", F.lit(".java")).cast("long").alias("p_partkey"), F.explode("endpoints").alias("e")).select("p_partkey", "e.*")


@query("""select s_suppkey, case s_suppkey % 6 when 0 then 'RepoA,Handler' when 1 then 'RepoB,RepoC' when 2 then 'RepoA,RepoD' when 3 then 'RepoC,Validator' when 4 then '' else 'RepoB' end as depends_on from supplier""")
def java_injection(t):
    """Stacked annotations, setters, constructors, Lombok; creation of an object is no constructor, and JDK types don't count."""
    bodies = [
        '@Autowired @Qualifier("x") private RepoA a; @Autowired private Map<String, List<Handler>> h;',
        'public S(@Qualifier("p(q)") final RepoB b, Map<String, List<RepoC>> m, int n) throws IOException { }',
        'private final RepoA a; private final RepoB b = new RepoB(); private static final Logger LOG = null; @NonNull protected final java.util.List<RepoD> d; private RepoC c;',
        '@Resource(name = "c") RepoC c; @Inject public void setAll(List<Validator> v, String s) { }',
        "Object make(RepoA o) { return new S(o); } Object other() { return x.S(y); }",
        "@Autowired S(S self, RepoB b) { }",
    ]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = t("supplier").select(F.lit("r").alias("repo"), F.concat("s_suppkey", F.lit(".java")).alias("path"), _text("@Service @RequiredArgsConstructor class S { ", body, " }").alias("text"))
    return java.java_classes(rows).select(F.replace("file", F.lit(".java")).cast("long").alias("s_suppkey"), F.array_join("depends_on", ",").alias("depends_on"))


@query("""select p_partkey, config_prefix, key, has_default from part, lateral (select case when p_partkey % 3 = 0 then 'shop.p' || p_partkey when p_partkey % 3 = 1 then 'plain' end as config_prefix),
 (values ('a.b', true), ('c', false)) u(key, has_default)""")
def java_config_uses(t):
    """Prefixes by name or place, none of a constant; keys of @Value once, those that begin with a placeholder."""
    k = F.col("p_partkey").cast("string")
    bound = F.when(F.col("p_partkey") % 3 == 0, _text('(prefix = "shop.p', k, '")')).when(F.col("p_partkey") % 3 == 1, '("plain")').otherwise("(prefix = NAME)")
    code = _text("@ConfigurationProperties", bound, ' record P(int a) { @Value("${a.b:x}") int x; @Value("${ c }") int y; @Value("${a.b}") int z; @Value("at ${d}") int w; @Value("#{e}") int v; /* @Value("${f}") */ }')
    found = java.java_classes(t("part").select(F.lit("r").alias("repo"), F.concat(k, F.lit(".java")).alias("path"), code.alias("text")))
    return found.select(F.replace("file", F.lit(".java")).cast("long").alias("p_partkey"), "config_prefix", F.explode("config_uses").alias("u")).select("p_partkey", "config_prefix", "u.*")


@query("""select c_custkey, doc_idx, key, value from customer, lateral (values (0, 'name', c_custkey || ''), (0, 'list[0]', 'a'), (0, 'list[1].k', c_custkey || ''), (0, 'empty', ''), (0, 'none', ''), (0, 'on', 'yes'), (0, 'oct', '12'), (0, 'whole', '1000'), (0, 'part', '0.5'),
 (1, 'base.x', '1'), (1, 'more.x', '1'), (1, 'more.y', c_custkey || ' two'), (2, 'after', 'error')) v(doc_idx, key, value)""")
def yaml_flatten(t):
    """Documents, lists, maps, numbers of YAML 1.2, anchors and merges; a document in error goes, those after it stay."""
    k = F.col("c_custkey").cast("string")
    body = _text("name: ", k, '\nlist: [a, {k: "', k, '"}]\nempty: {}\nnone: ~\non: yes\noct: 0o14\nwhole: 1e3\npart: .5\n---\nbase: &b {x: 1}\nmore:\n  <<: *b\n  y: "', k, '\\x20two"\n---\n: : [\n---\nafter: error\n')
    files = _dealt(t("customer"), "c_custkey").select(F.lit("r").alias("repo"), F.concat(k, F.lit("/application.yml")).alias("path"), F.lit("application.yml").alias("name"), F.length(body).alias("size"), body.alias("text"))
    return settings.config_properties(files).select(F.substring_index("file", "/", 1).cast("long").alias("c_custkey"), "doc_idx", "key", "value")


@query("""select c_custkey, doc_idx, key, value from customer, lateral (values (0, 'a b', 'x' || chr(9) || c_custkey), (0, 'c:d', 'A=B'), (0, 'long', 'one two ' || c_custkey), (0, 'bare', ''), (1, '#---', 'no'), (1, 'last', 'end' || chr(92))) v(doc_idx, key, value)""")
def properties_unescape(t):
    r"""Escapes in keys and values, continuation lines, separators; an indented #--- is a comment, and a backslash at the very end stays."""
    k = F.col("c_custkey").cast("string")
    body = _text("a\\ b = x\\t", k, "\n! note\nc\\:d:\\u0041=B\nlong one \\\n   two \\\n", k, "\nbare\n  #---\n#---\n\\#--- no\nlast=end\\")
    files = t("customer").select(F.lit("r").alias("repo"), F.concat(k, F.lit("/application.properties")).alias("path"), F.lit("application.properties").alias("name"), F.length(body).alias("size"), body.alias("text"))
    rows = settings.parse_settings  # the parser alone: redaction strips control characters
    kind = "c_custkey long, doc_idx int, key string, value string"

    def parsed(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(r.c_custkey, i, a, b) for r in frame.itertuples() for i, (d, _) in enumerate(rows("properties", r.text)[0]) for a, b in d], columns=["c_custkey", "doc_idx", "key", "value"]).astype({"doc_idx": "int32"})

    return files.select(F.substring_index("path", "/", 1).cast("long").alias("c_custkey"), "text").mapInPandas(parsed, kind)


def _details(t):
    k = F.col("c_custkey").cast("string")
    lines = ["spring.profiles.active[0]=a", "spring.profiles.active[1]=b", "spring.profiles.include=c", "spring.r2dbc.url=r2dbc:pool:x", "spring.kafka.bootstrap-servers[0]=h1:1", "spring.KAFKA.bootstrapServers[1]=h2:2", "spring.data.mongodb.uri[0]=mongodb://m1", "spring.data.mongodb.uri[1]=m2", "spring.elasticsearch.uris=", "spring.datasource.one.jdbc-url=jdbc:h2:mem:t;X=1", "spring.datasource.url=jdbc:mysql://[::1]:1,${H:a,b}:2/x", "spring.cloud.gateway.default-filters[0]=A=1", "spring.cloud.gateway.mvc.default-filters[0].name=B", "spring.cloud.gateway.mvc.default-filters[0].args._genkey_0=x", "spring.cloud.gateway.mvc.default-filters[1]=AddRequestHeader=X-Token, v", "spring.cloud.gateway.discovery.locator.enabled=true", "spring.config.import[0]=optional:file:x", "spring.config.import[1]=", "spring.cloud.config.uri=http://c", "spring.cloud.config.server.git.uri=http://g", "spring.cloud.config.server.git.search-locations=", "spring.cloud.config.server.git.default-label=main", "spring.cloud.config.server.git.timeout=1"]
    body = _text("server.port=", k, "\n", "\n".join(lines))
    files = _dealt(t("customer"), "c_custkey").select(F.lit("r").alias("repo"), F.concat(k, F.lit("/application.properties")).alias("path"), F.lit("application.properties").alias("name"), F.length(body).alias("size"), body.alias("text"))
    return settings.config_properties(files)


@query("""select c_custkey || '/application.properties' as file, what, place, text from customer, lateral (values ('profile', 1, 'spring.profiles.active[0]=a'), ('profile', 2, 'spring.profiles.active[1]=b'), ('profile', 3, 'spring.profiles.include=c'), ('locator', 1, 'true'),
 ('import', 1, 'optional:file:x'), ('import', 2, 'http://c'), ('server', 1, 'git.uri: http://g'), ('server', 2, 'git.default-label: main'), ('filter', 1, 'A=1'), ('filter', 2, 'B([redacted])'), ('filter', 3, 'AddRequestHeader=X-Token,[redacted]'),
 ('backend', 1, 'h2 mem:t spring.datasource.one.jdbc-url'), ('backend', 2, 'mysql [::1]:1, ${H:a,b}:2 spring.datasource.url'), ('backend', 3, 'r2dbc pool:x spring.r2dbc.url'), ('backend', 4, 'mongodb m1,m2 spring.data.mongodb.uri'), ('backend', 5, 'kafka h1:1,h2:2 spring.kafka.bootstrap-servers')) v(what, place, text)""")
def config_details(t):
    """Profiles, imports, server settings, the filters of two lists, and backends whose lists mix spellings, each in its order."""
    rows = settled(_details(t), "details")
    parts = [
        ("profile", say.profile_settings(rows), ["ord"], F.concat_ws("=", "key", "value")),
        ("locator", say.scalars(rows).where("discovery_locator is not null"), ["file"], F.col("discovery_locator")),
        ("import", say.config_imports(rows), ["ord"], F.col("value")),
        ("server", say.config_server(rows), ["ord"], F.col("text")),
        ("filter", say.default_filters(rows), ["at", "ord"], F.col("text")),
        ("backend", say.backends(rows), ["ord"], F.concat_ws(" ", "kind", "target", "key")),
    ]
    out = None
    for what, df, order, text_ in parts:
        one = df.select("file", F.lit(what).alias("what"), F.row_number().over(Window.partitionBy("file").orderBy(*order)).alias("place"), text_.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select 'C' || p_partkey as name, 'p' || p_partkey as config_prefix from part where p_partkey % 3 <> 0 and p_partkey % 500 <> 0")
def undefined_prefixes(t):
    """A prefix is defined by a key that is it or stands below it, whatever the case and hyphens."""
    k = F.col("p_partkey").cast("string")
    classes = t("part").select(F.lit("r").alias("repo"), k.alias("file"), F.concat(F.lit("C"), k).alias("name"), F.concat(F.lit("p"), k).alias("config_prefix"))
    keys = t("part").where("p_partkey % 3 = 0").select(F.lit("r").alias("repo"), F.concat(F.lit("P-"), k, F.lit(".x")).alias("key")).union(t("part").where("p_partkey % 500 = 0").select(F.lit("r"), F.concat(F.lit("p_"), k)))
    return say.undefined_prefixes(classes, keys).select("name", "config_prefix")


@query("""select c_custkey, place, value, redacted from customer, lateral (values (1, '${DB_PASS}', false), (2, '', false), (3, '[redacted]', true), (4, 'jdbc:oracle:thin:u' || c_custkey || '/[redacted]@h:1', true), (5, 'u:[redacted]@h' || c_custkey || ':9092,x:[redacted]@g:1', true),
 (6, 'a [redacted] b', true), (7, 'key-' || c_custkey, false), (8, '[redacted] [redacted]', true), (9, '"api-key"=[redacted]', true), (10, 'http://h:8080/x@y', false), (11, rpad('z' || c_custkey || '-', 300, 'z') || '…', false)) v(place, value, redacted)""")
def redact_values(t):
    k = F.col("c_custkey").cast("string")
    pairs = [("db.password", F.lit("${DB_PASS}")), ("auth", F.lit("")), ("x.token", k), ("url", _text("jdbc:oracle:thin:u", k, "/p", k, "@h:1")), ("hosts", _text("u:p", k, "@h", k, ":9092,x:y@g:1")), ("note", _text("a ghp_", F.lpad(k, 24, "0"), " b")), ("name", _text("key-", k)), ("ids", _text("xoxb-", F.lpad(k, 12, "0"), " glpat-", F.lpad(k, 16, "0"))), ("json", _text('"api-key": "', k, '"')), ("at", F.lit("http://h:8080/x@y")), ("long", F.rpad(_text("z", k, "-"), 400, "z"))]
    each = F.posexplode(F.array(*(F.struct(F.lit(a).alias("key"), b.alias("value")) for a, b in pairs))).alias("at", "p")
    safe = redact.redact_value(F.col("p.key"), F.col("p.value")).alias("safe")
    return _dealt(t("customer"), "c_custkey").select("c_custkey", each).select("c_custkey", (F.col("at") + 1).alias("place"), safe).select("c_custkey", "place", "safe.value", "safe.redacted")


@query("""select s_suppkey, case s_suppkey % 3 when 0 then 'X-Api-Key|[redacted]|[redacted]' when 1 then 'name=X-Auth|value=[redacted]|[redacted]' else 'X-Trace|v' || s_suppkey end as args from supplier""")
def redact_route_arguments(t):
    k = F.col("s_suppkey").cast("string")
    args = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("X-Api-Key"), k, F.lit("b c"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("name=X-Auth"), F.concat(F.lit("value="), k), F.lit("b c"))).otherwise(F.array(F.lit("X-Trace"), F.concat(F.lit("v"), k)))
    return t("supplier").select("s_suppkey", F.array_join(redact.redact_route_args(args), "|").alias("args"))


@query("select s_suppkey, 'a' || s_suppkey as artifact_id, '<' || s_suppkey || '>' as version from supplier union all select s_suppkey, 'last', null from supplier")
def pom_views(t):
    """Comments, profiles, build and exclusions are no dependencies; CDATA is text."""
    k = F.col("s_suppkey").cast("string")
    dep = lambda a, more="": _text("<dependency><groupId>g</groupId><artifactId>", a, "</artifactId>", more, "</dependency>")
    xml = _text("<project><artifactId>x</artifactId><!-- <dependencies>", dep("no"), "</dependencies> --><dependencies>", dep(_text("a", k), _text("<version><![CDATA[<", k, ">]]></version>")), dep("last", "<exclusions><exclusion><groupId>g</groupId><artifactId>no</artifactId></exclusion></exclusions>"), "</dependencies><build><plugins><plugin><dependencies>", dep("no"), "</dependencies></plugin></plugins></build><profiles><profile><dependencies>", dep("no"), "</dependencies></profile></profiles></project>")
    found = builds.poms(t("supplier").select(F.lit("r").alias("repo"), k.alias("path"), xml.alias("text")))
    plain = lambda c: F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), F.explode("dependencies").alias("d")).select("s_suppkey", "d.artifact_id", plain(F.col("d.version")).alias("version"))


@query("select s_suppkey, 'spring-boot-gradle-plugin' as artifact_id, case when s_suppkey % 2 = 0 then '2.' || s_suppkey else '${boot}' end as version, 'advisory' as severity, s_suppkey % 2 = 1 as unresolved from supplier")
def gradle_boot_plugin(t):
    k = F.col("s_suppkey").cast("string")
    version = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("2."), k)).otherwise("${boot}")
    script = F.when(F.col("s_suppkey") % 4 < 2, _text("plugins { id 'org.springframework.boot' version '", version, "' }")).otherwise(_text('plugins {\n id("org.springframework.boot") version "', version, '"\n // id("org.springframework.boot") version "9"\n}'))
    found = builds.risk_findings(builds.gradle_dependencies(t("supplier").select(F.lit("r").alias("repo"), k.alias("path"), script.alias("text"))))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), "artifact_id", "version", "severity", versions.is_unresolved_version(F.col("version")).alias("unresolved"))


@query("select l_orderkey, l_linenumber, cast(sign(l_suppkey % 3 - 1) as integer) as c from lineitem")
def version_compare_long(t):
    """Numbers beyond any fixed width count, and zeros at the end don't."""
    nine = F.concat(F.lit("1.0.0.0.0.0.0.0.0."), (F.col("l_suppkey") % 3).cast("string"), F.lit(".0.0-x"))
    return t("lineitem").select("l_orderkey", "l_linenumber", versions.compare_versions(nine, F.lit("1.0.0.0.0.0.0.0.0.1")).alias("c"))


@query("select 'K' || n_nationkey as name, term, cast(tf as double) as tf from nation, (values ('widget', 3.0), ('controller', 8.0), ('endpoint', 4.0), ('look', 4.0), ('rest', 2.0), ('stor', 1.5), ('put', 5.0)) v(term, tf)")
def class_field_weights(t):
    """Fields of a class weigh differently, and a word of its body counts three times at most."""
    k = F.concat(F.lit("K"), F.col("n_nationkey").cast("string"))
    empty = F.array().cast("array<string>")
    ends = F.array(F.struct(F.lit("PUT").alias("http_method"), F.lit("/look").alias("path"), F.lit("x").alias("method_name")))
    rows = t("nation").select(k.alias("doc_id"), k.alias("name"), F.lit("controller").alias("kind"), F.lit("K.java").alias("file"), F.array(F.lit("RestController")).alias("annotations"), ends.alias("endpoints"), F.array(F.lit("Store")).alias("depends_on"), F.lit("widget widgets Widget widget widget put").alias("raw_body"), empty.alias("none"))
    tf = search.term_frequencies(search.class_fields(rows))
    return tf.select(F.col("doc_id").alias("name"), "term", "tf")


@query("select r_name, case when n > 8 then first || ' (+' || (n - 8) || ' more)' else first end as names from (select r_name, count(*) as n, array_to_string(list_sort(list(c_name))[1:8], ', ') as first from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name)")
def capped_lists(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(report.capped(F.array_sort(F.collect_list("c_name"))).alias("names"))
