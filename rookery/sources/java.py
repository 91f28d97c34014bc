"""Java sources to classes, endpoints, injection edges and configuration uses.

Lexing is the one imperative step: a Python table function per file, Arrow-batched. It works on two views of equal length, the text
without comments and the same with literals blanked; structure is read on the second, values on the first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Annotations that give a class its kind.
KINDS = {
    "RestController": "controller",
    "Controller": "controller",
    "ControllerAdvice": "advice",
    "RestControllerAdvice": "advice",
    "Service": "service",
    "Repository": "repository",
    "Entity": "entity",
    "MappedSuperclass": "entity",
    "Embeddable": "entity",
    "Configuration": "configuration",
    "SpringBootApplication": "configuration",
    "Component": "component",
    "Aspect": "component",
    "ConfigurationProperties": "configuration",
}
# Interfaces that make an interface a repository.
DATA_TYPES = "Repository CrudRepository ListCrudRepository PagingAndSortingRepository ListPagingAndSortingRepository JpaRepository MongoRepository ReactiveCrudRepository ReactiveMongoRepository R2dbcRepository ElasticsearchRepository JpaSpecificationExecutor".split()
# Mapping annotations and their methods.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ANY"}
# Type names that are no dependencies.
IGNORED = "String int long double float boolean char byte short void Integer Long Double Float Boolean Character Byte Short Object List Map Set Optional Collection ArrayList HashMap HashSet Logger extends super final".split()

LEXEME = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|\'(?:\\.|[^\'\\\n])*(?:\'|(?=\n)|\Z)', re.S)
MAPPING = re.compile(rf"@({'|'.join(MAPPINGS)})\b")
DECLARATION = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
ANNOTATION = re.compile(r"@([A-Za-z_][\w.]*)")
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "strictfp"}
FIELD_MODIFIERS = {"public", "private", "protected", "static", "final", "transient", "volatile"}
LITERAL = re.compile(r'"((?:\\.|[^"\\])*)"')
NAME = re.compile(r"[A-Za-z_$][\w$.]*")
BLANKS = re.compile(r"\s*")


def two_views(text: str) -> tuple[str, str]:
    """The text without comments, and that with the insides of literals blanked; both as long as the text, line breaks kept."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    bare, masked, at = [], [], 0
    for m in LEXEME.finditer(text):
        bare.append(text[at : m.start()])
        masked.append(text[at : m.start()])
        found = m[0]
        if found[0] == "/":
            bare.append(blank(found))
            masked.append(blank(found))
        else:
            mark = '"""' if found.startswith('"""') else found[0]
            shut = mark if len(found) >= 2 * len(mark) and found.endswith(mark) else ""
            bare.append(found)
            masked.append(mark + blank(found[len(mark) : len(found) - len(shut)]) + shut)
        at = m.end()
    return "".join([*bare, text[at:]]), "".join([*masked, text[at:]])


class Source:
    """One file in both views, with the partner of each bracket and the annotations by where they end, each found in one pass."""

    def __init__(self, text: str):
        self.bare, self.masked = two_views(text)
        self.partner: dict[int, int] = {}
        for pair in ("()", "{}"):
            opened: list[int] = []
            for m in re.finditer(f"[{re.escape(pair)}]", self.masked):
                if m[0] == pair[0]:
                    opened.append(m.start())
                elif opened:
                    self.partner[opened.pop()] = m.start()
        self.ends: dict[int, tuple[int, str, str]] = {}
        for m in ANNOTATION.finditer(self.masked):
            stop, args = m.end(), ""
            after = self.skip_blanks(stop)
            if self.masked[after : after + 1] == "(" and (shut := self.closing(after)) < len(self.masked):
                args, stop = self.bare[after + 1 : shut], shut + 1
            self.ends[stop] = (m.start(), m[1], args)

    def closing(self, opened: int) -> int:
        """Place of the bracket that closes the one at opened; the end of the text without one."""
        return self.partner.get(opened, len(self.masked))

    def skip_blanks(self, at: int) -> int:
        return BLANKS.match(self.masked, at).end()

    def before(self, at: int) -> int:
        """The end of what stands before at, blanks left out."""
        while at > 0 and self.masked[at - 1].isspace():
            at -= 1
        return at

    def word_before(self, at: int) -> str:
        start = at
        while start > 0 and (self.masked[start - 1].isalnum() or self.masked[start - 1] == "_"):
            start -= 1
        return self.masked[start:at]

    def annotations_before(self, at: int) -> list[tuple[str, str]]:
        """(name, arguments) of the unbroken run of annotations and then modifiers that ends at a keyword, in order."""
        at = self.before(at)
        while (word := self.word_before(at)) in MODIFIERS:
            at = self.before(at - len(word))
        out: list[tuple[str, str]] = []
        while at in self.ends:
            start, name, args = self.ends[at]
            out.append((name, args.strip()))
            at = self.before(start)
        return out[::-1]

    def past_annotations(self, at: int, modifiers: bool) -> int:
        """The first place from at that is no blank, annotation or (if asked) modifier."""
        while True:
            at = self.skip_blanks(at)
            if (m := ANNOTATION.match(self.masked, at)) and m[1] != "interface":
                after = self.skip_blanks(m.end())
                at = min(self.closing(after) + 1, len(self.masked)) if self.masked[after : after + 1] == "(" else m.end()
            elif modifiers and (m := re.compile(r"[A-Za-z]+(?![\w$])").match(self.masked, at)) and m[0] in MODIFIERS:
                at = m.end()
            else:
                return at


def mapping_args(args: str) -> tuple[list[str], list[str], bool]:
    """(paths, methods, unresolved) of a mapping annotation's arguments.

    Only a literal, or braces, right at the start or right after value= or path= names paths; another expression there is unresolved.
    """
    methods = re.findall(r"RequestMethod\.(\w+)", args)
    value = re.compile(r'\{[^}]*\}|"(?:\\.|[^"\\])*"')
    named = [m.end() for m in re.finditer(r"\b(?:value|path)\s*=\s*", args)]
    plain = bool(args.strip()) and not re.match(r"\s*\w+\s*=", args)
    found = next((v for at in named if (v := value.match(args, at))), None) or (value.match(args, BLANKS.match(args).end()) if plain else None)
    paths = LITERAL.findall(found[0]) if found else []
    return paths, methods, not paths and (plain or bool(named))


def split_top(text: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p for p in [*out, text[start:]] if p.strip()]


def type_names(expression: str) -> list[str]:
    return [n.split(".")[-1] for n in NAME.findall(expression)]


def _parameter_types(source: Source, start: int, end: int) -> list[str]:
    """Type names of the parameters between two places: of each, all but its own name, annotations and final."""
    out, at = [], start
    for part in split_top(source.masked[start:end]):
        first = source.past_annotations(source.masked.index(part, at, end), False)
        at = source.masked.index(part, at, end) + len(part)
        kind = re.sub(r"^(?:final\s+(?:@\w[\w.]*\s+)*)+", "", source.masked[first:at].strip())
        out += type_names(re.sub(r"\s*[\w$]+\s*$", "", kind))
    return out


def injected(source: Source, start: int, end: int, name: str, annotations: list[str]) -> list[str]:
    """Type names that the class with the body from start to end takes: marked members, its own constructors, then Lombok's final fields."""
    masked, out = source.masked, []
    for m in re.compile(r"@(?:Autowired|Inject|Resource)\b").finditer(masked, start, end):
        after = source.skip_blanks(m.end())
        head = source.past_annotations(source.closing(after) + 1 if masked[after : after + 1] == "(" else m.end(), True)
        stop = re.compile(r"[;({=]").search(masked, head, end)
        if not stop:
            continue
        member = masked[head : stop.start()]
        if ")" in member or len(split_top(member)) > 1:
            continue  # it marks a parameter
        if stop[0] == "(":
            out += _parameter_types(source, stop.end(), min(source.closing(stop.start()), end))
        elif stop[0] != "{":
            out += type_names(re.sub(r"\s*[\w$]+\s*$", "", member))
    for m in re.compile(rf"\b{re.escape(name)}\s*\(").finditer(masked, start, end):
        before = source.before(m.start())
        shut = source.closing(m.end() - 1)
        if masked[before - 1 : before] != "." and source.word_before(before) != "new" and re.compile(r"\s*(?:throws\s[\w.$,\s]+)?\{").match(masked, shut + 1, end):
            out += _parameter_types(source, m.end(), shut)
    if "RequiredArgsConstructor" in annotations:
        pieces = re.split(r"([;{}()=@])", masked[start:end])
        for piece, mark in zip(pieces[::2], pieces[1::2], strict=False):
            tokens = piece.split()
            first = next((i for i, t in enumerate(tokens) if t in FIELD_MODIFIERS), len(tokens))
            last = next((i for i in range(first, len(tokens)) if tokens[i] not in FIELD_MODIFIERS), len(tokens))
            rest = " ".join(tokens[last:])
            if mark == ";" and "final" in tokens[first:last] and "static" not in tokens[first:last] and re.fullmatch(r"[\w.$]+(?: ?<.*>)? [\w$]+", rest):
                out += type_names(rest.rpartition(" ")[0])
    return list(dict.fromkeys(out))


def joined_path(prefix: str, path: str) -> str:
    return "/" + "/".join(p for p in (prefix.strip("/"), path.strip("/")) if p)


def _handler(source: Source, at: int, end: int) -> str:
    """Name of the method declared from at on."""
    at = source.past_annotations(at, False)
    stop = re.compile(r"[({};]").search(source.masked, at, end)
    m = re.search(r"([A-Za-z_$][\w$]*)\s*$", source.masked[at : stop.start()]) if stop and stop[0] == "(" else None
    return m[1] if m else "(unknown)"


def value_uses(body: str) -> list[dict]:
    """Keys of @Value annotations whose literal begins with a placeholder, each once, and whether it has a default."""
    uses: dict[str, bool] = {}
    for m in re.finditer(r'@Value\s*\(\s*"([^"]*)"\s*\)', body):
        inside, shut, _ = m[1].removeprefix("${").partition("}")
        key, default, _ = inside.partition(":")
        key = key.lstrip() if default else key.strip()
        if m[1].startswith("${") and shut and key.rstrip() and not re.search(r"\s", key.rstrip()):
            uses.setdefault(key.rstrip(), bool(default))
    return [{"key": k, "has_default": d} for k, d in uses.items()]


def parse_java(text: str) -> list[dict]:
    """The classes with a role in Spring, in order of declaration; nested ones too."""
    source = Source(text)
    bare, masked = source.bare, source.masked
    out = []
    for m in DECLARATION.finditer(masked):
        keyword, name = m[1], m[2]
        if keyword == "record" and not re.match(r"\s*(?:<[^>{}]*>)?\s*\(", masked[m.end() : m.end() + 200]):
            continue
        opened = masked.find("{", m.start())
        if opened < 0:
            continue
        shut = source.closing(opened)
        marks = source.annotations_before(m.start())
        short = [n.split(".")[-1] for n, _ in marks]
        kind = next((KINDS[n] for n in short if n in KINDS), "other")
        if kind == "other" and keyword == "interface":
            extends = re.search(r"\bextends\b", masked[m.start() : opened])
            kind = "repository" if extends and {*re.findall(r"[A-Za-z_$][\w$]*", masked[m.start() + extends.end() : opened])} & {*DATA_TYPES} else kind
        if kind == "other":
            continue
        body = bare[opened + 1 : shut]
        prefixes, _, unresolved = next((mapping_args(a) for (_, a), n in zip(marks, short, strict=True) if n == "RequestMapping"), ([], [], False))
        prefix = prefixes[0] if prefixes else ""
        endpoints = []
        if kind == "controller":
            at = opened + 1
            while e := MAPPING.search(masked, at, shut):
                at = e.end()
                after, args = source.skip_blanks(at), ""
                if masked[after : after + 1] == "(":
                    end = min(source.closing(after), shut)
                    args, at = bare[after + 1 : end], end + 1
                paths, methods, lost = mapping_args(args)
                methods = (methods or ["ANY"]) if e[1] == "RequestMapping" else [MAPPINGS[e[1]]]
                handler = _handler(source, at, shut)
                endpoints += [{"http_method": method, "path": "" if lost or unresolved else joined_path(prefix, path), "method_name": handler} for method in methods for path in paths or [""]]
        bound = next((a for (_, a), n in zip(marks, short, strict=True) if n == "ConfigurationProperties"), None)
        config = re.match(r'\s*(?:(?:prefix|value)\s*=\s*)?"([^"]*)"', bound) if bound is not None else None
        depends = [d for d in injected(source, opened + 1, shut, name, short) if d != name and d not in IGNORED]
        out.append({"ord": len(out), "name": name, "kind": kind, "annotations": [n for n, _ in marks], "endpoints": endpoints, "depends_on": depends, "raw_body": body.strip(), "config_prefix": config[1] if config else None, "config_uses": value_uses(body)})
    return out


CLASS_SCHEMA = "repo string, file string, ord int, name string, kind string, annotations array<string>, endpoints array<struct<http_method:string,path:string,method_name:string>>, depends_on array<string>, raw_body string, config_prefix string, config_uses array<struct<key:string,has_default:boolean>>"


def java_classes(files: DataFrame) -> DataFrame:
    """files(repo, path, text) -> one row for each class with a role; depends_on holds all candidate type names."""

    def parsed(frames):
        for frame in frames:
            rows = [{"repo": r.repo, "file": r.path, **c} for r in frame.itertuples() for c in parse_java(r.text or "")]
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in re.split(r", (?=\w+ )", CLASS_SCHEMA)])

    return files.where(F.endswith("path", F.lit(".java"))).select("repo", "path", "text").mapInPandas(parsed, CLASS_SCHEMA)


def resolved(classes: DataFrame) -> DataFrame:
    """depends_on cut to names of classes of the same repository: a semi-join on simple names, order kept."""
    known = classes.select("repo", F.col("name").alias("target")).distinct()
    edges = classes.select("repo", "file", "ord", F.posexplode("depends_on").alias("at", "target")).join(known, ["repo", "target"], "left_semi")
    listed = edges.groupBy("repo", "file", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda e: e["target"]).alias("known"))
    return classes.join(listed, ["repo", "file", "ord"], "left").withColumn("depends_on", F.coalesce("known", F.array().cast("array<string>"))).drop("known").select(*classes.columns)


def endpoints(classes: DataFrame) -> DataFrame:
    return classes.select("repo", "file", F.col("name").alias("class_name"), F.posexplode("endpoints").alias("ord", "e")).select("repo", "file", "class_name", "ord", "e.*")


def di_edges(classes: DataFrame) -> DataFrame:
    return classes.select("repo", "file", F.col("name").alias("class_name"), F.posexplode("depends_on").alias("ord", "target"))


def used_by(classes: DataFrame) -> DataFrame:
    """repo, name, user: reverse edges, a class's own left out."""
    return di_edges(classes).where("class_name <> target").select("repo", F.col("target").alias("name"), F.col("class_name").alias("user")).distinct()
