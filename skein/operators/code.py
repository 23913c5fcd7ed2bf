"""Call graphs, endpoints, entities, rules, flows and services of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds that can be called, names that say nothing.
CALLABLE = ("function", "class", "method", "const")
BUILTINS = ("len", "str", "int", "list", "dict", "set", "map", "print", "range", "open", "type", "super")


def call_sites(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """caller, callee, callee_file, line: a line of a file that names a symbol before an opening bracket.

    symbols (path, name, kind, line), files (path, content). Lines are cut into identifiers once and joined by name, so
    no symbol is tried on every file; of symbols of one name the last by path and line counts. The line of a definition
    in its own file is no call.
    """
    good = symbols.where(F.col("kind").isin(*CALLABLE) & (F.length("name") >= 3) & ~F.col("name").isin(*BUILTINS))
    last = good.groupBy("name").agg(F.max(F.struct("path", "line", "kind")).alias("d"))
    defined = last.select("name", F.col("d.path").alias("callee_file"), F.col("d.line").alias("at"))
    lines = files.select(F.col("path").alias("caller"), F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    named = lines.select("caller", "line", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))).alias("name"))
    calls = named.join(defined, "name").where((F.col("caller") != F.col("callee_file")) | (F.col("line") != F.col("at")))
    return calls.select("caller", F.col("name").alias("callee"), "callee_file", "line")


def call_summary(calls: DataFrame) -> DataFrame:
    """callee, calls, callers (sorted distinct files)."""
    return calls.groupBy("callee").agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("caller")), ",").alias("callers"))


def mermaid(calls: DataFrame, least: int = 1) -> DataFrame:
    """Lines of a Mermaid flow chart: file to file with the number of calls."""
    edges = calls.groupBy("caller", "callee_file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return edges.select(F.concat(F.lit('  "'), "caller", F.lit('" -->|'), F.col("n").cast("string"), F.lit('| "'), "callee_file", F.lit('"')).alias("line"))


VERBS = "get|post|put|patch|delete"
# Lines that open a route, by patterns of our own.
ROUTE_ANCHORS = [rf"@\w+\.(?:{VERBS}|route)\s*\(", rf"\b(?:app|router|bp)\.(?:{VERBS})\s*\(", r"\.add_url_rule\s*\(", r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE)\b", r"export\s+const\s+(?:GET|POST|PUT|PATCH|DELETE)\s*="]
# Forms of a route in the order in which they are tried, with the groups of method and route (0: none).
ROUTES = [
    (r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH)\s*\(", 1, 0),
    (r"export\s+const\s+(GET|POST|PUT|DELETE|PATCH)\s*=", 1, 0),
    (r"""\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 1, 2),
    (r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 1, 2),
    (r"""@app\.route\s*\(\s*['"]([^'"]+)['"].*methods\s*=\s*\[['"](\w+)""", 2, 1),
    (r"""@app\.route\s*\(\s*['"]([^'"]+)['"]""", 0, 1),
    (r"""@\w+\.route\s*\(\s*['"]([^'"]+)['"].*methods\s*=\s*[\[\(]['"](\w+)""", 2, 1),
    (r"""@\w+\.route\s*\(\s*['"]([^'"]+)['"]""", 0, 1),
    (r"""\.add_url_rule\s*\(\s*['"]([^'"]+)['"].*methods\s*=\s*[\[\(]['"]?(\w+)""", 2, 1),
    (r"""\.add_url_rule\s*\(\s*['"]([^'"]+)['"]""", 0, 1),
]
CONTEXT_LINES = 5


def endpoints(files: DataFrame) -> DataFrame:
    """path, line, method, route: routes that decorators, calls or exported handlers open, by the first form of ROUTES that
    the line and those behind it, up to the next such line, show; without a method GET, without a route the one of the
    file's place."""
    from skein.functions.text import route_of_file

    opens = "|".join(f"(?:{p})" for p in ROUTE_ANCHORS)
    lines = files.where(F.col("content").rlike(opens)).select("path", F.split("content", "\n").alias("lines"))
    opening = lines.select("path", "lines", F.posexplode("lines").alias("line", "text")).where(F.col("text").rlike(opens))
    behind = F.slice("lines", F.col("line") + 2, F.lit(CONTEXT_LINES - 1))
    next_ = F.array_position(F.transform(behind, lambda x: x.rlike(opens)), F.lit(True))
    own = F.when(next_ > 0, F.slice(behind, F.lit(1), next_.cast("int") - 1)).otherwise(behind)
    shown = opening.select("path", (F.col("line") + 1).alias("line"), F.array_join(F.concat(F.array("text"), own), "\n").alias("text"))
    picked = lambda group, default: F.coalesce(*[F.when(F.col("text").rlike("(?is)" + p), F.regexp_extract("text", "(?is)" + p, g[group]) if g[group] else default) for p, *g in ROUTES])
    method = F.upper(F.coalesce(picked(0, F.lit("GET")), F.nullif(F.regexp_extract("text", rf"(?i)\b({VERBS})\b", 1), F.lit(""))))
    place = route_of_file(F.col("path"))
    return shown.select("path", "line", method.alias("method"), F.coalesce(F.nullif(picked(1, place), F.lit("")), place, F.lit("/unknown")).alias("route")).where("method is not null")


# Names of field types in schema calls and in columns of mapped classes.
FIELD_TYPES = {"serial": "serial", "varchar": "string", "text": "text", "integer": "integer", "boolean": "boolean", "timestamp": "timestamp", "uuid": "uuid", "Integer": "integer", "String": "string", "Text": "text", "Boolean": "boolean", "DateTime": "datetime"}
#: Where an entity's body lies, with the groups of its name and its fields' names and types.
ENTITY_FORMS = [
    (r"(?ms)^class \w+\((?:Base|Model|BaseModel|db\.Model)\):\n(?:[ \t]+[^\n]*\n?)+", r"class (\w+)", r"(?m)^[ \t]+(\w+)\s*:\s*(\w+)"),
    (r"(?ms)^class \w+\((?:Base|Model|BaseModel|db\.Model)\):\n(?:[ \t]+[^\n]*\n?)+", r"class (\w+)", r"(?m)^[ \t]+(\w+)\s*=\s*(?:db\.)?Column\s*\(\s*(?:db\.)?(Integer|String|Text|Boolean|DateTime)\b"),
    (r"""(?s)\b(?:pg|mysql|sqlite)Table\s*\(\s*["']\w+["']\s*,\s*\{.*?\n?\}\s*\)""", r"""Table\s*\(\s*["'](\w+)""", r"(\w+)\s*:\s*(serial|varchar|text|integer|boolean|timestamp|uuid)\s*\("),
]


def entities(files: DataFrame) -> DataFrame:
    """entity, path, fields (name:type, as written): classes on a base, by annotations or columns, and tables of schema
    calls; the first of a name wins."""
    types = F.create_map(*[F.lit(x) for pair in FIELD_TYPES.items() for x in pair])
    found = []
    for form, (body, name, field) in enumerate(ENTITY_FORMS):
        each = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(body), F.lit(0))).alias("body"))
        known = lambda t: F.coalesce(F.element_at(types, t), t)
        fields = F.zip_with(F.regexp_extract_all("body", F.lit(field), F.lit(1)), F.regexp_extract_all("body", F.lit(field), F.lit(2)), lambda n, t: F.concat(n, F.lit(":"), known(t)))
        found.append(each.select(F.regexp_extract("body", name, 1).alias("entity"), "path", F.lit(form).alias("form"), F.array_join(fields, ",").alias("fields")))
    # Tables are named as their rows would be.
    tables = found[2].withColumn("entity", F.concat(F.upper(F.substring("entity", 1, 1)), F.expr("substring(entity, 2)")))
    named = found[0].unionByName(found[1]).unionByName(tables).where("fields <> ''")
    return named.groupBy("entity").agg(F.min(F.struct("path", "form", "fields")).alias("x")).select("entity", "x.path", "x.fields")


# Signs of business rules and of side effects, any of which shows the rule or the effect.
RULES = {
    "validate uniqueness": [r"findUnique\s*\(", r"\.exists\s*\(", r"count\s*\(\s*\)\s*[=><!]=\s*0", r"unique.*constraint", r"already.?exists", r"duplicate.*entry"],
    "hash password securely": [r"bcrypt\.(hash|compare)", r"argon2\.", r"hashPassword", r"verifyPassword", r"password.*hash"],
    "verify authorization": [r"isAdmin", r"hasPermission", r"canAccess", r"requireAuth", r"checkAuth", r"session\?\.", r"currentUser"],
    "apply rate limiting": [r"rateLimit", r"throttle", r"tooManyRequests", r"429"],
    "soft delete (preserve record)": [r"deletedAt", r"isDeleted", r"softDelete", r"\.update.*deleted"],
    "validate input": [r"\.parse\s*\(", r"validate\w*\s*\(", r"safeParse", r"ValidationError"],
    "return 404 if not found": [r"404", r"not.?found", r"NotFoundError", r"if\s*\(\s*!\s*\w+\s*\)"],
}
EFFECTS = {
    "email": [r"sendEmail", r"mailer\.", r"resend\.", r"nodemailer", r"smtp", r"EmailService"],
    "stripe": [r"stripe\.", r"PaymentIntent", r"Subscription", r"Customer.*stripe", r"createCheckout"],
    "webhook": [r"webhook", r"\.post\s*\(\s*['\"]https?://", r"fetch\s*\(\s*['\"]https?://", r"axios\.(post|put)"],
    "queue": [r"\.add\s*\(\s*['\"]", r"enqueue", r"publish\s*\(", r"emit\s*\("],
    "s3": [r"s3\.", r"S3Client", r"putObject", r"getSignedUrl", r"uploadFile"],
}


def labels(files: DataFrame, groups: dict[str, list[str]], name: str) -> DataFrame:
    """path with the sorted labels of which its content shows a pattern, in any case."""
    any_of = lambda patterns: "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    shown = F.array_compact(F.array(*[F.when(F.col("content").rlike(any_of(ps)), F.lit(g)) for g, ps in sorted(groups.items())]))
    return files.select("path", F.array_join(shown, ",").alias(name)).where(F.col(name) != "")


def flows(calls: DataFrame, starts: DataFrame, depth: int = 10) -> DataFrame:
    """start, file, depth: files that are reached from a start file through calls, with the least number of steps."""
    steps = calls.select(F.col("caller").alias("file"), F.col("callee_file").alias("next")).where("file <> next").distinct()
    seen = now = starts.select(F.col("path").alias("start"), F.col("path").alias("file"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        new = now.join(steps, "file").select("start", F.col("next").alias("file")).distinct().join(seen, ["start", "file"], "left_anti")
        now = new.withColumn("depth", F.lit(d))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen


def application(files: DataFrame) -> DataFrame:
    """kind (entity, endpoint), name, path, detail of all files: what an application consists of, in one table."""
    e = entities(files).select(F.lit("entity").alias("kind"), F.col("entity").alias("name"), "path", F.col("fields").alias("detail"))
    r = endpoints(files).where("route is not null").select(F.lit("endpoint").alias("kind"), F.concat_ws(" ", "method", "route").alias("name"), "path", F.concat(F.lit("line "), F.col("line").cast("string")).alias("detail"))
    return e.unionByName(r)


def markdown(app: DataFrame, order: str | None = "name") -> DataFrame:
    """One line of Markdown for each row of application(), by name, by path or unsorted."""
    app = app if order is None else app.orderBy("kind", order)
    return app.select(F.concat(F.lit("- **"), "name", F.lit("** ("), "kind", F.lit(", "), "path", F.lit("): "), "detail").alias("line"))


def services(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """service, confidence of signals (service, weight): the strongest, and a tenth for each further one, at most 0.2."""
    bonus = F.least(F.lit(0.1) * (F.count("*") - 1), F.lit(0.2))
    out = signals.groupBy("service").agg(F.round(F.least(F.lit(1.0), F.max("weight") + bonus), 6).alias("confidence"), F.count("*").alias("signals"))
    return out.where(F.col("confidence") >= least)


def components(manifest: DataFrame, lock: DataFrame, registry: DataFrame) -> DataFrame:
    """name, version, kind: dependencies (name, spec, ord), the first of a name, with locked versions and known kinds."""
    first = manifest.groupBy("name").agg(F.min_by("spec", "ord").alias("spec"))
    return first.join(lock.select("name", "locked"), "name", "left").join(registry, "name", "left").select("name", F.coalesce("locked", "spec").alias("version"), F.coalesce("kind", F.lit("library")).alias("kind"))


def stack_hash(parts: DataFrame) -> DataFrame:
    """One row: sixteen hex digits of the sorted name@version lines. A stack is a few hundred rows."""
    line = F.concat("name", F.lit("@"), "version")
    return parts.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 16).alias("stack_hash"))


def turn_ids(lines: DataFrame) -> DataFrame:
    """lines (session, ord, role) with turn: how many user lines came up to here in the session."""
    upto = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("turn_id", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto).cast("long"))


#: Lines of an entity's window at most.
ENTITY_LINES = 50
# Lines at the left margin that open a definition, and those of them that open an entity, with the group of its name.
DEFINITION = r"^(?:export\s+|abstract\s+|async\s+)*(?:class|def|function|const|let|model|enum|interface|type|struct|fn|@Entity)\b"
ENTITY = r"^(?:export\s+)?(?:class\s+(\w+)|const\s+(\w+)\s*=\s*(?:(?:pg|mysql|sqlite)Table|z\.object)\b|model\s+(\w+)\s*\{)"
# Fields of five families of schemas, with the group of the type; that of the name is 1.
SCHEMA_FIELDS = {
    "drizzle": [(r"(\w+):\s*(serial|varchar|text|integer|boolean|timestamp|uuid)\s*\(", 2)],
    "sqlalchemy": [(r"(\w+)\s*=\s*(?:db\.)?Column\s*\(\s*(?:db\.)?(Integer|String|Text|Boolean|DateTime)\b", 2)],
    "pydantic": [(r"(\w+):\s*(str|int|bool|float|list|dict)\s*(?:=|\[|$|\n)", 2)],
    "zod": [(r"(\w+):\s*z\.(string|number|boolean|array|object)\s*\(", 2)],
    "prisma": [(r"(\w+)[ \t]+(String|Int|Boolean|DateTime|Float)(?:\s|$|\?)", 2)],
}
# Names of the types of all families.
SCHEMA_TYPES = {"varchar": "string", "Integer": "integer", "String": "string", "Text": "text", "Boolean": "boolean", "DateTime": "datetime", "str": "string", "int": "integer", "bool": "boolean", "list": "array", "dict": "object", "Int": "integer", "Float": "float"}
# Forms of a relation in the order in which they count, with its type.
RELATIONS = [
    (r"Column\s*\([^)]*ForeignKey\s*\(\s*[\"'](\w+)\.", "belongs_to"),
    (r"\w+[ \t]+([A-Z]\w+)\[\]", "has_many"),
    (r"\w+[ \t]+([A-Z]\w+)[ \t]+@relation", "belongs_to"),
    (r"@OneToMany\s*\(\s*\(\)\s*=>\s*(\w+)", "has_many"),
    (r"@ManyToOne\s*\(\s*\(\)\s*=>\s*(\w+)", "belongs_to"),
    (r"@ManyToMany\s*\(\s*\(\)\s*=>\s*(\w+)", "many_to_many"),
    (r"relationship\s*\(\s*[\"'](\w+)[\"']", "has_many"),
]


def entity_windows(files: DataFrame) -> DataFrame:
    """path, line, entity, body: every definition of an entity with its lines up to the next definition at the margin.

    Lines of a file are numbered islands that begin at such definitions; a file is the unit of the window.
    """
    lines = files.where(F.col("content").rlike("(?m)" + ENTITY)).select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = lines.withColumn("island", F.sum(F.when(F.col("text").rlike(DEFINITION), 1).otherwise(0)).over(upto)).where("island > 0")
    each = islands.groupBy("path", "island").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows"))
    own = F.slice(F.transform("rows", lambda r: r["text"]), 1, ENTITY_LINES)
    name = F.concat(*[F.regexp_extract(F.element_at("rows", 1)["text"], ENTITY, g) for g in (1, 2, 3)])
    pascal = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return each.select("path", (F.col("at") + 1).alias("line"), pascal.alias("entity"), F.array_join(own, "\n").alias("body")).where("entity <> ''")


def entity_fields(windows: DataFrame) -> DataFrame:
    """entity, path, family, fields (name:type, in the order of the text) of windows that show fields of a family."""
    types = F.create_map(*[F.lit(x) for pair in SCHEMA_TYPES.items() for x in pair])
    found = []
    for family, forms in SCHEMA_FIELDS.items():
        for pattern, group in forms:
            pairs = F.zip_with(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), F.regexp_extract_all("body", F.lit(pattern), F.lit(group)), lambda n, t: F.concat(n, F.lit(":"), F.coalesce(F.element_at(types, t), t)))
            found.append(F.struct(F.lit(family).alias("family"), F.array_join(pairs, ",").alias("fields")))
    return windows.select("entity", "path", F.inline(F.array(*found))).where("fields <> ''")


def entity_relations(windows: DataFrame) -> DataFrame:
    """entity, path, type, target of what windows relate to; of several relations to a target the first form's counts."""

    def named(i: int, kind: str):
        return lambda x: F.struct(F.lit(i).alias("form"), F.lit(kind).alias("type"), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))).alias("target"))

    forms = [F.transform(F.regexp_extract_all("body", F.lit(p), F.lit(1)), named(i, kind)) for i, (p, kind) in enumerate(RELATIONS)]
    each = windows.select("entity", "path", "line", F.inline(F.concat(*forms)))
    return each.groupBy("path", "line", "entity", "target").agg(F.min(F.struct("form", "type")).alias("x")).select("entity", "path", "x.type", "target")
