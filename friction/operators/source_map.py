"""Routes and frameworks of a code base, from a table of its files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.functions.tables import spread

#: Folders that hold routes, how a file in them becomes one, and the endings that count, in order of precedence.
ROUTE_FOLDERS = (
    ("pages", "file", (".vue", ".js", ".ts")),
    ("src/pages", "file", (".vue", ".js", ".ts")),
    ("src/routes", "file", (".svelte", ".js", ".ts")),
    ("routes", "file", (".svelte",)),
    ("src/pages", "file", (".astro", ".md", ".mdx")),
    ("content", "content", (".md", ".html")),
    ("_posts", "content", (".md", ".markdown", ".html")),
    ("_pages", "content", (".md", ".html")),
    ("src", "content", (".njk", ".liquid", ".md")),
    ("source", "content", (".html", ".erb", ".md")),
)
#: How much a kind of evidence says.
EVIDENCE = {"package-dep": 0.55, "config-file": 0.4, "file-extension": 0.25, "script": 0.1}


def let(value: Column, made) -> Column:
    """made(value), the value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def route_of(inside: Column, ending: Column, mode: Column) -> Column:
    """Route of a file by its path inside a route folder; null if it is none."""
    folder = F.regexp_replace(F.regexp_extract(inside, r"^(.*/)?[^/]*$", 1), r"(^|/)\([^/]*\)(?=/)", "$1")
    name = F.regexp_extract(inside, r"([^/]*)$", 1)

    def routed(base: Column) -> Column:
        routable = F.when(mode == "content", F.lit(True)).otherwise(~F.coalesce(base.startswith("_") | (base.startswith("+") & (base != "+page")), F.lit(False)))
        slot = F.concat(F.lit(":"), F.replace(F.regexp_extract(base, r"^\[(.*)\]$", 1), F.lit("..."), F.lit("*")))
        leaf = let(F.when((mode == "file") & base.rlike(r"^\[.*\]$"), slot).otherwise(base), lambda b: F.when((b == "index") | ((mode == "file") & (b == "+page")), F.lit("")).otherwise(b))
        path = F.regexp_replace(F.concat(F.lit("/"), folder, leaf), r"/+", "/")
        path = F.regexp_replace(F.regexp_replace(path, r"\[\.\.\.([^\]]+)\]", r"*$1"), r"\[([^\]]+)\]", r":$1")
        return F.when(routable, let(path, lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))))

    hidden = inside.rlike(r"(^|/)(\.|node_modules/)")
    return F.when(~hidden, let(F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ending)), routed))


def file_routes(files: DataFrame) -> DataFrame:
    """repo, route, parent, path: one row for each route of each repo. files: repo, path.

    The first folder of the list wins a route, then the smaller path."""
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d + "/").alias("folder"), F.lit(m).alias("mode"), F.array(*map(F.lit, x)).alias("endings")) for i, (d, m, x) in enumerate(ROUTE_FOLDERS)])
    rows = spread(files.select("repo", "path")).select("repo", "path", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ending"), F.explode(listed).alias("c"))
    rows = rows.where(F.col("path").startswith(F.col("c.folder")) & F.array_contains("c.endings", F.col("ending")))
    inside = F.substring("path", F.char_length("c.folder") + 1, F.char_length("path"))
    # a generator, so that no filter on the route makes it anew
    rows = rows.select("repo", "path", "c.rank", F.explode(F.array_compact(F.array(route_of(inside, F.col("ending"), F.col("c.mode"))))).alias("route"))
    best = rows.groupBy("repo", "route").agg(F.min(F.struct("rank", "path")).alias("b"))
    up = F.regexp_replace("route", r"/[^/]*$", "")
    return best.select("repo", "route", F.when(F.col("route") != "/", F.when(up == "", "/").otherwise(up)).alias("parent"), "b.path")


def frameworks(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """repo, framework, confidence, rank, primary: what the evidence of each repo speaks for.

    evidence: repo, kind (a key of EVIDENCE), value; registry: framework, kind, value, priority, build_tool. A kind
    of evidence counts once for each value; independent pieces multiply the doubt. The first that is no build tool is
    primary, else the first."""
    weight = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])[F.col("kind")]
    hits = evidence.select("repo", "kind", "value").distinct().join(registry, ["kind", "value"])
    g = hits.groupBy("repo", "framework").agg(F.exp(F.sum(F.log(1 - weight))).alias("doubt"), F.max("priority").alias("priority"), F.bool_or("build_tool").alias("build_tool"))
    g = g.withColumn("confidence", F.round(F.least(F.lit(0.99), 1 - F.col("doubt")), 6))
    order = [F.desc("confidence"), F.desc("priority"), F.asc("framework")]
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    first = F.row_number().over(Window.partitionBy("repo").orderBy("build_tool", "rank"))
    return g.select("repo", "framework", "confidence", "rank", (first == 1).alias("primary"))


#: What a route is by its place, in order of precedence: folder, convention.
CONVENTIONS = (("app", "app"), ("src/app", "app"), ("pages", "pages"), ("src/pages", "pages"), ("app/routes", "flat"))
#: What tells that a route needs a login, folders that are no sources, endings of sources.
AUTH = r"(?i)\bauth\s*\(\s*\)|getServerSession|currentUser|requireAuth|redirect.*sign-?in"
SKIPPED = ("node_modules", ".next", ".nuxt", ".svelte-kit", ".git", ".cache", ".parcel-cache", ".turbo", "dist", "build", "out", "coverage", "public", "static")
TEMPLATES = (".html", ".htm", ".vue", ".svelte", ".astro", ".marko", ".liquid", ".erb", ".njk", ".hbs", ".mustache", ".pug", ".ejs", ".twig", ".jinja", ".j2", ".md", ".mdx", ".razor", ".cshtml", ".py", ".ex", ".heex", ".leex", ".eex")
SCRIPTS = (".tsx", ".ts", ".jsx", ".js", ".mjs")


def conventional_routes(files: DataFrame) -> DataFrame:
    """repo, route, path, convention, and what else files has: routes of repos (files: repo, path, ...) by the first convention of CONVENTIONS that finds any.

    app: a page file names its folder, groups in parentheses left out. pages: each file but those that begin with _. flat:
    dots part segments, $ marks a parameter, index files name nothing."""
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d + "/").alias("folder"), F.lit(m).alias("mode")) for i, (d, m) in enumerate(CONVENTIONS)])
    more = [c for c in files.columns if c not in ("repo", "path")]
    rows = files.select("repo", "path", *more, F.explode(listed).alias("c")).where(F.col("path").startswith(F.col("c.folder")))
    inside = F.substring("path", F.char_length("c.folder") + 1, F.char_length("path"))
    rows = rows.select("repo", "path", *more, "c.rank", F.col("c.mode").alias("convention"), inside.alias("inside")).where(~F.col("inside").rlike(r"(^|/)(\.|node_modules/)"))
    folder, name = F.regexp_extract("inside", r"^(?:(.*)/)?[^/]*$", 1), F.regexp_extract("inside", r"([^/]*)$", 1)
    base, script = F.regexp_replace(name, r"\.(t|j)sx?$", ""), name.rlike(r"\.(t|j)sx?$")
    bare = F.array_join(F.filter(F.split(folder, "/"), lambda x: (x != "") & ~(x.startswith("(") & x.endswith(")"))), "/")
    segments = F.transform(F.split(base, r"\."), lambda x: F.when(x.startswith("$"), F.concat(F.lit(":"), F.when(x == "$", "param").otherwise(F.substring(x, F.lit(2), F.char_length(x))))).otherwise(x))
    route = (
        F.when((F.col("convention") == "app") & name.rlike(r"^page\.(t|j)sx?$"), F.concat(F.lit("/"), bare))
        .when((F.col("convention") == "pages") & script & ~name.startswith("_"), F.concat(F.lit("/"), folder, F.lit("/"), F.when(base == "index", "").otherwise(base)))
        .when((F.col("convention") == "flat") & script, F.concat(F.lit("/"), F.array_join(F.filter(segments, lambda x: ~x.isin("_index", "index")), "/")))
    )
    rows = rows.withColumn("route", F.regexp_replace(route, "/+", "/")).where("route is not null")
    first = rows.groupBy("repo").agg(F.min("rank").alias("best"))
    return rows.join(first, "repo").where("rank = best").select("repo", "route", "path", "convention", *more)


def route_metadata(routes: DataFrame) -> DataFrame:
    """routes (repo, route, path, source) with title (of the metadata it exports, else its first h1), description, sections,
    params and auth_required."""
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    block = F.regexp_extract("source", r"export\s+const\s+metadata\s*[:=][^\{]*\{([\s\S]*?)\}", 1)
    stated = lambda key: F.nullif(F.regexp_extract(block, key + r"""\s*:\s*['"`]([^'"`]+)['"`]""", 1), F.lit(""))
    heads = F.transform(F.regexp_extract_all("source", F.lit(r"(?i)<h(?:2|3)[^>]*>([\s\S]*?)</h(?:2|3)>"), F.lit(1)), lambda h: F.substring(plain(h), 1, 120))
    h1 = F.substring(plain(F.regexp_extract("source", r"(?i)<h1[^>]*>([\s\S]*?)</h1>", 1)), 1, 200)
    params = F.regexp_extract_all("route", F.lit(r":([a-zA-Z_]\w*)"), F.lit(1))
    return routes.select("repo", "route", "path", F.coalesce(stated("title"), h1).alias("title"), stated("description").alias("description"), F.slice(F.filter(heads, lambda h: h.isNotNull()), 1, 12).alias("sections"), params.alias("params"), F.coalesce(F.col("source").rlike(AUTH), F.lit(False)).alias("auth_required"))


def source_files(files: DataFrame) -> DataFrame:
    """repo, path, kind (`template` or `script`) of the files that are read for elements: none of a skipped folder, no tests
    and no type declarations among scripts."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    skipped = F.array_size(F.array_intersect(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))) > 0
    aside = F.col("path").rlike(r"\.(test|spec)\.[a-z]+$") | F.col("path").endswith(".d.ts")
    kind = F.when(ending.isin(*TEMPLATES), "template").when(ending.isin(*SCRIPTS) & ~aside, "script")
    return files.select("repo", "path", kind.alias("kind")).where(~skipped & F.col("kind").isNotNull())


def source_tree(spark, root: str, glob: str | None = None, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """The files below a folder of repositories, root/<repo>/...: repo, path, source of those up to a size; and repo, path,
    bytes of those beyond it, which are reported instead of read. glob: of file names, such as *.vue.

    Listing and reading are Spark's; the text of a file that is left out never leaves the disk."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    inside = F.regexp_extract("path", r"^(?:[a-z]+:/*)?/" + re.escape(root.split(":", 1)[-1].strip("/")) + r"/(.*)$", 1)
    files = files.withColumn("inside", inside).withColumn("repo", F.regexp_extract("inside", r"^([^/]+)/", 1))
    files = files.withColumn("path", F.substring("inside", F.char_length("repo") + 2, F.char_length("inside")))
    kept = files.where(F.col("length") <= most_bytes).select("repo", "path", F.decode("content", "UTF-8").alias("source"))
    return kept, files.where(F.col("length") > most_bytes).select("repo", "path", F.col("length").alias("bytes"))
