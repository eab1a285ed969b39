"""Repositories as tables: a pruned walk, file classes, bounded text, ignore rules, changes and coverage.

A walk lists metadata only; contents are read for files that stay and are small enough."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scanlattice.functions.shipping import ship

TEXT_LIMIT = 2 * 1024 * 1024
# Directories that hold no authored sources, by name, and by parent and name.
PRUNED = """.git .hg .svn target node_modules bower_components jspm_packages vendor deps third_party third-party thirdparty 3rdparty 3rd-party singleheader single-header
pods .pnpm-store .cache .next .nuxt _nuxt .output .nitro .vinxi .vite .vite-temp .quasar .docusaurus .react-router .astro _astro .svelte-kit .angular .parcel-cache .turbo .venv venv .tox .nox site-packages __pycache__ .gradle .nuget coverage storybook-static playwright-report blob-report dist build out obj""".split()
PRUNED_BELOW = ("_next/static", ".vitepress/cache", ".vuepress/.temp", ".yarn/cache", ".yarn/unplugged", ".yarn/sdks", ".yarn/releases", ".nx/cache", ".nx/workspace-data")
# Classes of extensions.
LANGUAGES = {
    "c": "c", "cpp": "h hh hpp hxx cc cpp cxx c++", "csharp": "cs", "razor": "cshtml razor", "webforms": "aspx ascx", "java": "java", "kotlin": "kt kts", "javascript": "js jsx mjs cjs", "typescript": "ts mts cts", "tsx": "tsx",
    "embedded_template": "ejs", "vue": "vue", "python": "py pyi py3 pyw", "go": "go", "rust": "rs", "php": "php phtml php5 php7 php8",
    "secret_only": "json json5 yaml yml toml ini cfg conf config properties xml env tf tfvars hcl md markdown txt sql graphql sh bash zsh ps1 pug hbs",
    "unsupported_source": "as rb scala swift ex exs dart lua sol",
}
# Path components of code that is not shipped, their beginnings and ends.
TEST_NAMES = """test tests libtest libtests unit_test unit_tests unit-test unit-tests unittest unittests integration_test integration_tests integration-test integration-tests test_utils test_crates __tests__ __specs__
spec specs e2e e2e-tests e2e_tests end-to-end end_to_end fixture fixtures testdata example examples sample samples benches benchmark benchmarks fuzz oss-fuzz __mocks__ migrations""".split()
NAMESPACES = ("sample", "samples", "example", "examples")
TEST_EDGES = r"^(test_|test-|test\.)|(_test|_tests|-test|-tests|\.test|\.tests)$"
# File names of tests and generated sources, lower-cased, and those whose case counts.
TEST_FILES = (
    r"\.(spec|test|specs|tests|e2e|e2e-spec|e2e-test|integration-spec|unit-spec)\.|_test\.go$|^(test|tests)\.rs$|_tests?\.rs$|^test_.*\.pyw?$|_test\.pyw?$|^(tests|conftest)\.py$|^test.*\.java$"
    r"|\.generated\.(kt|php|cs)$|\.d\.(ts|mts|cts)$|\.(min|bundle)\.[mc]?js|\.pb\.go$|\.designer\.cs$|\.g\.cs$"
)
TEST_FILES_CASED = r"Tests?\.(java|kt|cs|php)$"
KOTLIN_SETS = "common jvm android ios iosarm64 iosx64 iossimulatorarm64 js wasmjs wasmwasi native apple linux linuxx64 linuxarm64 macos macosx64 macosarm64 mingwx64 watchos tvos".replace(" ", "|")
_CODE = [k for k in LANGUAGES if k not in ("secret_only", "unsupported_source")]


def extension(path: Column) -> Column:
    """What follows the last dot of a name that does not begin there, lower-cased; else empty."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_excluded(path: Column) -> Column:
    """Whether a path is of tests, samples or generated sources by its components or its name."""
    parts, low = F.split(F.lower(path), "/"), F.lower(path)
    kotlin = extension(path).isin("kt", "kts")
    kotlin_test = kotlin & low.rlike(rf"(^|/)src/((?:{KOTLIN_SETS})test|androidunittest|androidinstrumentedtest)/kotlin(/|$)")
    # Below a production source root of the JVM, sample and example are name spaces.
    main = rf"(?:^|.*?/)src/main/(?:kotlin|java)/", rf"(?:^|.*?/)src/(?:main|(?:{KOTLIN_SETS})main)/(?:kotlin|java)/"
    below = F.when(kotlin, F.regexp_extract(low, f"^{main[1]}(.*)$", 1)).otherwise(F.regexp_extract(low, f"^{main[0]}(.*)$", 1))
    free = F.size(parts) - F.when(below != "", F.size(F.split(below, "/"))).otherwise(0)
    hit = F.exists(F.transform(parts, lambda p, i: (p.isin([n for n in TEST_NAMES if n not in NAMESPACES]) | p.rlike(TEST_EDGES)) | (p.isin(list(NAMESPACES)) & (i < free))), lambda x: x)
    route = low.startswith("src/app/") & F.element_at(parts, -1).rlike(r"^route\.(js|jsx|ts|tsx)$")
    return kotlin_test | (hit & ~route) | F.lower(_name(path)).rlike(TEST_FILES) | _name(path).rlike(TEST_FILES_CASED)


def classify(path: Column, include_nonproduction: bool = False, ignored_names: tuple[str, ...] = ()) -> Column:
    """Class of a path by its name, then its extension: a language, a template kind, secret_only,
    unsupported_source or ignored. Sources that are not shipped are secret_only unless asked for."""
    name, ext = F.lower(_name(path)), extension(path)
    out = F.lit("ignored")
    for kind, list_ in LANGUAGES.items():
        out = F.when(ext.isin(list_.split()), F.lit(kind)).otherwise(out)
    if not include_nonproduction:
        out = F.when(out.isin(_CODE) & is_excluded(path), F.lit("secret_only")).otherwise(out)
    named = (name == ".env") | name.startswith(".env.") | name.isin("dockerfile", "containerfile")
    return F.when(name.isin(list(ignored_names)), "ignored").when(named, "secret_only").otherwise(out)


def reason(path: Column, kind: Column) -> Column:
    """Why a path is not analysed as code; null if it is."""
    return (
        F.when(kind.isin(_CODE), F.lit(None))
        .when(kind == "secret_only", F.when(is_excluded(path), "test or generated source"))
        .when(kind == "unsupported_source", "language is not enabled")
        .when(_name(path).isin(".gitignore", ".ignore"), "ignore configuration")
        .when(extension(path) == "csproj", "project manifest")
        .otherwise("no source file")
    )


def is_generated_javascript(path: Column, text: Column) -> Column:
    """Bundles without a telling name: 64 KiB or more, a line of 32 KiB or more, and a source map or .prod. name."""
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.octet_length(F.regexp_replace(x, r"\r$", ""))))
    marked = text.contains("sourceMappingURL=") | F.lower(_name(path)).rlike(r"\.prod\.[mc]?js")
    return extension(path).isin("js", "jsx", "mjs", "cjs") & (F.octet_length(text) >= 65536) & (longest >= 32768) & marked


def pruned_at(path: Column) -> Column:
    """The shallowest directory of a path that is not entered, with a slash; null if there is none."""
    parts = F.split(path, "/")
    low = F.transform(parts, lambda p: F.lower(p))
    last = F.size(parts) - 1
    hits = F.transform(low, lambda p, i: F.when((i < last) & (p.isin(PRUNED) | ((i > 0) & F.concat_ws("/", F.get(low, i - 1), p).isin(list(PRUNED_BELOW)))), i + 1))
    first = F.array_min(hits)
    return F.when(first.isNotNull(), F.concat(F.array_join(F.slice(parts, 1, first), "/"), F.lit("/")))


def selection(path: str) -> str:
    """A path inside the root, with slashes; ValueError for any other."""
    path = path.replace("\\", "/")
    if path.startswith("/") or ":" in path or ".." in path.split("/"):
        raise ValueError("a selected path must stay inside the root")
    return path.strip("/")


def _is_pruned(parent: str, name: str) -> bool:
    return name.lower() in PRUNED or f"{parent}/{name}".lower() in PRUNED_BELOW


class _List:
    """mapInArrow function over (folder): every file below each, hidden ones too. Folders that are not entered are
    a row with a slash behind the path; links are not followed and have no length."""

    def __init__(self, root: str, prune: bool):
        self.root, self.prune = root, prune

    def __call__(self, batches):
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(self.root)
        local = isinstance(filesystem, fs.LocalFileSystem)
        for batch in batches:
            open_ = [f for f in batch.column("folder").to_pylist()]
            out = []
            while open_:
                folder = open_.pop()
                for x in filesystem.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                    path = f"{folder}/{x.base_name}" if folder else x.base_name
                    if local and os.path.islink(x.path):
                        out.append((path, None))
                    elif x.type == fs.FileType.File:
                        out.append((path, x.size))
                    elif self.prune and _is_pruned(folder.rsplit("/", 1)[-1], x.base_name):
                        out.append((path + "/", None))
                    else:
                        open_.append(path)
                if len(out) > 8192:
                    yield _paths(out)
                    out = []
            yield _paths(out)


def _paths(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "length"])


def listing(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """(path, uri, length) of every file below root, a URI; contents are not read. Folders of the first level
    are listed by tasks of their own. Spark's own file sources leave hidden files out, so they are not used."""
    from pyarrow import fs

    ship(spark)
    root = root.rstrip("/")
    filesystem, base = fs.FileSystem.from_uri(root)
    first = filesystem.get_file_info(fs.FileSelector(base))
    local = isinstance(filesystem, fs.LocalFileSystem)
    folders = [x.base_name for x in first if x.type == fs.FileType.Directory and not (local and os.path.islink(x.path))]
    files = [(x.base_name, None if local and os.path.islink(x.path) else x.size) for x in first if x.base_name not in folders]
    files += [(f + "/", None) for f in folders if prune and _is_pruned("", f)]
    enter = [(f,) for f in folders if not (prune and _is_pruned("", f))]
    rows = spark.createDataFrame(files, "path string, length long")
    if enter:
        dealt = spark.createDataFrame(enter, "folder string").repartition(min(len(enter), 4096))
        rows = rows.unionByName(dealt.mapInArrow(_List(root, prune), "path string, length long"))
    return rows.select("path", F.concat(F.lit(root + "/"), "path").alias("uri"), "length")


def walk(files: DataFrame, selected: str | None = None, include_nonproduction: bool = False, ignored_names: tuple[str, ...] = (), rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """listing -> (files with class and reason, pruned directories). selected: one relative file or
    directory, tested on the listing. rules: those of ignore files; what they ignore is not listed.

    A `.git` file or folder is no input at all; other pruned directories are recorded once each."""
    if selected is not None:
        own = selection(selected)
        files = files.where((F.col("path") == own) | F.col("path").startswith(own + "/"))
    files = files.where(~F.lower("path").rlike(r"(^|/)\.git(/|$)")).withColumn("pruned", pruned_at(F.col("path")))
    kept = files.where("pruned is null").drop("pruned")
    if rules is not None:
        kept = kept.join(ignored(kept.select("path"), rules), "path", "left_anti")
    kind = classify(F.col("path"), include_nonproduction, ignored_names)
    kept = kept.withColumn("class", kind).withColumn("reason", reason(F.col("path"), F.col("class")))
    return kept, files.where("pruned is not null").select(F.col("pruned").alias("path")).distinct()


def ignore_rules(texts: DataFrame) -> DataFrame:
    """(path, text) of ignore files -> directory, line, pattern (a regular expression on paths below the
    directory), negated, folders_only. The syntax is that of .gitignore."""
    lines = texts.where(_name(F.col("path")).isin(".gitignore", ".ignore")).select(F.regexp_replace("path", "[^/]*$", "").alias("directory"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    raw = F.regexp_replace("raw", r"(?<!\\)\s+$", "")
    lines = lines.withColumn("raw", raw).where("raw != '' and not startswith(raw, '#')")
    lines = lines.withColumn("negated", F.col("raw").startswith("!")).withColumn("raw", F.regexp_replace("raw", r"^!|^\\(?=[!#])", ""))
    lines = lines.withColumn("folders_only", F.col("raw").endswith("/")).withColumn("raw", F.regexp_replace("raw", "/$", ""))
    anchored = F.col("raw").contains("/")
    body = F.regexp_replace("raw", "^/", "")
    quoted = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"(^|/)\*\*/", "$1\u0001"), r"/\*\*$", "/\u0002"), r"\*+", "[^/]*")
    glob = F.replace(F.replace(F.regexp_replace(marked, r"\?", "[^/]"), F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".+"))
    return lines.select("directory", "line", F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), F.regexp_replace(glob, r"\[!", "[^"), F.lit("$")).alias("pattern"), "negated", "folders_only")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths that ignore rules leave out: the last rule that matches a path or a folder above it decides, and
    nothing below an ignored folder comes back. Rules join on the directory that they are for."""
    parts = F.split("path", "/")
    each = paths.select("path", F.posexplode(F.transform(parts, lambda p, i: F.array_join(F.slice(parts, 1, i + 1), "/"))).alias("n", "own"), (F.size(parts) - 1).alias("last"))
    above = each.select("path", "own", (F.col("n") < F.col("last")).alias("folder"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.concat(F.array_join(F.slice(F.split("own", "/"), 1, k), "/"), F.when(k > 0, "/").otherwise("")))).alias("directory"))
    met = above.join(rules, "directory").where((F.col("folder") | ~F.col("folders_only")) & F.expr("substring(own, length(directory) + 1) rlike pattern"))
    decided = met.groupBy("path", "own").agg(F.max_by("negated", F.struct(F.length("directory"), "line")).alias("negated"))
    return decided.where(~F.col("negated")).select("path").distinct()


def looks_binary(content: Column) -> Column:
    """A zero byte, or more than one control byte other than line ends and tabs in a hundred."""
    latin = F.decode(content, "ISO-8859-1")
    controls = F.length(latin) - F.length(F.regexp_replace(latin, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    return latin.contains("\x00") | ((controls > 0) & (controls * 100 > F.greatest(F.length(content), F.lit(1))))


def bounded_text(rows: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """rows(content, length) with text and skipped: text is null where skipped says why not."""
    large = F.col("length") > limit
    valid = F.expr("is_valid_utf8(cast(content as string))")
    why = F.when(large, F.format_string("size limit exceeded: %d bytes is greater than %d", F.col("length"), F.lit(limit))).when(looks_binary(F.col("content")), "binary content").when(~valid, "not UTF-8")
    return rows.withColumn("skipped", why).withColumn("text", F.when(F.col("skipped").isNull(), F.col("content").cast("string"))).drop("content")


class _Read:
    """mapInArrow function over (uri, length): contents of files within the limit, in batches of bounded size."""

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, batches):
        from pyarrow import fs

        for batch in batches:
            out, held = [], 0
            for uri, length in zip(batch.column("uri").to_pylist(), batch.column("length").to_pylist()):
                content, error = None, None
                if length is not None and length <= self.limit:
                    try:
                        filesystem, path = fs.FileSystem.from_uri(uri)
                        with filesystem.open_input_file(path) as f:
                            content = f.read(self.limit + 1)
                    except OSError as e:
                        error = f"could not be read: {type(e).__name__}"
                out.append((uri, content, error))
                held += len(content or b"")
                if held >= 8 << 20:
                    yield self._batch(out)
                    out, held = [], 0
            yield self._batch(out)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["uri", "content", "error"])


def read_texts(files: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """files(path, uri, length) with text and skipped. Larger files are never opened; what cannot be read or is no
    UTF-8 text is a row with the reason."""
    ship(files.sparkSession)
    content = files.select("uri", "length").mapInArrow(_Read(limit), "uri string, content binary, error string")
    out = bounded_text(files.join(content, "uri", "left"), limit)
    return out.withColumn("skipped", F.coalesce("error", "skipped", F.when(F.col("length").isNull(), "not a regular file"))).drop("error")


def coverage(files: DataFrame, secrets_enabled: bool = False) -> DataFrame:
    """files(path, class, skipped, parse_failed) -> path, language, status."""
    code = F.col("class").isin(_CODE)
    status = (
        F.when(code & F.coalesce("parse_failed", F.lit(False)), "parse_failed").when(code, "scanned").when(F.col("class") == "unsupported_source", "unsupported")
        .when((F.col("class") == "secret_only") & F.lit(secrets_enabled), F.when(F.col("skipped").isNull(), "secret_scanned").otherwise("secret_skipped")).otherwise("ignored")
    )
    return files.select("path", F.when(code, F.col("class")).alias("language"), status.alias("status"), F.col("class"), F.col("skipped"))


def totals(covered: DataFrame) -> DataFrame:
    """One row: discovered and the number of files of each status."""
    names = ("scanned", "ignored", "unsupported", "parse_failed", "secret_scanned", "secret_skipped")
    return covered.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def omitted_by_extension(covered: DataFrame, secrets_enabled: bool = False) -> DataFrame:
    """(extension, non_source, secret_scan_disabled, unsupported_source) of files left out of the scan."""
    kind = F.col("class")
    rows = covered.withColumn("extension", F.coalesce(F.nullif(extension(F.col("path")), F.lit("")), F.lit("(none)")))
    out = rows.groupBy("extension").agg(F.count_if(kind == "ignored").alias("non_source"), F.count_if((kind == "secret_only") & F.lit(not secrets_enabled)).alias("secret_scan_disabled"), F.count_if(kind == "unsupported_source").alias("unsupported_source"))
    return out.where("non_source + secret_scan_disabled + unsupported_source > 0")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots (path, text) -> path, status, previous_path, changed_lines. A file that is new
    and has the text of one that is gone is renamed; changed_lines are runs of the new text's lines that the
    old text lacks (as many times), as (low, high); none for a deletion."""
    digest = lambda s: F.sha2(F.coalesce(f"{s}_text", F.lit("")), 256)
    b, a = (x.select("path", F.col("text").alias(f"{s}_text"), F.lit(True).alias(f"in_{s}")) for x, s in ((before, "b"), (after, "a")))
    both = b.join(a, "path", "full")
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "deleted").when(F.col("b_text").eqNullSafe(F.col("a_text")), "unchanged").otherwise("modified")
    rows = both.withColumn("status", status).where("status != 'unchanged'")
    gone = rows.where("status = 'deleted'").groupBy(digest("b").alias("h")).agg(F.min("path").alias("previous_path"))
    new = rows.where("status = 'added'").withColumn("h", digest("a"))
    first = new.groupBy("h").agg(F.min("path").alias("path"))
    moved = first.join(gone, "h").select("path", "previous_path")
    rows = rows.join(moved, "path", "left").join(moved.select(F.col("previous_path").alias("path"), F.lit(True).alias("left_here")), "path", "left").where("left_here is null")
    rows = rows.withColumn("status", F.when(F.col("previous_path").isNotNull(), "renamed").otherwise(F.col("status")))
    ranges = line_ranges(rows.where("status in ('modified', 'added')"))
    return rows.select("path", "status", "previous_path").join(ranges, "path", "left").withColumn("changed_lines", F.coalesce("changed_lines", F.array().cast("array<struct<low:int,high:int>>")))


def line_ranges(rows: DataFrame) -> DataFrame:
    """(path, b_text, a_text) -> path, changed_lines: lines of a_text beyond those that b_text has, joined to runs."""
    numbered = lambda s: rows.where(f"{s}_text is not null").select("path", F.posexplode(F.split(f"{s}_text", "\n")).alias("n", "value")).withColumn("k", F.row_number().over(Window.partitionBy("path", "value").orderBy("n")))
    fresh = numbered("a").join(numbered("b").select("path", "value", "k"), ["path", "value", "k"], "left_anti")
    run = fresh.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("path").orderBy("n")))
    spans = run.groupBy("path", "run").agg((F.min("n") + 1).alias("low"), (F.max("n") + 1).alias("high"))
    return spans.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("changed_lines"))


def changed_list(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """An explicit list of changes as a table, checked: statuses are known, paths stay inside, ranges are in order."""
    out = []
    for r in rows:
        ranges = [(int(a), int(b)) for a, b in r.get("changed_lines", [])]
        if r["status"] not in ("added", "modified", "deleted", "renamed") or any(not 0 < a <= b for a, b in ranges):
            raise ValueError(f"not a change: {r}")
        out.append((selection(r["path"]), r["status"], r.get("previous_path"), ranges))
    return spark.createDataFrame(out, "path string, status string, previous_path string, changed_lines array<struct<low:int,high:int>>")
