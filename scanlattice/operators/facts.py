"""Facts about sources and pages beside their trees: build symbols, conditional lines, literals, URL prefixes,
provenance, imported compiler facts, embedded scripts, gates and admission."""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanlattice.functions.shipping import ship

# --- build symbols ---------------------------------------------------------------------------------


def compile_commands(spark: SparkSession, text: str, root: str = "") -> DataFrame:
    """A compilation database as (path, directory, language, symbols): -D sets a symbol (to false with =0), -U unsets
    it, the later one counts. ValueError for what is no database."""
    try:
        commands = json.loads(text)
        assert isinstance(commands, list)
    except (json.JSONDecodeError, AssertionError) as e:
        raise ValueError("not a compilation database") from e
    rows = []
    for c in commands:
        words = list(c.get("arguments") or re.findall(r'(?:[^\s"]|"[^"]*")+', c.get("command", "")))
        path = c["file"] if c["file"].startswith("/") else f"{c.get('directory', '.')}/{c['file']}"
        path = _inside(path, root)
        language = "c" if path.endswith(".c") or "-xc" in words else "cpp" if re.search(r"\.(cc|cpp|cxx|c\+\+)$", path) else None
        if language:
            rows.append((path, path.rpartition("/")[0], language, _symbols(words)))
    return spark.createDataFrame(rows, "path string, directory string, language string, symbols map<string,boolean>")


def _inside(path: str, root: str) -> str:
    parts: list[str] = []
    for p in path.removeprefix(root.rstrip("/") + "/").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return "/".join(parts)


def _symbols(words: list[str]) -> dict[str, bool]:
    out: dict[str, bool] = {}
    for at, w in enumerate(words):
        flag, body = w[:2], w[2:] or (words[at + 1] if at + 1 < len(words) else "")
        name, sign, value = body.partition("=")
        if flag == "-D" and name:
            out[name] = not (sign and value.strip('"') in ("0", "false"))
        elif flag == "-U" and name:
            out[name] = False
    return out


# Calls of build files that define symbols.
_DEFINES = re.compile(r"(?:(?:add_definitions|add_compile_definitions|add_project_arguments)\s*\(|target_compile_definitions\s*\(\s*\S+)([^)]*)\)|(?:defines|copts|local_defines)\s*=\s*\[([^\]]*)\]")


def build_profiles(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Build files (path, text) of CMake, Meson and Bazel as (directory, symbols): what they define outside conditions."""
    rows = []
    for path, text in files:
        text = re.sub(r"#[^\n]*", "", text)
        text = re.sub(r"(?is)\bif\s*\(.*?\bendif\s*\([^)]*\)|\bif\b.*?\bendif\b|select\(\{.*?\}\)", "", text)
        words = []
        for m in _DEFINES.finditer(text):
            for w in re.findall(r"""[^\s,'"]+(?:="[^"]*")?""", m[1] or m[2] or ""):
                if w not in ("PRIVATE", "PUBLIC", "INTERFACE") and re.match(r"(-[DU])?[A-Za-z_]\w*(=|$)", w):
                    words.append(w if w[:2] in ("-D", "-U") else "-D" + w)
        rows.append((path.rpartition("/")[0], _symbols(words)))
    return spark.createDataFrame(rows, "directory string, symbols map<string,boolean>")


def build_symbols(files: DataFrame, commands: DataFrame) -> DataFrame:
    """files(path) -> symbols on which all their commands agree: those of the file, else of the nearest directory above."""
    pairs = lambda rows, *key: rows.select(*key, F.explode("symbols").alias("name", "value")).groupBy(*key, "name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("k"))
    def agreed(rows: DataFrame, key: str) -> DataFrame:
        size = rows.groupBy(key).agg(F.count("*").alias("n"))
        same = pairs(rows, key).join(size, key).where("low = high and k = n").groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "low")))).alias("symbols"))
        return size.join(same, key, "left").select(key, F.coalesce("symbols", F.create_map().cast("map<string,boolean>")).alias("symbols"))

    has_path = "path" in commands.columns
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("directory"))
    near = above.join(agreed(commands, "directory"), "directory").groupBy("path").agg(F.max_by("symbols", F.length("directory")).alias("near"))
    out = files.join(near, "path", "left")
    if has_path:
        out = out.join(agreed(commands, "path").withColumnRenamed("symbols", "own"), "path", "left")
    own = [F.col("own")] if has_path else []
    return out.select(*files.columns, F.coalesce(*own, "near", F.create_map().cast("map<string,boolean>")).alias("symbols"))


# --- conditional lines -----------------------------------------------------------------------------


def truth(expression: str, symbols: dict[str, bool]) -> bool | None:
    """Three-valued value of a condition of names, defined(), !, && and ||; None is unknown."""
    tokens = re.findall(r"defined|\w+|&&|\|\||[!()]|\S", expression)
    at = 0

    def either() -> bool | None:
        nonlocal at
        value = both()
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            other = both()
            value = True if value is True or other is True else None if value is None or other is None else False
        return value

    def both() -> bool | None:
        nonlocal at
        value = one()
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            other = one()
            value = False if value is False or other is False else None if value is None or other is None else True
        return value

    def one() -> bool | None:
        nonlocal at
        if at >= len(tokens):
            return None
        t = tokens[at]
        at += 1
        if t == "!":
            value = one()
            return None if value is None else not value
        if t == "(":
            value = either()
            at += at < len(tokens) and tokens[at] == ")"
            return value
        if t == "defined":
            bracket = at < len(tokens) and tokens[at] == "("
            at += bracket
            name = tokens[at] if at < len(tokens) else ""
            at += 1 + bracket
            return symbols.get(name)
        if t in ("true", "True", "1"):
            return True
        if t in ("false", "False", "0"):
            return False
        return symbols.get(t) if t.isidentifier() else None

    value = either()
    return value if at == len(tokens) else None


def conditional_lines(text: str, symbols: dict[str, bool]) -> list[tuple[int, int, str, str]]:
    """(first line, last line, included | excluded | conditional, condition) of each branch of #if directives; an
    inner branch is no more available than the one around it."""
    out, stack = [], []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b\s*(.*?)\s*(?://.*)?$", line)
        if not m:
            continue
        word, expression = m[1], m[2]
        if word in ("if", "ifdef", "ifndef"):
            value = truth(expression, symbols) if word == "if" else symbols.get(expression)
            value = (None if value is None else not value) if word == "ifndef" else value
            stack.append({"first": n + 1, "value": value, "done": value, "text": f"{word} {expression}"})
            continue
        if not stack:
            continue
        top = stack[-1]
        around = [s["value"] for s in stack]
        state = "excluded" if False in around else "conditional" if None in around else "included"
        out.append((top["first"], n - 1, state, top["text"]))
        if word == "endif":
            stack.pop()
            continue
        rest = None if top["done"] is None else not top["done"]
        own = True if word == "else" else truth(expression, symbols)
        top["value"] = False if rest is False or own is False else None if rest is None or own is None else True
        top["done"] = True if top["done"] is True or own is True else None if top["done"] is None or own is None else False
        top["first"], top["text"] = n + 1, f"{word} {expression}".strip()
    return out


class _Conditional:
    def __call__(self, batches):
        for batch in batches:
            rows = []
            for path, text, symbols in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                rows += [(path, *r) for r in conditional_lines(text or "", dict(symbols or []))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["path", "first", "last", "state", "condition"])


def conditional(files: DataFrame) -> DataFrame:
    """files(path, text, symbols) -> a row for each conditional branch."""
    ship(files.sparkSession)
    return files.select("path", "text", "symbols").mapInArrow(_Conditional(), "path string, first long, last long, state string, condition string")


def availability(evidence: DataFrame, branches: DataFrame) -> DataFrame:
    """Evidence with what the innermost branch around its line says: included where there is none."""
    b = branches.select(F.col("path").alias("b_path"), "first", "last", "state", "condition")
    met = evidence.select("id", "path", "line").join(b, (F.col("path") == F.col("b_path")) & F.col("line").between(F.col("first"), F.col("last")))
    inner = met.groupBy("id").agg(F.max_by(F.struct("state", "condition"), "first").alias("b"))
    return evidence.join(inner, "id", "left").withColumn("availability", F.coalesce("b.state", F.lit("included"))).withColumn("condition", F.col("b.condition")).drop("b")


# --- literals and URLs -----------------------------------------------------------------------------

DEPTH = 16


def literal(node: ast.AST, names: dict[str, ast.AST], depth: int = 0, seen: frozenset = frozenset()) -> tuple[str, object]:
    """(known, value), (partial, pieces: text or None for what is not known) or (unknown, None) of an expression.
    names: what each name that is bound once stands for; a name that needs itself is unknown."""
    if depth >= DEPTH:
        return "unknown", None
    below = lambda n: literal(n, names, depth + 1, seen)
    if isinstance(node, ast.Constant):
        return ("known", node.value) if not isinstance(node.value, (bytes, complex)) and node.value is not Ellipsis else ("unknown", None)
    if isinstance(node, ast.Name):
        if node.id in names and node.id not in seen:
            return literal(names[node.id], names, depth + 1, seen | {node.id})
        return "unknown", None
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        state, value = below(node.operand)
        return ("known", -value if isinstance(node.op, ast.USub) else value) if state == "known" and type(value) in (int, float) else ("unknown", None)
    if isinstance(node, (ast.List, ast.Tuple)):
        parts = [below(e) for e in node.elts]
        return ("known", [v for _, v in parts]) if all(s == "known" for s, _ in parts) else ("partial", [v if s == "known" else None for s, v in parts])
    if isinstance(node, ast.Dict):
        keys, values = [below(k) if k else ("unknown", None) for k in node.keys], [below(v) for v in node.values]
        good = all(s == "known" and isinstance(k, str) for s, k in keys) and all(s == "known" for s, _ in values)
        return ("known", {k: v for (_, k), (_, v) in zip(keys, values)}) if good else ("partial", [k for s, k in keys if s == "known"])
    pieces = None
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        pieces = [below(node.left), below(node.right)]
        if not any(s != "unknown" and (isinstance(v, str) or s == "partial") for s, v in pieces):
            return "unknown", None
    elif isinstance(node, ast.JoinedStr):
        pieces = [below(v.value) if isinstance(v, ast.FormattedValue) and not v.format_spec else below(v) if isinstance(v, ast.Constant) else ("unknown", None) for v in node.values]
        pieces = [(s, str(v) if s == "known" and isinstance(v, (str, int)) and not isinstance(v, bool) else v) for s, v in pieces]
    if pieces is None:
        return "unknown", None
    if all(s == "known" and isinstance(v, str) for s, v in pieces):
        return "known", "".join(v for _, v in pieces)
    flat: list = []
    for s, v in pieces:
        flat += [v] if s == "known" and isinstance(v, str) else v if s == "partial" and all(x is None or isinstance(x, str) for x in v) else [None]
    merged: list = []
    for x in flat:
        if merged and x is not None and merged[-1] is not None:
            merged[-1] += x
        else:
            merged.append(x)
    return ("partial", merged) if any(x is not None for x in merged) else ("unknown", None)


def _bound_once(tree: ast.Module) -> dict[str, ast.AST]:
    """Names of the module that are bound by one assignment at its top and nowhere else."""
    bound: dict[str, int] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            bound[n.id] = bound.get(n.id, 0) + 1
        elif isinstance(n, ast.arg):
            bound[n.arg] = bound.get(n.arg, 0) + 1
    return {s.targets[0].id: s.value for s in tree.body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and bound[s.targets[0].id] == 1}


class _Literals:
    def __call__(self, batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                names = _bound_once(tree)
                for n in ast.walk(tree):
                    if isinstance(n, ast.Call):
                        for k, a in enumerate(n.args):
                            state, value = literal(a, names)
                            lead = value if state == "known" and isinstance(value, str) else value[0] if state == "partial" and value and isinstance(value[0], str) else None
                            rows.append((path, n.lineno, ast.unparse(n.func), k, state, None if state == "unknown" else json.dumps(value), lead))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "line", "callee", "argument", "state", "value", "prefix"])


def literals(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(path, line, callee, argument, state, value as JSON, prefix) of every positional argument of every call."""
    ship(sources.sparkSession)
    return sources.select(F.col(key).cast("string"), text).mapInArrow(_Literals(), "path string, line long, callee string, argument long, state string, value string, prefix string")


def url_certainty(prefix: Column, whole: Column) -> Column:
    """What a literal prefix of a URL settles: fixed_authority (http and a host that the prefix ends), fixed_scheme,
    fixed_path (one slash and a path on the same host), or open. whole: the prefix is all of the URL."""
    authority = prefix.rlike(r"^(?i:https?)://[^/?#\\@\s]+[/?#]") | (whole & prefix.rlike(r"^(?i:https?)://[^/?#\\@\s]+$"))
    path = prefix.rlike(r"^/[^/\\]") | (whole & (prefix == "/"))
    return F.when(prefix.isNull(), "open").when(authority, "fixed_authority").when(prefix.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "fixed_scheme").when(path, "fixed_path").otherwise("open")


def normalized_symbol(c: Column) -> Column:
    """A dotted name without module schemes and global marks; the promise form of the file module is one name."""
    plain = F.replace(F.regexp_replace(F.trim(c), r"^(node:|global::)+", ""), F.lit("::"), F.lit("."))
    return F.regexp_replace(plain, r"^fs/promises($|\.)", r"fs.promises$1")


# --- provenance and imported facts -----------------------------------------------------------------


def provenance(files: DataFrame, listing: DataFrame, limit: int = 200) -> DataFrame:
    """Candidates (path, origin, kind) for where a file comes from, that exist in the listing: entries of a package.json
    (main, bin), sources of a version 3 source map, and the file that a generated-file header names."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    name = F.element_at(F.split("path", "/"), -1)
    j = lambda p: F.get_json_object("text", p)
    bins = F.coalesce(F.map_values(F.from_json(j("$.bin"), "map<string,string>")), F.array(j("$.bin")))
    package = files.where(name == "package.json").select("path", folder.alias("folder"), F.explode(F.concat(F.array(F.struct(F.lit("main").alias("kind"), j("$.main").alias("target"))), F.transform(bins, lambda b: F.struct(F.lit("bin").alias("kind"), b.alias("target"))))).alias("c")).select("path", "folder", "c.*")
    maps = files.where(name.endswith(".map") & (j("$.version") == "3")).select("path", folder.alias("folder"), F.lit("source_map").alias("kind"), F.explode(F.from_json(j("$.sources"), "array<string>")).alias("s"), F.coalesce(j("$.sourceRoot"), F.lit("")).alias("root")).select("path", "folder", "kind", F.concat("root", "s").alias("target"))
    head = F.substring(F.col("text"), 1, 1000)
    named = F.regexp_extract(head, r"(?i)(?:generated (?:from|by)|source:)\s+([\w./-]+\.\w+)", 1)
    headers = files.where(named != "").select("path", folder.alias("folder"), F.lit("generated_header").alias("kind"), named.alias("target"))
    found = package.unionByName(maps).unionByName(headers).where("target is not null and not startswith(target, '/') and not contains(target, '://')")
    full = F.concat("folder", F.regexp_replace("target", r"^(\./)+", ""))
    up = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin(".", ""), acc).otherwise(F.array_append(acc, p)))
    origin = found.select("path", F.array_join(up, "/").alias("origin"), "kind").distinct()
    return origin.join(listing.select(F.col("path").alias("origin")), "origin", "left_semi").orderBy("path", "origin", "kind").limit(limit)


def compiler_facts(facts: DataFrame, files: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts that hold, facts refused with the reason). facts(path, sha256, evidence, name, value) come from a compiler
    outside; they hold only for the text that they were made from and for evidence that there is."""
    now = files.select("path", F.sha2("text", 256).alias("now"))
    met = facts.join(now, "path", "left").join(evidence.select(F.col("id").alias("evidence"), F.lit(True).alias("there")), "evidence", "left")
    why = F.when(F.col("now").isNull(), "unknown_file").when(F.col("now") != F.col("sha256"), "other_text").when(F.col("there").isNull(), "unknown_evidence")
    met = met.withColumn("refused", why)
    return met.where("refused is null").select(*facts.columns), met.where("refused is not null").select(*facts.columns, "refused")


def original_lines(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """Evidence of generated sources at its original place: mapping(path, first, last, original, original_first). What no
    range holds is left out."""
    m = mapping.select(F.col("path").alias("m_path"), "first", "last", "original", "original_first")
    met = evidence.join(m, (F.col("path") == F.col("m_path")) & F.col("line").between(F.col("first"), F.col("last")))
    return met.withColumn("line", F.col("original_first") + F.col("line") - F.col("first")).withColumn("path", F.col("original")).drop("m_path", "first", "last", "original", "original_first")


# --- embedded code and pages -----------------------------------------------------------------------


def islands(pages: DataFrame, opening: str, closing: str, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, n, start, line, attributes, body) of the blocks between an opening and a closing mark: `<script ...>` and
    `</script>`, `<%` and `%>`, the blocks of a component. Offsets count characters; positions are those of the body.

    A page is cut at its opening marks once, so long pages take one pass; an unclosed block has the rest."""
    parts = F.split(text, opening, -1)
    marks = F.regexp_extract_all(text, F.lit(f"({opening})"), F.lit(1))
    zipped = F.arrays_zip(marks.alias("mark"), F.slice(parts, 2, F.size(marks)).alias("rest"), F.transform(F.slice(parts, 1, F.size(marks)), lambda x: F.length(x)).alias("gap"))
    rows = pages.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.posexplode(zipped).alias("n", "z"))
    from pyspark.sql import Window

    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("z.gap") + F.length("z.mark")).over(before).cast("long")
    rows = rows.select("key", "n", start.alias("start"), "text", F.regexp_extract("z.mark", r"^<\w*\s*([^>]*?)>?$", 1).alias("attributes"), F.element_at(F.split("z.rest", closing, 2), 1).alias("body"))
    line = F.length(F.regexp_replace(F.substring(F.col("text"), F.lit(1), F.col("start").cast("int")), "[^\n]", "")) + 1
    return rows.select("key", "n", "start", line.alias("line"), "attributes", "body")


# Checks of page sources, by name and pattern.
PAGE_CHECKS = {
    "inline_handler": r"(?i)<[a-z][^>]*\son[a-z]+\s*=", "script_url": r"(?i)(?:href|src|action)\s*=\s*[\"']?\s*javascript:", "frame_without_sandbox": r"(?i)<iframe(?![^>]*\ssandbox)[^>]*>", "raw_output": r"(?i)@Html\.Raw\s*\(|<%=(?!:)",
    "form_without_token": r"(?is)<form[^>]*method\s*=\s*[\"']?post(?:(?!</form>|csrf|__RequestVerificationToken|AntiForgeryToken).)*</form>", "plain_resource": r"(?i)<(?:script|img|iframe|link)[^>]*\s(?:src|href)\s*=\s*[\"']?http://", "request_validation_off": r"(?i)validateRequest\s*=\s*[\"']?false",
}


def page_checks(pages: DataFrame, key: str = "page_id", text: str = "html", checks: dict[str, str] | None = None) -> DataFrame:
    """(key, check, n): how often each check's pattern occurs; template and web form sources have the same checks."""
    found = [F.struct(F.lit(k).alias("check"), F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))).alias("n")) for k, p in (checks or PAGE_CHECKS).items()]
    return pages.select(F.col(key).alias("key"), F.explode(F.array(*found)).alias("c")).select("key", "c.*").where("n > 0")


# --- gates and admission ---------------------------------------------------------------------------


def receiver_gate(sites: DataFrame, bindings: DataFrame, constructors: list[str]) -> DataFrame:
    """Call sites whose receiver is a name that its file binds to one of the constructors, and to nothing else.
    bindings(doc, name, canonical); a site's receiver is what its callee has before the last dot."""
    good = bindings.groupBy("doc", "name").agg(F.bool_and(F.col("canonical").isin(constructors)).alias("only")).where("only").select("doc", F.col("name").alias("receiver"))
    return sites.withColumn("receiver", F.regexp_extract("callee", r"^(.*)\.[^.]+$", 1)).join(good, ["doc", "receiver"], "left_semi")


def exact_symbols(sites: DataFrame, canonical: list[str]) -> DataFrame:
    """Call sites that an import resolves to one of the names exactly."""
    return sites.where((F.col("method") == "import") & F.col("canonical").isin(canonical))


def compiled_rules(rules: DataFrame, replaced: dict[str, list[str]]) -> DataFrame:
    """Rules without those that a front end of their language replaces unconditionally."""
    gone = F.lit(False)
    for language, ids in replaced.items():
        gone = gone | ((F.col("language") == language) & F.col("id").isin(ids))
    return rules.where(~gone)


def admission(evidence: DataFrame, connected: DataFrame) -> DataFrame:
    """Evidence with connected (it is in a path), a disposition (review or inventory_only) and, for the latter, the reason;
    excluded_from_comprehensive says why a row is not in the widest scope either."""
    ids = connected.select(F.explode(F.array_union(F.array("source", "sink"), F.col("protections"))).alias("id")).distinct().withColumn("connected", F.lit(True))
    rows = evidence.join(ids, "id", "left").withColumn("connected", F.coalesce("connected", F.lit(False)))
    tag = lambda t: F.array_contains("tags", t)
    lone = ~F.col("connected")
    why = (
        F.when(tag("closed-query"), "closed_operand").when(tag("non-content-effect"), "no_content_effect").when(tag("positive-control"), "positive_control").when(F.col("kind").isin("source", "protection") & lone, "context_only")
        .when((F.col("capability") == "logging") & lone, "unconnected_log").when((F.col("capability") == "cryptographic_hash") & lone & ~tag("security-purpose"), "no_security_purpose").when((F.col("capability") == "cross_origin") & lone & ~tag("credentials"), "no_credentials")
    )
    wide = F.when(F.col("reachability") == "unreachable", "unreachable").when(tag("comment"), "comment").when(F.col("kind") == "note", "no_security_role")
    return rows.withColumn("reason", why).withColumn("disposition", F.when(F.col("reason").isNull(), "review").otherwise("inventory_only")).withColumn("excluded_from_comprehensive", wide)


def pass_timing(runs: DataFrame) -> DataFrame:
    """runs(name, microseconds) by pass."""
    return runs.groupBy("name").agg(F.count("*").alias("runs"), F.sum("microseconds").alias("microseconds"))


# --- modules and links across files ------------------------------------------------------------------

# Endings that a module name may leave out, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.mjs")


def packages(files: DataFrame) -> DataFrame:
    """(name, folder, main) of every package.json with a name; of two with one name the shallower counts."""
    j = lambda p: F.get_json_object("text", p)
    rows = files.where(F.element_at(F.split("path", "/"), -1) == "package.json").select(j("$.name").alias("name"), F.regexp_replace("path", "[^/]*$", "").alias("folder"), F.coalesce(j("$.main"), F.lit("index")).alias("main")).where("name is not null")
    return rows.groupBy("name").agg(F.min_by(F.struct("folder", "main"), F.struct(F.length("folder"), "folder")).alias("p")).select("name", "p.*")


def module_targets(imports: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """imports(path, specifier) with the file that each means, null if there is none in the tree: relative names from
    the importer's folder, package names through the workspace's packages(name, folder, main)."""
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    first = F.when(F.col("specifier").startswith("@"), F.regexp_extract("specifier", "^[^/]+/[^/]+", 0)).otherwise(F.regexp_extract("specifier", "^[^/]+", 0))
    keyed = imports.withColumn("name", F.when(~relative, first)).join(known, "name", "left")
    rest = F.substring(F.col("specifier"), F.length("name") + 2, F.length("specifier"))
    full = F.when(relative, F.concat(F.regexp_replace("path", "[^/]*$", ""), "specifier")).when(F.col("folder").isNotNull(), F.concat("folder", F.when(rest == "", F.col("main")).otherwise(rest)))
    walked = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin(".", ""), acc).otherwise(F.array_append(acc, p)))
    base = keyed.select("path", "specifier", F.array_join(walked, "/").alias("base"))
    tries = base.select("path", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS])).alias("rank", "target"))
    found = tries.join(files.select(F.col("path").alias("target")), "target", "left_semi").groupBy("path", "specifier").agg(F.min_by("target", "rank").alias("target"))
    return imports.join(found, ["path", "specifier"], "left")


def unreleased(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """opened(id, symbol, path, function) that no closed(symbol, function) of any file releases: by the symbol and, where the
    release names one, the function that hands it on. Linked after all files are scanned, as one anti-join."""
    own = closed.select("symbol", F.col("function").alias("by"))
    return opened.join(own, (opened.symbol == own.symbol) & (F.col("by").isNull() | (F.col("by") == F.col("function"))), "left_anti")
