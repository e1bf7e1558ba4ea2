"""Readers of repository files: root documents, manifests, DDL and its invariants, symbols.

Files come as (path, text) rows from Spark's binary reader; each parser is a function from one file to facts
that runs in Arrow batches. A file that cannot be parsed gives one ``skipped`` fact with the reason.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = "skipped"


class Fact(NamedTuple):
    """What a file says: an atom's type and topic, its claim at three lengths, and the predicate that it still does."""

    kind: str
    topic: str
    short: str
    claim: str
    long: str = ""
    live: str = "regex"
    pattern: str = ""
    source: str = "manifest"
    line: int = 0


FACTS = "path string, kind string, topic string, short string, claim string, long string, live string, pattern string, source string, line int, nth int"

# --- fixed values ---------------------------------------------------------------------------------------
ROOT_DOCS = ("README.md", "README.rst", "README", "CLAUDE.md", "AGENTS.md", "CONTRIBUTING.md", "ARCHITECTURE.md")
CAPS = {"manifest": 300, "schema": 300, "invariants": 400, "symbols": 200, "modules": 100}
SOURCE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".dart", ".go", ".rs", ".rb", ".java", ".kt", ".swift", ".c", ".h", ".cpp", ".hpp", ".cs", ".sql")
NEVER_MODULES = (".git", ".factloom", ".github", ".vscode", "__pycache__")
H1 = r"(?m)^#\s+(.+?)\s*$"
CREATE_TABLE = r'(?i)CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:"?[A-Za-z_]\w*"?\.)?"?([A-Za-z_]\w*)"?\s*\('
TABLE_LEVEL = r"(?i)(PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT)\b"
COLUMN = r'\s*"?([A-Za-z_]\w*)"?\s+([A-Za-z]\w*(?:\([^)]*\))?)'
REFERENCES = r'(?i)\bREFERENCES\s+"?(\w+)"?\s*(?:\(\s*"?(\w+)"?\s*\))?'
#: Language -> suffixes and declarations of its public surface.
LANGUAGES = {
    "python": ((".py",), (r"^(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", r"^class\s+([A-Za-z_]\w*)\b")),
    "dart": ((".dart",), (r"^(?:abstract\s+|sealed\s+)?class\s+([A-Za-z_]\w*)\b", r"^(?:mixin|enum)\s+([A-Za-z_]\w*)\b")),
    "javascript": ((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), (r"^export\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", r"^export\s+(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", r"^export\s+const\s+([A-Za-z_$][\w$]*)\s*[=:]")),
    "go": ((".go",), (r"^func\s+(?:\([^)]*\)\s+)?([A-Z][A-Za-z0-9_]*)\s*\(", r"^type\s+([A-Z][A-Za-z0-9_]*)\s+")),
    "rust": ((".rs",), (r"^pub\s+(?:async\s+)?fn\s+([a-zA-Z_]\w*)", r"^pub\s+(?:struct|enum|trait)\s+([A-Z]\w*)")),
    "swift": ((".swift",), (r"^[ \t]*(?:(?:public|private|internal|fileprivate|open)\s+)?(?:(?:final|static|override|mutating|class)\s+)*func\s+([A-Za-z_]\w*)\s*[(<]", r"^[ \t]*(?:(?:public|private|internal|fileprivate|open)\s+)?(?:final\s+)?(?:class|struct|enum|protocol)\s+([A-Za-z_]\w*)\b", r"^[ \t]*extension\s+([A-Za-z_][\w.]*)\b")),
    "php": ((".php",), (r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+([A-Za-z_]\w*)\s*\(", r"^[ \t]*(?:final\s+|abstract\s+)?(?:class|interface|trait)\s+([A-Za-z_]\w*)\b")),
}
# ----------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, root: str, pattern: str = "*", *, exclude: tuple[str, ...] = (".git", "node_modules", "__pycache__"), max_kb: int = 512, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), text of files up to ``max_kb``, outside excluded folders, of the suffixes (any if none)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://")[-1].rstrip("/")
    below = F.expr(f"substring(path, instr(path, {json.dumps(base)}) + {len(base) + 1})")
    own = raw.where(F.col("length") <= max_kb * 1024).select(below.alias("path"), F.decode("content", "UTF-8").alias("text"))
    own = own.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*exclude)))
    return own.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)) if suffixes else own


def only_changed(rows: DataFrame, changed: DataFrame) -> DataFrame:
    return rows.join(changed.select("path").distinct(), "path", "left_semi")


def parsed(rows: DataFrame, parse: Callable[[str, str], list[Fact]]) -> DataFrame:
    """Facts of each file in their order (``nth``); one ``skipped`` fact for a file that cannot be parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    found = parse(path, text or "")
                except (ValueError, KeyError, TypeError, AttributeError) as error:
                    found = [Fact(SKIPPED, path, "", f"{type(error).__name__}: {error}"[:200], live="none")]
                out += [(path, *fact, nth) for nth, fact in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", *Fact._fields, "nth"]).astype({"line": "int32", "nth": "int32"})

    return rows.select("path", "text").mapInPandas(run, FACTS)


def capped(facts: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` facts in the order of path and place - the feature of bounded ingestion."""
    return facts.orderBy("path", "nth").limit(cap)


def token_pattern(name: str) -> str:
    """A regular expression of a name as a whole token, scopes and dashes included."""
    if not name:
        return ""
    word = lambda c: c.isalnum() or c == "_"
    return (r"\b" if word(name[0]) else r"(?<![\w@])") + re.escape(name) + (r"\b" if word(name[-1]) else r"(?![\w-])")


def relaxed_pattern(declaration: str) -> str:
    """A regular expression of a declaration whatever its white space."""
    return r"\s+".join(map(re.escape, declaration.split()))


# --- root documents ---------------------------------------------------------------------------------------


def summary(text: str, words: int) -> str:
    """The first paragraph after the title that is no heading, cut at ``words`` words; else the text's first words."""
    title = re.search(H1, text)
    body = text[title.end() :] if title else text
    for paragraph in re.split(r"\n\s*\n", body.strip()):
        if (p := paragraph.strip()) and not p.startswith("#"):
            return " ".join(p.split()[:words])
    return " ".join(text.split()[:words])


def readme(path: str, text: str) -> list[Fact]:
    """A root document as a glossary fact, alive while its title stands."""
    if "/" in path or path not in ROOT_DOCS:
        return []
    m = re.search(H1, text)
    title = m[1].strip() if m else path.rsplit(".", 1)[0]
    claim = summary(text, 50) or title
    live, pattern = ("regex", rf"(?m)^#\s+{re.escape(title)}\s*$") if m else ("none", "")
    return [Fact("glossary", f"doc:{path}", title, claim, summary(text, 250) or claim, live, pattern, "readme", text[: m.start()].count("\n") + 1 if m else 0)]


# --- manifests --------------------------------------------------------------------------------------------


def dependency(ecosystem: str, name: str, spec: str, path: str) -> Fact:
    return Fact("dependency", f"dep:{ecosystem}:{name}", f"{ecosystem} dep {name}", f"{ecosystem} dependency {name} pinned at {spec} (from {path}).", pattern=token_pattern(name))


def runtime(lang: str, version: str, path: str) -> Fact:
    return Fact("runtime", f"runtime:{lang}", f"{lang} {version}", f"{lang} runtime constraint: {version} (declared in {path}).", pattern=re.escape(version.strip(" \"'")))


def recipe(ecosystem: str, name: str, body: str, path: str) -> Fact:
    return Fact("build_recipe", f"script:{ecosystem}:{name}", f"{ecosystem} script {name}", f"{ecosystem} script `{name}` runs: {body}", pattern=token_pattern(name))


def requirement(text: str) -> tuple[str, str]:
    """Name and the rest - extras, versions, markers - of a requirement; the whole text if it has no name."""
    m = re.match(r"\s*([A-Za-z0-9_.\-]+)\s*(.*)", text)
    return (m[1], m[2].strip()) if m else (text, "")


def pyproject(path: str, text: str) -> list[Fact]:
    project = tomllib.loads(text).get("project") or {}
    out = [runtime("python", str(v), path)] if (v := project.get("requires-python")) else []
    groups = [("", project.get("dependencies") or []), *(project.get("optional-dependencies") or {}).items()]
    for extra, rows in groups:
        for name, spec in map(requirement, map(str, rows)):
            out.append(dependency("pypi", name, (spec or "*") + (f" (extra:{extra})" if extra else ""), path))
    return out + [recipe("pypi", n, str(v), path) for n, v in (project.get("scripts") or {}).items()]


def package_json(path: str, text: str) -> list[Fact]:
    data = json.loads(text)
    out = [runtime("node", str(v), path)] if (v := (data.get("engines") or {}).get("node")) else []
    for section in ("dependencies", "devDependencies", "peerDependencies"):
        note = "" if section == "dependencies" else f" ({section})"
        out += [dependency("npm", n, f"{v}{note}", path) for n, v in (data.get(section) or {}).items()]
    return out + [recipe("npm", n, str(v), path) for n, v in (data.get("scripts") or {}).items()]


def cargo_toml(path: str, text: str) -> list[Fact]:
    data = tomllib.loads(text)
    package = data.get("package") or {}
    out = [runtime("rust", str(v), path)] if (v := package.get("edition") or package.get("rust-version")) else []
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        note = "" if section == "dependencies" else f" ({section})"
        out += [dependency("cargo", n, (v if isinstance(v, str) else json.dumps(v, sort_keys=True)) + note, path) for n, v in (data.get(section) or {}).items()]
    return out


def requirements_txt(path: str, text: str) -> list[Fact]:
    out = []
    for i, line in enumerate(map(str.strip, text.splitlines()), 1):
        if (m := re.match(r"([A-Za-z0-9_.\-]+)\s*(.*)", line)) and line[0] not in "#-":
            out.append(dependency("pypi", m[1], m[2].strip() or "*", path)._replace(line=i))
    return out


def go_mod(path: str, text: str) -> list[Fact]:
    out, inside = [], False
    for i, line in enumerate(map(str.strip, text.splitlines()), 1):
        if line.startswith("go "):
            out.append(runtime("go", line[3:].strip(), path)._replace(line=i))
        elif line.startswith("require ("):
            inside = True
        elif inside and line == ")":
            inside = False
        else:
            wanted = line if inside else line.removeprefix("require ") if line.startswith("require ") else ""
            if m := re.match(r"([\w./\-]+)\s+(v\S+)", wanted):
                out.append(dependency("gomod", m[1], m[2], path)._replace(line=i))
    return out


def pubspec_yaml(path: str, text: str) -> list[Fact]:
    out, section = [], ""
    for i, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("#"):
            continue
        if not line.startswith(" "):
            section = line.split(":", 1)[0].rstrip()
        elif m := re.match(r"\s{2}([A-Za-z0-9_]+):\s*(.+)$", line):
            if section in ("dependencies", "dev_dependencies"):
                out.append(dependency("pub", m[1], m[2].strip() or "*", path)._replace(line=i))
            elif section == "environment" and m[1] in ("sdk", "flutter"):
                out.append(runtime({"sdk": "dart"}.get(m[1], m[1]), m[2].strip(), path)._replace(line=i))
    return out


PARSERS = {"pyproject.toml": pyproject, "package.json": package_json, "pubspec.yaml": pubspec_yaml, "Cargo.toml": cargo_toml, "requirements.txt": requirements_txt, "go.mod": go_mod}


def manifest(path: str, text: str) -> list[Fact]:
    parse = PARSERS.get(path.rsplit("/", 1)[-1])
    return parse(path, text) if parse else []


# --- DDL ----------------------------------------------------------------------------------------------------


def top_level(text: str) -> list[str]:
    """Parts between commas that stand in no parentheses or quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in [*parts, text[start:].strip()] if p]


def tables(text: str) -> Iterator[tuple[str, list[str], int]]:
    """Name (without its schema), definitions and line of each CREATE TABLE whose parentheses close."""
    for m in re.finditer(CREATE_TABLE, text):
        depth, i, quote = 1, m.end(), ""
        while i < len(text) and depth:
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += {"(": 1, ")": -1}.get(c, 0)
            i += 1
        if depth == 0:
            yield m[1], top_level(re.sub(r"--[^\n]*", "", text[m.end() : i - 1])), text[: m.start()].count("\n") + 1


def schema_sql(path: str, text: str) -> list[Fact]:
    """Tables with their columns and types, alive while the CREATE TABLE stands."""
    out = []
    for name, parts, line in tables(text):
        columns = [(m[1], m[2]) for p in parts if not re.match(TABLE_LEVEL, p) and (m := re.match(COLUMN, p))]
        more = f" (+{len(columns) - 6} more)" if len(columns) > 6 else ""
        claim = f"Table `{name}` defined in {path} with {len(columns)} columns: {', '.join(f'{n} {t}' for n, t in columns[:6])}{more}."
        pattern = rf'(?i)CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\"?\w+\"?\.)?\"?{re.escape(name)}\"?'
        out.append(Fact("schema_fact", f"table:{name}", f"table {name} ({len(columns)} cols)", claim, f"{claim} {'; '.join(f'{n}:{t}' for n, t in columns)}", "regex", pattern, "schema_snapshot", line))
    return out


def claims_of(table: str, declaration: str) -> Iterator[tuple[str, str, str]]:
    """(kind, topic suffix, claim) of a column's constraints."""
    if not (m := re.match(r'\s*"?([A-Za-z_]\w*)"?\s', declaration)):
        return
    column, has = m[1], lambda p: re.search(p, declaration, re.I | re.S)
    if has(r"\bPRIMARY\s+KEY\b"):
        yield "primary_key", f"{column}.pk", f"`{table}` is keyed by `{column}`."
    if has(r"\bNOT\s+NULL\b"):
        yield "not_null", f"{column}.not_null", f"`{table}.{column}` is required — NOT NULL is enforced by the schema."
    if has(r"\bUNIQUE\b"):
        yield "unique", f"{column}.unique", f"`{table}.{column}` must be unique — duplicates are rejected by the schema."
    if check := has(r"\bCHECK\s*\((.+)\)"):
        yield "check", f"{column}.check", f"`{table}.{column}` is constrained to {' '.join(check[1].split())[:120]} — enforced by a CHECK."
    if there := re.search(REFERENCES, declaration):
        yield "foreign_key", f"{column}.fk", f"`{table}.{column}` must reference `{there[1]}({there[2] or 'id'})` — a foreign key enforces it."


def invariants(path: str, text: str) -> list[Fact]:
    """Constraints of each column as claims, alive while the declaration stands whatever its white space."""
    out = []
    for table, parts, line in tables(text):
        for declaration in parts:
            if re.match(TABLE_LEVEL, declaration):
                continue
            for kind, suffix, claim in claims_of(table, declaration):
                out.append(Fact("invariant", f"invariant:{table}.{suffix}", f"{table}.{suffix.split('.')[0]} {kind}", claim, f"{claim} Declared in {path} as: {declaration}", "regex", relaxed_pattern(declaration), "schema_snapshot", line))
    return out


# --- symbols --------------------------------------------------------------------------------------------------


def language_of(path: str) -> str | None:
    suffix = re.search(r"\.[^./]*$", path)
    return next((lang for lang, (ends, _) in LANGUAGES.items() if suffix and suffix[0].lower() in ends), None)


def declared(path: str, text: str) -> list[tuple[str, int]]:
    """(name, line) of a file's declarations, by pattern in order; of a name seen twice the first."""
    lang, found = language_of(path), {}
    for pattern in LANGUAGES[lang][1] if lang else ():
        for m in re.finditer(pattern, text, re.M):
            found.setdefault(m[1], text[: m.start(1)].count("\n") + 1)
    return list(found.items())


def symbols(path: str, text: str) -> list[Fact]:
    """Public declarations as glossary facts. Grammars are not at hand: declarations come from patterns, and so
    does the predicate that they still stand."""
    lang, folder = language_of(path), path.rpartition("/")[0] or "."
    return [
        Fact("glossary", f"symbol:{path}:{name}", f"{lang} symbol {name} in {path.rsplit('/', 1)[-1]}", f"{lang} symbol `{name}` declared in {path}. Public surface — referenced from {folder}.", "", "regex", token_pattern(name), "manifest", line)
        for name, line in declared(path, text)
    ]


def symbol_table(rows: DataFrame) -> DataFrame:
    """path, name of the declarations of files, by which ``ast`` predicates are checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, n) for p, t in zip(batch["path"], batch["text"]) for n, _ in declared(p, t or "")], columns=["path", "name"])

    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*[s for ends, _ in LANGUAGES.values() for s in ends])).select("path", "text").mapInPandas(run, "path string, name string")


def modules(paths: DataFrame, cap: int = CAPS["modules"]) -> DataFrame:
    """Top-level folders that hold source files, hidden and state folders left out: module, files; the first ``cap``."""
    top = F.split("path", "/")[0]
    source = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*SOURCE_SUFFIXES)
    inside = paths.where(F.col("path").contains("/") & source & ~F.col("path").startswith(".") & ~top.isin(*NEVER_MODULES))
    return inside.groupBy(top.alias("module")).agg(F.count(F.lit(1)).alias("files")).orderBy("module").limit(cap)


def commits(log: DataFrame, since: int | None = None, first: int = 50, most: int = 500, base: str | None = None) -> DataFrame:
    """Commit log rows (sha, ts, author, subject, body) as closed change decisions, newest first.

    ``since`` is a time, ``base`` the last indexed commit. A new store takes the last ``first`` commits, and so does
    one whose base is not in the log; else up to ``most`` newer ones come.
    """
    known = None
    if base is not None:
        known = log.where(F.col("sha") == base).select(F.max("ts")).first()[0]
    rows = log
    if known is not None:
        rows = log.where((F.col("ts") > known) | ((F.col("ts") == known) & (F.col("sha") != base)))
    elif since is not None:
        rows = log.where(F.col("ts") > since)
    short, body = F.substring("sha", 1, 7), F.coalesce("body", F.lit("")) if "body" in log.columns else F.lit("")
    newest = rows.orderBy(F.desc("ts"), "sha").limit(most if known is not None or (since is not None and base is None) else first)
    return newest.select(
        F.concat(F.lit("commit:"), short).alias("topic"), F.substring("subject", 1, 80).alias("short"), F.concat("subject", F.lit(" — "), "author", F.lit(" ("), short, F.lit(")")).alias("claim"),
        F.concat("subject", F.lit("\n\nAuthor: "), "author", F.lit("  SHA: "), short, F.lit("\n\n"), F.trim(F.regexp_replace(body, r"\s+", " "))).alias("long"),
        F.lit("decision").alias("kind"), F.lit("CLOSED").alias("decision_status"), F.lit("change").alias("decision_class"), F.col("ts").alias("valid_from"), F.col("sha").alias("source_ref"),
    )
