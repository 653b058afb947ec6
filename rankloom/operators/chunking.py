"""Chunkers: sections of Markdown, YAML, TOML and HCL in DataFrame functions; Python by its own parser; merging and packing."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.operators import nix
from rankloom.operators.nix import whole_file

# File suffixes and their languages.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "jsx",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".svelte": "svelte",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".md": "markdown",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c++": "cpp",
    ".cs": "csharp",
    ".nix": "nix",
    ".toml": "toml",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".tf": "hcl",
}
OVERLAP, BUDGET = 100, 2500
SCHEMA = "path string, start_line int, end_line int, kind string, name string, parent string, text string, docstring string, tags array<string>"


def language(path: Column) -> Column:
    """The language of a path by its suffix, any case; null if it is none of ours."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


def _sections(lines: DataFrame, starts: Column, least: int = 1) -> DataFrame:
    """Runs of lines that begin where starts holds: (path, start_line, end_line, head, text); what precedes the first is run 0.

    One sort per file; a file's lines meet in one task, files are dealt over all.
    """
    w = W.partitionBy("path").orderBy("i")
    run = lines.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = run.groupBy("path", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    g = g.select("path", "run", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), F.col("ls")[0]["line"].alias("head"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
    return g.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").where(F.col("end_line") - F.col("start_line") + 1 >= F.when(F.col("run") == 0, 1).otherwise(least))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections of files (path, text) from each ATX heading to the next; fenced # lines are text; no heading: one document."""
    w = W.partitionBy("path").orderBy("i")
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    lines = _lines(files).withColumn("open", F.coalesce(F.sum(fence.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2 == 1)
    s = _sections(lines, ~F.col("open") & ~fence & F.col("line").rlike(r"^#{1,6}\s+\S"))
    any_ = F.max("run").over(W.partitionBy("path"))
    kind = F.when(any_ == 0, "document").when(F.col("run") == 0, "preamble").otherwise("section")
    name = F.when(F.col("run") > 0, F.trim(F.regexp_replace("head", r"^#{1,6}\s+|\s+#+\s*$", "")))
    return s.select("path", "start_line", "end_line", kind.alias("kind"), name.alias("name"), "text")


def _overlapped(s: DataFrame) -> DataFrame:
    """Each section's text behind the last OVERLAP characters of the one before; line ranges do not cover them."""
    before = F.lag("text").over(W.partitionBy("path").orderBy("start_line"))
    return s.withColumn("text", F.when(before.isNotNull(), F.concat(F.substring(before, -OVERLAP, OVERLAP), F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


def yaml_sections(files: DataFrame) -> DataFrame:
    lines = _lines(files).where("line <> '---'")
    s = _sections(lines, F.col("line").rlike(r"^[A-Za-z_][\w.-]*\s*:"), 2)
    return _overlapped(s.select("path", "start_line", "end_line", F.when(F.col("run") == 0, "preamble").otherwise("section").alias("kind"), F.regexp_extract("head", r"^([\w.-]+)\s*:", 1).alias("name"), "text"))


def toml_sections(files: DataFrame) -> DataFrame:
    s = _sections(_lines(files), F.col("line").rlike(r"^\[[^\]\[]+\]\s*$"))
    name = F.when(F.col("run") == 0, F.lit("_preamble")).otherwise(F.regexp_extract("head", r"^\[([^\]]+)\]", 1))
    return _overlapped(s.select("path", "start_line", "end_line", F.lit("section").alias("kind"), name.alias("name"), "text"))


def hcl_blocks(files: DataFrame) -> DataFrame:
    """Top-level blocks by counting braces."""
    w = W.partitionBy("path").orderBy("i")
    net = F.regexp_count("line", F.lit("[{]")) - F.regexp_count("line", F.lit("[}]"))
    lines = _lines(files).withColumn("depth", F.coalesce(F.sum(net).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = _sections(lines, (F.col("depth") == 0) & F.col("line").rlike(r"^\w[^={]*[{]"))
    return _overlapped(s.where("run > 0").select("path", "start_line", "end_line", F.lit("block").alias("kind"), F.trim(F.regexp_replace(F.regexp_extract("head", r"^([^{]*)", 1), '"', "")).alias("name"), "text"))


def python_units(path: str, text: str) -> list[dict]:
    """Functions, classes and decorated definitions of a Python file; methods follow their plain class; none: one module."""
    lines = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        tree = None
    out: list[dict] = []

    def visit(body: list, parent: str | None) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                deco = bool(n.decorator_list)
                start = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                cls = isinstance(n, ast.ClassDef)
                kind = "decorated_definition" if deco else "class" if cls else "method" if parent else "function"
                tags = [*(["async"] if isinstance(n, ast.AsyncFunctionDef) else []), *(["decorated"] if deco else []), *(["test"] if n.name.startswith("test") else [])]
                out.append({"path": path, "start_line": start, "end_line": n.end_lineno, "kind": kind, "name": n.name, "parent": parent, "text": "\n".join(lines[start - 1 : n.end_lineno]), "docstring": ast.get_docstring(n), "tags": sorted(tags)})
                if cls and not deco:
                    visit(n.body, n.name)
            else:
                for field in ("body", "orelse", "finalbody", "handlers"):
                    inner = getattr(n, field, None)
                    if isinstance(inner, list):
                        visit([x for h in inner for x in (h.body if isinstance(h, ast.ExceptHandler) else [h])], parent)

    visit(tree.body if tree else [], None)
    if not out and text.strip():
        out.append({"path": path, "start_line": 1, "end_line": len(lines), "kind": "module", "name": None, "parent": None, "text": text, "docstring": ast.get_docstring(tree) if tree else None, "tags": []})
    return out


# How declarations begin in languages without a grammar here; group 1 or 2 is the name.
DECLARATIONS = {
    "function": re.compile(r"^\s*(?:export\s+|default\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|inline\s+|virtual\s+|unsafe\s+)*(?:function\*?|func|fn)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    "class": re.compile(r"^\s*(?:export\s+|default\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+|sealed\s+|partial\s+|typedef\s+)*(?:class|struct|interface|enum|trait|impl|union|namespace|mod|record|type)\s+(?:class\s+)?([A-Za-z_]\w*)"),
    "c_function": re.compile(r"^[A-Za-z_][\w\s*&:<>,\[\]]*?\b([A-Za-z_~]\w*)\s*\([^;]*\)\s*(?:const\s*|noexcept\s*|throws\s+[\w, ]+)?[{]\s*$"),
    "arrow": re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
}
_NOT_NAMES = frozenset("if for while switch return else catch do try sizeof".split())


def braced_units(path: str, text: str) -> list[dict]:
    """Declarations of a brace language by their first lines and brace depth; nested ones inherit the enclosing class as parent."""
    lines, out, depth, open_ = text.split("\n"), [], 0, []
    for i, line in enumerate(lines):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$", "", line)
        kind, name = next(((k, m[1]) for k, p in DECLARATIONS.items() if (m := p.match(line)) and m[1] not in _NOT_NAMES), (None, None))
        inside_function = any(u["kind"] != "class" for u, _ in open_)
        if kind and not inside_function:
            kind = {"c_function": "function", "arrow": "function"}.get(kind, kind)
            parent = next((u["name"] for u, _ in reversed(open_) if u["kind"] == "class"), None)
            kind = "method" if kind == "function" and parent else kind
            unit = {"path": path, "start_line": i + 1, "end_line": i + 1, "kind": kind, "name": name, "parent": parent, "docstring": None, "tags": []}
            out.append(unit)
            if "{" in bare or not bare.rstrip().endswith(";"):
                open_.append((unit, depth))
        depth += bare.count("{") - bare.count("}")
        while open_ and depth <= open_[-1][1] and ("}" in bare or bare.rstrip().endswith(";")):
            open_.pop()[0]["end_line"] = i + 1
    for unit, _ in open_:
        unit["end_line"] = len(lines)
    for u in out:
        u["text"] = "\n".join(lines[u["start_line"] - 1 : u["end_line"]])
    if not out and text.strip():
        out.append({"path": path, "start_line": 1, "end_line": len(lines), "kind": "module", "name": None, "parent": None, "text": text, "docstring": None, "tags": []})
    return out


_TAG = re.compile(r"<(script|style)\b[^>]*>", re.IGNORECASE)


def svelte_units(path: str, text: str) -> list[dict]:
    """Script and style elements of a component, and the declarations inside its scripts; none: one module."""
    out, lines = [], text.split("\n")
    line_of = lambda at: text.count("\n", 0, at) + 1
    for m in _TAG.finditer(text):
        kind = m[1].lower()
        close = re.compile(f"</{kind}\\s*>", re.IGNORECASE).search(text, m.end())
        end = close.end() if close else len(text)
        a, b = line_of(m.start()), line_of(max(m.start(), end - 1))
        out.append({"path": path, "start_line": a, "end_line": b, "kind": kind, "name": kind, "parent": None, "text": "\n".join(lines[a - 1 : b]), "docstring": None, "tags": ["svelte"]})
        if kind == "script":
            inner = text[m.end() : close.start() if close else len(text)]
            shift = line_of(m.end()) - 1
            out += [u | {"start_line": u["start_line"] + shift, "end_line": u["end_line"] + shift, "parent": u["parent"] or "script"} for u in braced_units(path, inner) if u["kind"] != "module"]
    return out or whole_file(path, text)


# Units of a file by language; braced_units() for all others. An entry takes (path, text) and gives dicts of SCHEMA's fields.
CHUNKERS = {".py": python_units, ".svelte": svelte_units, ".nix": nix.nix_units}


def chunker(suffix: str):
    """Registers a chunker for a suffix, in place of the one there was; the suffix must have a language."""

    def add(f):
        if suffix not in LANGUAGES:
            raise LookupError(f"no language has the suffix {suffix}")
        CHUNKERS[suffix] = f
        return f

    return add


def code_units(files: DataFrame) -> DataFrame:
    """Units of files (path, text) with a code suffix; a null or blank file gives none. One task holds a batch of files."""

    chunkers = dict(CHUNKERS)
    of = lambda path: chunkers.get("." + path.lower().rsplit(".", 1)[-1], braced_units)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [u for p, t in zip(pdf["path"], pdf["text"], strict=True) if t for u in of(p)(p, t)]
            yield pd.DataFrame(rows, columns=cols)

    code = [k for k, v in LANGUAGES.items() if v not in ("markdown", "yaml", "toml", "hcl")]
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(code)).select("path", "text").mapInPandas(run, SCHEMA)


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of files (path, text) by the chunker of their language, as SCHEMA has them; tags hold the language."""
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    known = files.where(F.col("text").isNotNull()).withColumn("lang_", language(F.col("path")))
    out = code_units(known).select(cols).withColumn("tags", F.array_sort(F.array_distinct(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce(language(F.col("path")), F.lit(""))))))
    for lang, f in (("markdown", markdown_sections), ("yaml", yaml_sections), ("toml", toml_sections), ("hcl", hcl_blocks)):
        none = F.lit(None).cast("string")
        own = f(known.where(F.col("lang_") == lang)).withColumns({"parent": none, "docstring": none, "tags": F.array(F.lit(lang))})
        out = out.unionByName(own.select(cols))
    return out


def weight(text: str) -> int:
    return sum(not c.isspace() for c in text)


def pack(weights: list[int], joined: list[bool], budget: int = BUDGET) -> list[int]:
    """Group numbers of consecutive items: an item joins the group before if joined (no hole between) and the budget holds."""
    out, group, held = [], -1, 0
    for w, j in zip(weights, joined, strict=True):
        if group < 0 or not j or held + w > budget:
            group, held = group + 1, 0
        held += w
        out.append(group)
    return out


def merge_file(text: str, units: list[dict], budget: int = BUDGET) -> list[dict]:
    """A file's units merged: outer units kept whole with what they hold, lines between them caught, neighbours packed to budget.

    Every line that is not blank is in a chunk; ranges of chunks are disjoint or nested. Names of merged units join with ' + ';
    equal kinds stay, others become merged.
    """
    lines = text.split("\n")
    units = sorted(units, key=lambda u: (u["start_line"], -u["end_line"]))
    tops, inner, end = [], [], 0
    for u in units:
        if u["start_line"] > end:
            tops.append(u)
            end = u["end_line"]
        elif u["end_line"] <= end:
            inner.append(u)
    parts, at = [], 1
    for u in [*tops, None]:
        stop = u["start_line"] - 1 if u else len(lines)
        gap = "\n".join(lines[at - 1 : stop])
        if gap.strip():
            a, b = at, stop
            while not lines[a - 1].strip():
                a += 1
            while not lines[b - 1].strip():
                b -= 1
            parts.append({"start_line": a, "end_line": b, "kind": "module", "name": None, "tags": []})
        if u:
            parts.append(u)
            at = u["end_line"] + 1
    body = lambda a, b: "\n".join(lines[a - 1 : b])
    groups: dict[int, list[dict]] = {}
    joined = [i > 0 and not body(parts[i - 1]["end_line"] + 1, p["start_line"] - 1).strip() for i, p in enumerate(parts)]
    for p, g in zip(parts, pack([weight(body(p["start_line"], p["end_line"])) for p in parts], joined, budget), strict=True):
        groups.setdefault(g, []).append(p)
    out = []
    for g in groups.values():
        if len(g) == 1:
            out.append({**g[0], "text": body(g[0]["start_line"], g[0]["end_line"])})
            out += [i for i in inner if weight(body(g[0]["start_line"], g[0]["end_line"])) > budget and g[0]["start_line"] <= i["start_line"] and i["end_line"] <= g[0]["end_line"]]
            continue
        kinds, names = {p["kind"] for p in g}, [p["name"] for p in g if p.get("name")]
        tags = {t for p in g for t in p.get("tags") or []} | ({"multi_chunk_merge"} if len(names) > 1 else set())
        out.append({"start_line": g[0]["start_line"], "end_line": g[-1]["end_line"], "kind": kinds.pop() if len(kinds) == 1 else "merged", "name": " + ".join(names) or None, "tags": sorted(tags), "text": body(g[0]["start_line"], g[-1]["end_line"])})
    return out


def merged_chunks(files: DataFrame, units: DataFrame, budget: int = BUDGET) -> DataFrame:
    """merge_file() over files (path, text) and their units (path, start_line, end_line, kind, name, tags); a task holds a file."""
    u = units.groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line", "kind", "name", "tags")).alias("units"))
    j = files.select("path", "text").join(u, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t, us in zip(pdf["path"], pdf["text"], pdf["units"], strict=True):
                own = [dict(x) | {"tags": list(x["tags"]) if x["tags"] is not None else []} for x in us] if us is not None else []
                rows += [{"path": p, "start_line": c["start_line"], "end_line": c["end_line"], "kind": c["kind"], "name": c.get("name"), "tags": list(c.get("tags") or []), "text": c.get("text")} for c in merge_file(t or "", own, budget)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "kind", "name", "tags", "text"])

    return j.mapInPandas(run, "path string, start_line int, end_line int, kind string, name string, tags array<string>, text string")


def token_batches(lengths: Column, budget: int) -> Column:
    """Batch numbers of an ordered array of texts' lengths: a batch holds at most budget tokens of four characters."""
    cost = lambda n: F.floor(n / 4).cast("long")
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("held"))

    def step(s: Column, n: Column) -> Column:
        new = (s["held"] > 0) & (s["held"] + cost(n) > budget)
        b = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.concat(s["out"], F.array(b)).alias("out"), b.alias("batch"), F.when(new, cost(n)).otherwise(s["held"] + cost(n)).alias("held"))

    return F.aggregate(lengths, start, step, lambda s: s["out"])


def embedding_text(head: Column, docstring: Column, siblings: Column, body: Column, most: int = 6000) -> Column:
    """What an embedder sees: header, at most 15 sibling names, 300 characters of docstring, body cut in the middle to most."""
    names = F.when(F.size(siblings) > 0, F.concat(F.lit("# Siblings: "), F.array_join(F.slice(siblings, 1, 15), ", ")))
    doc = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit('"""'), F.substring(docstring, 1, 300), F.lit('"""')))
    room = F.greatest(F.lit(most) - F.char_length(head), F.lit(0))
    part = F.floor(room / 2).cast("int")
    cut = F.when(F.char_length(body) > room, F.concat(F.substring(body, F.lit(1), part), F.lit("\n    # ...\n"), F.substring(body, F.char_length(body) - part + 1, part))).otherwise(body)
    return F.concat_ws("\n", head, names, doc, cut)
