"""Scalar text functions as Columns: tokens, globs, paths, snippets, boosts, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def name_tokens(text: Column) -> Column:
    """Words of a name: one split at each lower-upper border, _ and - as spaces, then lower-cased runs of letters and digits."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")
    return F.regexp_extract_all(F.lower(spaced), F.lit(f"({WORD})"), F.lit(1))


def fts_terms(query: Column) -> Column:
    """Terms of a full-text query: operators and control characters blanked, split at spaces, one-character terms dropped."""
    clean = F.regexp_replace(F.coalesce(query, F.lit("")), r'[?"*/\\(){}^~:+\-\x00-\x1F]', " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.char_length(t) > 1)


def fts_query(query: Column) -> Column:
    """The terms quoted and joined by OR; null if none is left (no lexical arm)."""
    t = fts_terms(query)
    return F.when(F.size(t) > 0, F.array_join(F.transform(t, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR "))


def stem(token: Column) -> Column:
    """The token without the first of tion, ing, ed, s that leaves three characters or more."""
    out = token
    for suffix in reversed(("tion", "ing", "ed", "s")):
        fits = token.endswith(suffix) & (F.char_length(token) > len(suffix) + 2)
        out = F.when(fits, F.substring(token, F.lit(1), F.char_length(token) - len(suffix))).otherwise(out)
    return out


def non_space_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))


def snippet(text: Column, limit: int = 160) -> Column:
    """The first line that is not blank, white space collapsed, cut to limit characters with an ellipsis."""
    line = F.coalesce(F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""), F.lit(0)), F.lit(""))
    return clip(F.trim(F.regexp_replace(line, r"\s+", " ")), limit)


def clip(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def preview(text: Column, limit: int = 200) -> Column:
    """The first limit characters, and an ellipsis where there are more."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: the double nearest to x times a power of ten, half away from zero. round() goes by the
    decimal digits that x is shown with, and so takes 77.195, which lies below the half, up."""
    return F.round(x.cast("double") * 10.0**digits, 0) / 10.0**digits


def chunk_id(path: Column, start: Column, end: Column, kind: Column, name: Column | None = None) -> Column:
    base = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), kind)
    return base if name is None else F.when(F.coalesce(name, F.lit("")) != "", F.concat(base, F.lit(":"), name)).otherwise(base)


def lexical_header(path: Column, kind: Column, parent: Column, name: Column) -> Column:
    """The line that precedes a chunk's text in the lexical arm."""
    full = F.when((F.coalesce(parent, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != ""), F.concat(parent, F.lit("."), name)).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.nullif(parent, F.lit(""))))
    return F.concat(F.lit("# From "), path, F.lit(" - "), F.concat_ws(" ", kind, full), F.lit("\n"))


def glob_regex(glob: str) -> str:
    """A shell glob as a regex over the whole string: * and ? cross slashes, [!x] negates."""
    out, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) >= 0:
            body = glob[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def matches_glob(path: Column, globs: str | list[str]) -> Column:
    """Whether the path (backslashes as slashes) or its last part matches one of the globs; an empty path never does."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    last = F.element_at(F.split(p, "/"), -1)
    hit = F.lit(False)
    for g in [globs] if isinstance(globs, str) else globs:
        hit = hit | p.rlike(glob_regex(g)) | last.rlike(glob_regex(g))
    return hit & (p != "")


def norm_path(path: Column) -> Column:
    """Slashes for backslashes, without leading ./ or / and trailing /."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"^(?:\./)+|^/+", ""), "/+$", "")


def same_file(target: Column, relative: Column, absolute: Column) -> Column:
    """Whether target names the chunk's file: its relative path, or a longer path that ends in it at a slash; where no relative
    path is stored, the absolute path or an end of it."""
    t, r, a = norm_path(target), norm_path(relative), norm_path(absolute)
    by_rel = (t == r) | (t.endswith(F.concat(F.lit("/"), r)) & F.startswith(F.coalesce(target, F.lit("")), F.lit("/")))
    return F.when(t == "", False).when(r != "", by_rel).when(a != "", (t == a) | a.endswith(F.concat(F.lit("/"), t))).otherwise(False)


def path_suffix_match(a: Column, b: Column) -> Column:
    """Equal, or either ends in the other (no slash needed)."""
    return (a == b) | a.endswith(b) | b.endswith(a)


def lines_overlap(start: Column, end: Column, low: Column | int, high: Column | int) -> Column:
    return start.isNull() | end.isNull() | ((end >= low) & (start <= high))


def name_boost(name: Column, query: Column, tokens: Column) -> Column:
    """1.4 for an equal name; by the share of the query's tokens in it 1.3, 1.2, 1.1 or 1.05; 1 for none or no name."""
    own = F.array_distinct(name_tokens(name))
    asked = F.array_distinct(tokens)
    share = F.size(F.array_intersect(own, asked)) / F.greatest(F.size(asked), F.lit(1))
    ratio = F.when(share >= 0.8, 1.3).when(share >= 0.5, 1.2).when(share >= 0.3, 1.1).when(share > 0, 1.05).otherwise(1.0)
    return F.when(F.coalesce(name, F.lit("")) == "", 1.0).when(F.lower(name) == F.lower(query), 1.4).otherwise(ratio)


def path_boost(path: Column, tokens: Column) -> Column:
    """1.05 and 0.05 more for each further query token in the lower-cased path; 1 for none."""
    parts = F.regexp_replace(F.lower(F.coalesce(path, F.lit(""))), r"[/\\]", " ")
    return F.lit(1.0) + F.size(F.array_intersect(F.array_distinct(name_tokens(parts)), F.array_distinct(tokens))) * F.lit(0.05)


# Fixed values in the next three functions: words that ask for tests or documentation, and paths that are tests or documentation.


def asks_tests(query: Column) -> Column:
    """Whether the query's first line asks for tests."""
    return F.coalesce(F.regexp_extract(query, r"^([^\r\n]*)", 1), F.lit("")).rlike(r"(?i)\b(?:test|tests|testing|spec|specs)\b")


def asks_docs(query: Column) -> Column:
    """Whether the query's first line asks for documentation."""
    return F.coalesce(F.regexp_extract(query, r"^([^\r\n]*)", 1), F.lit("")).rlike(r"(?i)\b(?:doc|docs|documentation|readme|guide|tutorial)\b")


def role_boost(path: Column, asks_tests: Column, asks_docs: Column) -> Column:
    """0.82 for tests or documentation unless the query asks for them (a test in a documentation folder counts as either)."""
    p = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))
    base = F.element_at(F.split(p, "/"), -1)
    test = p.rlike(r"(?:^|/)tests?(?:/|$)") | base.startswith("test_") | base.rlike(r"(?:_test\.py|\.(?:test|spec)\.[^.]+)$")
    doc = p.rlike(r"(?:^|/)(?:doc|docs|documentation)(?:/|$)") | base.rlike(r"[^.]\.(?:md|rst)$")
    return F.when(test & ~asks_tests, 0.82).when(doc & ~asks_docs, 0.82).otherwise(1.0)


def body_of(path: Column, text: Column) -> Column:
    """The text that a content hash covers: front matter of Markdown files is left out."""
    close = F.locate("\n---", text, 4)
    strip = F.lower(path).rlike(r"\.(md|mdx|markdown)$") & text.startswith("---") & (close > 0)
    return F.when(strip, F.substring(text, close + 4, F.char_length(text))).otherwise(text)


def generation_id(repository: Column, revision: Column, dirty: Column) -> Column:
    return F.sha2(F.concat_ws("\0", repository, revision, dirty), 256)


def json_text(value: Column) -> Column:
    """A JSON string literal as compact JSON writes it, non-ASCII kept."""
    return F.when(value.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def stable_id(prefix: str, **fields: Column) -> Column:
    """prefix:v1:sha256 of compact JSON with sorted keys; numbers stay bare, strings are quoted, nulls are kept."""
    parts: list[Column] = []
    for i, (k, v) in enumerate(sorted(fields.items())):
        parts += [F.lit(("," if i else "") + f'"{k}":'), v]
    return F.concat(F.lit(f"{prefix}:v1:"), F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256))


def line_range(value: Column) -> Column:
    """'a-b' as (start, end); null where it is not two numbers with 1 <= start <= end."""
    fits = value.rlike(r"^\s*\d{1,9}\s*-\s*\d{1,9}\s*$")
    part = lambda n: F.trim(F.split_part(value, F.lit("-"), F.lit(n))).try_cast("int")
    return F.when(fits & (part(1) >= 1) & (part(2) >= part(1)), F.struct(part(1).alias("start"), part(2).alias("end")))


def judge_score(reply: Column) -> Column:
    """A judge's reply (JSON, maybe in a code fence) as a score of 0 to 10; a missing key is 0, an unreadable reply null."""
    body = F.trim(F.regexp_replace(reply, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    v = F.try_parse_json(body)
    raw = F.try_variant_get(v, "$.score", "double")
    there = F.get_json_object(body, "$.score")
    whole = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw)).cast("int")
    return F.when(v.isNull() | ~body.startswith("{"), None).when(there.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), whole)))


# Patterns of the six intents.
INTENTS = {
    "function_search": [r"\bfunction\b", r"\bdef\b", r"\bmethod\b", r"\bclass\b", r"how.*work", r"implement.*", r"algorithm.*"],
    "error_handling": [r"\berror\b", r"\bexception\b", r"\btry\b", r"\bcatch\b", r"handle.*error", r"exception.*handling"],
    "database": [r"\bdatabase\b", r"\bdb\b", r"\bquery\b", r"\bsql\b", r"\bmodel\b", r"\btable\b", r"connection"],
    "api": [r"\bapi\b", r"\bendpoint\b", r"\broute\b", r"\brequest\b", r"\bresponse\b", r"\bhttp\b", r"rest.*api"],
    "authentication": [r"\bauth\b", r"\blogin\b", r"\btoken\b", r"\bpassword\b", r"\bsession\b", r"authenticate", r"permission"],
    "testing": [r"\btest\b", r"\bmock\b", r"\bassert\b", r"\bfixture\b", r"unit.*test", r"integration.*test"],
}
# Words that make a short query a task, not a name.
ACTION_WORDS = ["find", "search", "get", "show", "list", "how", "what", "where", "when", "create", "build", "make", "handle", "process", "manage", "implement"]


def intents(query: Column, families: dict[str, list[str]] = INTENTS) -> Column:
    """Names of the families of which some pattern is in the lower-cased query, in their order."""
    return F.array_compact(F.array(*[F.when(F.lower(query).rlike("|".join(f"(?:{p})" for p in ps)), F.lit(k)) for k, ps in families.items()]))


def entity_like(query: Column, tokens: Column) -> Column:
    """At most three tokens, none of them an action word, and at most two unless the query is written in CamelCase."""
    actions = F.array(*[F.lit(x) for x in ACTION_WORDS])
    return (F.size(tokens) <= 3) & ~F.arrays_overlap(tokens, actions) & (query.rlike("[A-Z][a-z]+[A-Z]") | (F.size(tokens) <= 2))


def short_natural(query: Column) -> Column:
    """Fewer than five words, without shapes that only code has."""
    return (F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")) < 5) & ~query.rlike(r"[_(){}\[\].:/\\`]|[a-z][A-Z]|\b[A-Z]{2,}\b")


def remote_url(remote: Column) -> Column:
    """A repository's remote as https://host/path: scp form rewritten, credentials, query, fragment, .git and / dropped."""
    r = F.trim(remote)
    scp = F.regexp_replace(r, r"^(?:[^@/:]+@)?([^@/:]+):(?!//)(.+)$", "https://$1/$2")
    url = F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), r).otherwise(scp)
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    tail = F.substring(bare, F.char_length(head) + 1, F.char_length(bare))
    head = F.regexp_replace(head, r"^(?:ssh|git|http)://", "https://")
    return F.concat(head, F.regexp_replace(F.regexp_replace(tail, "/+$", ""), r"\.git$", ""))


def pipeline_version(parts: list[str]) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(F.array(*[F.lit(p) for p in parts])), "|")), 1, 16)


def repository_id(remote: Column, path: Column) -> Column:
    """sha256 of remote:<normalised url>, or of path:<path> where there is no remote."""
    has = F.coalesce(F.trim(remote), F.lit("")) != ""
    return F.sha2(F.when(has, F.concat(F.lit("remote:"), remote_url(remote))).otherwise(F.concat(F.lit("path:"), path)), 256)


def checkout_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("path:"), path), 256)


def project_id(path: Column, provider: Column) -> Column:
    """md5 of the path, with :provider where there is one."""
    return F.md5(F.when(F.coalesce(provider, F.lit("")) != "", F.concat(path, F.lit(":"), provider)).otherwise(path))


def claim_text(text: Column) -> Column:
    """A claim as its id sees it: white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def claim_token(text: Column) -> Column:
    return F.lower(claim_text(text))


def component_name(name: Column) -> Column:
    """Whether a name is a component's: it begins with a capital and is not all capitals."""
    return F.coalesce(name.rlike(r"^[A-Z]") & name.rlike(r"[a-z]"), F.lit(False))


def hook_name(name: Column) -> Column:
    """Whether a name is a hook's: use, then a capital."""
    return F.coalesce(name.rlike(r"^use[A-Z]"), F.lit(False))


def gold_match(path: Column, expected: Column) -> Column:
    """Whether a path is one of the expected ones or ends in one after a slash."""
    return F.exists(expected, lambda e: (path == e) | path.endswith(F.concat(F.lit("/"), e)))


def frame(label: bytes, payload: bytes) -> bytes:
    """label, NUL, the payload's length as 8 bytes (big end first), payload."""
    return label + b"\0" + len(payload).to_bytes(8, "big") + payload


def dirty_fingerprint(frames: list[tuple[bytes, bytes]]) -> str:
    """sha256 over the frames of a working tree's changes, in order; a clean tree has none."""
    import hashlib

    h = hashlib.sha256()
    for label, payload in frames:
        h.update(frame(label, payload))
    return h.hexdigest()


def staleness_warning(freshness: str | None, age_minutes: float | None = None) -> str | None:
    """What a caller is told where results may be older than the files; None where they are fresh."""
    if not freshness or freshness.startswith("fresh"):
        return None
    return f"results may be stale ({freshness})" + ("" if age_minutes is None else f": the index is {age_minutes:.0f} minutes old")


def terminal(state: str) -> bool:
    """Whether a job in this state has ended."""
    return state in ("completed", "failed", "cancelled")
