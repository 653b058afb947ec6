"""Chunkers of Nix files: bindings by their braces, and options one by one."""

from __future__ import annotations

import re

_BINDING = re.compile(r"""^\s*((?:[A-Za-z_][\w'-]*|"[^"]*")(?:\.(?:[A-Za-z_][\w'-]*|"[^"]*"|\$\{[^}]*\}))*)\s*=(?!=)""")
_QUOTED = re.compile(r"""''(?:[^']|'(?!')|'''|''[$\\].)*''|"(?:\\.|[^"\\])*"|\#[^\n]*|/\*.*?\*/""", re.DOTALL)
_OPTION = re.compile(r"\s*[^=]+=\s*(?:lib\.)?mk(?:Enable|Package)?Option\b")
#: Lines of a binding that is a chunk, and the share of its lines that its inner chunks leave it.
NIX_LINES, NIX_SHARE = 5, 0.5


def whole_file(path: str, text: str) -> list[dict]:
    """One module of a file that is not blank."""
    return [{"path": path, "start_line": 1, "end_line": text.count("\n") + 1, "kind": "module", "name": None, "parent": None, "text": text, "docstring": None, "tags": []}] if text.strip() else []


def bindings(text: str) -> list[dict]:
    """All bindings of a file, in order: name (behind the name around it), start_line, end_line and level."""
    bare = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")
    lines, out, open_, depth = text.split("\n"), [], [], 0
    for i, line in enumerate(bare):
        m = _BINDING.match(lines[i]) if "=" in line else None
        if m:
            b = {"name": ".".join([*[x["name"] for x, _ in open_[-1:]], m[1]]), "start_line": i + 1, "end_line": i + 1, "level": len(open_)}
            out.append(b)
            open_.append((b, depth))
        for c in line:
            depth += (c in "{[(") - (c in "}])")
            while c == ";" and open_ and depth <= open_[-1][1]:
                open_.pop()[0]["end_line"] = i + 1
    for b, _ in open_:
        b["end_line"] = len(lines)
    return out


def nix_units(path: str, text: str) -> list[dict]:
    """Bindings of NIX_LINES lines or more; one that holds such bindings only if they cover under half of its lines. Options
    (mkOption, mkEnableOption) and services are kinds of their own; none: one module."""
    lines, length = text.split("\n"), lambda b: b["end_line"] - b["start_line"] + 1
    found, out = [b for b in bindings(text) if length(b) >= NIX_LINES], []
    for b in found:
        inner = [x for x in found if x["level"] == b["level"] + 1 and b["start_line"] <= x["start_line"] and x["end_line"] <= b["end_line"]]
        if inner and sum(map(length, inner)) >= NIX_SHARE * length(b):
            continue
        body = "\n".join(lines[b["start_line"] - 1 : b["end_line"]])
        kind = "option" if _OPTION.match(body) else "service_config" if re.search(r"(?:^|\.)services(?:\.|$)", b["name"]) else "binding"
        out.append({"path": path, "start_line": b["start_line"], "end_line": b["end_line"], "kind": kind, "name": b["name"], "parent": b["name"].rpartition(".")[0] or None, "text": body, "docstring": None, "tags": ["nix"]})
    return out or whole_file(path, text)


def nix_option_units(path: str, text: str) -> list[dict]:
    """One chunk for each option of a module, whatever its length, headed by its name, type, default and description. These are
    never merged with others."""
    lines, out = text.split("\n"), []
    for b in bindings(text):
        body = "\n".join(lines[b["start_line"] - 1 : b["end_line"]])
        if not _OPTION.match(body):
            continue
        facts = {k: m[1].strip() for k in ("type", "default", "description") if (m := re.search(rf"\b{k}\s*=\s*([^;]+);", body))}
        name = b["name"].removeprefix("options.")
        head = "\n".join([f"# Option: {name}", *[f"# {k.capitalize()}: {v}" for k, v in facts.items()]])
        out.append({"path": path, "start_line": b["start_line"], "end_line": b["end_line"], "kind": "option", "name": name, "parent": name.rpartition(".")[0] or None, "text": head + "\n" + body, "docstring": facts.get("description", "").strip("\"'") or None, "tags": ["nix", "option"]})
    return out
