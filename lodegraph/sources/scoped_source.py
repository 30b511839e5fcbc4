"""Functions, classes and calls of languages that are written in braces, and of Ruby, by their scopes.

Comments and strings are blanked first, so that braces count.  What stands between the last statement's end and a brace tells
what the brace opens: a class, a function, or a plain block.  So methods have their class, nested functions their outer one, and a
body ends where its brace closes.  No grammar: what needs one (overloads, macros, generated code) is left as it is.
"""

from __future__ import annotations

import re

# Words that open scopes, words before a bracket that are no calls, and how a language says import.
KEYWORDS = frozenset("if for while switch catch return function func fn def fun class new match sizeof typeof await when guard using lock fixed foreach elseif else do try synchronized super this".split())
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_HASH = re.compile(r"#(?!\s*include)[^\n]*")
_CLASS = re.compile(r"\b(?:class|interface|struct|trait|enum|protocol|object|extension|record|union)\s+([A-Za-z_]\w*)")
_IMPL = re.compile(r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?([\w:]+)")
_BASES = re.compile(r"\b(?:extends|implements|with)\s+([^{]+?)(?=\b(?:extends|implements|with|where)\b|$)|(?<!:):(?!:)\s*([^{]+?)(?=\bwhere\b|$)", re.S)
_KEYWORD_FUNCTION = re.compile(r"\b(?:function|func|fn|fun)\b\s*\*?\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(?:<[^>(]*>\s*)?([A-Za-z_]\w*)?\s*(?:<[^>(]*>)?\s*\(")
_ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>\s*$", re.S)
_MEMBER = re.compile(r"(?:^|[\s*&>\]])(?:(\w+)::)?(~?[A-Za-z_]\w*)\s*(?:<[^>(]*>)?\s*\(", re.S)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_IMPORT = re.compile(
    r"^\s*import\s+(?:static\s+)?(?:[\w*{}\s,$]+\s+from\s+)?['\"]([^'\"\n]+)['\"]|\brequire\s*\(\s*['\"]([^'\"\n]+)['\"]|^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)(?:\.\*)?\s*;?\s*$|^\s*(?:pub\s+)?use\s+([A-Za-z_\\][\w:\\]*)|^\s*#\s*include\s*[<\"]([^>\"\n]+)|^\s*using\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;|^\s*require(?:_relative)?\s+['\"]([^'\"\n]+)",
    re.M,
)
_GO_IMPORTS = re.compile(r"^import\s*\((.*?)\)", re.S | re.M)
_RUBY = re.compile(r"^([ \t]*)(class|module|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)\s*(?:<\s*([\w:]+))?(?:\(([^)]*)\))?", re.M)


def _blanked(content: str, hash_comments: bool) -> str:
    space = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = _BLANK.sub(space, content)
    return _HASH.sub(space, text) if hash_comments else text


def _parameters(text: str, language: str) -> list[str]:
    """The names in a list of parameters, cut at commas outside brackets."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and text[k - 1 : k] not in "-=")
        if c == "," and depth == 0:
            parts.append(text[start:k])
            start = k + 1
    out = []
    for part in [*parts, text[start:]]:
        part = part.split("=")[0].strip()
        if not part:
            continue
        head = part.split(":")[0] if language in ("typescript", "javascript", "rust", "kotlin", "swift") else part
        words = re.findall(r"[A-Za-z_$]\w*", head)
        if words:
            out.append((words[0] if language in ("go",) else words[-1]).lstrip("$"))
    return out


def _doc(content: str, at: int) -> str:
    """The comment that ends right before a declaration."""
    before = content[:at].rstrip()
    if before.endswith("*/"):
        text = before[before.rfind("/*") + 2 : -2]
        return "\n".join(x.strip().lstrip("*").strip() for x in text.split("\n")).strip()
    lines = []
    for line in reversed(before.split("\n")):
        if not re.match(r"\s*(///?|#)", line):
            break
        lines.append(line.strip().lstrip("/#").strip())
    return "\n".join(reversed(lines))


def _arguments(header: str, at: int) -> tuple[int, str]:
    """Where the bracket that opens at `at` - 1 closes, and what it holds."""
    depth = 1
    for k in range(at, len(header)):
        depth += (header[k] == "(") - (header[k] == ")")
        if not depth:
            return k, header[at:k]
    return len(header), header[at:]


def _opened(header: str, in_class: bool, language: str):
    """What a header opens: ("class", name, bases) or ("function", name, class, parameters), or None."""
    if language == "rust" and (m := _IMPL.search(header)):
        return "class", m[2].split("::")[-1], [m[1]] if m[1] else []
    m = _KEYWORD_FUNCTION.search(header)
    if m and m[2]:
        return "function", m[2], m[1] if language == "go" else None, _arguments(header, m.end())[1]
    if c := _CLASS.search(header):
        rest = re.sub(r"<[^<>]*>|\([^()]*\)", "", header[c.end() :])
        bases = [b.split()[-1] for m in _BASES.finditer(rest) for b in (m[1] or m[2] or "").split(",") if b.split()]
        return "class", c[1], [b for b in bases if re.fullmatch(r"[\w.:]+", b)]
    if a := _ARROW.search(header):
        inside = re.search(r"\(([^)]*)\)\s*(?::[^=]+)?=>\s*$", header, re.S)
        return "function", a[1], None, inside[1] if inside else ""
    for m in _MEMBER.finditer(header):
        close, inside = _arguments(header, m.end())
        if m[2] in KEYWORDS or "=" in header[: m.start()] or (not in_class and not header[: m.start(2)].strip()):
            continue
        if re.fullmatch(r"[\s\w:<>,\[\]|&.?*()]*", header[close + 1 :]):
            return "function", m[2], m[1], inside
    return None


def scopes(content: str, language: str) -> list[dict]:
    """kind, name, outer (names of the scopes around), bases, parameters, start, end, header of each class and function."""
    if language == "ruby":
        return _ruby(content)
    text = _blanked(content, language == "php")
    out, stack, begin, round_ = [], [], 0, 0
    for m in re.finditer(r"[{}();]", text):
        c, at = m[0], m.start()
        if c in "()":
            round_ = max(0, round_ + (1 if c == "(" else -1))
        elif c == ";" and not round_:
            begin = at + 1
        elif c == "{":
            header = text[begin:at]
            around = next((s for s in reversed(stack) if s), None)
            found = _opened(header, bool(around and around["kind"] == "class"), language) if not round_ or "=>" in header else None
            scope = None
            if found:
                lead = len(header) - len(header.lstrip())
                outer = [s["name"] if s["kind"] == "class" else s["name"] + ".<locals>" for s in stack if s]
                outer = outer + [found[2]] if found[0] == "function" and found[2] and found[2] not in outer else outer
                scope = {"kind": found[0], "name": found[1], "outer": outer, "bases": found[2] if found[0] == "class" else [], "parameters": _parameters(found[3], language) if found[0] == "function" else [], "start": begin + lead, "end": len(content), "header": content[begin + lead : at].strip()}
                scope["method"] = bool(scope["kind"] == "function" and (around and around["kind"] == "class" or found[2]))
                out.append(scope)
            stack.append(scope)
            begin, round_ = at + 1, 0
        elif c == "}":
            if stack and (scope := stack.pop()):
                scope["end"] = at + 1
            begin, round_ = at + 1, 0
    return out


def _ruby(content: str) -> list[dict]:
    out, stack = [], []
    for m in _RUBY.finditer(_HASH.sub(lambda x: " " * len(x[0]), content)):
        indent = len(m[1])
        stack = [s for s in stack if s[0] < indent]
        close = re.compile(rf"^[ \t]{{0,{indent}}}end\b", re.M).search(content, m.end())
        kind = "function" if m[2] == "def" else "class"
        outer = [s[1]["name"] for s in stack if s[1]["kind"] == "class"]
        scope = {"kind": kind, "name": m[3], "outer": outer, "bases": [m[4]] if m[4] and kind == "class" else [], "parameters": _parameters(m[5] or "", "ruby"), "start": m.start() + indent, "end": close.end() if close else len(content), "header": m[0].strip(), "method": kind == "function" and bool(outer)}
        stack.append((indent, scope))
        out.append(scope)
    return out


def imports(content: str, language: str) -> list[str]:
    out = [next(g for g in m.groups() if g) for m in _IMPORT.finditer(content)]
    if language == "go":
        out += re.findall(r'"([^"\n]+)"', " ".join(m[1] for m in _GO_IMPORTS.finditer(content))) + re.findall(r'^import\s+(?:\w+\s+)?"([^"\n]+)"', content, re.M)
    return list(dict.fromkeys(out))


def called(content: str, scope: dict, all_scopes: list[dict], language: str) -> list[str]:
    """Names that a function calls itself, in order, without those of functions inside it."""
    body = _blanked(content, language in ("php", "ruby"))[scope["start"] + len(scope["header"]) : scope["end"]]
    shift = scope["start"] + len(scope["header"])
    for inner in all_scopes:
        if inner is not scope and inner["kind"] == "function" and scope["start"] < inner["start"] and inner["end"] <= scope["end"]:
            a, b = max(0, inner["start"] - shift), inner["end"] - shift
            body = body[:a] + " " * (b - a) + body[b:]
    return [c for c in _CALL.findall(body) if c not in KEYWORDS]
