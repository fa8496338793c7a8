"""Public symbols of source files: pure functions from a source text to rows. No Spark in here.

No grammar library is assumed: Python goes through ``ast``; Perl and Ruby are read line by line; the other languages
through one scanner that blanks comments and strings and knows brackets, so that broken files give partial results.
A row is a dict of ``name, kind, signature, line, visibility, parent_symbol, return_type, parameters``; callables have
a list of parameters, types have None.
"""

from __future__ import annotations

import ast
import re

EXTENSIONS_BY_KIND = {"npm": ["ts", "tsx", "js", "jsx"], "go": ["go"], "cargo": ["rs"], "python": ["py"], "maven": ["java", "kt"], "gradle": ["java", "kt"], "perl": ["pm", "pl"], "ruby": ["rb"]}


def row(name, kind, signature, line, parent=None, returns=None, parameters=None, visibility="public") -> dict:
    return {"name": name, "kind": kind, "signature": signature, "line": line, "visibility": visibility, "parent_symbol": parent, "return_type": returns, "parameters": parameters}


def blanked(source: str, quotes: str = "\"'`", hash_comments: bool = False, raw: str = "") -> str:
    """The source with comments and the inside of strings as spaces; places and lines stay."""
    out, i, n = list(source), 0, len(source)

    def wipe(a, b):
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two = "" if hash_comments else source[i : i + 2]
        if two == "//" or hash_comments and source[i] == "#":
            end = source.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif two == "/*":
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            wipe(i, end)
            i = end
        elif source[i] in quotes:
            quote = source[i] * 3 if source[i : i + 3] == source[i] * 3 and (source[i] == '"' or hash_comments) else source[i]
            if quote == "'" and raw == "rust" and not re.match(r"'(?:\\.[^']*|[^\\'])'", source[i : i + 12]):
                i += 1
                continue
            j = i + len(quote)
            while j < n and not source.startswith(quote, j):
                if source[j] == "\\":
                    j += 1
                elif source[j] == "\n" and quote in ("'", '"'):
                    break
                j += 1
            wipe(i + 1, j)
            i = j + len(quote)
        else:
            i += 1
    return "".join(out)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Place after the bracket that closes the one at ``at``; the end if there is none."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == pair[0]:
            depth += 1
        elif text[k] == pair[1]:
            depth -= 1
            if depth == 0:
                return k + 1
    return len(text)


def split(text: str, by: str = ",") -> list[str]:
    """Parts of a list outside brackets."""
    out, depth, held = [], 0, ""
    for k, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[k - 1 : k] not in ("-", "="):
            depth -= 1
        if c == by and depth <= 0:
            out.append(held)
            held = ""
        else:
            held += c
    return [x.strip() for x in [*out, held] if x.strip()]


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def joined(text: str) -> str:
    """The lines of a text, as one."""
    return " ".join(text.splitlines()).strip()


def head(text: str, by: str = ":=") -> tuple[str, str | None, str]:
    """A declaration at its first character of ``by`` outside brackets: what comes before, that character, what follows."""
    depth = 0
    for k, c in enumerate(text):
        if c in by and depth == 0 and not (c == ":" and ":" in (text[k + 1 : k + 2], text[k - 1 : k])) and text[k : k + 2] != "=>":
            return text[:k].strip(), c, text[k + 1 :].strip()
        depth += (c in "([{<") - (c in ")]}" or c == ">" and text[k - 1 : k] not in ("-", "="))
    return text.strip(), None, ""


def statements(clean: str, at: int, end: int, newlines: bool = False):
    """``(start, stop)`` of the statements between two places: up to a semicolon or the end of a block outside brackets,
    and with ``newlines`` to the end of a line that the next one doesn't go on."""
    start, depth = None, 0
    for k in range(at, end):
        c = clean[k]
        if start is None:
            if c.isspace() or c == ";":
                continue
            start = k
        depth += (c in "([{") - (c in ")]}")
        done = depth == 0 and c in ";}"
        if c == "}" and depth == 0 and re.match(r"\s*[,;=.)\]|&]", clean[k + 1 : end]):
            done = False
        if newlines and c == "\n" and depth == 0 and not re.match(r"\s*[=.{:|&?),]", clean[k + 1 : end]) and not re.search(r"[=,:|&(]\s*$", clean[max(start, k - 40) : k]):
            done = True
        if done:
            yield start, k + 1
            start = None
    if start is not None:
        yield start, end


def line_of(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def depths(clean: str) -> list[int]:
    """Brace depth before each character."""
    out, d = [], 0
    for c in clean:
        out.append(d)
        d += (c == "{") - (c == "}")
    return out


# TypeScript and JavaScript

_EXPORT = re.compile(r"\bexport\s+(default\s+)?(async\s+)?(function(?!\s*\*)|class|interface|type|enum|const\s+enum|const|let)\b\s*([\w$]*)")
_DECORATORS = re.compile(r"(?:@[\w$.]+(?:\([^()]*\))?\s*)+")
_MEMBER = re.compile(r"((?:(?:public|private|protected|static|readonly|async|override|abstract|declare|accessor|get|set)\b\s*(?![(=:;?!]))*)\*?\s*(#?[\w$]+|\[[^\]]*\]|\"[^\"]*\"|'[^']*')\s*[?!]?\s*(?:<[^(]*?>\s*)?([(:=;]?)")


def _ts_parameters(text: str, typed: bool) -> list[dict]:
    out = []
    for p in split(text):
        p = _DECORATORS.sub("", p)
        p = re.sub(r"^((public|private|protected|readonly|override)\s+)+", "", p)
        name, mark, rest = head(p)
        if typed:
            kind = head(rest, "=")[0] if mark == ":" else None
            out.append({"name": name.rstrip("? "), "type": kind or None})
        elif mark is None and re.fullmatch(r"[\w$]+", name):
            out.append({"name": name, "type": None})
    return out


def _ts_callable(source: str, clean: str, at: int) -> tuple[str, str | None, int, int] | None:
    """Parameters' text, return type, and the places where the parameters and the head end, from the bracket at or after
    ``at``."""
    start = clean.find("(", at)
    if start < 0:
        return None
    end = closing(clean, start, "()")
    returns, stop = None, end
    m = re.compile(r"\s*:\s*").match(clean, end)
    if m:
        depth, k = 0, m.end()
        while k < len(clean):
            c = clean[k]
            if c == "{" and depth == 0 and clean[m.end() : k].strip():
                break
            if c in "([{<":
                depth += 1
            elif c in ")]}" or c == ">" and clean[k - 1] != "=":
                if depth == 0:
                    break
                depth -= 1
            elif c in ";\n" and depth == 0 and (c == ";" or clean[m.end() : k].strip()):
                break
            k += 1
        returns = source[m.end() : k].strip() or None
        stop = m.end() + len(source[m.end() : k].rstrip())
    return source[start + 1 : end - 1], returns, end, stop


def typescript(source: str, typed: bool = True) -> list[dict]:
    clean, out = blanked(source), []
    depth = depths(clean)
    for m in _EXPORT.finditer(clean):
        if depth[m.start()] != 0:
            continue
        default, keyword, name = m[1], "enum" if "enum" in m[3] else m[3], m[4]
        start = m.start(2) if m[2] else m.start(3)
        line = line_of(source, start)
        brace = clean.find("{", m.end())
        if keyword == "function" and name:
            found = _ts_callable(source, clean, m.end())
            if found:
                out.append(row(name, "function", joined(source[start : found[3]]), line, None, found[1], _ts_parameters(found[0], typed)))
        elif keyword == "class" and name:
            out.append(row(name, "class", f"class {name}", line))
            if brace > 0:
                out += _ts_members(source, clean, brace, name, typed)
        elif keyword == "interface" and name or keyword == "enum" and name and not default:
            out.append(row(name, keyword, f"{keyword} {name}", line))
        elif keyword == "type" and name and not default:
            out.append(row(name, "type", source[start:].split("\n")[0].rstrip(), line))
        elif keyword in ("const", "let") and not default:
            end = next(statements(clean, start, len(clean), newlines=True))[1]
            first, at = source[start:end].split("\n")[0].rstrip(), m.end(3)
            for part in split(clean[at:end].rstrip().rstrip(";")):
                at = clean.index(part, at)
                own = head(source[at : at + len(part)])[0].rstrip("!")
                if own:
                    out.append(row(own, "constant", first, line_of(source, at)))
                at += len(part)
    return out


def _ts_members(source, clean, brace, parent, typed) -> list[dict]:
    """Methods with a body, and in TypeScript fields, which read as methods without parameters."""
    out, end = [], closing(clean, brace) - 1
    for start, stop in statements(clean, brace + 1, end, newlines=True):
        decorated = _DECORATORS.match(clean, start, stop)
        at = decorated.end() if decorated else start
        m = _MEMBER.match(source, at, stop)
        if not m or m[2][0] == "#" or {"private", "protected"} & set(m[1].split()):
            continue
        name, line = m[2], line_of(source, at)
        if m[3] == "(":
            found = _ts_callable(source, clean, m.start(3))
            if clean[found[3] : stop].lstrip().startswith("{"):
                text = source[clean.index("(", m.start(3)) : found[2]]
                out.append(row(name, "method", f"{name}{text}" + (f": {found[1]}" if found[1] else ""), line, parent, found[1], _ts_parameters(found[0], typed)))
        elif typed and clean[at : at + 1] != "{" and m[1].strip() != "static" or typed and m[3] in ("=", ":", ";"):
            out.append(row(name, "method", f"{name}()", line_of(source, start), parent, None, []))
    return out


def javascript(source: str) -> list[dict]:
    return typescript(source, typed=False)


# Go

_GO_FUNC = re.compile(r"^func\s*(\(\s*(?:\w+\s+)?(\*?)\s*(\w+(?:\[[^\]]*\])?)[^)]*\))?\s*(\w+)\s*(?:\[[^\]]*\])?\s*\(", re.M)
_GO_TYPE = re.compile(r"^(?:type\s+|\t)(\w+)(?:\[[^\]=]*\])?\s+(struct\b|interface\b|[^\s=(][^\n]*)", re.M)

# How a type that is neither struct nor interface reads in a signature, by how it begins.
_GO_KINDS = ((r"func\b", "function"), (r"map\[", "map"), (r"\[\]", "slice"), (r"\[", "array"), (r"\*", "pointer"), (r"chan\b|<-", "channel"), (r"\(", "parenthesized"), (r"\w+\.\w", "qualified"), (r"\w+\[", "generic"), ("", "type_identifier"))


def go(source: str) -> list[dict]:
    clean, out = blanked(source), []
    depth = depths(clean)
    for m in _GO_FUNC.finditer(clean):
        name = m[4]
        if depth[m.start()] or not name[0].isupper():
            continue
        end = closing(clean, m.end() - 1, "()")
        body = clean.find("{", end)
        newline = clean.find("\n", end)
        stop = min(x for x in (body, newline, len(clean)) if x >= 0)
        returns = source[end:stop].strip() or None
        parameters = [{"name": p[0], "type": p[1]} for p in _go_groups(source[m.end() : end - 1])]
        out.append(row(name, "method" if m[1] else "function", source[m.start() : stop].strip(), line_of(source, m.start()), m[3] if m[1] else None, returns, parameters))
    grouped = [(m.end(), closing(clean, m.end() - 1, "()")) for m in re.finditer(r"^type\s*\(", clean, re.M)]
    for m in _GO_TYPE.finditer(clean):
        inside = any(a <= m.start() < b for a, b in grouped)
        if depth[m.start()] or not m[1][0].isupper() or not (m[0].startswith("type") or inside):
            continue
        kind = m[2].strip() if m[2].strip() in ("struct", "interface") else "type"
        text = f"type {m[1]} {kind if kind != 'type' else next(k for x, k in _GO_KINDS if re.match(x, m[2]))}"
        out.append(row(m[1], kind, text, line_of(source, m.start())))
    return sorted(out, key=lambda r: r["line"])


def _go_groups(text: str) -> list[tuple[str, str]]:
    """First name and type of each group of parameters; variadic ones are left out."""
    out, names = [], []
    for p in split(text):
        words = p.split(None, 1)
        names.append(words[0])
        if len(words) == 2:
            if not words[1].startswith("..."):
                out.append((names[0], flat(words[1])))
            names = []
    return out


# Rust

_RUST = re.compile(r"\bpub(?:\s*\([^)]*\))?\s+(?:(?:async|const|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(fn|struct|enum|trait)\s+(\w+)")
_RUST_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b\s*(<[^{]*?>)?\s*([^{]*?)\s*\{", re.M)


def rust(source: str) -> list[dict]:
    clean, out = blanked(source, '"\'', raw="rust"), []
    depth = depths(clean)
    owners = []
    for m in _RUST_IMPL.finditer(clean):
        if depth[m.start()] == 0:
            kind = re.split(r"\bwhere\b", m[2])[0]
            owners.append((m.end() - 1, closing(clean, m.end() - 1), flat(kind.split(" for ")[-1])))
    for m in _RUST.finditer(clean):
        kind, name, line = m[1], m[2], line_of(source, m.start())
        owner = next((o for a, b, o in owners if a < m.start() < b), None)
        if depth[m.start()] != (1 if owner else 0) or owner and kind != "fn":
            continue
        if kind != "fn":
            out.append(row(name, kind, f"pub {kind} {name}", line))
            continue
        start = clean.find("(", m.end())
        end = closing(clean, start, "()")
        stop = min(x for x in (clean.find("{", end), clean.find(";", end), len(clean)) if x >= 0)
        arrow = re.match(r"\s*->\s*(.*?)\s*(?:\bwhere\b.*)?$", source[end:stop], re.S)
        parameters = []
        for p in split(source[start + 1 : end - 1]):
            own, mark, told = head(re.sub(r"^(#\[[^\]]*\]\s*)*(mut\s+)?", "", p), ":")
            if mark and own != "self":
                parameters.append({"name": own, "type": told})
        last = end + arrow.end(1) if arrow else end
        out.append(row(name, "method" if owner else "function", source[m.start() : min(stop, last + 200)].strip(), line, owner, arrow[1] if arrow else None, parameters))
    return out


# Python

def python(source: str) -> list[dict]:
    """Top-level functions and classes with their methods. Where a file can't be parsed as a whole, its top-level blocks
    are parsed one by one, and those that can't are left out."""
    lines = source.splitlines(keepends=True)
    try:
        blocks = [(0, ast.parse(source))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        starts = [k for k, x in enumerate(lines) if re.match(r"(?:async\s+def|def|class)\b", x)]
        blocks = []
        for a, b in zip(starts, [*starts[1:], len(lines)], strict=False):
            if next((x for x in reversed(lines[:a]) if x.strip()), "").startswith("@"):
                continue
            while b > a + 1 and not (lines[b - 1].strip() and lines[b - 1][0].isspace()):
                b -= 1
            try:
                blocks.append((a, ast.parse("".join(lines[a:b]))))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
    clean = blanked(source, "\"'", hash_comments=True)
    begins = [0]
    for x in lines:
        begins.append(begins[-1] + len(x))
    out: list[dict] = []

    def place(line, column):
        return begins[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    def function(node, shift, parent=None):
        text = lambda x: None if x is None else source[place(x.lineno + shift, x.col_offset) : place(x.end_lineno + shift, x.end_col_offset)]
        a = node.args
        given = [(x.arg, x) for x in (*a.posonlyargs, *a.args)] + [("*" + x.arg, x) for x in (a.vararg,) if x and x.annotation] + [(x.arg, x) for x in a.kwonlyargs] + [("**" + x.arg, x) for x in (a.kwarg,) if x and x.annotation]
        parameters = [{"name": name, "type": text(x.annotation)} for name, x in given if not (parent and name == "self")]
        start = place(node.lineno + shift, node.col_offset)
        opened = clean.find("(", re.compile(r"(?:async\s+)?def\s+\w+\s*(?:\[[^(]*\])?").match(clean, start).end())
        signature = f"def {node.name}{source[opened : closing(clean, opened, '()')]}" + (f" -> {text(node.returns)}" if node.returns else "")
        return row(node.name, "method" if parent else "function", signature, node.lineno + shift, parent, text(node.returns), parameters)

    for shift, tree in blocks:
        for node in tree.body:
            if getattr(node, "decorator_list", None):
                continue
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(function(node, shift))
            elif isinstance(node, ast.ClassDef):
                out.append(row(node.name, "class", f"class {node.name}", node.lineno + shift))
                for x in node.body:
                    if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and not x.decorator_list and (x.name == "__init__" or not x.name.startswith("_")):
                        out.append(function(x, shift, node.name))
    return out


# Protocol buffers

def proto(source: str) -> list[dict]:
    clean, out = blanked(source, "\"'"), []

    def walk(at, end, parent):
        pattern = re.compile(r"\b(message|service|enum|oneof|rpc)\s+(\w+)")
        while m := pattern.search(clean, at, end):
            kind, name, line = m[1], m[2], line_of(source, m.start())
            full = f"{parent}.{name}" if parent else name
            if kind == "rpc":
                head = re.compile(r"\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)").match(clean, m.end())
                at = m.end()
                if head:
                    asks, gives = ("stream " * bool(head[1]) + head[2]), ("stream " * bool(head[3]) + head[4])
                    out.append(row(name, "method", f"rpc {name}({asks}) returns ({gives})", line, parent, gives, [{"name": "request", "type": asks}]))
                    at = head.end()
                continue
            brace = re.compile(r"\s*\{").match(clean, m.end())
            if not brace:
                at = m.end()
                continue
            close = closing(clean, brace.end() - 1)
            told = {"message": "struct", "service": "interface", "enum": "enum", "oneof": "type"}[kind]
            out.append(row(name, told, f"{kind} {full}" if kind != "service" else f"service {name}", line, parent))
            if kind in ("message", "service"):
                walk(brace.end(), close - 1, name)
            at = close

    walk(0, len(clean), None)
    return out


# Java

_ANNOTATED = r"(?:@(?!interface)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?\s+)*"
_JAVA_TYPE = re.compile(rf"{_ANNOTATED}((?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+{_ANNOTATED})+)(class|interface|enum)\s+(\w+)")
_JAVA_MEMBER = re.compile(rf"{_ANNOTATED}((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|transient|volatile|strictfp)\s+{_ANNOTATED})+)(<[^(]*?>\s*)?([\w.<>\[\],?& ]+?)\s+(\w+)\s*(\(|=|;|,|\[)")


def java(source: str) -> list[dict]:
    clean, out = blanked(source, "\"'"), []
    depth = depths(clean)
    for m in _JAVA_TYPE.finditer(clean):
        words = set(re.findall(r"\b\w+", re.sub(r"@[\w.]+", "", m[1])))
        seen = next((v for v in ("public", "protected") if v in words and "private" not in words), None)
        if depth[m.start()] or not seen:
            continue
        brace = clean.find("{", m.end())
        brace = len(clean) if brace < 0 else brace
        out.append(row(m[3], m[2], source[m.start() : brace].strip(), line_of(source, m.start()), visibility=seen))
        if m[2] != "class":
            continue
        end = closing(clean, brace) - 1 if brace < len(clean) else brace
        for start, stop in statements(clean, brace + 1, end):
            x = _JAVA_MEMBER.match(clean, start, stop)
            marks = set(re.findall(r"\b\w+", re.sub(r"@[\w.]+", "", x[1]))) if x else set()
            own = next((v for v in ("public", "protected") if v in marks and "private" not in marks), None)
            if not own or x[3].split()[0] in ("class", "interface", "enum", "record"):
                continue
            line, told = line_of(source, start), source[x.start(3) : x.end(3)]
            if x[5] == "(":
                close = closing(clean, x.end() - 1, "()")
                body = clean.find("{", close, stop)
                parameters = []
                for p in split(source[x.end() : close - 1]):
                    part = re.match(r"(?:@[\w.]+(?:\([^)]*\))?\s+|final\s+)*(.+?)\s+(\w+)$", p, re.S)
                    if part and not part[1].endswith("..."):
                        parameters.append({"name": part[2], "type": part[1]})
                out.append(row(x[4], "function" if "static" in marks else "method", source[start : body if body >= 0 else stop].strip(), line, m[3], told, parameters, own))
            elif {"static", "final"} <= marks:
                out.append(row(x[4], "constant", f"public static final {told} {x[4]}", line, m[3], visibility=own))
    return out


# Kotlin

_KOTLIN = re.compile(r"(?:^|(?<=[{};\n]))[ \t]*((?:@[\w.]+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|protected|open|abstract|sealed|data|inner|enum|annotation|override|suspend|inline|operator|infix|tailrec|final|const|external|value|fun(?=\s+interface))\s+)*)(class|interface|object|fun)\s+(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?(\w+)", re.M)


def kotlin(source: str) -> list[dict]:
    clean, out = blanked(source, "\"'"), []
    depth = depths(clean)
    types: list[tuple[int, int, str]] = []
    for m in _KOTLIN.finditer(clean):
        marks, keyword, name = m[1].split(), m[2], m[3]
        start = m.start(1) if m[1] else m.start(2)
        owner = next((n for a, b, n in types if a < m.start(2) < b), None)
        if depth[m.start(2)] != (1 if owner else 0) or {"private", "internal"} & set(marks) or owner and keyword != "fun":
            continue
        line = line_of(source, start)
        if keyword == "fun":
            bracket = clean.find("(", m.end())
            if bracket < 0:
                continue
            end = closing(clean, bracket, "()")
            stop = min(x for x in (clean.find("{", end), clean.find("=", end), clean.find("\n", end), clean.find("}", end), len(clean)) if x >= 0)
            returns = re.match(r"\s*:\s*(.+)", re.split(r"\bwhere\b", source[end:stop])[0], re.S)
            parameters = [{"name": p[1], "type": head(p[2], "=")[0]} for x in split(source[bracket + 1 : end - 1]) if (p := re.match(r"(?:@\w+\s+)*(?:(?:vararg|noinline|crossinline)\s+)*(\w+)\s*:\s*(.+)", x, re.S))]
            out.append(row(name, "method" if owner else "function", source[start:stop].strip(), line, owner, returns[1].strip() if returns else None, parameters))
            continue
        brace = next((k for k in range(m.end(), len(clean)) if clean[k] in "{\n" and clean.count("(", m.end(), k) == clean.count(")", m.end(), k)), len(clean))
        kind = "enum" if "enum" in marks else "interface" if keyword == "interface" else "class"
        out.append(row(name, kind, f"{'enum class' if kind == 'enum' else keyword} {name}", line))
        if clean[brace : brace + 1] == "{":
            types.append((brace, closing(clean, brace), name))
    return out


# Perl and Ruby

def perl(source: str) -> list[dict]:
    out, scope = [], None
    for n, line in enumerate(source.splitlines(), 1):
        if m := re.match(r"\s*package\s+([\w:]+)", line):
            scope = m[1]
            out.append(row(scope, "class", f"package {scope}", n))
        elif (m := re.match(r"\s*sub\s+(\w+)", line)) and not m[1].startswith("_"):
            out.append(row(m[1], "method" if scope else "function", f"sub {scope}::{m[1]}" if scope else f"sub {m[1]}", n, scope))
    return out


def _ruby_parameters(text: str | None) -> list[dict]:
    out = []
    for p in split(text or ""):
        p = p.split("=")[0].strip()
        mark = re.match(r"\*\*|\*|&", p)
        name = p[len(mark[0]) if mark else 0 :].rstrip(":").split(":")[0].strip()
        if name:
            out.append({"name": name, "type": mark[0] if mark else None})
    return out


def ruby(source: str) -> list[dict]:
    out, scopes, depth = [], [], 0
    for n, line in enumerate(source.splitlines(), 1):
        bare = line.strip()
        if m := re.match(r"(class|module)\s+([\w:]+)(?:\s*<\s*([\w:]+))?", bare):
            parent = scopes[-1][0] if scopes else None
            out.append(row(m[2], "class", f"{m[1]} {m[2]}" + (f" < {m[3]}" if m[3] else ""), n, parent))
            depth += 1
            scopes.append((m[2], depth))
        elif m := re.match(r"def\s+(self\.)?(\w+[?!=]?)\s*(?:\(([^)]*)\)|([^=;#]*))?", bare):
            parent = scopes[-1][0] if scopes else None
            kind = "function" if m[1] or not parent else "method"
            given = m[3] if m[3] is not None else (m[4] or "").strip()
            out.append(row(m[2], kind, f"def {m[1] or ''}{m[2]}" + (f"({given})" if given else ""), n, parent, None, _ruby_parameters(given)))
            depth += 1
        elif bare == "end":
            if scopes and scopes[-1][1] == depth:
                scopes.pop()
            depth = max(0, depth - 1)
    return out


EXTRACTORS = {"ts": typescript, "tsx": typescript, "js": javascript, "jsx": javascript, "go": go, "rs": rust, "py": python, "java": java, "kt": kotlin, "proto": proto, "pm": perl, "pl": perl, "rb": ruby}
# Directories and file names that hold no sources of their own.
SKIPPED_DIRECTORIES = ("node_modules", "target", "dist", ".build", "vendor", "test", "tests", "__tests__", "__pycache__")
SKIPPED_FILES, SKIPPED_SUFFIXES = ("build.rs",), (".generated.ts", ".generated.js", ".pb.go", "_test.go", ".d.ts")


def extract(extension: str, source: bytes | str) -> list[dict]:
    """Symbols of one file; none for other extensions and for files that aren't UTF-8."""
    if isinstance(source, bytes):
        try:
            source = source.decode("utf-8")
        except UnicodeDecodeError:
            return []
    return EXTRACTORS[extension](source) if extension in EXTRACTORS else []
