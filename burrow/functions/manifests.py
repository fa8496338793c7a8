"""Package manifests: pure functions from a file's text to a package with its dependencies. No Spark in here.

A parser takes ``(text, directory, context)`` and returns a package dict with ``name, version, description, metadata``
and ``dependencies`` of ``(name, version_req, dep_kind)``; it raises ``ValueError`` for files that describe no package.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field


@dataclass
class Context:
    """What manifests elsewhere in the tree say about a workspace's members."""

    cargo: dict[str, str | None] = field(default_factory=dict)
    go: set[str] = field(default_factory=set)
    maven: dict[str, dict] = field(default_factory=dict)
    gradle: set[str] = field(default_factory=set)
    gradle_roots: dict[str, str | None] = field(default_factory=dict)


def dashed(directory: str) -> str:
    return directory.replace("/", "-")


def package(name, kind, version=None, description=None, dependencies=(), metadata=None) -> dict:
    return {"name": name, "kind": kind, "version": version, "description": description, "metadata": metadata, "dependencies": list(dependencies)}


def _text(value):
    return value if isinstance(value, str) else None


def npm(text: str, directory: str, context: Context) -> dict:
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("package.json holds no object")
    found = []
    for section, kind in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer")):
        listed = data.get(section)
        for name, version in (listed.items() if isinstance(listed, dict) else ()):
            version = _text(version)
            found.append((name, version.removeprefix("workspace:") if version else version, kind))
    return package(_text(data.get("name")) or dashed(directory), "npm", _text(data.get("version")), _text(data.get("description")), found)


def go_mod(text: str, directory: str, context: Context) -> dict:
    module = version = None
    found, block = [], False
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        words = line.split()
        if block and line == ")":
            block = False
        elif block or words[:1] == ["require"] and line != "require (":
            words = words if block else words[1:]
            if len(words) >= 2:
                found.append((words[0], words[1], "runtime"))
        elif line == "require (":
            block = True
        elif words[:1] == ["module"] and len(words) > 1:
            module = words[1]
        elif words[:1] == ["go"] and len(words) > 1:
            version = words[1]
    name = module.rsplit("/", 1)[-1] if module else dashed(directory)
    return package(name, "go", version, module, found, json.dumps({"go_workspace": True}, separators=(",", ":")) if directory in context.go else None)


def go_work(text: str) -> list[str]:
    """Directories of a workspace's members."""
    out, block = [], False
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if block and line == ")":
            block = False
        elif re.fullmatch(r"use\s*\(", line):
            block = True
        elif block and line:
            out.append(line.removeprefix("./"))
        elif line.startswith("use "):
            out.append(line[4:].strip().removeprefix("./"))
    return out


def _cargo_version(value, name: str, context: Context):
    if isinstance(value, dict):
        if value.get("workspace") is True and context.cargo:
            return context.cargo.get(name)
        return _text(value.get("version"))
    return _text(value)


def cargo(text: str, directory: str, context: Context) -> dict:
    data = tomllib.loads(text)
    own = data.get("package")
    if not isinstance(own, dict):
        raise ValueError("no [package] section")
    found = []
    for section, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
        listed = data.get(section)
        found += [(n, _cargo_version(v, n, context), kind) for n, v in (listed.items() if isinstance(listed, dict) else ())]
    return package(_text(own.get("name")) or dashed(directory), "cargo", _text(own.get("version")), _text(own.get("description")), found)


def cargo_workspace(text: str) -> dict[str, str | None]:
    listed = tomllib.loads(text).get("workspace", {}).get("dependencies", {})
    return {n: _text(v.get("version")) if isinstance(v, dict) else _text(v) for n, v in listed.items()}


_NAME = re.compile(r"[\w.\-]*")


def requirement(text: str) -> tuple[str, str | None]:
    """Name and version of a Python requirement, without extras and environment marker."""
    text = text.strip()
    name = _NAME.match(text)[0]
    rest = re.sub(r"^\s*\[[^\]]*\]", "", text[len(name) :]).split(";")[0].strip()
    return name, rest or None


def python(text: str, directory: str, context: Context) -> dict:
    own = tomllib.loads(text).get("project")
    own = own if isinstance(own, dict) else {}
    found = [(*requirement(x), "runtime") for x in own.get("dependencies", ()) if isinstance(x, str)]
    groups = own.get("optional-dependencies", {})
    found += [(*requirement(x), "dev") for g in (groups.values() if isinstance(groups, dict) else ()) for x in g if isinstance(x, str)]
    return package(_text(own.get("name")) or dashed(directory), "python", _text(own.get("version")), _text(own.get("description")), found)


def _xml(text: str) -> ET.Element:
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def _child(e: ET.Element | None, path: str) -> str | None:
    value = e.findtext(path) if e is not None else None
    return value.strip() or None if value else None


def maven_parent(text: str) -> tuple[str, dict] | None:
    """Key and context of a pom that has modules."""
    root = _xml(text)
    if root.find("modules/module") is None:
        return None
    group, artifact = _child(root, "groupId"), _child(root, "artifactId")
    managed = {f"{_child(d, 'groupId') or ''}:{_child(d, 'artifactId') or ''}": v for d in root.findall("dependencyManagement/dependencies/dependency") if (v := _child(d, "version"))}
    return f"{group or ''}:{artifact or ''}", {"group": group, "version": _child(root, "version"), "managed": managed}


def maven(text: str, directory: str, context: Context) -> dict:
    root = _xml(text)
    artifact = _child(root, "artifactId")
    if not artifact:
        raise ValueError("no artifactId")
    if root.find("modules/module") is not None and _child(root, "packaging") == "pom":
        raise ValueError("aggregator pom")
    above = root.find("parent")
    known = context.maven.get(f"{_child(above, 'groupId') or ''}:{_child(above, 'artifactId') or ''}", {}) if above is not None else {}
    group = _child(root, "groupId") or known.get("group") or _child(above, "groupId")
    version = _child(root, "version") or known.get("version") or _child(above, "version")
    own = {f"{_child(d, 'groupId') or ''}:{_child(d, 'artifactId') or ''}": v for d in root.findall("dependencyManagement/dependencies/dependency") if (v := _child(d, "version"))}
    managed, found = known.get("managed", {}) | own, []
    for d in root.findall("dependencies/dependency"):
        name = _child(d, "artifactId")
        if name:
            key = f"{_child(d, 'groupId') or ''}:{name}"
            found.append((key, _child(d, "version") or managed.get(key), {"test": "dev", "provided": "peer"}.get(_child(d, "scope") or "", "runtime")))
    name = f"{group}:{artifact}" if group else (dashed(directory) or artifact)
    return package(name, "maven", version, _child(root, "description"), found)


# Gradle configurations by the kind of dependency that they declare.
GRADLE = {"implementation": "runtime", "api": "runtime", "runtimeOnly": "runtime", "testImplementation": "dev", "testRuntimeOnly": "dev", "compileOnly": "peer", "testCompileOnly": "peer"}
_GRADLE_LINE = re.compile(rf"^\s*({'|'.join(GRADLE)})\b[\s(]*(?:(project)\s*\(\s*(?:path\s*[:=]\s*)?)?[\"']([^\"']+)[\"']", re.M)


def _property(text: str, name: str) -> str | None:
    m = re.search(rf"^\s*{name}\s*=?\s*[\"']([^\"']+)[\"']", text, re.M)
    return m[1] if m else None


def gradle(text: str, directory: str, context: Context) -> dict:
    group, found = _property(text, "group"), []
    for configuration, project, notation in _GRADLE_LINE.findall(text):
        if project:
            found.append((":" + notation.lstrip(":"), None, GRADLE[configuration]))
        else:
            parts = notation.split(":", 2)
            if len(parts) >= 2:
                found.append((f"{parts[0]}:{parts[1]}", parts[2] if len(parts) > 2 else None, GRADLE[configuration]))
    base = context.gradle_roots.get(directory) or (directory.rsplit("/", 1)[-1] if directory else "root")
    return package(f"{group}:{base}" if group else (dashed(directory) or base), "gradle", _property(text, "version"), None, found, json.dumps({"gradle_workspace": True}, separators=(",", ":")) if directory in context.gradle else None)


def gradle_settings(text: str) -> tuple[list[str], str | None]:
    """Directories of the included projects, and the root project's name."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    dirs = [x.strip(":").replace(":", "/") for m in re.finditer(r"^\s*include\b\s*\(?((?:\s*[\"'][^\"']+[\"']\s*,?)+)", text, re.M) for x in re.findall(r"[\"']([^\"']+)[\"']", m[1])]
    name = re.search(r"rootProject\.name\s*=\s*[\"']([^\"']+)[\"']", text)
    return dirs, name[1] if name else None


def cpanfile(text: str, directory: str, context: Context) -> dict:
    found, depth, inside = [], 0, False
    for line in text.splitlines():
        if re.match(r"\s*on\s+'test'\s*=>\s*sub\s*\{", line):
            inside, depth = True, 0
        if inside:
            depth += line.count("{") - line.count("}")
        m = re.match(r"\s*requires\s+'([^']+)'(?:\s*,\s*'([^']*)')?\s*;", line)
        if m:
            found.append((m[1], m[2], "dev" if inside else "runtime"))
        inside = inside and depth > 0
    return package(directory, "perl", dependencies=found)


def gemfile(text: str, directory: str, context: Context) -> dict:
    found, depth = [], 0
    for line in text.splitlines():
        bare = line.split("#")[0].strip()
        if depth:
            if re.search(r"\bdo\b(\s*\|[^|]*\|)?$", bare):
                depth += 1
            elif bare == "end":
                depth -= 1
        elif re.match(r"group\b.*:(?:test|development)\b.*\bdo$", bare):
            depth = 1
        m = re.match(r"gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", bare)
        if m:
            found.append((m[1], m[2], "dev" if depth else "runtime"))
    return package(directory, "ruby", dependencies=found)


#: By file name, in order of precedence within one directory.
PARSERS = {"package.json": npm, "go.mod": go_mod, "Cargo.toml": cargo, "pyproject.toml": python, "pom.xml": maven, "build.gradle": gradle, "build.gradle.kts": gradle, "cpanfile": cpanfile, "Gemfile": gemfile}
CONTEXT_FILES = ("go.work", "settings.gradle", "settings.gradle.kts")


def collect_context(manifests: list[tuple[str, str, str]]) -> Context:
    """Context from ``(directory, filename, text)`` of all manifests; files that can't be read add nothing."""
    out = Context()
    under = lambda base, d: "/".join(x for x in (base, d.strip("/")) if x and x != ".")
    for directory, name, text in sorted(manifests):
        try:
            if name == "go.work":
                out.go |= {under(directory, d) for d in go_work(text)}
            elif name.startswith("settings.gradle"):
                dirs, root = gradle_settings(text)
                out.gradle |= {under(directory, d) for d in dirs}
                out.gradle_roots[directory] = root
            elif name == "Cargo.toml":
                out.cargo |= cargo_workspace(text)
            elif name == "pom.xml" and (found := maven_parent(text)):
                out.maven[found[0]] = found[1]
        except (ValueError, ET.ParseError, AttributeError):
            continue
    return out


def parse(filename: str, text: str, directory: str, context: Context | None = None) -> dict:
    """The package of a manifest, or ``{"error": message}``."""
    try:
        found = PARSERS[filename](text, directory, context or Context())
        return found | {"error": None}
    except (ValueError, KeyError, ET.ParseError, AttributeError, TypeError) as e:
        return {"error": f"{type(e).__name__}: {e}"}
