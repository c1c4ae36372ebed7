"""TOML by the grammar of its specification, one line a statement, and lenient.

A line is cut into tokens that know their place. A header or an assignment is
read from the tokens; a value is text between two places, or a bracketed list of
values. What the statements say is put into one ordered tree afterwards.

Leniencies, as rules:
* a value without a valid form is a string: itself, less quotes around it;
* brackets that don't close, or don't end their value, make it a string;
* empty list entries are passed over;
* of two assignments to a key the later one counts, takes its place at the end,
  and a warning says so;
* a header of one table opens tables only; other keys with dots go through whatever has children;
* comment lines directly above a statement belong to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|\'[^\']*\'?|[\[\]{}=,.#]|\s+|[^\[\]{}=,.#"\'\s]+')

#: The forms of scalars, underlines between digits left out.
_INTEGER = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(?:(?:\d+\.\d*|\.\d+)|(?:\d+(?:\.\d*)?)[eE][+-]?\d+)")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[Tt ][\d:.+\-Zz]+)?")


def unquoted(text: str) -> str:
    quote = text[:1]
    if len(text) < 2 or quote not in ("'", '"') or text[-1] != quote:
        return text
    try:
        return json.loads(text) if quote == '"' else text[1:-1]
    except ValueError:
        return text[1:-1]


def scalar(text: str) -> tuple[str, object]:
    """(type, value)."""
    digits = text.replace("_", "")
    if text in ("true", "false"):
        return "boolean", text == "true"
    if _INTEGER.fullmatch(digits):
        return "integer", int(digits)
    if _FLOAT.fullmatch(digits):
        return "float", float(digits)
    return ("datetime", text) if _DATE.fullmatch(text) else ("string", unquoted(text))


class Line:
    """Tokens of a line, up to its comment: (mark, start, end); a mark is a single sign or empty."""

    def __init__(self, text: str):
        self.text, self.tokens = text, []
        for m in _TOKEN.finditer(text):
            if m[0] == "#":
                break
            if not m[0].isspace():
                self.tokens.append((m[0] if m[0] in "[]{}=,." else "", m.start(), m.end()))

    def marks(self, a: int, b: int) -> str:
        """One sign a token; * stands for any other."""
        return "".join(mark or "*" for mark, *_ in self.tokens[a:b])

    def between(self, a: int, b: int) -> str:
        """The text from token ``a`` to before token ``b``."""
        return self.text[self.tokens[a][1] : self.tokens[b - 1][2]] if a < b else ""

    def parts(self, a: int, b: int, sign: str) -> list[tuple[int, int]]:
        """Stretches of tokens between signs that stand in no bracket."""
        depth, out = 0, [a]
        for i in range(a, b):
            mark = self.tokens[i][0]
            depth += (mark in ("[", "{")) - (mark in ("]", "}"))
            if mark == sign and depth == 0:
                out.append(i + 1)
        return list(zip(out, [*(x - 1 for x in out[1:]), b]))

    def key(self, a: int, b: int) -> tuple[str, ...]:
        found = (unquoted(self.between(*part)) for part in self.parts(a, b, "."))
        return tuple(k for k in found if k)

    def pair(self, a: int, b: int) -> tuple[tuple[str, ...], tuple[int, int] | None]:
        """A key and where its value stands."""
        (first, end), *rest = self.parts(a, b, "=")
        return self.key(first, end), (rest[0][0], b) if rest else None

    def value(self, a: int, b: int) -> Node:
        around = self.tokens[a][0] + self.tokens[b - 1][0] if b - a > 1 else ""
        if around not in ("[]", "{}"):
            kind, value = scalar(self.between(a, b))
            return Node("value", kind, value)
        entries = [x for x in self.parts(a + 1, b - 1, ",") if x[0] < x[1]]
        if around == "[]":
            node = Node("array", "array")
            for i, part in enumerate(entries):
                node.put(f"[{i}]", self.value(*part))
            return node
        node = Node("inline-table")
        for part in entries:
            key, place = self.pair(*part)
            node.put(".".join(key), self.value(*place) if place else Node("value", "string", ""))
        return node


@dataclass
class Node:
    kind: str
    type: str = "table"
    value: object = None
    line: int = 0
    comment: str | None = None
    inside: list[tuple[str, Node]] = field(default_factory=list)
    #: of each key the first child of each kind
    first: dict[str, dict[str, tuple[int, Node]]] = field(default_factory=dict)

    def put(self, key: str, node: Node) -> Node:
        self.first.setdefault(key, {}).setdefault(node.kind, (len(self.inside), node))
        self.inside.append((key, node))
        return node

    def get(self, key: str, kinds: frozenset[str]) -> Node | None:
        found = [f for k, f in self.first.get(key, {}).items() if k in kinds]
        return min(found, key=lambda f: f[0])[1] if found else None

    def take(self, key: str) -> None:
        """Remove the children of a key."""
        if self.first.pop(key, None):
            self.inside = [x for x in self.inside if x[0] != key]

    def plain(self) -> object:
        """As JSON has it."""
        if self.kind == "value":
            return self.value
        if self.type == "array":
            return [n.plain() for _, n in self.inside]
        return {k: n.plain() for k, n in self.inside}


TABLES = frozenset({"table"})
OPEN = frozenset({"table", "array-of-tables", "inline-table"})


def statements(source: str) -> Iterator[tuple[str, int, str | None, Line, tuple[str, ...]]]:
    """(form, line number, comment, line, key): form is table, tables, pair or a warning."""
    above: list[str] = []
    for number, text in enumerate(source.splitlines(), 1):
        line, bare = Line(text), text.strip()
        if line.tokens:
            n = len(line.tokens)
            marks = line.marks(0, n)
            comment, above = "\n".join(above) or None, []
            if re.fullmatch(r"\[\[[^][]+]]", marks):
                form, key = "tables", line.key(2, n - 2)
            elif re.fullmatch(r"\[[^][]+]", marks):
                form, key = "table", line.key(1, n - 1)
            else:
                key, place = line.pair(0, n)
                form = "pair" if place and key else "Missing key before assignment." if place else "Expected key/value assignment."
            yield form, number, comment, line, key
        elif bare:
            above.append(re.sub(r"^#+\s?", "", bare))
        else:
            above = []


def tree(source: str) -> tuple[Node, list[tuple[str, int]]]:
    """(root, warnings)."""
    root = Node("table")
    now, base = root, ""
    warnings: list[tuple[str, int]] = []
    assigned: set[str] = set()

    def down(node: Node, key: str, kinds: frozenset[str], number: int) -> Node:
        return node.get(key, kinds) or node.put(key, Node("table", line=number))

    for form, number, comment, line, key in statements(source):
        if form == "table":
            now, base = root, ".".join(key)
            for k in key:
                now = down(now, k, TABLES, number)
            now.comment, now.line = (comment, number) if comment else (now.comment, now.line)
        elif form == "tables":
            parent = root
            for k in key[:-1]:
                parent = down(parent, k, OPEN, number)
            group = parent.get(key[-1], frozenset({"array-of-tables"})) or parent.put(key[-1], Node("array-of-tables", "array", None, number, comment))
            at = f"[{len(group.inside)}]"
            now, base = group.put(at, Node("table", "table", None, number, None if group.inside else comment)), ".".join(key) + at
        elif form == "pair":
            parent = now
            for k in key[:-1]:
                parent = down(parent, k, OPEN, number)
            path = ".".join([base, *key] if base else key)
            if path in assigned:
                warnings.append((f"Duplicate key: {path}", number))
            assigned.add(path)
            _, place = line.pair(0, len(line.tokens))
            node = line.value(*place) if place[0] < place[1] else Node("value", "string", "")
            node.line, node.comment = number, comment
            parent.take(key[-1])
            parent.put(key[-1], node)
        else:
            warnings.append((form, number))
    return root, warnings


def rows(source: str) -> Iterator[tuple]:
    """(row, id, parent_id, depth, kind, value_type, key, path, value, comment, line): nodes in pre-order, the JSON form, warnings."""
    root, warnings = tree(source)
    waiting = [(0, 0, "", "", root.line, root)]
    own = 0
    while waiting:
        parent, depth, key, path, line, node = waiting.pop()
        own += 1
        shown = None if node.value is None else json.dumps(node.value) if isinstance(node.value, bool) else str(node.value)
        yield "node", own, parent, depth, node.kind, node.type, key, path, shown, node.comment, node.line or line
        for k, n in reversed(node.inside):
            waiting.append((own, depth + 1, k, path + k if k[:1] == "[" else f"{path}.{k}" if path else k, node.line or line, n))
    yield "json", 0, 0, 0, "", "", "", "", json.dumps(root.plain(), ensure_ascii=False), None, 0
    for message, line in warnings:
        yield "warning", 0, 0, 0, "", "", "", "", message, None, line
