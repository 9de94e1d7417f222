"""Statements of Turtle texts.

Lines are cut into chunks that end with a dot at a line's end, outside of long strings and quoted formulas; each chunk is read
by itself, so memory is bounded by a statement and a statement that cannot be read costs one error, not its file. Lists become
chains of first and rest. Quoted formulas (`{ ... }`) assert nothing; a statement that holds one is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<iri><[^<>"\s]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)'
    r"|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<sign>\^\^|[.;,\[\](){}])|(?P<bnode>_:[\w-]+)|(?P<name>[\w-]*:(?:[\w%-]|\.(?=[\w%-]))*|\w+)|(?P<bad>.)",
    re.S,
)
MARK = re.compile(r'"""|\'\'\'|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|<[^<>"\s]*>|#|[{}]')
CLOSING = {'"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''")}
DIRECTIVE = re.compile(r"\s*@?(prefix\s+([\w-]*):|base)\s*<([^<>]*)>", re.I)


def unescaped(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), s, flags=re.S)


def after(line: str, quote: str) -> tuple[str, str, bool]:
    """What a line leaves behind: the long quote that is open at its end, its braces, and whether a dot ends it."""
    at, end, braces = 0, len(line), ""
    while True:
        if quote:
            if not (m := CLOSING[quote].match(line, at)):
                return quote, braces, False
            at, quote = m.end(), ""
        if not (m := MARK.search(line, at)):
            return "", braces, line[at:end].rstrip().endswith(".")
        if m[0] == "#":
            return "", braces, line[at : m.start()].rstrip().endswith(".")
        at = m.end()
        if m[0] in CLOSING:
            quote = m[0]
        elif m[0] in "{}":
            braces += m[0]


def depth_after(depth: int, braces: str) -> int:
    for b in braces:
        depth = depth + 1 if b == "{" else max(depth - 1, 0)
    return depth


def chunks(lines: Iterable[str], quote: str = "", depth: int = 0) -> Iterator[tuple[str, bool]]:
    """(text, whole) from lines that begin in the given state; the last chunk may lack its end. The inner lines of a formula
    that spans several are left out."""
    held: list[str] = []
    for line in lines:
        inner = depth if not quote else 0
        quote, braces, dot = after(line, quote)
        depth = depth_after(depth, braces)
        if not inner or inner != depth or quote:
            held.append(line)
        if dot and not depth:
            yield "\n".join(held), True
            held = []
    if held:
        yield "\n".join(held), False


class Reader:
    """Reads chunks of one document in their order. Rows are (s, s_kind, p, o, o_kind, o_dt, o_lang, error); blank nodes without
    a name get `made` and a number."""

    def __init__(self, doc: str, prefixes: dict[str, str] | None = None, made: str = "b"):
        self.doc, self.made, self.count = doc, made, 0
        self.prefixes = dict(prefixes or {})  # the base is that of the name "@base"

    def declare(self, line: str) -> None:
        if m := DIRECTIVE.match(line):
            self.prefixes["@base" if m[2] is None else m[2]] = m[3]

    def rows(self, text: str) -> Iterator[tuple]:
        self.tokens = [(m.lastgroup, m[0], m.start()) for m in TOKEN.finditer(text) if m.lastgroup]
        self.tokens.append(("end", "", len(text)))
        self.place = 0
        while self.tokens[self.place][0] != "end":
            start, self.out = self.place, []
            try:
                self._statement()
            except (ValueError, IndexError, RecursionError) as e:
                found = text[self.tokens[start][2] :]
                self.out = [(None,) * 7 + (f"{e or type(e).__name__} in {' '.join(found[:80].split())!r}",)]
                self._recover(start, text)
            yield from self.out

    def _recover(self, start: int, text: str) -> None:
        """The next statement begins after the next dot outside of braces, or where a line begins with a name."""
        failed, depth = self.place, 0
        for i in range(start, len(self.tokens)):
            kind, value, at = self.tokens[i]
            depth = depth_after(depth, value) if kind == "sign" and value in "{}" else depth
            if i > start and i >= failed and not depth and kind in ("iri", "name", "bnode") and text[at - 1] == "\n":
                self.place = i
                return
            if i >= failed - 1 and value == "." and kind == "sign" and not depth:
                self.place = i + 1
                return
        self.place = len(self.tokens) - 1

    def _take(self, expected: str | None = None) -> tuple[str, str]:
        kind, value, _ = self.tokens[self.place]
        if expected is not None and (value != expected or kind == "text"):
            raise ValueError(f"{expected!r} expected, {value[:40]!r} found")
        if kind == "end":
            raise ValueError("a statement without its end")
        self.place += 1
        return kind, value

    def _sees(self, *signs: str) -> bool:
        kind, value, _ = self.tokens[self.place]
        return kind == "sign" and value in signs

    def _full(self, kind: str, value: str) -> str:
        if kind == "iri":
            return value[1:-1] if ":" in value else self.prefixes.get("@base", "") + value[1:-1]
        prefix, colon, local = value.partition(":")
        if kind != "name" or not colon or prefix not in self.prefixes:
            raise ValueError(f"unknown name {value[:40]!r}")
        return self.prefixes[prefix] + local

    def _node(self) -> str:
        self.count += 1
        return f"{self.doc}:{self.made}{self.count}."

    def _statement(self) -> None:
        kind, word, _ = self.tokens[self.place]
        if kind in ("lang", "name") and word.lower() in ("@prefix", "prefix", "@base", "base"):
            self._take()
            name = self._take()[1] if word.lower().endswith("prefix") else "@base:"
            if not name.endswith(":"):
                raise ValueError(f"a prefix expected, {name[:40]!r} found")
            kind, iri = self._take()
            if kind != "iri":
                raise ValueError(f"an IRI expected, {iri[:40]!r} found")
            self.prefixes[name[:-1]] = iri[1:-1]
            if word[0] == "@":
                self._take(".")
            return
        alone = self._sees("[")
        s, s_kind, _, _ = self._term()
        if s_kind == "lit":
            raise ValueError("a literal as subject")
        if not (alone and self._sees(".")):
            self._properties(s, s_kind)
        self._take(".")

    def _term(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self._take()
        if kind == "sign" and value == "[":
            node = self._node()
            if not self._sees("]"):
                self._properties(node, "bnode")
            self._take("]")
            return node, "bnode", None, None
        if kind == "sign" and value == "(":
            return self._items()
        if kind == "sign" and value == "{":
            raise ValueError("a quoted formula")
        if kind == "bnode":
            return f"{self.doc}:{value[2:]}", "bnode", None, None
        if kind == "text":
            quotes = 3 if value[:3] in CLOSING else 1
            content = unescaped(value[quotes:-quotes])
            if self.tokens[self.place][0] == "lang":
                return content, "lit", None, self._take()[1][1:]
            if self._sees("^^"):
                self._take()
                return content, "lit", self._full(*self._take()), None
            return content, "lit", None, None
        if kind == "number":
            return value, "lit", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "name" and value in ("true", "false"):
            return value, "lit", XSD + "boolean", None
        if kind in ("iri", "name"):
            return self._full(kind, value), "iri", None, None
        raise ValueError(f"unexpected {value[:40]!r}")

    def _items(self) -> tuple[str, str, None, None]:
        """A list: each item's node has the item as first, and the next node, or nil, as rest."""
        head, last = None, None
        while not self._sees(")"):
            node = self._node()
            if last:
                self.out.append((last, "bnode", RDF + "rest", node, "bnode", None, None, None))
            head, last = head or node, node
            self.out.append((node, "bnode", RDF + "first", *self._term(), None))
        self._take(")")
        if head is None:
            return RDF + "nil", "iri", None, None
        self.out.append((last, "bnode", RDF + "rest", RDF + "nil", "iri", None, None, None))
        return head, "bnode", None, None

    def _properties(self, s: str, s_kind: str) -> None:
        while True:
            kind, value = self._take()
            p = RDF + "type" if (kind, value) == ("name", "a") else self._full(kind, value)
            self.out.append((s, s_kind, p, *self._term(), None))
            while self._sees(","):
                self._take()
                self.out.append((s, s_kind, p, *self._term(), None))
            if not self._sees(";"):
                return
            while self._sees(";"):
                self._take()
            if self._sees(".", "]"):
                return


def turtle(text: str, doc: str) -> Iterator[tuple]:
    """Rows of one text."""
    reader = Reader(doc)
    for chunk, _ in chunks(text.split("\n")):
        yield from reader.rows(chunk)
