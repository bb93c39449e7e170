"""SPARQL queries as nested tuples. Only query forms parse, so nothing can be written through it."""

from __future__ import annotations

import re

from quadrel.functions.terms import PREFIXES, RDF, XSD

_LEX = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<str>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<var>[?$]\w+)|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<pname>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-](?:[\w:.%-]*[\w:%-])?)?|_:\w+)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;|/^+*?!=<>-])""",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


def unquote(s: str) -> str:
    n = 3 if s[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES[m[1]], s[n:-n])


def iri(value: str):
    return ("term", "uri", value, "", "")


def literal(value: str, lang: str = "", dt: str = ""):
    return ("term", "literal", value, lang.lower(), dt or ("" if lang else XSD + "string"))


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.prefixes = dict(PREFIXES if prefixes is None else prefixes)
        self.base, self.at, self.fresh = "", 0, 0
        self.tokens, pos = [], 0
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m:
                raise SyntaxError(f"unexpected {text[pos : pos + 20]!r}")
            pos = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at]
        return kind in ("word", "op") and text.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> str:
        if not self.peek(*words):
            raise SyntaxError(f"expected {' or '.join(words)}, found {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1].upper()

    def is_a(self, *kinds: str) -> bool:
        return self.tokens[self.at][0] in kinds

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    # queries

    def query(self):
        while self.peek("PREFIX", "BASE"):
            if self.next().upper() == "BASE":
                self.base = self.next()[1:-1]
            else:
                name = self.next()
                self.prefixes[name[:-1]] = self.next()[1:-1]
        if self.peek("SELECT"):
            out = self.select()
        elif self.take("ASK"):
            self.take("WHERE")
            out = ("ask", self.group())
        elif self.take("CONSTRUCT"):
            template = self.template()
            self.need("WHERE")
            out = ("construct", template, self.group(), self.modifiers())
        elif self.take("DESCRIBE"):
            what = []
            while self.is_a("iri", "pname", "var"):
                what.append(self.term())
            self.take("WHERE")
            out = ("describe", what, self.group() if self.peek("{") else None)
        else:
            raise SyntaxError("only SELECT, ASK, CONSTRUCT and DESCRIBE are served")
        if not self.is_a("end"):
            raise SyntaxError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def template(self):
        self.need("{")
        out = []
        while not self.take("}"):
            out += self.triples()
            self.take(".")
        return out

    def select(self):
        self.need("SELECT")
        distinct = self.take("DISTINCT") or self.take("REDUCED")
        items = []
        if not self.take("*"):
            while True:
                if self.is_a("var"):
                    items.append((self.next()[1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    items.append((self.next()[1:], e))
                    self.need(")")
                else:
                    break
        self.take("WHERE")
        where = self.group()
        return ("select", distinct, items, where, self.modifiers())

    def modifiers(self):
        mod = {"group": [], "having": [], "order": [], "limit": None, "offset": 0, "values": None}
        while True:
            if self.take("GROUP"):
                self.need("BY")
                while self.is_a("var") or self.peek("("):
                    if self.take("("):
                        e = self.expression()
                        name = self.next()[1:] if self.take("AS") else self.new_var()
                        mod["group"].append((name, e))
                        self.need(")")
                    else:
                        mod["group"].append((self.next()[1:], None))
            elif self.take("HAVING"):
                while self.peek("("):
                    mod["having"].append(self.bracketed())
            elif self.take("ORDER"):
                self.need("BY")
                while True:
                    if self.peek("ASC", "DESC"):
                        down = self.next().upper() == "DESC"
                        mod["order"].append((self.bracketed(), down))
                    elif self.is_a("var") or self.peek("(") or self.is_a("word") and not self.peek("LIMIT", "OFFSET", "VALUES"):
                        mod["order"].append((self.primary(), False))
                    else:
                        break
            elif self.take("LIMIT"):
                mod["limit"] = int(self.next())
            elif self.take("OFFSET"):
                mod["offset"] = int(self.next())
            elif self.peek("VALUES"):
                mod["values"] = self.values()
            else:
                return mod

    def new_var(self) -> str:
        self.fresh += 1
        return f"_b{self.fresh}"

    # patterns

    def group(self):
        self.need("{")
        if self.peek("SELECT"):
            out = [("subselect", self.select())]
            self.need("}")
            return ("group", out)
        out = []
        while not self.take("}"):
            if self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.append(("minus", self.group()))
            elif self.take("FILTER"):
                out.append(("filter", self.bracketed() if self.peek("(") else self.primary()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.append(("bind", self.next()[1:], e))
                self.need(")")
            elif self.take("GRAPH"):
                out.append(("graph", self.term(), self.group()))
            elif self.take("SERVICE"):
                self.take("SILENT")
                out.append(("service", self.term(), self.group()))
            elif self.peek("VALUES"):
                out.append(self.values())
            elif self.peek("{"):
                parts = [self.group()]
                while self.take("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else parts[0])
            else:
                bgp = []
                while not self.peek("}", "OPTIONAL", "MINUS", "FILTER", "BIND", "GRAPH", "SERVICE", "VALUES", "{"):
                    bgp += self.triples()
                    if not self.take("."):
                        break
                out.append(("bgp", bgp))
            self.take(".")
        return ("group", out)

    def values(self):
        self.need("VALUES")
        rows = []
        if self.is_a("var"):
            names = [self.next()[1:]]
            self.need("{")
            while not self.take("}"):
                rows.append([None if self.take("UNDEF") else self.term()])
            return ("values", names, rows)
        self.need("(")
        names = []
        while not self.take(")"):
            names.append(self.next()[1:])
        self.need("{")
        while not self.take("}"):
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(None if self.take("UNDEF") else self.term())
            rows.append(row)
        return ("values", names, rows)

    def triples(self):
        out: list = []
        s = self.node(out)
        if self.peek(".", "}") and out:
            return out
        while True:
            p = ("var", self.next()[1:]) if self.is_a("var") else self.path()
            while True:
                out.append((s, p, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return out
            while self.take(";"):
                pass
            if self.peek(".", "}", "]"):
                return out

    def node(self, out: list):
        if self.take("["):
            b = ("var", self.new_var())
            while not self.take("]"):
                p = self.path()
                out.append((b, p, self.node(out)))
                self.take(";")
            return b
        return self.term()

    def term(self):
        kind, text = self.tokens[self.at]
        if kind == "var":
            self.at += 1
            return ("var", text[1:])
        if kind == "iri":
            self.at += 1
            return iri(text[1:-1] if ":" in text else self.base + text[1:-1])
        if kind == "pname":
            self.at += 1
            if text.startswith("_:"):
                return ("var", "_b_" + text[2:])
            name, _, local = text.partition(":")
            if name not in self.prefixes:
                raise SyntaxError(f"unknown prefix {name!r}")
            return iri(self.prefixes[name] + local)
        if kind == "str":
            self.at += 1
            value = unquote(text)
            if self.is_a("lang"):
                return literal(value, self.next()[1:])
            if self.take("^^"):
                return literal(value, "", self.term()[2])
            return literal(value)
        if kind == "num" or text in ("-", "+"):
            sign = self.next() if text in ("-", "+") else ""
            text = sign.replace("+", "") + self.next()
            return literal(text, "", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if self.peek("TRUE", "FALSE"):
            return literal(self.next().lower(), "", XSD + "boolean")
        raise SyntaxError(f"expected a term, found {text!r}")

    # paths

    def path(self):
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = [self.step()]
        while self.take("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self):
        if self.take("^"):
            return ("inv", self.step())
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.is_a("word") and self.tokens[self.at][1] == "a":
            self.at += 1
            p = iri(RDF + "type")
        else:
            p = self.term()
        if self.take("+"):
            return ("repeat", p, 1, None)
        if self.take("*"):
            return ("repeat", p, 0, None)
        if self.take("?"):
            return ("repeat", p, 0, 1)
        if self.peek("{") and self.tokens[self.at + 1][0] == "num":
            self.need("{")
            low = int(self.next())
            high = low
            if self.take(","):
                high = int(self.next()) if self.is_a("num") else None
            self.need("}")
            return ("repeat", p, low, high)
        return p

    # expressions

    def bracketed(self):
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def expression(self):
        out = self.conjunction()
        while self.take("||"):
            out = ("call", "OR", [out, self.conjunction()])
        return out

    def conjunction(self):
        out = self.relation()
        while self.take("&&"):
            out = ("call", "AND", [out, self.relation()])
        return out

    def relation(self):
        out = self.sum()
        if self.peek("=", "!=", "<", ">", "<=", ">="):
            return ("call", self.next(), [out, self.sum()])
        negated = self.peek("NOT")
        if negated and self.tokens[self.at + 1][1].upper() == "IN":
            self.at += 1
        if self.take("IN"):
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            e = ("call", "IN", [out, *items])
            return ("call", "NOT", [e]) if negated else e
        return out

    def sum(self):
        out = self.product()
        while self.peek("+", "-"):
            out = ("call", self.next(), [out, self.product()])
        return out

    def product(self):
        out = self.unary()
        while self.peek("*", "/"):
            out = ("call", self.next(), [out, self.unary()])
        return out

    def unary(self):
        if self.take("!"):
            return ("call", "NOT", [self.unary()])
        if self.peek("-") and not self.tokens[self.at + 1][0] == "num":
            self.at += 1
            return ("call", "NEG", [self.unary()])
        return self.primary()

    def primary(self):
        if self.peek("("):
            return self.bracketed()
        if self.peek("NOT", "EXISTS"):
            negated = self.take("NOT")
            self.need("EXISTS")
            return ("exists", self.group(), negated)
        kind, text = self.tokens[self.at]
        if kind == "word" and self.tokens[self.at + 1][1] == "(":
            name = self.next().upper()
            return self.aggregate(name) if name in AGGREGATES else ("call", name, self.arguments())
        if kind in ("pname", "iri") and self.tokens[self.at + 1][1] == "(":
            return ("call", self.term()[2], self.arguments())
        return self.term()

    def arguments(self):
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def aggregate(self, name: str):
        self.need("(")
        distinct = self.take("DISTINCT")
        e = None if self.take("*") else self.expression()
        sep = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            sep = unquote(self.next())
        self.need(")")
        return ("agg", name, distinct, e, sep)


def parse(text: str, prefixes: dict[str, str] | None = None):
    """The query of a text; well-known prefixes need not be declared."""
    return Parser(text, prefixes).query()
