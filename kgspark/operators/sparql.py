"""Basic graph patterns over triples (s, p, o): patterns with variables become joins; OPTIONAL, FILTER, DISTINCT, paths, ASK."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import NAMESPACE, OWL, RDF, SCHEMA, SKOS, XSD
from .graph import reachable

PREFIXES = {"kl": NAMESPACE, "rdf": RDF, "schema": SCHEMA, "skos": SKOS, "xsd": XSD, "owl": OWL}


@dataclass
class Pattern:
    """A triple pattern; terms that begin with ? are variables. path: "", "+" or "*"."""

    s: str
    p: str
    o: str
    path: str = ""


@dataclass
class Query:
    patterns: list[Pattern]
    select: list[str] = field(default_factory=list)
    optional: list[list[Pattern]] = field(default_factory=list)
    filters: list[Column] = field(default_factory=list)
    distinct: bool = False
    ask: bool = False


def _matches(triples: DataFrame, t: Pattern) -> DataFrame:
    rows = triples.select("s", "p", "o")
    if t.path:
        steps = rows.where(F.col("p") == t.p).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        starts = steps.select(F.col("src").alias("start")).distinct()
        if not t.s.startswith("?"):
            starts = starts.where(F.col("start") == t.s)
        found = reachable(steps, starts).select(F.col("start").alias("s"), F.lit(t.p).alias("p"), F.col("id").alias("o"))
        if t.path == "*":
            ends = rows.select(F.col("s").alias("x")).unionByName(rows.select(F.col("o").alias("x")))
            given = [(x,) for x in (t.s, t.o) if not x.startswith("?")]  # a term leads to itself, in the graph or not
            ends = (ends.unionByName(rows.sparkSession.createDataFrame(given, "x string")) if given else ends).distinct()
            found = found.unionByName(ends.select(F.col("x").alias("s"), F.lit(t.p).alias("p"), F.col("x").alias("o"))).distinct()
        rows = found
    out, names = rows, {}
    for c, term in (("s", t.s), ("p", t.p), ("o", t.o)):
        if not term.startswith("?"):
            out = out.where(F.col(c) == term)
        elif term[1:] in names:
            out = out.where(F.col(c) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = c
    return out.select([F.col(c).alias(v) for v, c in names.items()] or [F.lit(1).alias("__any")])


#: Most rows of a product of patterns that share no variable.
PRODUCT = 20_000_000


def bgp(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """A row for each solution, a column for each variable. Patterns are joined in an order in which each shares a variable with
    those before it, if there is one; a product of others is an error beyond PRODUCT rows."""
    out, left = None, list(patterns)
    while left:
        known = () if out is None else out.columns
        names = [{x[1:] for x in (t.s, t.p, t.o) if x.startswith("?")} for t in left]
        t = left.pop(next((i for i, own in enumerate(names) if not own or own & {*known}), 0))
        rows = _matches(triples, t)
        if out is None:
            out = rows
            continue
        shared = [c for c in rows.columns if c in out.columns and c != "__any"]
        if "__any" in rows.columns:
            rows = rows.limit(1).drop("__any").withColumn("__hit", F.lit(1))
            out = out.join(F.broadcast(rows)).drop("__hit")
        elif shared:
            out = out.join(rows, shared)
        else:
            if out.count() * rows.count() > PRODUCT:
                raise ValueError("patterns share no variable and their product is too large")
            out = out.crossJoin(rows)
    return out


def run(triples: DataFrame, q: Query) -> DataFrame:
    """SELECT's rows; of an ASK one row, ``answer``."""
    out = bgp(triples, q.patterns)
    for group in q.optional:
        more = bgp(triples, group)
        out = out.join(more, [c for c in more.columns if c in out.columns], "left")
    for f in q.filters:
        out = out.where(f)
    if q.ask:
        return out.limit(1).agg((F.count("*") > 0).alias("answer"))
    out = out.select(*(q.select or [c for c in out.columns if c != "__any"]))
    return out.distinct() if q.distinct else out


_TOKEN = re.compile(r"<[^>\s]*>|\"(?:[^\"\\]|\\.)*\"|\?\w+|[\w-]*:[\w./~%-]+[+*]?|-?\d+(?:\.\d+)?|&&|\|\||[!<>]=|[{}().;,+*!=<>]|[A-Za-z]+")
_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class _Filter:
    """A FILTER expression as a column, by recursive descent: || && ! and comparisons of variables, terms and numbers, and regex,
    contains, strstarts, strends, bound, str, lcase, ucase."""

    def __init__(self, found: list[str], at: int, term):
        self.found, self.at, self.term = found, at, term

    def take(self, *wanted: str) -> str | None:
        if wanted and self.found[self.at] not in wanted:
            return None
        self.at += 1
        return self.found[self.at - 1]

    def any(self) -> Column:
        out = self.all()
        while self.take("||"):
            out = out | self.all()
        return out

    def all(self) -> Column:
        out = self.one()
        while self.take("&&"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.take("!"):
            return ~self.one()
        left, number = self.value()
        op = self.take(*_COMPARE)
        if not op:
            return left
        right, other = self.value()
        if number or other:
            left, right = (x.try_cast("double") for x in (left, right))
        return getattr(left, _COMPARE[op])(right)

    def value(self) -> tuple[Column, bool]:
        x = self.take()
        if x == "(":
            out = self.any()
            if not self.take(")"):
                raise ValueError(f"not understood: {self.found[self.at]}")
            return out, False
        if x.startswith("?"):
            return F.col(x[1:]), False
        if re.fullmatch(r"-?\d+(?:\.\d+)?", x):
            return F.lit(float(x)), True
        if x.isalpha() and self.take("("):
            plain = x.lower() == "regex" and self.found  # a pattern is a plain string
            args = []
            while not self.take(")"):
                args.append(self.value()[0] if not (plain and self.found[self.at].startswith('"')) else self.term(self.take()))
                self.take(",")
            call = {
                "regex": lambda v, pattern, flags="": v.rlike(f"(?{flags})" * bool(flags) + pattern),
                "contains": lambda a, b: a.contains(b), "strstarts": lambda a, b: a.startswith(b), "strends": lambda a, b: a.endswith(b),
                "bound": lambda a: a.isNotNull(), "str": lambda a: a, "lcase": F.lower, "ucase": F.upper,
            }
            if x.lower() not in call:
                raise ValueError(f"not understood: {x}")
            return call[x.lower()](*args), False
        return F.lit(self.term(x)), False


def parse(text: str) -> Query:
    """SELECT or ASK text with prefixes, triple patterns, ``a``, ``;``, FILTER, OPTIONAL and the paths + and *; anything else is an
    error."""
    prefixes = dict(PREFIXES)
    for name, iri in re.findall(r"PREFIX\s+([\w-]*):\s*<([^>]*)>", text, re.I):
        prefixes[name] = iri
    found = _TOKEN.findall(re.sub(r"PREFIX\s+[\w-]*:\s*<[^>]*>", "", text, flags=re.I))
    head = found[0].upper()
    if head not in ("SELECT", "ASK") or "{" not in found:
        raise ValueError("only SELECT and ASK")
    at = found.index("{")
    distinct = any(x.upper() == "DISTINCT" for x in found[1:at])
    select = [x[1:] for x in found[1:at] if x.startswith("?")]

    def term(x: str) -> str:
        if x.startswith("?"):
            return x
        if x == "a":
            return RDF + "type"
        if x.startswith("<"):
            return x[1:-1]
        if x.startswith('"'):
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        name, _, rest = x.partition(":")
        if name not in prefixes or not _:
            raise ValueError(f"not understood: {x}")
        return prefixes[name] + rest

    filters: list[Column] = []

    def group(i: int) -> tuple[list[Pattern], list[list[Pattern]], int]:
        own, optional, subject = [], [], None
        while found[i] != "}":
            if found[i].upper() == "FILTER":
                told = _Filter(found, i + 1, term)
                filters.append(told.one())
                i, subject = told.at, None
                continue
            if found[i].upper() == "OPTIONAL":
                before = len(filters)
                inner, _, i = group(i + 2)
                if len(filters) > before:
                    raise ValueError("FILTER inside OPTIONAL is not understood")
                optional.append(inner)
                i += 1
                continue
            if found[i] in (".", ";"):
                subject = None if found[i] == "." else subject
                i += 1
                continue
            if subject is None:
                subject = found[i]
                i += 1
            p, path = found[i], ""
            i += 1
            if p[-1] in "+*" and len(p) > 1:
                p, path = p[:-1], p[-1]
            elif found[i] in ("+", "*"):
                path = found[i]
                i += 1
            own.append(Pattern(term(subject), term(p), term(found[i]), path))
            i += 1
        return own, optional, i

    patterns, optional, _ = group(at + 1)
    return Query(patterns, select, optional, filters, distinct, head == "ASK")


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    """The names of nodes of a type, as often as they occur; the type is compared, never spliced into a query."""
    return nodes.where(F.col("type") == kind).select("name")
