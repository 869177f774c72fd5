"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import NAMESPACE, PREFIX_TYPES, STOPWORDS

# Ends of lines; a link with its heading and alias.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
#: Stands for U+FFFD while bytes are checked: private characters that no text has side by side.
_KEPT = "\U0010fffd\ue0f1\U0010fffd"
_ENDS = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def strip(x: Column) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(x, _ENDS, "")


def lines(x: Column) -> Column:
    """The lines of x; an end of line at the very end adds no line."""
    parts = F.split(x, LINE_END, -1)
    return F.when(x == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def decode(content: Column) -> Column:
    """UTF-8 text of bytes: bytes that aren't valid are left out, and ends of lines are line feeds."""
    own = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit(_KEPT))  # U+FFFD of the text itself
    valid = F.replace(F.make_valid_utf8(own), F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(F.replace(valid, F.lit(_KEPT), F.lit("\ufffd")), "\r\n?", "\n")


def wikilinks(x: Column) -> Column:
    """The targets of the links in x, without heading and alias; empty ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(WIKILINK), F.lit(1)), strip), lambda t: t != "")


def delink(x: Column) -> Column:
    """The first link's target, else x without white space at its ends."""
    return F.coalesce(F.get(wikilinks(x), F.lit(0)), strip(x))


def basename(x: Column) -> Column:
    return F.element_at(F.split(x, "/", -1), -1)


def basename_key(x: Column) -> Column:
    """The base name without its last extension, in lower case."""
    return F.lower(F.regexp_replace(basename(x), r"\.[^.]*$", ""))


def clean_label(name: Column, id: Column) -> Column:
    """A node's label: base name of its name (of its id if that is empty) without extension and known prefix, as words."""
    base = basename_key(F.when(F.coalesce(name, F.lit("")) == "", id).otherwise(name))
    return F.translate(F.regexp_replace(base, f"^({'|'.join(PREFIX_TYPES)})", ""), "_-", "  ")


def tokens(x: Column, stopwords: list[str] = STOPWORDS, pattern: str = "[a-z0-9]+") -> Column:
    """Tokens in order: matches of the pattern in lower case, without stopwords."""
    found = F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stopwords)) if stopwords else found


def percent(x: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits, '-', '.', '_' and '~' stay."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def node_iri(id: Column) -> Column:
    return F.concat(F.lit(f"{NAMESPACE}n/"), percent(id))


def iri_to_id(iri: Column) -> Column:
    """The node id of an IRI of node_iri(); any other IRI stays."""
    start = f"{NAMESPACE}n/"
    return F.when(iri.startswith(start), F.url_decode(F.replace(F.substring(iri, len(start) + 1, 1 << 30), F.lit("+"), F.lit("%2B")))).otherwise(iri)


def predicate_iri(p: Column) -> Column:
    return F.concat(F.lit(NAMESPACE), p)


def node_type(id: Column, declared: Column) -> Column:
    """A declared type in the vocabulary, else the type of the file name's prefix, else Note."""
    from ..vocab import ENTITY_TYPES

    word = strip(declared)
    word = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))
    out = F.when(word.isin(ENTITY_TYPES), word)
    for prefix, kind in PREFIX_TYPES.items():
        out = out.when(F.lower(basename(id)).startswith(prefix), F.lit(kind))
    return out.otherwise(F.lit("Note"))


def first_cue(x: Column, cues: list[tuple[str, str]], default: Column) -> Column:
    out, low = F, F.lower(x)
    for cue, predicate in cues:
        out = out.when(low.contains(cue), F.lit(predicate))
    return out.otherwise(default)
