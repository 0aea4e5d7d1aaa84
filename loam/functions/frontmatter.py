"""Frontmatter as values: the block mappings and lists that heads of pages are written in, as VARIANT."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loam.functions import text as T

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"\[\]{}#&*!|>%@`,-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")
_PLAIN = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_DEEPEST = 50


def _scalar(text: str) -> object:
    """A value on one line: quoted, a number, a truth value, nothing, a flow list or mapping, or the text itself."""
    value, rest = _flow(text.strip(), 0) if text.strip()[:1] in tuple("[{\"'") else (None, None)
    if rest is not None:
        if text.strip()[rest:].split("#")[0].strip():
            raise ValueError(text)
        return value
    plain = re.sub(r"(^|\s)#.*$", "", text).strip()
    if re.search(r":(\s|$)", plain) or plain[:1] in tuple("&*!|>%@`[]{},\"'"):
        raise ValueError(text)
    return _typed(plain)


def _typed(plain: str) -> object:
    if plain in _PLAIN:
        return _PLAIN[plain]
    if re.fullmatch(r"[-+]?[0-9]{1,18}", plain):
        return int(plain)
    if re.fullmatch(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+][0-9]+)?", plain):
        return float(plain)
    return plain


def _flow(text: str, at: int, depth: int = 0) -> tuple[object, int]:
    """A quoted text, or a list or mapping between brackets, from ``at`` on; and where it ends."""
    if depth > _DEEPEST:
        raise ValueError("too deep")
    if found := re.compile(r'"((?:[^"\\]|\\.)*)"').match(text, at):
        return json.loads(f'"{found[1]}"'), found.end()
    if found := re.compile(r"'((?:[^']|'')*)'").match(text, at):
        return found[1].replace("''", "'"), found.end()
    if text[at : at + 1] in ("'", '"'):
        raise ValueError(text)
    if text[at : at + 1] not in ("[", "{"):
        found = re.compile(r"[^,\[\]{}:]*(?::(?!\s|$)[^,\[\]{}:]*)*").match(text, at)
        return _typed(found[0].strip()), found.end()
    close, out = {"[": ("]", []), "{": ("}", {})}[text[at]]
    at = re.compile(r"\s*").match(text, at + 1).end()
    while text[at : at + 1] != close:
        value, at = _flow(text, at, depth + 1)
        at = re.compile(r"\s*").match(text, at).end()
        if isinstance(out, dict):
            if text[at : at + 1] != ":":
                raise ValueError(text)
            own, at = _flow(text, re.compile(r"\s*").match(text, at + 1).end(), depth + 1)
            out[str(value)] = own
            at = re.compile(r"\s*").match(text, at).end()
        else:
            out.append(value)
        if text[at : at + 1] == ",":
            at = re.compile(r"\s*").match(text, at + 1).end()
        elif text[at : at + 1] != close:
            raise ValueError(text)
    return out, at + 1


def _block(lines: list[tuple[int, str]], at: int, depth: int = 0) -> tuple[object, int]:
    """The list or mapping that begins with line ``at`` and goes on as long as lines stand as far in."""
    if depth > _DEEPEST:
        raise ValueError("too deep")
    indent, first = lines[at]
    listed = first == "-" or first.startswith("- ")
    out: list | dict = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")) == listed:
        body = lines[at][1]
        if listed:
            rest = body[1:].lstrip()
            if rest and (_KEY.match(rest) or rest == "-" or rest.startswith("- ")):  # a block that begins on the item's line
                lines[at] = (indent + len(body) - len(rest), rest)
                value, at = _block(lines, at, depth + 1)
                out.append(value)
                continue
            key = None
        else:
            found = _KEY.match(body)
            if not found:
                raise ValueError(body)
            key, rest = _scalar(found[1]) if found[1][0] in "'\"" else found[1], body[found.end() :].strip()
        at += 1
        if rest[:1] in ("|", ">"):
            held = []
            while at < len(lines) and lines[at][0] > indent:
                held.append(lines[at][1])
                at += 1
            value = ("\n" if rest[0] == "|" else " ").join(held) + ("" if rest[1:2] == "-" else "\n")
        elif not rest or rest.startswith("#"):
            inner = at < len(lines) and (lines[at][0] > indent or not listed and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")))
            value, at = _block(lines, at, depth + 1) if inner else (None, at)
        else:
            value = _scalar(rest)
        if listed:
            out.append(value)
        else:
            out[str(key)] = value
    if at < len(lines) and lines[at][0] > indent:
        raise ValueError(lines[at][1])
    return out, at


def parse(text: str | None) -> dict:
    """The mapping that a head of a page is; an empty one where it is malformed or something else."""
    try:
        raw = [x.rstrip() for x in (text or "").splitlines()]
        if any("\t" in re.match(r"\s*", x)[0] for x in raw):
            return {}
        lines = [(len(x) - len(x.lstrip(" ")), x.lstrip(" ")) for x in raw if x.strip() and not x.lstrip().startswith("#")]
        value, at = _block(lines, 0) if lines else ({}, 0)
        return value if isinstance(value, dict) and at == len(lines) else {}
    except ValueError:
        return {}


@F.pandas_udf(StringType())
def _as_json(head: pd.Series) -> pd.Series:
    return head.map(lambda x: json.dumps(parse(x), ensure_ascii=False))


def frontmatter_value(text: Column | str) -> Column:
    """A page's frontmatter as VARIANT: block and flow mappings and lists, quoted, plain and block texts, numbers, truth values.

    Pages without frontmatter, and malformed ones, have an empty mapping. Of repeated keys the last counts; dates stay
    texts; anchors, tags and several documents are malformed here.
    """
    head = F.regexp_extract(T.c(text), r"(?s)\A---\r?\n(.*?)(?:\r?\n)?---\r?\n", 1)
    return F.parse_json(_as_json(head))
