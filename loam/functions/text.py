"""Text functions as column expressions. Everything here runs in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file suffix. Fixed values.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java", ".go": "go",
    ".cs": "csharp", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".sql": "sql", ".sh": "shell",
}
#: White space as Python's str.split() sees it, which is wider than Java's.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Line ends as Python's str.splitlines() sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: How a citation and a link to a page look. Fixed values.
CITATION = r"([A-Za-z0-9_./-]+):L(\d+)-L(\d+)"
LINK = r"\[[^\]]+\]\(([^)]+\.md)\)"


def c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def normalize_newlines(text: Column | str) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``, as text-mode reading does."""
    return F.regexp_replace(c(text), r"\r\n?", "\n")


def language(path: Column | str) -> Column:
    """By the suffix of the file name, case ignored; a leading dot is no suffix; others are ``text``."""
    name = F.element_at(F.split(c(path), "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[suffix], F.lit("text"))


def content_hash(text: Column | str) -> Column:
    return F.sha2(c(text), 256)


def cite(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.format_string("%s:L%d-L%d", c(path), c(start).cast("int"), c(end).cast("int"))


def cite_path(citation: Column | str) -> Column:
    """The path of a citation: all before the first ``:L``."""
    return F.substring_index(c(citation), ":L", 1)


def cite_span(citation: Column | str) -> Column:
    """``struct(path, start, end)`` of a well-formed citation, else null."""
    part = lambda g: F.regexp_extract(c(citation), f"^{CITATION}$", g)
    span = F.struct(part(1).alias("path"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"))
    return F.when(part(1) != "", span)


def component(path: Column | str) -> Column:
    return F.substring_index(c(path), "/", 1)


def slug(name: Column | str) -> Column:
    """Lower case; letters and digits stay, blanks and ``-_/.`` become single dashes, all else goes; ``page`` if none."""
    kept = F.regexp_replace(F.lower(F.trim(c(name))), r"[^\p{L}\p{N} \-_/.]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[ \-_/.]+", "-"), r"^-+|-+$", "")
    return F.when(dashed == "", "page").otherwise(dashed)


def split_lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end adds no line, and an empty text has none."""
    body = F.regexp_replace(F.regexp_replace(c(text), LINE_END, "\n"), r"\n\z", "")
    return F.when(c(text) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, cut to what there is) joined again."""
    first = F.greatest(F.lit(1), start)
    count = F.greatest(F.lit(0), F.least(F.size(lines), end) - first + 1)
    return F.array_join(F.slice(lines, first, count), "\n")


def words(text: Column | str) -> Column:
    return F.filter(F.split(c(text), f"(?U){SPACE}+"), lambda w: w != "")


def token_estimate(text: Column | str) -> Column:
    """1.35 tokens a word, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(1.35)).cast("int")


def message_tokens(messages: Column) -> Column:
    """Sum over messages (``struct(role, content)``) of the estimate of role, line end and content."""
    return F.aggregate(F.transform(messages, lambda m: token_estimate(F.concat(m["role"], F.lit("\n"), m["content"]))), F.lit(0), lambda a, x: a + x)


def preview(text: Column | str, length: int = 240) -> Column:
    return F.left(F.array_join(words(text), " "), F.lit(length))


def ordered_unique(items: Column) -> Column:
    """Trimmed, without empties; the first of equals stays."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def route_segment(route: Column | str) -> Column:
    """The second ``/``-segment of what follows the method; null where there is none or it is empty."""
    return F.nullif(F.get(F.split(F.regexp_replace(c(route), r"^[^ ]* ", ""), "/"), F.lit(1)), F.lit(""))


def capability(route: Column | str) -> Column:
    return F.coalesce(route_segment(route), F.lit("general"))


def capability_label(route: Column | str) -> Column:
    return F.coalesce(F.trim(F.translate(route_segment(route), "-_", "  ")), F.lit("general api"))


def mermaid_id(text: Column | str) -> Column:
    return F.regexp_replace(c(text), r"[:/.\-]", "_")


def entity_id(name: Column | str) -> Column:
    """An upper-case identifier of letters, digits and single underscores; ``ENTITY`` if none is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(c(name)), r"[^A-Za-z0-9_]", "_"), "_+", "_")
    clean = F.upper(F.regexp_replace(clean, "^_+|_+$", ""))
    return F.when(clean == "", "ENTITY").otherwise(clean)


def page_title(path: Column | str) -> Column:
    """The file name without ``.md``, dashes as blanks, each word capitalised."""
    return F.initcap(F.translate(F.regexp_replace(F.element_at(F.split(c(path), "/"), -1), r"\.md$", ""), "-_", "  "))


def folder(path: Column | str) -> Column:
    """The first folder, ``misc`` for a root page."""
    return F.when(F.contains(c(path), F.lit("/")), F.substring_index(c(path), "/", 1)).otherwise("misc")


def relative_link(label: Column | str, source: Column | str, target: Column | str) -> Column:
    """``[label](path)`` with the path of ``target`` relative to the folder of ``source``; null for a self link."""
    a, b = F.split(c(source), "/"), F.split(c(target), "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    common = F.least(same, F.size(a) - 1, F.size(b) - 1)
    path = F.concat(F.array_repeat(F.lit(".."), F.size(a) - 1 - common), F.slice(b, common + 1, F.size(b) - common))
    return F.when(c(source) != c(target), F.concat(F.lit("["), c(label), F.lit("]("), F.array_join(path, "/"), F.lit(")")))


def normalize_path(path: Column | str) -> Column:
    """The path without ``.`` parts, each ``..`` taking back the part before it."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(c(path), "/"), F.array().cast("array<string>"), step), "/")


def summary_section(markdown: Column | str) -> Column:
    """The body under ``## Summary`` up to the next second-level heading, white space collapsed, lower case."""
    body = F.regexp_extract(F.concat(F.lit("\n"), c(markdown), F.lit("\n")), r"(?s)\n\s*## Summary\s*?\n(.*?)(?:\n## |\z)", 1)
    return F.lower(F.array_join(words(body), " "))


def json_object(text: Column | str) -> Column:
    """The outermost ``{...}`` of a model's answer, code fences dropped; null where there is none."""
    bare = F.trim(F.regexp_replace(c(text), r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def citations(text: Column | str) -> Column:
    return F.regexp_extract_all(c(text), F.lit(CITATION), F.lit(0))


def links(text: Column | str) -> Column:
    return F.regexp_extract_all(c(text), F.lit(LINK), F.lit(1))


def heading_ids(html: Column | str) -> Column:
    """``<h2>`` and ``<h3>`` without attributes get their text's ASCII slug as id."""
    pattern = r"(?i)<(h[23])>([^<]*)</h[23]>"
    parts = F.split(c(html), pattern, -1)
    tags, titles = F.regexp_extract_all(c(html), F.lit(pattern), F.lit(1)), F.regexp_extract_all(c(html), F.lit(pattern), F.lit(2))
    ids = F.transform(titles, lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"[^a-z0-9]+", "-"), "^-+|-+$", ""))
    one = lambda i: F.concat(F.lit("<"), tags[i], F.lit(' id="'), ids[i], F.lit('">'), titles[i], F.lit("</"), tags[i], F.lit(">"), parts[i + 1])
    return F.when(F.size(tags) == 0, c(html)).otherwise(F.concat(parts[0], F.array_join(F.transform(F.sequence(F.lit(0), F.size(tags) - 1), one), "")))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(c(html), r"<[^>]+>", "")


#: Marks where a match begins; a private-use character, which no pattern tells from the one that stands in for it.
_MARK, _MARK_STAND_IN = "\ue000", "\ufffd"


def match_lines(text: Column | str, pattern: str) -> Column:
    """The line that each match of ``pattern`` starts on, counting ``\\n`` alone.

    The text is marked where matches begin and then split into lines, so the work is linear in the text.
    """
    marked = F.regexp_replace(F.translate(c(text), _MARK, _MARK_STAND_IN), F.lit(pattern), F.lit(_MARK + "$0"))
    times = lambda line: F.length(line) - F.length(F.translate(line, _MARK, ""))
    lines = F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: F.array_repeat(i + 1, times(line))))
    return F.when(F.rlike(c(text), F.lit(pattern)), lines).otherwise(F.array().cast("array<int>"))


def matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    """``array<struct(ord, line, text)>``: each match of ``pattern`` with the line it starts on; ``text`` is its ``group``."""
    shown = F.regexp_extract_all(c(text), F.lit(pattern), F.lit(group))
    rows = F.zip_with(match_lines(text, pattern), shown, lambda line, t: F.struct(line.alias("line"), t.alias("text")))
    return F.transform(rows, lambda m, i: F.struct((i + 1).alias("ord"), m["line"].alias("line"), m["text"].alias("text")))


def glob_regex(globs: list[str]) -> str:
    """One pattern for all globs: ``*`` also crosses ``/``, and a leading ``**/`` may match nothing."""

    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            ch = glob[i]
            end = glob.find("]", i + 2) if ch == "[" else -1
            if end > 0:
                inner = glob[i + 1 : end].replace("\\", r"\\")
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
                i = end
            else:
                out += {"*": ".*", "?": "."}.get(ch, re.escape(ch))
            i += 1
        return out

    every = [x for g in globs for x in ([g, g[3:]] if g.startswith("**/") else [g])]
    return "(?s)^(?:" + "|".join(map(one, every)) + ")$" if every else "(?!)"
