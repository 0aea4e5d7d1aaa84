"""Declarations of bracketed languages from their tokens: strings, comments and brackets first, then what they enclose.

A text is cut into tokens by one pattern a language, in which strings and comments are single tokens; brackets are
paired; types are found by keyword at any depth, functions among the members of type bodies (Go: by keyword). A
declaration ends where its body or its statement ends, and a function's calls are those inside these bounds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_COMMENT, _QUOTED = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"(?:\\.|[^\"\\\n])*\"?"
_INNER = r"\"(?:\\.|[^\"\\\n])*\""  # a string inside another one's braces
_CHAR, _WORD = r"'(?:\\.|[^'\\\n])*'?", r"[^\W\d]\w*"
_MARK = r"=>|->|::|\?\.|\.\.\.|[=!<>]=|[^\s\w]"
#: Strings of each language, tried in this order before words and marks.
_STRINGS = {
    "java": rf"\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|{_QUOTED}|{_CHAR}",
    "csharp": rf"\$*(?P<q>\"{{3,}}).*?(?:(?P=q)|\Z)|(?:\$@|@\$|@)\"(?:\"\"|[^\"])*\"?|\$\"(?:\\.|\{{\{{|\{{(?:{_INNER}|[^{{}}\"\n])*\}}|[^\"\\\n])*\"?|{_QUOTED}|{_CHAR}",
    "go": rf"`[^`]*`?|{_QUOTED}|{_CHAR}",
}
_SKIPPED = {"java": _COMMENT, "go": _COMMENT, "csharp": rf"{_COMMENT}|(?m:^[ \t]*#[^\n]*)"}
_NAMES = {"java": _WORD, "csharp": f"@?{_WORD}", "go": _WORD}
TOKENS = {
    lang: re.compile(rf"(?P<skip>{_SKIPPED[lang]})|(?P<string>{strings})|(?P<word>{_NAMES[lang]})|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<mark>{_MARK})", re.DOTALL)
    for lang, strings in _STRINGS.items()
}
#: Keywords that open a type with a body, and those of them that the symbol table lists. Fixed values.
TYPES = {
    "java": ({"class", "interface", "enum", "record"}, {"class", "interface", "enum"}),
    "csharp": ({"class", "interface", "struct", "record", "enum"}, {"class", "interface", "struct", "record"}),
}
#: Words before an opening bracket that call nothing.
PLAIN = {
    "java": set("if for while switch catch synchronized return throw try assert do else case default yield super this new instanceof".split()),
    "csharp": set("if for foreach while switch catch lock using fixed return throw try do else case when super this base typeof sizeof default checked unchecked await new in out ref is as yield and or not".split()),
    "go": set("if for switch select return case go defer range func import var const type struct interface map chan package else".split()),
}
#: Words that may stand before the name of what is called.
BEFORE = set("return throw assert else do yield await in is as and or not when out ref".split())
#: Words before the name in a member's head that make it no method.
NO_METHOD = {"java": {"class", "interface", "enum"}, "csharp": {"class", "interface", "enum", "struct", "operator", "delegate"}}
#: Words that are left out when the last name of what is called is taken. Fixed values.
UNNAMED = {"new", "await", "this", "super"}
CLOSING = {")": "(", "]": "[", "}": "{"}


class Source:
    """A text's tokens with their kinds, places and paired brackets."""

    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang = text, lang
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.words, self.kinds, self.at = [], [], []
        for m in TOKENS[lang].finditer(text):
            kind, word = m.lastgroup if m.lastgroup != "q" else "string", m.group()
            if kind == "line" or kind == "skip" and "\n" in word:
                word = ";" if lang == "go" and self._ends_statement() else ""
                kind = "line"
            if kind == "skip" or not word:
                continue
            self.words.append(word)
            self.kinds.append(kind)
            self.at.append(m.start())
        self.size = len(self.words)
        self.pair = [self.size] * self.size
        self.opened = [-1] * self.size  # the innermost bracket around a token
        stack: list[int] = []
        for i, (word, kind) in enumerate(zip(self.words, self.kinds)):
            if kind == "mark" and word in CLOSING and any(self.words[j] == CLOSING[word] for j in stack[-8:]):
                while self.words[stack[-1]] != CLOSING[word]:
                    stack.pop()
                j = stack.pop()
                self.pair[j], self.pair[i] = i, j
            self.opened[i] = stack[-1] if stack else -1
            if kind == "mark" and word in "([{":
                stack.append(i)
        self.head = [self.size] * (self.size + 2)  # where what goes on at a token meets a body, a statement's end or a bracket's
        for i in range(self.size - 1, -1, -1):
            self.head[i] = i if self.word(i) in ("{", ";", ")", "]", "}") else self.head[self.over(i)]

    def _ends_statement(self) -> bool:
        if not self.words:
            return False
        kind, word = self.kinds[-1], self.words[-1]
        return kind in ("string", "number") or word in (")", "]", "}", "return") or kind == "word" and word not in PLAIN["go"]

    def word(self, i: int) -> str:
        """A word or mark; nothing for strings and outside the text."""
        return self.words[i] if 0 <= i < self.size and self.kinds[i] != "string" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.size and self.kinds[i] == "word"

    def line(self, i: int) -> int:
        return bisect_right(self.starts, self.at[i])

    def over(self, i: int) -> int:
        """The token after ``i``, behind its pair where it opens a bracket."""
        return (self.pair[i] if self.word(i) in ("(", "[", "{") else i) + 1

    def end(self, i: int) -> int:
        """The first semicolon from ``i`` on that no bracket opened since hides, or the end of the bracket around it."""
        while i < self.size and self.word(i) != ";" and self.word(i) not in CLOSING:
            i = self.over(i)
        return i

    def angle(self, i: int) -> int:
        """The ``<`` that the ``>`` at ``i`` closes as a list of types, or ``i`` where it is a comparison."""
        depth, j = 0, i
        while j >= 0 and (self.is_name(j) or self.word(j) in ("<", ">", ",", ".", "?", "[", "]", "::", "&")):
            depth += (self.word(j) == ">") - (self.word(j) == "<")
            if not depth:
                return j
            j -= 1
        return i


def _types(src: Source) -> Iterator[tuple]:
    """``(kind, name, keyword, last, body, is an enum)`` of types by keyword; ``kind`` is empty where only the body counts."""
    words, shown = TYPES[src.lang]
    for i in range(src.size):
        word = src.word(i)
        if word not in words or not src.is_name(i) or src.word(i - 1) in (".", ":", ",", "::", "=", "("):
            continue
        name = i + 1
        if word == "record":
            name += src.word(name) in ("class", "struct") and src.is_name(name + 1)
            if src.word(name + 1) not in ("(", "{", ";", "<", ":"):
                continue
        elif src.word(i - 1) == "record":
            continue
        if not src.is_name(name):
            continue
        end = src.head[name + 1]
        body = end if src.word(end) == "{" else None
        hidden = src.lang == "java" and src.word(i - 1) == "@"  # an annotation's own declaration
        yield "class" if word in shown and not hidden else "", src.words[name], i, src.over(end) - 1, None if hidden else body, word == "enum"


def _first(src: Source, i: int) -> int:
    """Where a declaration at ``i`` begins: its modifiers, without annotations or attributes above them."""
    while src.is_name(i - 1) and src.word(i - 2) not in ("@", ".") and src.word(i - 1) not in TYPES[src.lang][0] - {"record"}:
        i -= 1
    return i


def _bodies(src: Source, types: list[tuple]) -> Iterator[tuple[int, bool]]:
    """Opening brackets whose insides are members, and whether they begin with an enum's constants."""
    for *_, body, is_enum in types:
        if body is not None and not (is_enum and src.lang == "csharp"):
            yield body, is_enum
            if is_enum:
                i = body + 1
                while i < src.pair[body] and src.word(i) != ";":
                    if src.word(i) == "{":
                        yield i, False
                    i = src.over(i)
    if src.lang != "java":
        return
    for i in range(src.size):
        if src.word(i) == "{" and src.word(i - 1) == ")":
            j = src.pair[i - 1] - 1
            j = src.angle(j) - 1 if src.word(j) == ">" else j
            while src.is_name(j) and src.word(j - 1) == ".":
                j -= 2
            if src.word(j - 1) == "new":
                yield i, False


def _members(src: Source, body: int, is_enum: bool) -> Iterator[tuple]:
    """``("function", name, first, last, place of the name)`` of the methods and constructors directly inside a body."""
    close, i = src.pair[body], body + 1
    if is_enum:
        i = src.end(i) + 1
    while i < close:
        start, name, words = None, None, set()
        while i < close:
            word = src.word(i)
            if src.lang == "java" and word == "@" and src.word(i + 1) != "interface":
                i += 2
                while src.word(i) == ".":
                    i += 2
                i = src.over(i) if src.word(i) == "(" else i
                continue
            if src.lang == "csharp" and word == "[" and start is None:
                i = src.over(i)
                continue
            start = i if start is None else start
            if word in (";", "{", "=", "=>"):
                break
            if word == "(" and name is None:
                j = i - 1
                j = src.angle(j) - 1 if src.word(j) == ">" else j
                if j >= start and src.is_name(j) and src.word(j - 1) != "~":
                    name = j
            if name is None:
                words.add(word)
            i = src.over(i)
        if i >= close:
            return
        if src.word(i) in ("=", "=>"):
            i = src.end(i)
        last = min(src.over(i) - 1, close)
        if name is not None and not words & NO_METHOD[src.lang] and src.word(name - 1) != "record":
            yield "function", src.words[name], start, last, name
        i = last + 1


def _go(src: Source) -> Iterator[tuple]:
    """Functions, methods and type definitions; aliases are none."""
    for i in range(src.size):
        if not src.is_name(i):
            continue
        if src.words[i] == "func":
            name = src.over(i + 1) if src.word(i + 1) == "(" else i + 1
            if not src.is_name(name) or src.word(src.over(name + 1) if src.word(name + 1) == "[" else name + 1) != "(" or src.word(i - 1) not in ("", ";", "}"):
                continue
            end = src.head[name + 1]
            while src.word(end) == "{" and src.word(end - 1) in ("interface", "struct"):
                end = src.head[min(src.over(end), src.size)]
            yield "function", src.words[name], i, src.over(end) - 1 if src.word(end) == "{" else end - 1, name
        elif src.words[i] == "type" and (src.word(i + 1) == "(" or src.is_name(i + 1)):
            specs = [i + 1]
            if src.word(i + 1) == "(":
                inside = [j for j in range(i + 2, src.pair[i + 1]) if src.opened[j] == i + 1]
                specs = [j for j in inside if src.is_name(j) and (j == i + 2 or src.word(j - 1) == ";")]
            for j in specs:
                if src.word(j + 1) != "=":
                    yield "class", src.words[j], j, src.end(j + 1) - 1, j


def _calls(src: Source, declared: set[int]) -> list[tuple[int, str]]:
    """``(first token, name)`` of each call in order, those that enclose others first; the name is the last one of what is called."""
    found, called = [], set()
    for i in range(1, src.size):
        if src.word(i) != "(":
            continue
        j = i - 1
        if src.word(j) == ">" and src.lang == "csharp":
            at = src.angle(j) - 1
            name, j = next((k for k in range(j, at, -1) if src.is_name(k)), at), at
        elif src.lang == "go" and src.word(j) == "]":
            name = j = src.pair[j] - 1 if src.pair[j] < src.size else j
        elif src.lang == "go" and src.word(j) in (")", "}"):
            k = src.pair[j]
            literal = _literal(src, k) if src.word(j) == "}" else k - 1 if k in called else -1
            name = next((n for n in range(j, 0, -1) if src.is_name(n) and src.words[n] not in UNNAMED), j) if literal >= 0 else j
        else:
            name = j
        if not src.is_name(name) or not (src.is_name(j) or src.lang == "go") or src.words[j] in PLAIN[src.lang] or name in declared or j in declared:
            continue
        start = literal if src.lang == "go" and src.word(j) in (")", "}") else j
        while src.word(start - 1) in (".", "?.", "::", "!"):
            start -= 2
            while start > 0 and src.word(start) in (")", "]") and src.pair[start] < start:
                start = src.pair[start] - 1
            if not src.is_name(start):
                start += 1
                break
        before = src.word(start - 1)
        if src.lang != "go" and (before in ("new", "@", "instanceof", "case") or src.is_name(start - 1) and before not in BEFORE):
            continue
        if src.lang == "go" and before == "]" and start == j:
            continue  # a conversion to a slice
        called.add(i)
        found.append((start, -src.pair[i], src.words[name].lstrip("@")))
    return [(start, name) for start, _, name in sorted(found)]


def _literal(src: Source, brace: int) -> int:
    """The keyword of the function without a name whose body a Go block is, or -1."""
    j = brace - 1
    while j > 0 and src.word(j) not in (";", "{", "}", "=", ","):
        j = src.pair[j] if src.word(j) in CLOSING and src.pair[j] < j else j
        if src.word(j) == "(" and src.word(j - 1) == "func":
            return j - 1
        j -= 1
    return -1


def _imports(src: Source) -> list[str]:
    """Imported names in order, once each: what follows the keyword, as it is written (Go: the quoted path)."""
    out, text = [], src.text
    word = "using" if src.lang == "csharp" else "import"
    for i in range(src.size):
        if not src.is_name(i) or src.words[i] != word:
            continue
        if src.lang == "go":
            end = src.pair[i + 1] if src.word(i + 1) == "(" else src.end(i + 1)
            out += [src.words[j].strip("\"`") for j in range(i, min(end, src.size)) if src.kinds[j] == "string"]
            continue
        scope, before = src.opened[i], "global" if src.word(i - 1) == "global" else ""
        if scope >= 0 and not any(src.word(k) == "namespace" for k in range(max(0, scope - 12), scope)) or src.word(i + 1) in ("(", "var", "await"):
            continue
        end = src.end(i + 1)
        if end < src.size and (src.word(i - 1) in ("", ";", "}", "{") or before):
            head = text[src.at[i] + len(word) : src.at[end]].strip()
            out.append(f"global using {head}" if before else head.removeprefix("static ").strip())
    return list(dict.fromkeys(x for x in out if x))


def declared(path: str, text: str | None, lang: str) -> Iterator[tuple]:
    """The symbol rows of one file, in the order of their places; a name that repeats on a line counts once."""
    src = Source(text or "", lang)
    if lang == "go":
        rows = list(_go(src))
    else:
        types = list(_types(src))
        rows = [(kind, name, _first(src, i), last, i) for kind, name, i, last, _, _ in types if kind]
        rows += [m for body, is_enum in dict(_bodies(src, types)).items() for m in _members(src, body, is_enum)]
    calls = _calls(src, {name for *_, name in rows})
    places = [start for start, _ in calls]
    imports, seen = _imports(src), set()
    for kind, name, first, last, _ in sorted(rows, key=lambda r: (r[2], -r[3])):
        name, last = name.lstrip("@"), min(max(last, first), src.size - 1)
        start, end = src.line(first), src.line(last)
        if (name, start) in seen:
            continue
        seen.add((name, start))
        within = calls[bisect_right(places, first) : bisect_right(places, last)] if kind == "function" else []
        signature = src.text[src.at[first] : src.at[last] + len(src.words[last])].splitlines()[0][:120]
        yield f"{path}::{name}:{start}", kind, name, path, start, end, signature, "", list(dict.fromkeys(n for _, n in within if n not in UNNAMED)), imports, len(seen) - 1
