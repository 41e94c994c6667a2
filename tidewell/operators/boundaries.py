"""Where texts may be cut: sentences and words by the Unicode rules, code by its nesting.

Sentences follow UAX #29 (rules SB3 to SB998, over classes of characters), words and
characters that a reader sees as one follow the same annex by the ``regex`` module. Code is
scanned once for brackets outside strings, comments and literals of its language
family, which gives the nested blocks; Python's come from its own parser.
"""

from __future__ import annotations

import ast
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import regex

# ---- sentences and words -------------------------------------------------------

#: Full stops that may also end an abbreviation or stand in a number, and other ends of sentences.
FULL_STOPS = ".\u2024\ufe52\uff0e"
ENDS = "!?\u0589\u061e\u061f\u06d4\u0700\u0701\u0702\u07f9\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u1803\u1809\u203c\u203d\u2047\u2048\u2049\u2e2e\u3002\ufe56\ufe57\uff01\uff1f\uff61"
#: Marks after which a sentence goes on.
GOES_ON = ",-:\u055d\u060c\u060d\u07f8\u1802\u1808\u2013\u2014\u3001\ufe10\ufe11\ufe13\ufe31\ufe32\ufe50\ufe51\ufe55\ufe58\ufe63\uff0c\uff0d\uff1a\uff64"
#: Titles and the like, whose full stop ends no sentence before a blank; an addition to the rules.
TITLES = frozenset("Mr Mrs Ms Dr Prof St Jr Sr Rev Gen Col Capt Lt Hon Fig Figs No Nos vs cf Bd Hr Fr Mme Mlle Sra Srta Ud Uds bzw usw evtl".split())


@lru_cache(maxsize=1 << 16)
def sentence_class(c: str) -> str:
    """A letter for a character's class in the sentence rules: N line end, X joined to what is before, P blank, T full
    stop, S other end, K goes on, C quote or bracket, D digit, L lower, U upper, O other letter, ``_`` all else."""
    if c in "\r\n\x85\u2028\u2029":
        return "N"
    kind = unicodedata.category(c)
    if kind in ("Mn", "Mc", "Me") or kind == "Cf" and c != "\u200b" or c in "\u200c\u200d":
        return "X"
    if kind == "Zs" or c in "\t\x0b\x0c":
        return "P"
    for chars, name in ((FULL_STOPS, "T"), (ENDS, "S"), (GOES_ON, "K")):
        if c in chars:
            return name
    if kind in ("Ps", "Pe", "Pi", "Pf") or c in "\"'\u275b\u275c\u275d\u275e\u275f\u2760":
        return "C"
    if kind == "Nd" or c in "\u066b\u066c":
        return "D"
    if c.islower() or kind == "Ll":
        return "L"
    if kind in ("Lu", "Lt"):
        return "U"
    return "O" if kind in ("Lo", "Lm", "Nl") or c == "\u05f3" else "_"


# An end, its quotes, its blanks, its line end.
_ENDING = re.compile(r"([TS])X*((?:CX*)*)((?:PX*)*)((?:N(?<!X))?)|N")
_LOWER_FOLLOWS = re.compile(r"[^OULNTS]*L")


def sentence_ends(text: str, start: int = 0, stop: int | None = None, titles: frozenset[str] = TITLES) -> list[int]:
    """Places within ``text[start:stop]`` where a sentence ends, the last one's own end left out."""
    part = text[start:stop]
    classes = "".join(map(sentence_class, part))
    out = []
    at = 0
    while m := _ENDING.search(classes, at):
        end = m.end()
        crlf = end < len(part) and part[end - 1 : end + 1] == "\r\n"
        if classes[end - 1] == "N":  # a line end always ends a sentence, too
            out.append(end + crlf)
            at = end + crlf
            continue
        at = end
        if end == len(classes):
            break
        after = classes[end]
        bare = not m[2] and not m[3]
        if m[1] == "T":
            before = classes[: m.start()].rstrip("X")[-1:]
            if bare and (after == "D" or after == "U" and before in ("U", "L")):
                continue
            if _LOWER_FOLLOWS.match(classes, end):
                continue
            if m[3] and not m[2] and titles and part[max(m.start() - 8, 0) : m.start()].replace("(", " ").rpartition(" ")[2] in titles:
                continue
        if after in "KTS":
            continue
        out.append(end)
    return [start + e for e in out if e < len(part)]


_WORDS = regex.compile(r"(?w)\b")
_CHARACTERS = regex.compile(r"\X")


def word_ends(text: str, start: int = 0, stop: int | None = None) -> list[int]:
    """Places between words by the Unicode rules, so also in scripts without blanks."""
    part = text[start:stop]
    return [start + m.start() for m in _WORDS.finditer(part) if 0 < m.start() < len(part)]


def character_ends(text: str, start: int = 0, stop: int | None = None) -> list[int]:
    """Places between characters as a reader sees them."""
    part = text[start:stop]
    return [start + m.end() for m in _CHARACTERS.finditer(part) if m.end() < len(part)]


# ---- code ----------------------------------------------------------------------


@dataclass
class Block:
    """A stretch of code, and the blocks inside its brackets."""

    start: int
    end: int
    inner: list[Block] = field(default_factory=list)


_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:.*?\*/|.*\Z)"
_DOUBLE = r'"(?:\\.|[^"\\])*(?:"|\Z)'
_CHAR = r"'(?:\\[^\n]|[^'\\\n])+'"
#: What of each language family isn't code, and its strings that are raw or hold code of their own.
_SKIPPED = {
    "rust": (r'b?r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z)', _DOUBLE, r"b?'(?:\\(?:u\{[^}\n]*\}|x..|[^\n])|[^'\\\n])'"),
    "c": (r'(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\(.*?(?:\)(?P=mark)"|\Z)', _DOUBLE, _CHAR, r"^[ \t]*#(?:\\\n|[^\n])*"),
    "java": (r'"""(?:\\.|.)*?(?:"""|\Z)', _DOUBLE, _CHAR),
    "go": (r"`[^`]*(?:`|\Z)", _DOUBLE, _CHAR),
    "js": (_DOUBLE, r"'(?:\\.|[^'\\\n])*'", r"(?:(?<=[(,=:\[!&|?{};])|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"),
}
_TOKENS = {family: re.compile("|".join([*([_LINE, _BLOCK] if family != "rust" else [_LINE, r"/\*"]), *skipped, r"(?P<mark_>[{}()\[\];`])"]), re.S | re.M) for family, skipped in _SKIPPED.items()}
_NESTED = re.compile(r"/\*|\*/")
_REST = re.compile(r"[ \t]*[;,)]*[ \t]*(?://[^\n]*)?(?:\n|\Z)")
_BLANK = re.compile(r"\n[ \t]*\n")


def _comment_end(text: str, at: int) -> int:
    """End of a comment that may hold comments."""
    depth = 0
    for m in _NESTED.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """End of a template string from its backtick on; code in ``${...}`` may hold strings of its own."""
    i, open_ = at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif not open_ or open_[-1] == "`":  # in a template's text
            if c == "`":
                if not open_:
                    return i + 1
                open_.pop()
            elif text.startswith("${", i):
                open_.append("{")
                i += 1
        elif c == "`":
            open_.append("`")
        elif c == "{":
            open_.append("{")
        elif c == "}":
            open_.pop()
        elif c in "\"'":
            m = re.compile(rf"{c}(?:\\.|[^{c}\\\n])*{c}?").match(text, i)
            i = m.end() - 1
        i += 1
    return len(text)


def code_blocks(text: str, family: str) -> list[Block]:
    """The nested blocks of code with braces; together those of a level and what lies between are all of it.

    A block ends after a closing brace that ends its line, after a semicolon, or before a
    blank line, all outside of round and square brackets. Brackets in strings, comments and literals don't count.
    """
    tokens = _TOKENS[family]
    # For each open brace: the blocks done in it, where the next one starts, its inner blocks so far, open brackets.
    stack: list[list] = [[[], 0, [], 0]]

    def close(end: int) -> None:
        done, start, inner, _ = stack[-1]
        if text[start:end].strip():
            done.append(Block(start, end, inner))
        stack[-1][1], stack[-1][2] = end, []

    def blanks(until: int) -> None:
        if not stack[-1][3]:
            while m := _BLANK.search(text, max(stack[-1][1], blanks.at), until):
                if text[stack[-1][1] : m.start()].strip():
                    close(m.end())
                blanks.at = m.end()
        blanks.at = max(blanks.at, until)

    blanks.at = 0
    at = 0
    while m := tokens.search(text, at):
        blanks(m.start())
        mark, at = m["mark_"], m.end()
        if mark is None:
            if family == "rust" and m[0] == "/*":
                at = _comment_end(text, m.start())
            elif not at > m.start():
                at = m.start() + 1
            blanks.at = at
            continue
        if mark == "`":
            if family == "js":
                at = _template_end(text, m.start())
                blanks.at = at
        elif mark == "{":
            stack.append([[], at, [], 0])
        elif mark == "}":
            if len(stack) > 1:
                close(m.start())
                inner = stack.pop()[0]
                stack[-1][2] += inner
                if not stack[-1][3] and (rest := _REST.match(text, at)):
                    at = rest.end()
                    close(at)
                    blanks.at = at
        elif mark in "([":
            stack[-1][3] += 1
        elif mark in ")]":
            stack[-1][3] = max(0, stack[-1][3] - 1)
        elif not stack[-1][3]:
            rest = _REST.match(text, at)
            at = rest.end() if rest else at
            close(at)
            blanks.at = max(blanks.at, at)
    while len(stack) > 1:  # braces that were never closed
        close(len(text))
        inner = stack.pop()[0]
        stack[-1][2] += inner
    blanks(len(text))
    close(len(text))
    return stack[0][0]


def python_blocks(text: str) -> list[Block]:
    """The nested statements of a Python text; a text that doesn't parse raises ``SyntaxError``."""
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))

    def first(node) -> int:
        return lines[min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1]

    def of(body: list, end: int) -> list[Block]:
        starts = [first(n) for n in body]
        out = []
        for node, a, z in zip(body, starts, [*starts[1:], end], strict=True):
            if z > a:
                inner = getattr(node, "body", None)
                out.append(Block(a, z, of(inner, z) if isinstance(inner, list) and inner and isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and first(inner[0]) > a else []))
        return out

    return of(ast.parse(text).body, len(text))
