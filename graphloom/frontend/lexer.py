"""Tokens of ECMAScript 2022 modules."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, private, number, string, punct, template, regex, end
    value: str
    start: int
    end: int
    line: int
    after_newline: bool


class SyntaxProblem(ValueError):
    pass


BLANK = re.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*+")
NAME = re.compile(r"#?(?:[\w$]|[^\x00-\x7f\s\u2028\u2029]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))+")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?")
STRING = re.compile(r"""'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*\"""")
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
# Punctuators, longest first.
PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\n\r\u2028\u2029])|([\s\S]))")
SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def unescaped(body: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16))
        return "" if m[4] else SIMPLE.get(m[5], m[5])

    return ESCAPE.sub(one, body) if "\\" in body else body


class Lexer:
    """Reads tokens on demand; whether a slash begins a regular expression is for the parser to say."""

    def __init__(self, code: str):
        self.code = code
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|[\n\r\u2028\u2029]", code))]

    def line_at(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, offset)

    def token(self, at: int) -> Token:
        m = BLANK.match(self.code, at)
        start = m.end()
        line, newline = self.line_at(start), self.line_at(start) > self.line_at(at)
        if start >= len(self.code):
            return Token("end", "", start, start, line, newline)
        c = self.code[start]
        if c.isdigit() or c == "." and self.code[start + 1 : start + 2].isdigit():
            kind, m = "number", NUMBER.match(self.code, start)
        elif c in "'\"":
            kind, m = "string", STRING.match(self.code, start)
        elif c == "`":
            return Token("template", "`", start, start + 1, line, newline)
        elif p := PUNCT.match(self.code, start):
            kind, m = "punct", p
        else:
            kind, m = "name", NAME.match(self.code, start)
            if m and m[0][0] == "#":
                kind = "private"
        if not m or m.end() == start:
            raise SyntaxProblem(f"line {line}: unexpected {c!r}")
        return Token(kind, m[0], start, m.end(), line, newline)

    def regex(self, t: Token) -> Token:
        m = REGEX.match(self.code, t.start)
        if not m:
            raise SyntaxProblem(f"line {t.line}: unterminated regular expression")
        return Token("regex", m[0], t.start, m.end(), t.line, t.after_newline)
