"""Name-literal pairs of source and configuration syntax, in one pass linear in the text.

Read are: ``name = value`` with ``:=``, ``+=``, ``=>``, ``:`` and typed
``name: T = value`` (code, INI, TOML, YAML, JSON, shell, command-line flags),
``name["key"] = value``, ``#define NAME value``, XML ``<add key="name"
value="..."/>`` and ``<name>value</name>``.  A value is a string in single, double,
triple or back quotes, an unquoted word, a YAML block scalar, or a chain of strings
and names joined by ``+`` or, in parentheses, by standing next to each other; it may
begin on the next line if that line begins with a quote or a parenthesis was opened.

Names are matched possessively and only at their first character, a quote that its
line does not close is remembered, and names within an unquoted value share it out
among themselves (``url=http://h/?a=1&b=2``: url has all of it, a and b their own
parts), so nothing is read more than a few times.
"""

from __future__ import annotations

import re
from typing import NamedTuple

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
HEAD = re.compile(
    r"""(?<![A-Za-z0-9_.\-])--?+(?P<flag>[A-Za-z_][A-Za-z0-9_.\-]*+)=(?!=)
    |(?:(?P<quote>["'])(?P<quoted>[A-Za-z_][A-Za-z0-9_.\-\x20]*+)(?P=quote)|(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+))
    (?:\[["']?(?P<key>[A-Za-z0-9_\-]++)["']?\])?[\x20\t]*+
    (?::=|=>|\+?=(?![=>~])|:[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\]|]*+[\x20\t]++=[\x20\t]|:(?![:=/]))""",
    re.X,
)
DEFINE = re.compile(r"\#[\x20\t]*+define[\x20\t]++(?P<name>[A-Za-z_][A-Za-z0-9_]*+)[\x20\t]++")
TAG = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?P<rest>[^<>]*+)>(?:(?P<text>[^<>]++)</)?")
ATTRIBUTE = re.compile(r"""(?<![A-Za-z0-9_.:\-])(?P<name>[A-Za-z_][A-Za-z0-9_.:\-]*+)\s*+=\s*+(?P<quote>["'])(?P<value>[^"'<>]*+)(?P=quote)""")
UNQUOTED, PART = re.compile(r"""[^\s,;"'`{}()\[\]<>]++"""), re.compile(r"""[^\s,;&"'`{}()\[\]<>]++""")
BODY = {'"': re.compile(r'(?:[^"\\\n]++|\\.)*+'), "'": re.compile(r"(?:[^'\\\n]++|\\.)*+"), "`": re.compile(r"(?:[^`\\]++|\\.)*+", re.S)}
PREFIX = re.compile(r"""[rbufRBUF]{1,2}(?=["'])""")
BLANK, GAP = re.compile(r"[\x20\t]*+"), re.compile(r"(?:\s++|\\\n)*+")
NEXT_LINE = re.compile(r"""[\x20\t]*+\r?\n[\x20\t]*+(?=["'`])""")
BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[\x20\t]*+\r?\n")
LINE = re.compile(r"(?P<indent>[\x20\t]*+)(?P<text>[^\r\n]*+)\r?\n?")
NAMING, VALUING = ("key", "name", "id"), "value"


class Term(NamedTuple):
    """A literal (quotes left out) or a name of the right side of an assignment."""

    start: int
    end: int
    value: str
    is_name: bool


class _Reader:
    def __init__(self, text: str) -> None:
        self.text = text
        self.open_until: dict[str, int] = {}  # up to there, this quote opens nothing that closes
        self.block_end = 0
        self.word_end = 0  # of the last unquoted value
        self.next_head = len(text)

    def string(self, at: int) -> tuple[list[Term], int] | None:
        """The string that opens at a quote: its literals, a line each, and where it ends."""
        text, quote = self.text, self.text[at]
        triple = quote * 3
        if quote != "`" and text.startswith(triple, at) and at >= self.open_until.get(triple, 0):
            end = text.find(triple, at + 3)
            if end >= 0:
                return self.lines(at + 3, end), end + 3
            self.open_until[triple] = len(text)
        if at < self.open_until.get(quote, 0):
            return None
        end = BODY[quote].match(text, at + 1).end()
        if text[end : end + 1] != quote:
            self.open_until[quote] = end
            return None
        return [Term(at + 1, end, text[at + 1 : end], False)], end + 1

    def lines(self, start: int, end: int) -> list[Term]:
        """The lines of a piece of text, white space around them left out."""
        out, at = [], start
        for line in self.text[start:end].split("\n"):
            value = line.strip()
            if value:
                first = at + line.index(value)
                out.append(Term(first, first + len(value), value, False))
            at += len(line) + 1
        return out or [Term(start, start, "", False)]

    def block(self, head: int, at: int) -> list[Term]:
        """The lines below a YAML key that are indented further than it."""
        text = self.text
        own = head - (text.rfind("\n", 0, head) + 1)
        terms, here = [], at
        while here < len(text):
            m = LINE.match(text, here)
            if m["text"] and len(m["indent"]) <= own:
                break
            if m["text"]:
                value = m["text"].rstrip()
                terms.append(Term(m.start("text"), m.start("text") + len(value), value, False))
            if m.end() == here:
                break
            here = m.end()
        self.block_end = max(self.block_end, here)
        return terms

    def term(self, at: int, first: bool) -> tuple[list[Term], int] | None:
        text = self.text
        prefix = PREFIX.match(text, at)
        at = prefix.end() if prefix else at
        if text[at : at + 1] in BODY and at < len(text):
            return self.string(at)
        name = NAME.match(text, at)
        if name and (not first or self.chained(name.end())):
            return [Term(at, name.end(), name[0], True)], name.end()
        if not first:
            return None
        if at < self.word_end:  # within another name's value: up to the next name
            word = PART.match(text, at, max(at, min(self.next_head, self.word_end)))
        else:
            word = UNQUOTED.match(text, at)
            self.word_end = word.end() if word else 0
        if word is None:
            return None
        return [Term(at, word.end(), word[0], NAME.fullmatch(word[0]) is not None)], word.end()

    def chained(self, at: int) -> bool:
        """Is a name that ends here followed by + and another term?  In base64 a + has neither blanks nor a quote beside it."""
        plus = BLANK.match(self.text, at).end()
        if self.text[plus : plus + 1] != "+":
            return False
        after = BLANK.match(self.text, plus + 1).end()
        return self.text[after : after + 1] in ('"', "'", "`") or (plus > at and after > plus + 1)

    def value(self, head: int, at: int) -> list[Term]:
        """The terms of the value that begins here, for the name that begins at ``head``."""
        text = self.text
        at = BLANK.match(text, at).end()
        inside = text[at : at + 1] == "("
        if inside:
            at = GAP.match(text, at + 1).end()
        elif m := NEXT_LINE.match(text, at):
            at = m.end()
        elif head >= self.block_end and (m := BLOCK.match(text, at)):
            return self.block(head, m.end())
        terms: list[Term] = []
        while found := self.term(at, not terms):
            terms += found[0]
            gap = (GAP if inside else BLANK).match(text, found[1]).end()
            sign = text[gap : gap + 1]
            if sign == "+" and text[gap + 1 : gap + 2] != "=":
                at = GAP.match(text, gap + 1).end()
            elif inside and sign and (sign in BODY or PREFIX.match(text, gap)):
                at = gap
            else:
                break
        return terms


def assignments(text: str) -> list[tuple[str, list[Term]]]:
    """(target name, terms of its value) of each pair, in the order of their names."""
    reader, found = _Reader(text), []
    heads = list(HEAD.finditer(text))
    for m, after in zip(heads, [*heads[1:], None]):
        reader.next_head = after.start() if after else len(text)
        group = "flag" if m["flag"] else "name" if m["name"] else "quoted"
        if terms := reader.value(m.start(), m.end()):
            found.append((m.start(group), f"{m[group]}.{m['key']}" if m["key"] else m[group], terms))
    reader.word_end, reader.next_head = 0, len(text)
    if "#" in text:
        for m in DEFINE.finditer(text):
            if terms := reader.value(m.start(), m.end()):
                found.append((m.start("name"), m["name"], terms))
    if "<" in text:
        for m in TAG.finditer(text):
            if m["text"]:
                found.append((m.start("name"), m["name"], reader.lines(*m.span("text"))))
            given = {a["name"].lower(): a for a in ATTRIBUTE.finditer(text, *m.span("rest"))} if m["rest"] else {}
            name = next((given[k] for k in NAMING if k in given), None)
            if name and VALUING in given:
                start, end = given[VALUING].span("value")
                found.append((name.start("value"), name["value"], [Term(start, end, text[start:end], False)]))
    return [(target, terms) for _, target, terms in sorted(found, key=lambda f: f[0])]
