"""Lexical state of TypeScript and JavaScript: what is code, string, template, comment and markup, at any depth.

Spark's patterns have no recursion and its windows no stack, so this one step runs in Python over Arrow
batches: a single pass over a text's bytes with a stack of open brackets, templates and elements. It only says what
stands where; what follows from it (parents, props, declarations, scopes, signatures) are DataFrame operations
in ``jsx`` and ``modules``. Offsets and columns count bytes of UTF-8, lines and columns start at 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE, TEXT, TAG, TEMPLATE = range(4)
_NAME = rb"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_COMMENT = rb"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_STRING = rb"\"(?:[^\"\\\n]|\\(?s:.))*\"?|'(?:[^'\\\n]|\\(?s:.))*'?"
#: A slash starts a regular expression where an operand is due.
_REGEX = rb"(?<=[(,=:\[!&|?{};+])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
#: What opens or closes something in code, with all before it that doesn't: strings, comments, and braces that hold none of these.
_IN_CODE = re.compile(rb"(?:%s|%s|%s|[^\"'/`{}< \t]++|[ \t]++|/|\{[^{}\"'`</]*+\}|<(?![A-Za-z_$>]))*+([`{}<])" % (_COMMENT, _REGEX, _STRING))
#: What most tokens are comes first: no two of these but comments and regular expressions start alike.
_TOKEN = re.compile(rb"[\w$\x80-\xff]++|=>|\.\.\.|[^\s\w$\"'/]|%s|%s|%s|/" % (_COMMENT, _REGEX, _STRING))
_IN_TEMPLATE = re.compile(rb"`|\$\{|\\(?s:.)")
_IN_TEXT = re.compile(rb"[<{]")
_OPENING = re.compile(rb"<(%s(?:[.:-]%s)*)(?!\s+extends\b|\s*,)(?:<[^<>(){};]*>)?" % (_NAME, rb"[\w$\x80-\xff]+"))
_CLOSING = re.compile(rb"</\s*((?:[\w$\x80-\xff]+(?:[.:-][\w$\x80-\xff]+)*)?)\s*>")
_ATTRIBUTE = re.compile(rb"(?:\s|%s)*(?:(/?>)|([\w$\x80-\xff][\w$\x80-\xff:.-]*)(\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?=[{<])))?|\{\s*(\.\.\.)?)" % _COMMENT)
_VALUE = rb"=(?:\"[^\"]*\"|'[^']*'|\{[^{}\"'`</]*\})"
#: A closing tag, or an opening one whose attributes nest nothing, with the text before it; what it doesn't match is read step by step.
_STEP = re.compile(rb"[^<{]*+(?:</((?:[\w$\x80-\xff]+(?:[.:-][\w$\x80-\xff]+)*+)?)>|<(%s(?:[.:-][\w$\x80-\xff]+)*+)(?!\s+extends\b|\s*,)((?:\s++[\w$\x80-\xff][\w$\x80-\xff:.-]*+(?:%s)?+)*+)\s*+(/?)>(?=\s*+(</)?))" % (_NAME + rb"+", _VALUE))  # a name is never given up in part
_PART = re.compile(rb"([\w$\x80-\xff][\w$\x80-\xff:.-]*+)(?:(=)(?:\"([^\"]*)\"|'([^']*)'|\{[^{}]*\}))?")
_OPERAND_ENDS = re.compile(rb"[\w)\]$]")
_BLANK = re.compile(rb"\s*")

_LINE_STARTS = rb"(?:(?<=[\n\r])|(?<=\xc2\x85)|(?<=\xe2\x80[\xa8\xa9])|\A)"  # as Spark's patterns have it
_RARE_BREAK = re.compile(rb"[\r\x85\xa8\xa9]")
IMPORT = r"[ \t]*import\b\s*(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s*as\s+[\w$]+\s*)?(?:\{([^}]*)\}\s*)?(?:from\s*)?[\"']([^\"']+)[\"']"
IMPORTED = r"^\s*(?:type\s+)?([\w$]+)"
_IMPORT, _IMPORT_AT_ANY_BREAK, _IMPORTED = re.compile(b"(?m)^" + IMPORT.encode()), re.compile(_LINE_STARTS + IMPORT.encode()), re.compile(IMPORTED.encode())

ELEMENT = "struct<name:string,line:int,column:int,has_children:boolean,up:int,parent:string,props:map<string,string>>"
ELEMENT_TYPE = pa.struct([("name", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("has_children", pa.bool_()), ("up", pa.int32()), ("parent", pa.string()), ("props", pa.map_(pa.string(), pa.string()))])


_NUMBERS = ("seq", "at", "to", "line", "column", "up", "mate", "scope", "prev", "next", "angle", "lead", "paren", "body", "block", "stop", "last")
TOKEN = f"struct<kind:string,text:string,{','.join(f'{n}:int' for n in _NUMBERS)},begins:boolean,scopes:array<int>,comment:string>"
TOKEN_TYPE = pa.struct([("kind", pa.string()), ("text", pa.string()), *((n, pa.int32()) for n in _NUMBERS), ("begins", pa.bool_()), ("scopes", pa.list_(pa.int32())), ("comment", pa.string())])
_NEAR, _AFTER, _BRACKET = "struct<text:string,at:int,line:int,column:int>", "struct<seq:int,kind:string,text:string,to:int,line:int>", "struct<seq:int,at:int,to:int,line:int,column:int,next:string,next_to:int>"
_END, _PARAMETERS = "struct<at:int,to:int,line:int,column:int,seq:int>", "array<struct<at:int,to:int,type_at:int,type_to:int>>"
#: A word that may declare something, with what it is linked to.
LINK = (
    "struct<seq:int,kind:string,text:string,at:int,to:int,line:int,column:int,up:int,scope:int,angle:int,begins:boolean,in_class:boolean,followed:boolean,"
    + ",".join([*(f"b{n}:{_NEAR}" for n in range(1, 5)), *(f"a{n}:{_AFTER}" for n in range(1, 5)), *(f"{c}:{_BRACKET}" for c in ("paren", "body", "block")), f"stop:{_END},last:{_END},leads:{_NEAR},parameters:{_PARAMETERS}>"])
)
BRACE = "struct<scope:int,scopes:array<int>>"
#: Words that declare a name.
DECLARING = tuple("function class const let var interface type enum namespace module".split())
#: A brace after one of these words, in the same statement, opens a scope that may have a name.
_SCOPE_WORDS = {b"class", b"interface", b"namespace", b"module", b"enum"}
#: A statement goes on behind these tokens, and where a line starts with one of those.
GOES_ON = tuple("= ( [ { , . : ? + - * / % & | ^ ! ~ < => ... @ extends implements as typeof keyof new await satisfies is in of return".split())
_BEFORE = frozenset(GOES_ON)
_CONTINUES = frozenset("= ) ] } { ( [ , ; . : ? + - * / % & | ^ < > => extends implements as satisfies is".split())
#: Braces behind these belong to a type or a value, not to a body.
_NO_BODY = frozenset(": | & < , => = is (".split())
_PAIRS = {b"(": b")", b"[": b"]", b"{": b"}"}
_CLOSERS = {b: a for a, b in _PAIRS.items()}
_OPENERS = frozenset([*_PAIRS, b"`"])


#: What linking asks of a token's text, as bits.
_GOES_ON, _CONTINUED, _SEMICOLON, _VARIABLE, _LESS, _GREATER, _PAREN, _BRACE, _TYPED, _DECLARES, _CLASS, _DOT, _COMMA, _EQUALS, _COLON, _QUESTION, _FOLLOWS = (1 << n for n in range(17))
_BITS: dict[bytes, int] = {}
for _texts, _bit in ((_BEFORE, _GOES_ON), (_CONTINUES, _CONTINUED), ((";",), _SEMICOLON), (("const", "let", "var"), _VARIABLE), (("<",), _LESS), ((">",), _GREATER), (("(",), _PAREN), (("{",), _BRACE), (_NO_BODY, _TYPED),
                      (DECLARING, _DECLARES), (("class",), _CLASS), ((".",), _DOT), ((",",), _COMMA), (("=",), _EQUALS), ((":",), _COLON), (("?",), _QUESTION), ("(<:=?!;", _FOLLOWS)):
    for _text in _texts:
        _BITS[_text.encode()] = _BITS.get(_text.encode(), 0) | _bit
_WORD_STARTS = frozenset(b for b in range(256) if b > 127 or chr(b).isalnum() or chr(b) in "_$")
#: Bytes of text that are read at a time; one longer text is read alone.
SLICE_BYTES = 1 << 19
#: The same where equal usages of a slice become one row: a larger slice has fewer of them, and its lists are short.
SHAPED_BYTES = 1 << 21
_KNOWN_PARTS, _KNOWN_BYTES = 4096, 256


@dataclass(slots=True)
class Frame:
    """What is open: a bracket's code, an element's text, a tag or a template."""

    kind: int
    owner: int  # the enclosing component's element
    counts: bool  # whether elements count here
    name: bytes = b""  # of a bracket, or of an element
    start: int = 0
    element: list | None = None
    opener: int = -1  # token
    scope: int = -1  # the brace of the enclosing scope
    named: bool = False  # whether the statement so far has a scope's word
    comment: str | None = None  # the last one, until a token takes it


class Scan:
    """One pass over a text. ``elements``: opening tags of components; tokens, if asked for: words, brackets, strings.

    Of an element ``up`` is the enclosing component's place in the list and ``parent`` its name, of a token the enclosing bracket's, else -1. Tags
    in strings, templates' text, comments and attributes' values are no elements; HTML tags and fragments
    stand between an element and its component without counting. Tokens are lists side by side, ``kinds``, ``texts``, ``ats``,
    ``ups`` and so on; ``token_rows`` ties them to each other.
    """

    #: Props of attributes' texts seen before, few and short ones.
    _known: dict[bytes, dict[str, str]] = {}

    def __init__(self, code: bytes, tokens: bool = False, markup: bool = True):
        self.code, self.markup, self.with_tokens = code, markup, tokens
        self.opened: list[list] = []  # name, offset, whether it has children, up, props
        self.kinds: list[str] = []
        self.texts: list[bytes] = []
        self.ats: list[int] = []
        self.ups: list[int] = []
        self.mates: list[int] = []
        self.within: list[int] = []
        self.scopes: dict[int, list[int]] = {}
        self.comments: dict[int, str] = {}
        self.stack = [Frame(CODE, -1, True)]
        at, step = 0, (self._code, self._text, self._tag, self._template)
        while at is not None:
            at = step[self.stack[-1].kind](at)

    @property
    def elements(self) -> list[dict]:
        return element_rows([self]).to_pylist(maps_as_pydicts="lossy")[0]

    def _token(self, kind: str, at: int, text: bytes) -> int:
        top, own = self.stack[-1], len(self.ats)
        self.kinds.append(kind)
        self.texts.append(text)
        self.ats.append(at)
        self.ups.append(top.opener)
        self.mates.append(-1)
        self.within.append(top.scope)
        if top.comment is not None and text not in (b";", b","):
            self.comments[own], top.comment = top.comment, None
        return own

    def _push(self, kind: int, counts: bool, name: bytes, at: int) -> None:
        """Open a bracket or template at an offset."""
        top, opener, scope = self.stack[-1], -1, -1
        if self.with_tokens:
            opener, scope = self._token("p" if kind == CODE else "t", at, name), top.scope
            if name == b"{" and top.named:
                self.scopes[opener] = [*(self.scopes[scope] if scope >= 0 else ()), opener]
                scope, top.named = opener, False
        self.stack.append(Frame(kind, top.owner, counts, name[-1:], at, None, opener, scope))

    def _close(self, at: int, text: bytes) -> None:
        """Close the bracket or template on top."""
        frame = self.stack.pop()
        if self.with_tokens:
            own = self._token("p" if frame.kind == CODE else "t", at, text)
            if frame.opener >= 0:
                self.mates[frame.opener], self.mates[own] = own, frame.opener

    def _leave_bracket(self, closer: bytes, at: int) -> bool:
        """Close the innermost bracket that a closer ends, with all that is open in it; whether that leads out of code."""
        stack, opens = self.stack, _CLOSERS[closer]
        depth = len(stack) - 1
        while depth and stack[depth].kind == CODE and stack[depth].name != opens:
            depth -= 1
        if not depth or stack[depth].kind != CODE:
            return False
        del stack[depth + 1 :]
        self._close(at, closer)
        return stack[-1].kind != CODE

    def _plain_code(self, at: int) -> int | None:
        """``_code`` where no tokens are asked for."""
        code, stack, step = self.code, self.stack, _IN_CODE.match
        while (m := step(code, at)) is not None:
            first, end = m[1], m.end()
            at = end - 1
            if first == b"<":
                if self.markup and not (at and _OPERAND_ENDS.match(code, at - 1)) and (opened := self._opened(at, stack[-1].counts)):
                    return opened
            elif first == b"}":
                if self._leave_bracket(first, at):
                    return end
            else:
                self._push(CODE if first == b"{" else TEMPLATE, stack[-1].counts, first, at)
                if first == b"`":
                    return end
            at = end
        return None

    def _code(self, at: int) -> int | None:
        if not self.with_tokens:
            return self._plain_code(at)
        code, stack, top = self.code, self.stack, self.stack[-1]
        kinds, texts, ats, ups, mates, within = self.kinds, self.texts, self.ats, self.ups, self.mates, self.within
        for m in iter(_TOKEN.scanner(code, at).search, None):
            text, at, kind = m[0], m.start(), "p"
            if text[0] in _WORD_STARTS:
                kind = "w"
                if text in _SCOPE_WORDS:
                    top.named = True
            elif len(text) == 1:
                if text in _OPENERS:
                    self._push(TEMPLATE if text == b"`" else CODE, top.counts, text, at)
                    if text == b"`":
                        return m.end()
                    top = stack[-1]
                    continue
                if text in _CLOSERS:
                    if self._leave_bracket(text, at):
                        return m.end()
                    top = stack[-1]
                    continue
                if text == b"<" and self.markup and not (at and _OPERAND_ENDS.match(code, at - 1)) and (opened := self._opened(at, top.counts)):
                    return opened
                if text == b";":
                    top.named = False
                elif text in b"\"'":
                    kind = "s"
            elif text[:2] in (b"//", b"/*"):
                top.comment = text.decode("utf-8", "replace")
                continue
            elif text[:1] in b"\"' \t/":
                kind = "s"
            if top.comment is not None and text not in (b";", b","):
                self.comments[len(ats)], top.comment = top.comment, None
            kinds.append(kind)
            texts.append(text)
            ats.append(at)
            ups.append(top.opener)
            mates.append(-1)
            within.append(top.scope)
        return None

    def _opened(self, start: int, counts: bool) -> int:
        """Go into the tag that starts here; where to read on, 0 if none does."""
        owner = self.stack[-1].owner
        fragment = self.code.startswith(b"<>", start)
        name = None if fragment else _OPENING.match(self.code, start)
        if name is None and not fragment:
            return 0
        if self.with_tokens:
            self._token("e", start, b"<")
        element = None
        if counts and name and name[1][:1].isupper():
            element = [name[1], start, False, owner, {}]
            self.opened.append(element)
        below = self.stack[-1]
        self.stack.append(Frame(TEXT if fragment else TAG, owner, counts, name[1] if name else b"", start, element, below.opener, below.scope))
        return name.end() if name else start + 2

    def _tag(self, at: int) -> int:
        tag, m = self.stack[-1], _ATTRIBUTE.match(self.code, at)
        if m is None:  # no tag after all
            self.stack.pop()
            if tag.element is not None:
                self.opened.pop()
            return at
        at, props = m.end(), tag.element[4] if tag.element is not None else {}
        if m[1]:
            self.stack.pop()
            if m[1] == b">":
                owner = tag.owner
                if tag.element is not None:
                    owner = len(self.opened) - 1
                    tag.element[2] = not self.code.startswith(b"</", _BLANK.match(self.code, at).end())
                self.stack.append(Frame(TEXT, owner, tag.counts, tag.name, tag.start, None, tag.opener, tag.scope))
        elif m[2]:
            text = m[4] if m[4] is not None else m[5]
            if b":" not in m[2]:
                props[m[2].decode("utf-8", "replace")] = "true" if m[3] is None else (text or b"").decode("utf-8", "replace")
            if m[3] is not None and text is None:
                if self.code.startswith(b"<", at):
                    return self._opened(at, False) or at
                self._push(CODE, False, b"{", at)
                at += 1
        else:
            if m[6]:
                props["...spread"] = ""
            brace = self.code.rfind(b"{", m.start(), at)
            self._push(CODE, False, b"{", brace)
        return at

    def _steps(self, at: int) -> int:
        """Go over closing tags and opening ones whose attributes nest nothing; where to read on."""
        code, stack, opened, known = self.code, self.stack, self.opened, self._known
        base = stack[-1]
        last, counts, owner, names, owners = None, base.counts, base.owner, [], []  # of the elements opened here, until they are frames
        for m in iter(_STEP.scanner(code, at).match, None):
            last = m
            closes, name, parts, alone, empty = m.groups()
            if name is None:
                if names and names[-1] == closes:
                    names.pop()
                    owner = owners.pop()
                    continue
                self._framed(names, owners, owner, counts)
                self._leave(closes)
                names, owners = [], []
                if stack[-1].kind != TEXT:
                    return m.end()
                base = stack[-1]
                counts, owner = base.counts, base.owner
                continue
            before = owner
            if counts and b"@" < name < b"[":  # an upper case letter first
                props = known.get(parts)
                if props is None:
                    props = {}
                    for key, given, double, single in _PART.findall(parts):
                        if b":" not in key:
                            props[key.decode("utf-8", "replace")] = (double or single).decode("utf-8", "replace") if given else "true"
                    if len(parts) <= _KNOWN_BYTES:
                        if len(known) >= _KNOWN_PARTS:
                            known.clear()
                        known[parts] = props
                opened.append([name, m.start(2) - 1, not alone and empty is None, before, props])
                if not alone:
                    owner = len(opened) - 1
            if not alone:
                names.append(name)
                owners.append(before)
        self._framed(names, owners, owner, counts)
        return at if last is None else last.end()

    def _framed(self, names: list[bytes], owners: list[int], owner: int, counts: bool) -> None:
        """Put open elements on the stack; each has the owner that the next one had before it."""
        for name, own in zip(names, [*owners[1:], owner]):
            self.stack.append(Frame(TEXT, own, counts, name))

    def _leave(self, name: bytes) -> None:
        """Leave the innermost element of a name with all that is open in it, if there is one in this text."""
        depth = len(self.stack) - 1
        while depth and self.stack[depth].kind == TEXT and self.stack[depth].name != name:
            depth -= 1
        if self.stack[depth].kind == TEXT:
            del self.stack[depth:]

    def _text(self, at: int) -> int | None:
        if not self.with_tokens:
            at = self._steps(at)
            if self.stack[-1].kind != TEXT:
                return at
        m = _IN_TEXT.search(self.code, at)
        if m is None:
            return None
        if m[0] == b"{":
            self._push(CODE, self.stack[-1].counts, b"{", m.start())
        elif close := _CLOSING.match(self.code, m.start()):
            self._leave(close[1])
            return close.end()
        else:
            return self._opened(m.start(), self.stack[-1].counts) or m.end()
        return m.end()

    def _template(self, at: int) -> int | None:
        m = _IN_TEMPLATE.search(self.code, at)
        if m is None:
            return None
        if m[0] == b"`":
            self._close(m.start(), m[0])
        elif m[0] == b"${":
            self._push(CODE, self.stack[-1].counts, m[0], m.start())
        return m.end()


def _texts(rows: Sequence[bytes | None]) -> pa.Array:
    """Pieces of texts as strings."""
    try:
        return pa.array(rows, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t if t is None else t.decode("utf-8", "replace") for t in rows], pa.string())


def _ends(rows: Sequence[Sequence]) -> pa.Array:
    return pa.array([0, *accumulate(map(len, rows))], pa.int32())


def _placed(scans: list[Scan], sizes: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and columns of offsets, so many of each text, side by side."""
    starts = np.cumsum([0, *(len(s.code) for s in scans)])[:-1]
    breaks = np.flatnonzero(np.frombuffer(b"".join(s.code for s in scans), np.uint8) == 10)
    first = np.repeat(starts, sizes)
    at, passed = ats + first, np.repeat(np.searchsorted(breaks, starts), sizes)
    before = np.searchsorted(breaks, at)
    line_start = np.where(before > passed, np.append(breaks, 0)[before - 1] + 1, first)
    return before - passed + 1, at - line_start + 1


def element_rows(scans: list[Scan]) -> pa.ListArray:
    """Each text's elements, field by field."""
    rows = [s.opened for s in scans]
    names, ats, children, ups, props = zip(*chain.from_iterable(rows)) if any(rows) else ((),) * 5
    sizes, ups, names = np.fromiter(map(len, rows), np.int64, len(rows)), np.array(ups, np.int64), _texts(names)
    lines, columns = _placed(scans, sizes, np.array(ats, np.int64))
    parents = pc.fill_null(names.take(pa.array(ups + np.repeat(np.cumsum(sizes) - sizes, sizes), pa.int64(), mask=ups < 0)), "")
    maps = pa.MapArray.from_arrays(_ends(props), pa.array(list(chain.from_iterable(props)), pa.string()), pa.array(list(chain.from_iterable(map(dict.values, props))), pa.string()))
    fields = {"name": names, "parent": parents, "line": lines, "column": columns, "has_children": children, "up": ups, "props": maps}
    columns = [v if isinstance(v := fields[f.name], pa.Array) else pa.array(v, f.type, safe=False) for f in ELEMENT_TYPE]
    return pa.ListArray.from_arrays(_ends(rows), pa.StructArray.from_arrays(columns, fields=list(ELEMENT_TYPE)))


def _sources(code: bytes) -> dict[bytes, bytes]:
    """Where a page imports each name from; the last import of a name counts."""
    sources = {}
    if b"import" not in code:
        return sources
    for default, names, source in (_IMPORT_AT_ANY_BREAK if _RARE_BREAK.search(code) else _IMPORT).findall(code):
        for part in names.split(b","):
            if m := _IMPORTED.match(part):
                sources[m[1]] = source
        if default:
            sources[default] = source
    return sources


def shape_rows(scans: list[Scan], ids: pa.Array, pages: pa.Array) -> pa.RecordBatch:
    """The slice's usages, equal ones as one row with the ``places`` where they stand; pages without any share one of no name."""
    shapes: dict[tuple, int] = {}
    facts: dict[tuple, int] = {}  # names with their source and children
    given: dict[tuple, int] = {}  # props by what they hold
    known: dict[int, int] = {}  # the same by identity
    own: list[int] = []  # each usage's shape, and for pages without any that of none
    for scan in scans:
        opened = scan.opened
        if not opened:
            own.append(shapes.setdefault((None, None, None), len(shapes)))
            continue
        sources, children = _sources(scan.code), {}
        for name, _, _, up, _ in opened:
            if up >= 0:
                parent = opened[up][0]
                if parent in children:
                    children[parent].add(name)
                else:
                    children[parent] = {name}
        said = {}  # of each name: where it comes from, what it holds
        for name, _, _, up, props in opened:
            if (of_name := said.get(name)) is None:
                of_name = said[name] = facts.setdefault((name, sources.get(name), frozenset(children.get(name, ()))), len(facts))
            if (held := known.get(id(props))) is None:
                held = known[id(props)] = given.setdefault(tuple(props.items()), len(given))
            key = (of_name, opened[up][0] if up >= 0 else b"", held)
            if (shape := shapes.get(key)) is None:
                shape = shapes[key] = len(shapes)
            own.append(shape)
    sizes = np.fromiter((len(s.opened) or 1 for s in scans), np.int64, len(scans))
    ats = np.fromiter(chain.from_iterable([e[1] for e in s.opened] or [0] for s in scans), np.int64, len(own))
    named = np.repeat([bool(s.opened) for s in scans], sizes)
    lines, of = _placed(scans, sizes, ats)[0], np.array(own, np.int64)
    order = np.argsort(of, kind="stable")
    page = pa.array(np.repeat(np.arange(len(scans)), sizes)[order], pa.int64())
    fields = [ids.take(page), pages.take(page), pa.array(lines[order], pa.int32(), mask=~named[order])]
    ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(shapes)))), pa.int32())
    places = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["page_id", "page", "line"]))
    texts, said = [dict(p) for p in given], [(name, source, sorted(held)) for name, source, held in facts]
    names, sources, children = zip(*((None, None, ()) if f is None else said[f] for f, _, _ in shapes)) if shapes else ((),) * 3
    parents, props = [parent for _, parent, _ in shapes], [{} if p is None else texts[p] for _, _, p in shapes]
    maps = pa.MapArray.from_arrays(_ends(props), pa.array(list(chain.from_iterable(props)), pa.string()), pa.array(list(chain.from_iterable(map(dict.values, props))), pa.string()))
    held = pa.ListArray.from_arrays(_ends(children), _texts(list(chain.from_iterable(children))))
    return pa.RecordBatch.from_arrays([_texts(names), maps, _texts(parents), _texts(sources), held, places], ["component_name", "props", "parent_component", "source", "children", "places"])


@dataclass(slots=True)
class Tokens:
    """Tokens of some texts side by side: ``own`` and ``links`` by name, places counted in each text, and what links are made of."""

    base: np.ndarray  # where each token's text starts
    ends: np.ndarray  # of each text
    bits: np.ndarray
    kinds: pa.Array
    texts: pa.Array
    own: dict[str, np.ndarray]
    order: np.ndarray  # siblings side by side
    opens: np.ndarray  # whether one is the first of its bracket, in that order


def linked_tokens(scans: list[Scan]) -> Tokens:
    """Tokens of some texts, tied to each other.

    Siblings are the tokens of one bracket. Links are places in the text's list, or -1: ``prev`` and ``next`` in the same bracket,
    ``paren``, ``body`` and ``block`` the next parenthesis, the next brace that can be a body, and the next of any kind; ``lead`` the
    statement's first word, ``stop`` its last token, ``last`` the bracket's; ``mate`` a bracket's other end. ``angle`` counts angle brackets
    open at a token, ``begins`` says whether a statement starts; ``scope`` is the brace of the enclosing class, interface, namespace or
    enum, and ``scopes``, at such braces, are all that are open; ``comment`` is the last comment before a token in its bracket, separators aside.
    """
    sizes = np.array([len(s.ats) for s in scans], np.int64)
    total, texts = int(sizes.sum()), list(chain.from_iterable(s.texts for s in scans))
    whole = lambda name: np.fromiter(chain.from_iterable(getattr(s, name) for s in scans), np.int64, total)
    text_of = np.repeat(np.arange(len(scans)), sizes)
    base = (np.cumsum(sizes) - sizes)[text_of]
    ats, ups = whole("ats"), whole("ups")
    lengths = np.fromiter(map(len, texts), np.int64, total)
    bits = np.fromiter((_BITS.get(t, 0) for t in texts), np.int64, total)

    lines, columns = _placed(scans, sizes, ats)

    # Siblings stand side by side in this order; all below is by place in it, until the links are put back in the texts' order.
    order = np.argsort(np.where(ups >= 0, ups + base, total + text_of), kind="stable")
    place, seq = np.arange(total), (np.arange(total) - base)[order]
    up, line, bit = np.where(ups >= 0, ups + base, total + text_of)[order], lines[order], bits[order]
    opens = np.append(True, up[1:] != up[:-1])[:total]
    starts = np.flatnonzero(opens)
    end = np.repeat(np.append(starts[1:], total), np.diff(np.append(starts, total))) if total else place
    bit_before, line_before = np.append(0, bit[:-1])[:total], np.append(0, line[:-1])[:total]
    begins = opens | (bit_before & _SEMICOLON > 0) | (line > line_before) & (bit_before & _GOES_ON == 0) & (bit & _CONTINUED == 0)
    lead = np.maximum.accumulate(np.where(begins | (bit & _VARIABLE > 0), place, -1))
    seq_at = lambda at: np.where(at >= 0, seq[at], -1)

    def following(marked: np.ndarray) -> np.ndarray:
        """The next marked sibling's place, or -1."""
        nearest = np.minimum.accumulate(np.where(marked, place, total)[::-1])[::-1]
        after = np.append(nearest[1:], total)[:total]
        return np.where(after < end, after, -1)

    semicolon, brace = bit & _SEMICOLON > 0, bit & _BRACE > 0
    ending = following(semicolon | begins & ~opens)
    stop = np.where(ending >= 0, ending - ~semicolon[ending], -1) if total else place
    open_angles = np.cumsum((bit & _LESS > 0).astype(np.int64) - (bit & _GREATER > 0))
    links = {
        "prev": np.where(opens, -1, np.append(-1, seq[:-1])[:total]), "next": np.where(place + 1 < end, np.append(seq[1:], -1)[:total], -1), "angle": open_angles[end - 1] - open_angles, "lead": seq_at(lead),
        "paren": seq_at(following(bit & _PAREN > 0)), "body": seq_at(following(brace & (opens | (bit_before & _TYPED == 0)))), "block": seq_at(following(brace)), "stop": seq_at(stop), "last": seq[end - 1],
        "begins": begins,
    }

    def back(name: str) -> np.ndarray:
        out = np.empty(total, links[name].dtype)
        out[order] = links[name]
        return out

    own = {"seq": place - base, "at": ats, "to": ats + lengths, "line": lines, "column": columns, "up": ups, "mate": whole("mates"), "scope": whole("within"), **{name: back(name) for name in links}}
    return Tokens(base, np.append(0, np.cumsum(sizes)), bits, pa.array(list(chain.from_iterable(s.kinds for s in scans)), pa.string()), _texts(texts), own, order, opens)


def token_rows(scans: list[Scan], tokens: Tokens | None = None) -> pa.ListArray:
    """Each text's tokens, as ``linked_tokens`` has them."""
    tokens = linked_tokens(scans) if tokens is None else tokens

    def sparse(name: str, kind: pa.DataType) -> pa.Array:
        at, values = np.full(len(tokens.base), -1), []
        for scan, start in zip(scans, tokens.ends):
            for own, value in getattr(scan, name).items():
                at[start + own] = len(values)
                values.append(value)
        return pa.array(values, kind).take(pa.array(at, pa.int32(), mask=at < 0))

    made = {"kind": tokens.kinds, "text": tokens.texts, "scopes": sparse("scopes", pa.list_(pa.int32())), "comment": sparse("comments", pa.string())}
    fields = [made[f.name] if f.name in made else pa.array(tokens.own[f.name], f.type, safe=False) for f in TOKEN_TYPE]
    return pa.ListArray.from_arrays(pa.array(tokens.ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(TOKEN_TYPE)))


def _parameters(t: Tokens) -> pa.Array:
    """What stands between the commas of each parenthesis, by place of the parenthesis: offsets of names and types; null at other tokens.

    Of a parameter the first ``=``, ``:`` and ``?`` outside of angle brackets count.
    """
    total = len(t.base)
    up = np.where(t.own["up"] >= 0, t.own["up"] + t.base, -1)[t.order]
    bits, at, to = t.bits[t.order], t.own["at"][t.order], t.own["to"][t.order]
    top = t.own["angle"][t.order] == 0
    comma = (bits & _COMMA > 0) & top
    no = np.cumsum(comma | t.opens)  # each stretch between commas
    used = np.flatnonzero((up >= 0) & (t.bits[up] & _PAREN > 0) & ~comma)
    if not len(used):
        return pa.nulls(total, pa.list_(pa.struct([(n, pa.int32()) for n in ("at", "to", "type_at", "type_to")])))
    starts = np.flatnonzero(np.append(True, np.diff(no[used]) != 0))
    first = lambda bit: np.minimum.reduceat(np.where((bits[used] & bit > 0) & top[used], used, total), starts)
    equals, colon, question = first(_EQUALS), first(_COLON), first(_QUESTION)
    colon = np.where(colon < equals, colon, total)
    question = np.where(question < np.where(colon < total, colon, np.where(equals < total, equals, total + 1)), question, total)
    begin, end = at[used][starts], np.maximum.reduceat(to[used], starts)
    far = np.iinfo(np.int64).max
    at, to = np.append(at, far), np.append(to, far)
    last = np.minimum.reduce([end, at[equals], at[colon], at[question]])
    typed = pa.array(np.where(colon < total, to[colon], 0), pa.int32(), mask=colon >= total)
    parts = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(last, pa.int32()), typed, pa.array(np.minimum(end, at[equals]), pa.int32())], ["at", "to", "type_at", "type_to"])
    # In the order of their parentheses, which are those of siblings.
    owner = up[used][starts]
    heads = np.flatnonzero(np.append(True, np.diff(owner) != 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)), pa.int32()), parts)
    places = np.full(total, -1)
    places[owner[heads]] = np.arange(len(heads))
    return lists.take(pa.array(places, pa.int64(), mask=places < 0))


def link_rows(t: Tokens, scripts: np.ndarray) -> pa.ListArray:
    """Of each text the words that may declare something, with what they are linked to; ``scripts`` says which texts are JavaScript.

    ``b1`` to ``b4`` and ``a1`` to ``a4`` are the tokens before and after in the same bracket; ``leads`` is the
    statement's first word; ``paren``, ``body`` and ``block`` are the next brackets with their ends, ``stop`` and ``last``
    the ends of the statement and of what the bracket holds, ``parameters`` what stands in ``paren``. ``in_class`` are words right in a class's braces,
    ``followed`` those that what stands behind allows to be a member.
    """
    own, total = t.own, len(t.base)
    place = lambda name: np.where(own[name] >= 0, own[name] + t.base, -1)
    before, after, up, mate, lead = (place(n) for n in ("prev", "next", "up", "mate", "lead"))
    has = lambda at, bit: (at >= 0) & (t.bits[at] & bit > 0)
    word = pc.equal(t.kinds, "w").to_numpy(zero_copy_only=False).astype(bool)
    braces = np.zeros(total + 1, bool)
    braces[place("body")[word & (t.bits & _CLASS > 0) & ~has(before, _DOT)]] = True
    braces[-1] = False
    in_class = word & braces[up]
    followed = (after < 0) | has(after, _FOLLOWS) | (own["line"][after] > own["line"])
    texts = np.repeat(np.arange(len(t.ends) - 1), np.diff(t.ends))
    member = (up >= 0) & followed & (in_class | scripts[texts])
    at = np.flatnonzero(word & ((t.bits & _DECLARES > 0) | member | has(before, _COMMA) & has(lead, _VARIABLE)))

    def step(at: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, by[at], -1)

    def column(at: np.ndarray, name: str) -> pa.Array:
        gone = at < 0
        if name in ("text", "kind"):
            return (t.texts if name == "text" else t.kinds).take(pa.array(at, pa.int64(), mask=gone))
        return pa.array(t.own[name][at], pa.int32(), mask=gone)

    def struct(at: np.ndarray, fields: dict[str, pa.Array]) -> pa.StructArray:
        return pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=pa.array(at < 0))

    token = lambda at, *names: struct(at, {n: column(at, n) for n in names})
    shifted = lambda at: pc.add(column(at, "column"), pc.subtract(column(at, "to"), column(at, "at")))
    end = lambda at: struct(at, {"at": column(at, "at"), "to": column(at, "to"), "line": column(at, "line"), "column": shifted(at), "seq": column(at, "seq")})

    def bracket(at: np.ndarray) -> pa.StructArray:
        closer = step(at, mate)
        then = step(closer, after)
        behind = pc.add(column(closer, "column"), pa.scalar(1, pa.int32()))
        own = {"seq": column(at, "seq"), "at": column(at, "at")}
        return struct(at, own | {"to": column(closer, "to"), "line": column(closer, "line"), "column": behind, "next": column(then, "text"), "next_to": column(then, "to")})

    out: dict[str, pa.Array] = {n: column(at, n) for n in ("seq", "kind", "text", "at", "to", "line", "column", "up", "scope", "angle")}
    out |= {"begins": pa.array(own["begins"][at]), "in_class": pa.array(in_class[at]), "followed": pa.array(followed[at])}
    near = at
    for n in range(1, 5):
        near = step(near, before)
        out[f"b{n}"] = token(near, "text", "at", "line", "column")
    near = at
    for n in range(1, 5):
        near = step(near, after)
        out[f"a{n}"] = token(near, "seq", "kind", "text", "to", "line")
    ahead = {n: step(at, place(n)) for n in ("paren", "body", "block", "stop", "last")}
    out |= {n: bracket(ahead[n]) for n in ("paren", "body", "block")} | {n: end(ahead[n]) for n in ("stop", "last")}
    out["leads"] = token(step(at, lead), "text", "at", "line", "column")
    out["parameters"] = _parameters(t).take(pa.array(ahead["paren"], pa.int64(), mask=ahead["paren"] < 0))
    ends = np.searchsorted(at, t.ends)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(out.values()), list(out)))


def brace_rows(scans: list[Scan]) -> pa.ListArray:
    """Of each text the braces of scopes, with all scopes that are open there."""
    rows = [[{"scope": k, "scopes": v} for k, v in s.scopes.items()] for s in scans]
    return pa.array(rows, pa.list_(pa.struct([("scope", pa.int32()), ("scopes", pa.list_(pa.int32()))])))


def _slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of text, its first column."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_elements(pages: DataFrame, code: str, *keep: str) -> DataFrame:
    """The columns to keep and ``_elements``, the opening tags of components in each page's code; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            scans = [Scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], element_rows(scans)], [*batch.schema.names[1:], "_elements"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"_elements array<{ELEMENT}>"])
    return pages.select(F.col(code).cast("string").alias("_read"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def with_shapes(pages: DataFrame, code: str, id_col: str) -> DataFrame:
    """Usages of pages as ``shape_rows`` has them; ``page`` numbers the pages, also of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(_slices(b, SHAPED_BYTES) for b in batches):
            yield shape_rows([Scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(0)], batch.column(1), batch.column(2))

    place = f"struct<page_id:{dict(pages.dtypes)[id_col]},page:bigint,line:int>"
    schema = f"component_name string, props map<string,string>, parent_component string, source string, children array<string>, places array<{place}>"
    return pages.select(F.col(code).cast("string").alias("_read"), F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_page")).mapInArrow(run, schema)


def with_tokens(modules: DataFrame, code: str, markup: str, *keep: str, tokens: bool = True) -> DataFrame:
    """The columns to keep, ``_links`` (``link_rows``), ``_braces`` and, if asked for, ``_tokens``, words, punctuation, strings and starts of elements.

    ``markup`` says whether the language has elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            scans = [Scan(t.as_buffer().to_pybytes() if t.is_valid else b"", True, bool(f)) for t, f in zip(batch.column(0), batch.column(1).to_pylist())]
            linked = linked_tokens(scans)
            made = [link_rows(linked, np.array(batch.column(2).to_pylist(), bool)), brace_rows(scans), *([token_rows(scans, linked)] if tokens else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *made], [*batch.schema.names[3:], "_links", "_braces", *(["_tokens"] if tokens else [])])

    kinds = dict(modules.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"_links array<{LINK}>", f"_braces array<{BRACE}>", *([f"_tokens array<{TOKEN}>"] if tokens else [])])
    script = F.coalesce(F.col("language") == "JavaScript", F.lit(False))
    return modules.select(F.col(code).cast("string").alias("_read"), F.col(markup).alias("_flag"), script.alias("_script"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
