"""PDF values: reading them from bytes and writing them as bytes.

Null, booleans and numbers are Python's own; the other kinds are below. A
dictionary is a ``dict`` whose keys are names as latin-1 text, in file order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np

DEPTH = 100
PARENS = 100


class PdfError(Exception):
    """code: a short stable name of what is wrong."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


class Name(bytes):
    __slots__ = ()


class Str(bytes):
    """A string; ``hex`` tells how it was written."""

    hex = False

    def __new__(cls, data: bytes = b"", hex: bool = False):
        s = super().__new__(cls, data)
        s.hex = hex
        return s

    def __reduce__(self):
        return Str, (bytes(self), self.hex)


class Ref(NamedTuple):
    num: int
    gen: int = 0

    #: NumPy's numbers compare with it as with any other object, not item by item.
    __array_ufunc__ = None


@dataclass
class Stream:
    dict: dict = field(default_factory=dict)
    raw: bytes = b""
    allows_compression: bool = True
    start: int | None = None


@dataclass(slots=True)
class Operation:
    operator: str
    operands: list = field(default_factory=list)


def kind(v) -> str:
    if v is None:
        return "Null"
    if isinstance(v, bool):
        return "Boolean"
    return {int: "Integer", float: "Real", np.float32: "Real", Name: "Name", Str: "String", list: "Array", dict: "Dictionary", Stream: "Stream", Ref: "Reference"}[type(v)]


_WS = rb"[ \t\n\r\x00\x0c]"
_REG = rb"[^ \t\n\r\x00\x0c()<>\[\]{}/%]"
_SKIP = rb"(?:" + _WS + rb"++|%[^\r\n]*+)*+"
_TOKEN = re.compile(
    _SKIP
    + rb"(?:(?P<ref>(?P<rn>\d+)" + _WS + rb"+(?P<rg>\d+)" + _WS + rb"+R(?!" + _REG + rb"))"
    + rb"|(?P<real>[+-]?(?:\d+\.\d*|\.\d+))|(?P<int>[+-]?\d+)|/(?P<name>" + _REG + rb"*)"
    + rb"|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f \t\n\r\x00\x0c]*)>|(?P<lit>\()|(?P<kw>" + _REG + rb"+))"
)
_LIT = re.compile(rb"[()\\]")
_NAME_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESC = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_SKIPS = re.compile(_SKIP)


def skip_space(buf: bytes, at: int) -> int:
    return _SKIPS.match(buf, at).end()


def name_of(raw: bytes) -> Name:
    return Name(_NAME_HEX.sub(lambda m: bytes([int(m[1], 16)]), raw)) if b"#" in raw else Name(raw)


def hex_string(digits: bytes) -> Str:
    digits = re.sub(_WS, b"", digits)
    return Str(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), hex=True)


def _literal(buf: bytes, at: int) -> tuple[Str, int]:
    """The string whose opening parenthesis ends before ``at``."""
    out, depth = [], 1
    while True:
        m = _LIT.search(buf, at)
        if not m:
            raise PdfError("Parse", "string without end")
        c = m[0]
        if c == b")" and depth == 1 and not out:
            return Str(buf[at : m.start()]), m.end()
        out.append(buf[at : m.start()])
        at = m.end()
        if c == b"(":
            depth += 1
            if depth > PARENS + 1:
                raise PdfError("Parse", "too many nested parentheses")
            out.append(c)
        elif c == b")":
            depth -= 1
            if not depth:
                return Str(b"".join(out)), at
            out.append(c)
        else:
            e = buf[at : at + 1]
            if e in _ESC:
                out.append(_ESC[e])
                at += 1
            elif e.isdigit() and e < b"8":
                n = 1
                while n < 3 and buf[at + n : at + n + 1] and buf[at + n : at + n + 1] in b"01234567":
                    n += 1
                out.append(bytes([int(buf[at : at + n], 8) & 255]))
                at += n
            elif e in b"\r\n" and e:
                at += 2 if buf[at : at + 2] == b"\r\n" else 1
            else:
                out.append(e)
                at += 1


def _number(m) -> float | int:
    if m["real"] is not None:
        return np.float32(m["real"])
    n = int(m["int"])
    if not -(1 << 63) <= n < 1 << 63:
        raise PdfError("Parse", "integer out of range")
    return n


# Most entries of dictionaries at once: a plain key, and a reference, a whole number or a name that ends there.
_ENTRY = re.compile(
    _SKIP + rb"/([^ \t\n\r\x00\x0c()<>\[\]{}/%#]*+)" + _WS + rb"*+"
    + rb"(?:(\d++)" + _WS + rb"++(\d++)" + _WS + rb"++R(?!" + _REG + rb")|(\d{1,18})(?=/|>>)|/([^ \t\n\r\x00\x0c()<>\[\]{}/%#]*+)(?=/|>>))"
)
_WORDS = {b"true": True, b"false": False, b"null": None}
# Groups of _TOKEN by number.
_REAL, _INT, _NAME, _OPEN, _CLOSE, _HEXA, _LITERAL = (_TOKEN.groupindex[n] for n in ("real", "int", "name", "open", "close", "hex", "lit"))


def parse_value(buf: bytes, at: int = 0) -> tuple[object, int]:
    """(value, place after it)."""
    stack: list = []
    keys: list = []
    match, entry, wanted = _TOKEN.match, _ENTRY.match, False
    while True:
        while wanted and (m := entry(buf, at)):
            k, at = m.lastindex, m.end()
            stack[-1][m[1].decode("latin-1")] = Ref(int(m[2]), int(m[3])) if k == 3 else int(m[4]) if k == 4 else Name(m[5])
        m = match(buf, at)
        if not m:
            raise PdfError("Parse", f"no value at {at}")
        at = m.end()
        k = m.lastindex
        if k == _NAME:
            v = m[_NAME]
            v = name_of(v) if b"#" in v else Name(v)
        elif k < _REAL:
            v = Ref(int(m[2]), int(m[3]))
        elif k == _OPEN:
            if len(stack) >= DEPTH:
                raise PdfError("Parse", "nested too deep")
            wanted = m[_OPEN] != b"["
            stack.append({} if wanted else [])
            keys.append(None)
            continue
        elif k == _CLOSE:
            if not stack or isinstance(stack[-1], list) != (m[_CLOSE] == b"]") or keys[-1] is not None:
                raise PdfError("Parse", f"unexpected end of a container at {at}")
            v = stack.pop()
            keys.pop()
        elif k <= _INT:
            v = _number(m)
        elif k == _HEXA:
            v = hex_string(m[_HEXA])
        elif k == _LITERAL:
            v, at = _literal(buf, at)
        else:
            word = m["kw"]
            if word not in _WORDS:
                raise PdfError("Parse", f"unexpected word at {at}")
            v = _WORDS[word]
        if not stack:
            return v, at
        top = stack[-1]
        if type(top) is list:
            top.append(v)
            wanted = False
        elif keys[-1] is None:
            if not isinstance(v, Name):
                raise PdfError("Parse", "a key isn't a name")
            keys[-1] = v.decode("latin-1")
            wanted = False
        else:
            top[keys[-1]] = v
            keys[-1] = None
            wanted = True


_INLINE_SPACES = {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}
_CONTENT_WORD = re.compile(_SKIP + rb"([A-Za-z'\"*][A-Za-z0-9'\"*]*)")


# An operation of whole numbers and plain names, and one of a string without escapes.
_GAP = rb"[ \t\n\r\x0c]++"
_PLAIN_OPERATION = re.compile(_SKIP + rb"((?:(?:[+-]?\d{1,9}|/[^ \t\n\r\x00\x0c()<>\[\]{}/%#]++)" + _GAP + rb")*+)([A-Za-z'\"*][A-Za-z0-9'\"*]*+)")
_VALUES = {b"true", b"false", b"null", b"R", b"BI"}
_SHOWN = re.compile(_SKIP + rb"\(([^()\\]*+)\)" + _WS + rb"*+(Tj|')(?![A-Za-z0-9'\"*])")


def parse_content(buf: bytes, strict: bool = False) -> list[Operation]:
    """Operations of a content stream. Lenient reading stops at the first bad token."""
    ops, operands, at = [], [], 0
    while True:
        if m := _SHOWN.match(buf, at):
            ops.append(Operation(m[2].decode(), [*operands, Str(m[1])]))
            operands, at = [], m.end()
            continue
        if (m := _PLAIN_OPERATION.match(buf, at)) and m[2] not in _VALUES:
            operands += [Name(x[1:]) if x[0] == 47 else int(x) for x in m[1].split()]
            ops.append(Operation(m[2].decode(), operands))
            operands, at = [], m.end()
            continue
        m = _CONTENT_WORD.match(buf, at)
        if m and m[1] not in (b"true", b"false", b"null"):
            at = m.end()
            word = m[1].decode()
            if word == "BI":
                try:
                    image, at = _inline_image(buf, at)
                except PdfError:
                    end = buf.find(b" EI", at)
                    if strict or end < 0:
                        if strict:
                            raise
                        break
                    at = end + 3
                    operands = []
                    continue
                ops.append(Operation("BI", [image]))
            else:
                ops.append(Operation(word, operands))
            operands = []
            continue
        try:
            v, at = parse_value(buf, at)
        except PdfError:
            if skip_space(buf, at) >= len(buf):
                break
            if strict:
                raise
            return ops
        operands.append(v)
    if strict and operands:
        raise PdfError("Parse", "operands without operator")
    return ops


def _inline_image(buf: bytes, at: int) -> tuple[Stream, int]:
    d: dict = {}
    while True:
        m = _CONTENT_WORD.match(buf, at)
        if m and m[1] == b"ID":
            at = m.end()
            break
        key, at = parse_value(buf, at)
        if not isinstance(key, Name):
            raise PdfError("Parse", "inline image")
        d[key.decode("latin-1")], at = parse_value(buf, at)
    pick = lambda *names: next((d[n] for n in names if n in d), None)
    if pick("Filter", "F") is not None:
        raise PdfError("Unimplemented", "filtered inline image")
    w, h = pick("Width", "W"), pick("Height", "H")
    mask = pick("ImageMask", "IM")
    bits, space = (1, 1) if mask else (pick("BitsPerComponent", "BPC"), _INLINE_SPACES.get((pick("ColorSpace", "CS") or b"").decode("latin-1")))
    if None in (w, h, bits, space):
        raise PdfError("Parse", "inline image without a known size")
    size = (w * bits * space + 7) // 8 * h
    at += 1
    data = buf[at : at + size]
    end = skip_space(buf, at + size)
    if len(data) < size or buf[end : end + 2] != b"EI":
        raise PdfError("Parse", "inline image")
    return Stream(d, data), end + 2


_PLAIN = set(range(33, 127)) - set(b"()<>[]{}/%#")


@lru_cache(4096)
def write_name(n: bytes) -> bytes:
    return b"/" + b"".join(bytes([c]) if c in _PLAIN else b"#%02X" % c for c in n)


def write_string(s: Str) -> bytes:
    if s.hex:
        return b"<" + "".join(f"{c:02X}" for c in s).encode() + b">"
    if not _LIT.search(s) and b"\r" not in s:
        return b"(" + bytes(s) + b")"
    opened, bare = [], set()
    for i, c in enumerate(s):  # parentheses without a partner are escaped
        if c == 40:
            opened.append(i)
        elif c == 41:
            if opened:
                opened.pop()
            else:
                bare.add(i)
    bare |= set(opened)
    out = bytearray(b"(")
    for i, c in enumerate(s):
        if c == 13:
            out += b"\\r"
        elif c == 92 or i in bare:
            out += b"\\" + bytes([c])
        else:
            out.append(c)
    return bytes(out + b")")


def write_real(x) -> bytes:
    return np.format_float_positional(np.float32(x), trim="-").encode()


@lru_cache(4096)
def _key(k: str) -> bytes:
    return write_name(k.encode("latin-1"))


def write_value(v) -> bytes:
    kind = type(v)
    if kind is Ref:
        return b"%d %d R" % v
    if kind is dict:
        out = [b"<<"]
        for k, w in v.items():
            x = write_value(w)
            out += (_key(k), x) if x[:1] in _OPENERS else (_key(k), b" ", x)
        return b"".join([*out, b">>"])
    if kind is int:
        return b"%d" % v
    if kind is Name:
        return write_name(v)
    if kind is Str:
        return write_string(v)
    if kind is list:
        return b"[" + _spaced(map(write_value, v)) + b"]"
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, (float, np.floating)):
        return write_real(v)
    if isinstance(v, Stream):
        d = dict(v.dict)
        d["Length"] = len(v.raw)
        return write_value(d) + b"stream\n" + v.raw + b"\nendstream"
    raise TypeError(type(v))


_OPENERS = b"/([<"
_CLOSERS = b")]>"


def _spaced(parts) -> bytes:
    """Values in a row with a blank only where two would run together."""
    out, last = [], b""
    for p in parts:
        if last and p[:1] not in _OPENERS and last[-1:] not in _CLOSERS:
            out.append(b" ")
        out.append(p)
        last = p
    return b"".join(out)


def write_content(ops: list[Operation]) -> bytes:
    return b"\n".join([b" ".join([*map(write_value, o.operands), o.operator.encode()]) if o.operands else o.operator.encode() for o in ops])
