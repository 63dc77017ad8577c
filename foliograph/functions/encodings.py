"""Text encodings: one-byte tables, font encodings, ToUnicode maps, text strings."""

from __future__ import annotations

import codecs
import re
import unicodedata

from .filters import LIMIT, plain
from .syntax import Name, PdfError, Stream, Str, hex_string, parse_value

# Characters of one-byte encodings where they differ from a standard code page.
PDFDOC_24 = "˘ˇˆ˙˝˛˚˜"
PDFDOC_128 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
STANDARD_161 = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ"
STANDARD_177 = {177: "–", 178: "†", 179: "‡", 180: "·", 182: "¶", 183: "•", 184: "‚", 185: "„", 186: "”", 187: "»", 188: "…", 189: "‰", 191: "¿"}
STANDARD_193 = {193: "`", 194: "´", 195: "ˆ", 196: "˜", 197: "¯", 198: "˘", 199: "˙", 200: "¨", 202: "˚", 203: "¸", 205: "˝", 206: "˛", 207: "ˇ", 208: "—"}
STANDARD_225 = {225: "Æ", 227: "ª", 232: "Ł", 233: "Ø", 234: "Œ", 235: "º", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß"}


def _page(codec: str) -> list[str | None]:
    return [None if b < 32 else bytes([b]).decode(codec, "replace").replace("�", "") or None for b in range(256)]


def _tables() -> dict[str, list[str | None]]:
    ascii_ = [chr(b) if 32 <= b < 127 else None for b in range(256)]
    win = _page("cp1252")
    for b in (127, 129, 141, 143, 144, 157):
        win[b] = "•"
    win[160], win[173] = " ", "-"
    mac = _page("mac_roman")
    mac[127], mac[202] = None, " "
    doc = [chr(b) if b in (9, 10, 13) or 32 <= b < 127 or b >= 161 and b != 173 else None for b in range(256)]
    doc[24:32] = PDFDOC_24
    doc[128:159] = PDFDOC_128
    doc[160] = "€"
    std = list(ascii_)
    std[39], std[96] = "’", "‘"
    std[161:176] = STANDARD_161
    for part in (STANDARD_177, STANDARD_193, STANDARD_225):
        for b, c in part.items():
            std[b] = c
    return {"WinAnsiEncoding": win, "MacRomanEncoding": mac, "PDFDocEncoding": doc, "StandardEncoding": std}


TABLES = _tables()
_BACK: dict[str, dict[str, int]] = {}
for _n, _t in TABLES.items():
    _BACK[_n] = {}
    for _b, _c in enumerate(_t):
        if _c is not None:
            _BACK[_n].setdefault(_c, _b)

# Glyph names that don't follow from a character's Unicode name.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?",
    "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "endash": "–", "emdash": "—", "ellipsis": "…", "bullet": "•", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰",
    "guilsinglleft": "‹", "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "trademark": "™", "Euro": "€", "florin": "ƒ", "fraction": "⁄", "minus": "−", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ",
    "breve": "˘", "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛",
}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}


def glyph(name: str) -> str | None:
    """The character of a glyph name: listed, a digit, a letter with an accent, a Greek letter, uniXXXX or uXXXX."""
    if name in GLYPHS:
        return GLYPHS[name]
    if name in DIGITS:
        return str(DIGITS.index(name))
    if len(name) == 1 and name.isalpha():
        return name
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if name[:1].isalpha() and name[1:] in ACCENTS:
        c = unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
        return c if len(c) == 1 else None
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[:1].isupper() else 'SMALL'} LETTER {name.upper()}")
    except KeyError:
        return None


# One character a byte; U+FFFE stands for none.
_MAPS = {n: "".join(c or "\ufffe" for c in t) for n, t in TABLES.items()}
_CODES = {n: {ord(c): b for c, b in back.items()} for n, back in _BACK.items()}


def decode_table(table: str, data: bytes) -> str:
    return codecs.charmap_decode(data, "ignore", _MAPS[table])[0]


def encode_table(table: str, text: str) -> bytes:
    return codecs.charmap_encode(text, "ignore", _CODES[table])[0]


class CMap:
    """ToUnicode: codes of one to four bytes to text."""

    def __init__(self):
        self.ranges: list[list[tuple[int, int, list[str] | str]]] = [[], [], [], []]
        self.back: dict[str, bytes] = {}

    def put(self, size: int, lo: int, hi: int, target) -> None:
        if hi < lo or not target:
            raise PdfError("CMap", "range")
        self.ranges[size - 1].append((lo, hi, target))
        for i in range(min(hi - lo + 1, 65536)):
            t = self._target(lo + i, lo, target)
            self.back.setdefault(t, (lo + i).to_bytes(size, "big"))

    @staticmethod
    def _target(code: int, lo: int, target) -> str:
        if isinstance(target, list):
            return target[code - lo] if code - lo < len(target) else "�"
        units = target.encode("utf-16-be", "surrogatepass")
        last = (int.from_bytes(units[-2:], "big") + code - lo) & 0xFFFF
        return (units[:-2] + last.to_bytes(2, "big")).decode("utf-16-be", "replace")

    def get(self, code: int, size: int) -> str | None:
        for lo, hi, target in reversed(self.ranges[size - 1]):
            if lo <= code <= hi:
                return self._target(code, lo, target)
        return None

    def decode(self, data: bytes) -> str:
        """Shortest code first; four bytes without a match, or the end, give the replacement character."""
        out, at = [], 0
        while at < len(data):
            for size in range(1, 5):
                if at + size > len(data):
                    out.append("�")
                    at = len(data)
                    break
                if (t := self.get(int.from_bytes(data[at : at + size], "big"), size)) is not None:
                    out.append(t)
                    at += size
                    break
            else:
                out.append("�")
                at += 4
        return "".join(out)

    def encode(self, text: str) -> bytes:
        return b"".join(self.back.get(c, b"") for c in text)


_SECTION = re.compile(rb"\d*\s*begin(codespacerange|bfchar|bfrange)(.*?)end\1", re.S)
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def parse_cmap(data: bytes) -> CMap:
    if b"begincmap" not in data:
        raise PdfError("CMap", "no map")
    m = CMap()
    text = lambda h: bytes(hex_string(h)).decode("utf-16-be", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for what, body in _SECTION.findall(data):
        if what == b"bfchar":
            codes = _HEX.findall(body)
            for a, b in zip(codes[::2], codes[1::2], strict=False):
                src = bytes(hex_string(a))
                m.put(len(src), int.from_bytes(src, "big"), int.from_bytes(src, "big"), text(b))
        elif what == b"bfrange":
            at = 0
            while (lo := _HEX.search(body, at)) and (hi := _HEX.search(body, lo.end())):
                a, b = bytes(hex_string(lo[1])), bytes(hex_string(hi[1]))
                rest = body[hi.end() :].lstrip()
                if rest[:1] == b"[":
                    end = body.index(b"]", hi.end())
                    target: list[str] | str = [text(h) for h in _HEX.findall(body[hi.end() : end])]
                    at = end + 1
                else:
                    t = _HEX.search(body, hi.end())
                    if not t:
                        raise PdfError("CMap", "range without target")
                    target, at = text(t[1]), t.end()
                m.put(len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big"), target)
    return m


class Encoding:
    """kind: table, simple, unicode (CMap) or differences."""

    def __init__(self, kind: str, value, changes: dict[int, str] | None = None):
        self.kind, self.value, self.changes = kind, value, changes or {}

    def decode(self, data: bytes) -> str:
        if self.kind == "table":
            return decode_table(self.value, data)
        if self.kind == "unicode":
            return self.value.decode(data)
        if self.kind == "differences":
            return "".join(self.changes.get(b) or decode_table(self.value, bytes([b])) for b in data)
        if self.value in ("UniGB-UCS2-H", "UniGB-UTF16-H"):
            return data.decode("utf-16-be", "replace")
        if self.value == "WinAnsiEncoding":
            return decode_table(self.value, data)
        raise PdfError("CharacterEncoding", self.value)

    def encode(self, text: str) -> bytes:
        if self.kind == "table":
            return encode_table(self.value, text)
        if self.kind == "unicode":
            return self.value.encode(text)
        if self.kind == "differences":
            own = {c: b for b, c in reversed(self.changes.items())}
            return b"".join(bytes([own[c]]) if c in own else encode_table(self.value, c) for c in text)
        if self.value in ("UniGB-UCS2-H", "UniGB-UTF16-H"):
            return text.encode("utf-16-be")
        return encode_table(self.value, text) if self.value == "WinAnsiEncoding" else text.encode()


STANDARD = Encoding("table", "StandardEncoding")


def font_encoding(font: dict, resolve, limit: int | None = LIMIT) -> Encoding:
    """Encoding beats ToUnicode beats Standard; what can't be read falls back to Standard."""
    if font.get("Type") != Name(b"Font"):
        raise PdfError("DictType", "Font")
    try:
        e = resolve(font.get("Encoding"))
        if isinstance(e, Name):
            n = e.decode("latin-1")
            if n in TABLES:
                return Encoding("table", n)
            return _to_unicode(font, resolve, limit) if n in ("Identity-H", "Identity-V") else Encoding("simple", n)
        if isinstance(e, dict):
            if e.get("Type") != Name(b"Encoding"):
                raise PdfError("DictType", "Encoding")
            base = resolve(e.get("BaseEncoding"))
            table = base.decode("latin-1") if isinstance(base, Name) and base.decode("latin-1") in TABLES else "StandardEncoding"
            changes, code = {}, 0
            for x in resolve(e.get("Differences")) or []:
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    if (c := glyph(x.decode("latin-1"))) is None:
                        raise PdfError("CharacterEncoding", "glyph")
                    changes[code & 255] = c
                    code += 1
            return Encoding("differences", table, changes)
        return _to_unicode(font, resolve, limit) if "ToUnicode" in font else STANDARD
    except PdfError as x:
        if x.code == "MemoryLimitExceeded":
            raise
        return STANDARD


def _to_unicode(font: dict, resolve, limit: int | None) -> Encoding:
    s = resolve(font.get("ToUnicode"))
    if not isinstance(s, Stream):
        raise PdfError("ObjectType", "ToUnicode")
    return Encoding("unicode", parse_cmap(plain(s, limit)))


def text_string(text: str) -> Str:
    """ASCII as it is, everything else as UTF-16 with a mark, in hex."""
    return Str(text.encode()) if text.isascii() else Str(b"\xfe\xff" + text.encode("utf-16-be"), hex=True)


def decode_text_string(s: bytes) -> str:
    if s[:2] == b"\xfe\xff":
        return (s[2:] + b"\0" * (len(s) % 2)).decode("utf-16-be", "replace")
    if s[:3] == b"\xef\xbb\xbf":
        return s.decode("utf-8", "replace")
    return decode_table("PDFDocEncoding", s)
