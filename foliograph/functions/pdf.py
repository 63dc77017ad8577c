"""One PDF document: loading, saving, pages, text, outline and edits. No Spark in here."""

from __future__ import annotations

import contextlib
import re
import zlib
from dataclasses import dataclass, field

from . import crypto
from .encodings import decode_text_string, font_encoding, text_string
from .filters import LIMIT, compress, decompress, plain
from .syntax import DEPTH, Name, Operation, PdfError, Ref, Str, Stream, parse_content, parse_value, skip_space, write_content, write_string, write_value

DEREF = 128
PAGE_DEPTH = 256
KERNING_SPACE = -100
_OBJ = re.compile(rb"[ \t\n\r\x00\x0c]*(\d+)[ \t\n\r\x00\x0c]+(\d+)[ \t\n\r\x00\x0c]+obj")
_XREF_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])(?: \r| \n|\r\n|\n|\r)")
_STREAM_END = re.compile(rb"(?:\r\n|\n|\r)endstream[ \t\n\r\x00\x0c]*endobj")


@dataclass
class Document:
    version: str = "1.4"
    trailer: dict = field(default_factory=dict)
    objects: dict[Ref, object] = field(default_factory=dict)
    xref_start: int = 0
    xref: dict[int, tuple] = field(default_factory=dict)
    errors: list[tuple[int, str]] = field(default_factory=list)
    encrypted: bool = False
    _grown: dict | None = field(default=None, repr=False, compare=False)
    _last: Ref | None = field(default=None, repr=False, compare=False)

    @property
    def max_id(self) -> int:
        return max((r.num for r in self.objects), default=0)

    def add(self, value) -> Ref:
        # nothing came after the last one added: its number is still the highest
        ref = Ref((self._last.num if self._grown is self.objects and self._last == next(reversed(self.objects), None) else self.max_id) + 1)
        self.objects[ref] = value
        self._grown, self._last = self.objects, ref
        return ref

    def get(self, v):
        """Follows references; a missing object is an error."""
        for _ in range(DEREF):
            if not isinstance(v, Ref):
                return v
            if v not in self.objects:
                raise PdfError("ObjectNotFound", f"{v.num} {v.gen}")
            v = self.objects[v]
        raise PdfError("ReferenceLimit")

    def soft(self, v):
        try:
            return self.get(v)
        except PdfError:
            return None

    @property
    def catalog(self) -> dict:
        c = self.get(self.trailer.get("Root"))
        if not isinstance(c, dict):
            raise PdfError("DictKey", "Root")
        return c


# Loading


def _xref_at(buf: bytes, at: int, limit: int | None) -> tuple[dict[int, tuple], dict]:
    at = skip_space(buf, at)
    if buf[at : at + 4] != b"xref":
        ref, s = _object_at(buf, at, {}, len(buf))
        if not isinstance(s, Stream):
            raise PdfError("InvalidXref", "no table")
        return _xref_stream(s, limit), s.dict
    at += 4
    found: dict[int, tuple] = {}
    while True:
        at = skip_space(buf, at)
        if buf[at : at + 7] == b"trailer":
            trailer, _ = parse_value(buf, at + 7)
            return found, trailer
        m = re.compile(rb"(\d+) +(\d+)\s*").match(buf, at)
        if not m:
            raise PdfError("InvalidXref", "section")
        first, at = int(m[1]), m.end()
        for i in range(int(m[2])):
            e = _XREF_ENTRY.match(buf, at)
            if not e:
                break
            at = e.end()
            if e[3] == b"n":
                found[first + i] = ("Normal", int(e[1]), int(e[2]))


def _xref_stream(s: Stream, limit: int | None) -> dict[int, tuple]:
    w = s.dict.get("W")
    if not isinstance(w, list) or len(w) < 3 or not all(isinstance(x, int) and 0 <= x <= 8 for x in w) or not sum(w[:3]):
        raise PdfError("InvalidXref", "widths")
    data = plain(s, limit)
    index = s.dict.get("Index", [0, s.dict.get("Size", 0)])
    if not all(isinstance(x, int) and x >= 0 for x in index) or sum(index[1::2]) > len(data) // max(sum(w[:3]), 3):
        raise PdfError("InvalidXref", "counts")
    found: dict[int, tuple] = {}
    at = 0
    for first, count in zip(index[::2], index[1::2], strict=False):
        for i in range(count):
            v = []
            for k in range(3):
                v.append(int.from_bytes(data[at : at + w[k]], "big") if w[k] else int(k == 0))
                at += w[k]
            if v[0] == 1:
                found[first + i] = ("Normal", v[1], v[2])
            elif v[0] == 2:
                found[first + i] = ("Compressed", v[1], v[2])
    return found


def _object_at(buf: bytes, at: int, xref: dict, bound: int, expected: int | None = None) -> tuple[Ref, object]:
    m = _OBJ.match(buf, at)
    if not m or expected is not None and int(m[1]) != expected:
        raise PdfError("Parse", f"no object at {at}")
    ref = Ref(int(m[1]), int(m[2]))
    v, end = parse_value(buf, m.end())
    at = skip_space(buf, end)
    if not isinstance(v, dict) or buf[at : at + 6] != b"stream":
        return ref, v
    start = at + 6
    start += 2 if buf[start : start + 2] == b"\r\n" else buf[start : start + 1] in (b"\n", b"\r")
    n = v.get("Length")
    if isinstance(n, Ref):
        e = xref.get(n.num)
        n = _object_at(buf, e[1], {}, len(buf), n.num)[1] if e and e[0] == "Normal" else None
    n = int(n) if isinstance(n, (int, float)) and n == int(n) else n
    if not isinstance(n, int) or n < 0 or not buf.startswith(b"endstream", skip_space(buf, start + n)):
        ends = [x.start() for x in _STREAM_END.finditer(buf, start, bound)]
        if len(ends) != 1:  # none, or no way to tell
            raise PdfError("Parse", "stream length")
        n = ends[0] - start
    return ref, Stream(v, buf[start : start + n], start=start)


def object_stream(s: Stream, limit: int | None = LIMIT) -> dict[int, object]:
    """Members by number; the last of two with one number counts."""
    data = plain(s, limit)
    first = s.dict.get("First", 0)
    head = [int(x) for x in re.findall(rb"\d+", data[:first])]
    found: dict[int, object] = {}
    for num, at in zip(head[::2], head[1::2], strict=False):
        try:
            found[num] = parse_value(data, first + at)[0]
        except PdfError:
            continue
    return found


def read_xref(buf: bytes, limit: int | None = LIMIT) -> tuple[dict[int, tuple], dict, int, list[dict[int, tuple]]]:
    """(newest entry by number, newest trailer, its place, all revisions from new to old)."""
    end = buf.rfind(b"%%EOF")
    at = buf.rfind(b"startxref", 0, end if end >= 0 else len(buf))
    m = re.compile(rb"startxref\s*(\d+)").match(buf, at) if at >= 0 else None
    if not m:
        raise PdfError("Xref", "Start")
    start, seen, revisions, newest = int(m[1]), set(), [], {}
    at: int | None = start
    while isinstance(at, int) and at not in seen and 0 <= at < len(buf):
        seen.add(at)
        try:
            table, trailer = _xref_at(buf, at, limit)
        except PdfError:
            if revisions:
                break
            near = [x.start() for x in re.finditer(rb"(?<!start)xref", buf[max(0, at - 64) : at + 68])]
            if not near:
                raise
            at = max(0, at - 64) + min(near, key=lambda x: abs(x + max(0, start - 64) - start))
            table, trailer = _xref_at(buf, at, limit)
        newest = newest or trailer
        revisions.append(table)
        at = trailer.get("Prev")
        if at is not None and isinstance(hybrid := newest.get("XRefStm"), int) and hybrid not in seen:
            seen.add(hybrid)
            revisions.append(_xref_at(buf, hybrid, limit)[0])
    merged: dict[int, tuple] = {}
    for table in revisions:
        for num, entry in table.items():
            merged.setdefault(num, entry)
    return merged, newest, start, revisions


def unlocked(e, trailer: dict, password: str | None) -> crypto.Security | None:
    """Opens with the empty password or the one given; None if there is none to try."""
    own = trailer.get("ID")
    own = bytes(own[0]) if isinstance(own, list) and own and isinstance(own[0], Str) else b""
    try:
        return crypto.Security.open(e, own, "")
    except PdfError:
        if password is None:
            return None
        return crypto.Security.open(e, own, password)


def load(buf: bytes, password: str | None = None, strict: bool = False, limit: int | None = LIMIT, keep=None) -> Document:
    """keep: (Ref, value) to (Ref, value) or None, applied while objects are read."""
    head = buf.find(b"%PDF-")
    if head < 0:
        raise PdfError("Parse", "InvalidFileHeader")
    buf = buf[head:]
    xref, trailer, start, _ = read_xref(buf, limit)
    doc = Document(re.match(rb"%PDF-([^\s]*)", buf)[1].decode("latin-1"), dict(trailer), {}, start, xref)
    ends = sorted({e[1] for e in xref.values() if e[0] == "Normal"} | {start, len(buf)})
    nxt = dict(zip(ends, ends[1:], strict=False))
    for num, entry in sorted(xref.items()):
        if entry[0] != "Normal":
            continue
        try:
            ref, v = _object_at(buf, entry[1], xref, nxt.get(entry[1], len(buf)), num)
            doc.objects[ref] = v
        except PdfError as x:
            if strict:
                raise
            doc.errors.append((num, x.code))
    security = None
    if "Encrypt" in trailer:
        doc.encrypted = True
        e = doc.get(trailer["Encrypt"])
        security = unlocked(e, trailer, password)
        if security is None:
            doc.objects = {trailer["Encrypt"]: e}
            return doc
        doc.objects = {r: v if r == trailer["Encrypt"] else security.walk(r, v, security.decrypt) for r, v in doc.objects.items()}
        doc.objects.pop(trailer["Encrypt"], None)
        doc.trailer.pop("Encrypt")
    if keep:
        kept = (keep(r, v) for r, v in doc.objects.items())
        doc.objects = dict(x for x in kept if x)
    for ref, v in list(doc.objects.items()):
        if isinstance(v, Stream) and v.dict.get("Type") == Name(b"ObjStm"):
            try:
                members = object_stream(v, limit)
            except PdfError as x:
                if strict or x.code == "MemoryLimitExceeded":
                    raise
                continue
            for num, member in members.items():
                entry = xref.get(num)
                if (entry is None or entry[:2] == ("Compressed", ref.num)) and Ref(num) not in doc.objects:
                    got = keep(Ref(num), member) if keep else (Ref(num), member)
                    if got:
                        doc.objects[got[0]] = got[1]
    doc.objects = dict(sorted(doc.objects.items()))
    return doc


def metadata(buf: bytes, limit: int | None = LIMIT, password: str | None = None) -> dict:
    """Info and page count from the few objects they need; no Info if the file stays locked."""
    buf = buf[max(0, buf.find(b"%PDF-")) :]
    xref, trailer, _, _ = read_xref(buf, limit)
    cache: dict[int, dict] = {}
    security = None

    def object_at(num):
        e = xref.get(num)
        if not e or e[0] != "Normal":
            raise PdfError("ObjectNotFound", str(num))
        ref, v = _object_at(buf, e[1], xref, len(buf), num)
        return security.walk(ref, v, security.decrypt) if security else v

    def get(v):
        for _ in range(DEREF):
            if not isinstance(v, Ref):
                return v
            e = xref.get(v.num)
            if not e:
                return None
            if e[0] == "Compressed":
                if e[1] not in cache:
                    cache[e[1]] = object_stream(object_at(e[1]), limit)
                v = cache[e[1]].get(v.num)
            elif e[0] == "Normal":
                v = object_at(v.num)
            else:
                return None
        return None

    locked, flags = False, None
    if "Encrypt" in trailer:
        e = get(trailer["Encrypt"])
        flags = e.get("P") if isinstance(e, dict) and isinstance(e.get("P"), int) else None
        security = unlocked(e, trailer, password)
        locked = security is None
    info = get(trailer.get("Info")) if isinstance(trailer.get("Info"), Ref) and not locked else None
    texts = {k: decode_text_string(v) for k, v in (info if isinstance(info, dict) else {}).items() if isinstance(v, Str)}

    def count(v, depth=0) -> int:
        d = get(v)
        if not isinstance(d, dict) or depth > PAGE_DEPTH:
            return 0
        if d.get("Type") == Name(b"Page"):
            return 1
        if isinstance(d.get("Count"), int) and d["Count"] >= 0:
            return d["Count"]
        return sum(count(k, depth + 1) for k in d.get("Kids") or [])

    root = get(trailer.get("Root"))
    return {"info": texts, "pages": count(root.get("Pages")) if isinstance(root, dict) else 0, "version": buf[5:8].decode("latin-1"), "encrypted": "Encrypt" in trailer, "permissions": flags}


# Saving

_NEVER = {b"ObjStm", b"XRef", b"Linearized"}


def _type(v) -> bytes:
    d = v.dict if isinstance(v, Stream) else v
    t = d.get("Type") if isinstance(d, dict) else None
    return bytes(t) if isinstance(t, Name) else b""


def packable(ref: Ref, v, doc: Document) -> bool:
    linear = _type(v) == b"Catalog" and any(isinstance(x, dict) and "Linearized" in x for x in doc.objects.values())
    return not (isinstance(v, Stream) or ref.gen or ref == doc.trailer.get("Encrypt") or _type(v) in (b"XRef", b"ObjStm") or linear)


def islands(nums: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in nums:
        if out and n == out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out


def save(doc: Document, object_streams: bool = False, xref_stream: bool = False, per_stream: int = 100, level: int = 6, security: crypto.Security | None = None, previous: bytes = b"", prev_start: int | None = None) -> bytes:
    """The file's bytes. previous: an older file that this document's objects update."""
    version = doc.version if not (xref_stream or object_streams) or doc.version >= "1.5" else "1.5"
    out = bytearray(previous or b"%PDF-" + version.encode() + b"\n%\xbb\xad\xc0\xde\n")
    if previous and not previous.endswith(b"\n"):
        out += b"\n"
    trailer = dict(doc.trailer)
    objects = {r: v for r, v in sorted(doc.objects.items()) if _type(v) not in _NEVER}
    if security:
        objects = {r: security.walk(r, v, security.encrypt) for r, v in objects.items()}
        trailer["Encrypt"] = Ref(doc.max_id + 1)
        objects[trailer["Encrypt"]] = security.entries
        object_streams = False
    entries: dict[int, tuple[int, int, int]] = {}
    packed = [(r, v) for r, v in objects.items() if object_streams and packable(r, v, doc)]
    inside = {r for r, _ in packed}

    def put(ref: Ref, v) -> None:
        entries[ref.num] = (1, len(out), ref.gen)
        out.extend(b"%d %d obj\n" % (ref.num, ref.gen) + write_value(v) + b"\nendobj\n")

    for r, v in objects.items():
        if r not in inside:
            put(r, v)
    top = max((r.num for r in objects), default=0)
    if previous:  # the older file's numbers are taken, also where the update doesn't have them
        top = max(top, trailer.get("Size", 0) - 1)
    for at in range(0, len(packed), per_stream):
        top += 1
        part = packed[at : at + per_stream]
        head, body = [], b""
        for i, (r, v) in enumerate(part):
            head.append(b"%d %d" % (r.num, len(body)))
            body += write_value(v) + b" "
            entries[r.num] = (2, top, i)
        first = b" ".join(head) + b" "
        raw = first + body
        d = {"Type": Name(b"ObjStm"), "N": len(part), "First": len(first)}
        if level:
            raw = zlib.compress(raw, 1 if level <= 3 else 6 if level <= 6 else 9)
            d["Filter"] = Name(b"FlateDecode")
        put(Ref(top), Stream(d, raw))
    start = len(out)
    for k in ("Prev", "XRefStm", "W", "Index", "Filter", "DecodeParms", "Length", "Type"):
        trailer.pop(k, None)
    if prev_start is not None:
        trailer["Prev"] = prev_start
    if xref_stream or object_streams:
        top += 1
        entries[top] = (1, start, 0)
        trailer |= {"Type": Name(b"XRef"), "Size": top + 1, "W": [1, 4, 2], "Index": [x for i in islands(sorted(entries)) for x in i]}
        raw = b"".join(k.to_bytes(1, "big") + a.to_bytes(4, "big") + b.to_bytes(2, "big") for _, (k, a, b) in sorted(entries.items()))
        out += b"%d 0 obj\n" % top + write_value(Stream(trailer, raw)) + b"\nendobj\n"
    else:
        trailer["Size"] = top + 1
        out += b"xref\n" + (b"" if previous else b"0 1\n0000000000 65535 f \n")
        for first, n in islands(sorted(entries)):
            out += b"%d %d\n" % (first, n) + b"".join(b"%010d %05d n \n" % entries[first + i][1:] for i in range(n))
        out += b"trailer\n" + write_value(trailer) + b"\n"
    out += b"startxref\n%d\n%%%%EOF" % start
    return bytes(out)


# Pages and text


def pages(doc: Document) -> list[Ref]:
    """Depth first by /Type; direct kids don't count; a node is visited once."""
    out: list[Ref] = []
    seen: set[Ref] = set()
    stack = [(doc.soft(doc.trailer.get("Root")) or {}).get("Pages")]
    stack = [(stack[0], 0)]
    while stack:
        ref, depth = stack.pop()
        if not isinstance(ref, Ref) or ref in seen or depth > PAGE_DEPTH:
            continue
        seen.add(ref)
        d = doc.soft(ref)
        if _type(d) == b"Page":
            out.append(ref)
        elif _type(d) == b"Pages":
            kids = doc.soft(d.get("Kids"))
            stack += [(k, depth + 1) for k in reversed(kids if isinstance(kids, list) else [])]
    return out


def page_content(doc: Document, page: Ref, limit: int | None = LIMIT) -> bytes:
    c = doc.get(page).get("Contents")
    v = doc.soft(c)
    out = b""
    for s in [v] if isinstance(v, Stream) else [doc.soft(x) for x in v or []] if isinstance(v, list) else []:
        if isinstance(s, Stream):
            try:
                out += plain(s, limit)
            except PdfError as x:
                if x.code == "MemoryLimitExceeded":
                    raise
                out += s.raw
            out += b"\n"
    return out


def page_fonts(doc: Document, page: Ref) -> dict[str, dict]:
    """Nearest definition of each font name: the page's own dictionary, then resources up the tree."""
    found: dict[str, dict] = {}
    node, seen, own = page, set(), True
    while isinstance(node, Ref) and len(seen) < DEPTH:
        if node in seen:
            raise PdfError("ReferenceCycle")
        seen.add(node)
        d = doc.soft(node)
        if not isinstance(d, dict):
            break
        r = d.get("Resources")
        if own or isinstance(r, Ref):
            fonts = doc.soft((doc.soft(r) or {}).get("Font"))
            for k, v in (fonts if isinstance(fonts, dict) else {}).items():
                f = doc.soft(v)
                if isinstance(f, dict):
                    found.setdefault(k, f)
        node, own = d.get("Parent"), False
    return found


def page_text(doc: Document, page: Ref, limit: int | None = LIMIT) -> str:
    encodings = {k: font_encoding(f, doc.soft, limit) for k, f in page_fonts(doc, page).items()}
    return ops_text(parse_content(page_content(doc, page, limit)), encodings)


def _shown(font, operands: list) -> str:
    """The text of shown operands; a wide kerning and the end of a nested array count as blanks."""
    out = []
    for v in operands:
        if isinstance(v, Str):
            out.append(font.decode(v))
        elif isinstance(v, list):
            out.append(_shown(font, v) + " ")
        elif isinstance(v, int) and not isinstance(v, bool) and v < KERNING_SPACE:
            out.append(" ")
    return "".join(out)


def ops_text(ops: list[Operation], encodings: dict) -> str:
    """The text of operations; fonts that aren't known drop their text. A font's choice begins a new chunk, which may begin with a line's end."""
    out, chunk, font = [], "", None
    for o in ops:
        if o.operator == "Tf" and o.operands:
            font = encodings.get(o.operands[0].decode("latin-1")) if isinstance(o.operands[0], Name) else None
            out.append(chunk)
            chunk = ""
        elif o.operator in ("Tj", "TJ") and font is not None:
            chunk += _shown(font, o.operands)
        elif o.operator in ("'", '"') and font is not None:
            chunk += "" if chunk.endswith("\n") else "\n"
            chunk += _shown(font, o.operands if o.operator == "'" else o.operands[2:3])
        elif o.operator in ("T*", "ET"):
            chunk += "" if chunk.endswith("\n") else "\n"
    return "".join([*out, chunk])


def text_of(doc: Document, numbers: list[int]) -> list[str]:
    """Texts of the pages asked for, in that order, as often as they are named."""
    own = pages(doc)
    for n in numbers:
        if not 1 <= n <= len(own):
            raise PdfError("PageNumberNotFound", str(n))
    return [page_text(doc, own[n - 1]) for n in numbers]


# Outline, graph and edits


def named_destinations(doc: Document, tree, depth: int = 0) -> dict[bytes, list]:
    found: dict[bytes, list] = {}
    tree = doc.soft(tree)
    if not isinstance(tree, dict) or depth > DEPTH:
        return found
    for k in doc.soft(tree.get("Kids")) or []:
        found |= named_destinations(doc, k, depth + 1)
    names = doc.soft(tree.get("Names")) or []
    for n, v in zip(names[::2], names[1::2], strict=False):
        v = doc.soft(v)
        v = doc.soft(v.get("D")) if isinstance(v, dict) else v
        if isinstance(n, Str) and isinstance(v, list) and len(v) > 1:
            found[bytes(n)] = v
    return found


def toc(doc: Document) -> list[tuple[int, str, int]]:
    """(level, title, page number) of outline entries whose page is known."""
    number = {r: i for i, r in enumerate(pages(doc), 1)}
    root = doc.soft(doc.catalog.get("Outlines"))
    named = named_destinations(doc, doc.catalog.get("Dests") or (doc.soft(doc.catalog.get("Names")) or {}).get("Dests"))
    out: list[tuple[int, str, int]] = []
    seen: set[Ref] = set()
    stack = [(root.get("First") if isinstance(root, dict) else None, 1)]
    while stack:
        ref, level = stack.pop()
        d = doc.soft(ref)
        if not isinstance(d, dict) or ref in seen or level > DEPTH:
            continue
        seen.add(ref)
        a = doc.soft(d.get("A"))
        dest = doc.soft(a.get("D") if isinstance(a, dict) and a.get("S") in (Name(b"GoTo"), Name(b"GoToR")) else d.get("Dest"))
        dest = named.get(bytes(dest)) if isinstance(dest, (Str, Name)) else dest
        if isinstance(dest, list) and dest and dest[0] in number:
            t = doc.soft(d.get("Title"))
            raw = bytes(t) if isinstance(t, Str) else b""
            title = raw[2:].decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "utf-16-le", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("utf-8", "replace")
            out.append((level, title, number[dest[0]]))
        stack += [(d.get("Next"), level), (d.get("First"), level + 1)]
    return out


def references(v):
    """All references in a value with their paths."""
    stack = [("", v)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, Ref):
            yield path, x
        elif isinstance(x, list):
            stack += [(f"{path}[{i}]", y) for i, y in enumerate(x)]
        elif isinstance(x, (dict, Stream)):
            stack += [(f"{path}/{k}", y) for k, y in (x.dict if isinstance(x, Stream) else x).items()]


def reachable(doc: Document) -> set[Ref]:
    seen: set[Ref] = set()
    todo = [r for _, r in references(doc.trailer)]
    while todo:
        r = todo.pop()
        if r not in seen and r in doc.objects:
            seen.add(r)
            todo += [x for _, x in references(doc.objects[r])]
    return seen


def prune(doc: Document) -> list[Ref]:
    gone = sorted(set(doc.objects) - reachable(doc))
    for r in gone:
        del doc.objects[r]
    return gone


def mapped(v, turn):
    """The value with ``turn`` on its references."""
    if isinstance(v, Ref):
        return turn(v)
    if isinstance(v, list):
        return [mapped(x, turn) for x in v]
    if isinstance(v, dict):
        return {k: mapped(x, turn) for k, x in v.items()}
    if isinstance(v, Stream):
        return Stream(mapped(v.dict, turn), v.raw, v.allows_compression, v.start)
    return v


def renumber(doc: Document, start: int = 1) -> None:
    """Pages take the lowest of their own numbers in page order; then all numbers are dense from ``start``."""
    order = pages(doc)
    swap = dict(zip(order, sorted(order), strict=True))
    ids = sorted(swap.get(r, r) for r in doc.objects)
    dense = {r: Ref(start + i, r.gen) for i, r in enumerate(ids)}
    new = {r: dense[swap.get(r, r)] for r in doc.objects}
    live = reachable(doc)
    turn = lambda r: new.get(r, r)
    doc.objects = dict(sorted((new[r], mapped(v, turn) if r in live else v) for r, v in doc.objects.items()))
    doc.trailer = mapped(doc.trailer, turn)


def delete_pages(doc: Document, numbers: list[int]) -> None:
    order = pages(doc)
    for ref in [order[n - 1] for n in numbers if 0 < n <= len(order)]:
        node, seen = doc.objects.pop(ref).get("Parent"), set()
        for r, v in doc.objects.items():
            if isinstance(v, dict) and isinstance(v.get("Kids"), list):
                v["Kids"] = [k for k in v["Kids"] if k != ref]
        while isinstance(node, Ref) and node not in seen and isinstance(d := doc.soft(node), dict):
            seen.add(node)
            if isinstance(d.get("Count"), int):
                d["Count"] -= 1
            node = d.get("Parent")


def merge(docs: list[Document]) -> Document:
    """Inputs keep their page trees, under a new root."""
    out, roots, total = Document("1.5"), [], 0
    for d in docs:
        renumber(d, out.max_id + 1)
        total += len(pages(d))
        root = d.trailer.get("Root")
        roots.append(doc_pages := d.catalog.get("Pages"))
        out.objects |= {r: v for r, v in d.objects.items() if r != root}
        if not isinstance(doc_pages, Ref):
            raise PdfError("ObjectType", "Pages")
    top = out.add({"Type": Name(b"Pages"), "Kids": roots, "Count": total})
    for r in roots:
        out.objects[r]["Parent"] = top
    out.trailer["Root"] = out.add({"Type": Name(b"Catalog"), "Pages": top})
    renumber(out)
    return out


def replace_partial(doc: Document, page: Ref, old: str, new: str) -> int:
    """Replaces within each shown string; the number of replacements."""
    encodings = {k: font_encoding(f, doc.soft) for k, f in page_fonts(doc, page).items()}
    ops, font, n = parse_content(page_content(doc, page)), None, 0

    def turned(v):
        nonlocal n
        if isinstance(v, list):
            return [turned(x) for x in v]
        if not isinstance(v, Str) or font is None or not (k := font.decode(v).count(old)):
            return v
        n += k
        return Str(font.encode(font.decode(v).replace(old, new)), v.hex)

    for o in ops:
        if o.operator == "Tf" and o.operands and isinstance(o.operands[0], Name):
            font = encodings.get(o.operands[0].decode("latin-1"))
        elif o.operator in ("Tj", "TJ", "'", '"'):
            o.operands = [turned(x) for x in o.operands]
    if n:
        change_content(doc, page, write_content(ops))
    return n


def replace_text(doc: Document, page: Ref, old: str, new: str) -> int:
    """Replaces shown strings and arrays whose whole text is ``old``; the number of replacements.

    An array's first string takes the new text, the others become empty, kerning stays.
    """
    encodings = {k: font_encoding(f, doc.soft) for k, f in page_fonts(doc, page).items()}
    ops, font, n = parse_content(page_content(doc, page)), None, 0
    for o in ops:
        if o.operator == "Tf" and o.operands and isinstance(o.operands[0], Name):
            font = encodings.get(o.operands[0].decode("latin-1"))
        elif o.operator in ("Tj", "TJ") and font is not None:
            for i, v in enumerate(o.operands):
                if isinstance(v, Str) and font.decode(v) == old:
                    o.operands[i] = Str(font.encode(new), v.hex)
                    n += 1
                elif isinstance(v, list) and _shown(font, v) == old:
                    strings = [j for j, x in enumerate(v) if isinstance(x, Str)]
                    for j in strings:
                        v[j] = Str(font.encode(new) if j == strings[0] else b"", v[j].hex)
                    n += 1
    if n:
        change_content(doc, page, write_content(ops))
    return n


def compress_all(doc: Document) -> None:
    for v in doc.objects.values():
        if isinstance(v, Stream) and v.allows_compression:
            compress(v)


def decompress_all(doc: Document) -> None:
    """Streams that can't be decoded stay as they are."""
    for v in doc.objects.values():
        if isinstance(v, Stream):
            with contextlib.suppress(PdfError):
                decompress(v)


def change_content(doc: Document, page: Ref, content: bytes) -> None:
    s = Stream({}, content)
    compress(s)
    old = doc.get(page).get("Contents")
    if isinstance(old, Ref) and isinstance(doc.soft(old), Stream):
        doc.objects[old] = s
    else:
        doc.get(page)["Contents"] = doc.add(s)


def build(title: str, author: str | None, keywords: str | None, page_lines: list[list[bytes]], compressed: bool = False) -> Document:
    """A document with one font, one outline entry per page, and lines as strings."""
    doc = Document()
    top, font = doc.add({}), doc.add({"Type": Name(b"Font"), "Subtype": Name(b"Type1"), "BaseFont": Name(b"Courier"), "Encoding": Name(b"WinAnsiEncoding")})
    kids, num = [], 2
    for lines in page_lines:
        shown = b"\nT*\n".join([write_string(Str(line)) + b" Tj" for line in lines])
        s = Stream({}, b"\n".join([b"BT\n/F1 12 Tf\n50 780 Td", *([shown] if lines else []), b"ET"]))
        if compressed:
            compress(s)
        doc.objects[Ref(num + 1)] = s
        doc.objects[Ref(num + 2)] = {"Type": Name(b"Page"), "Parent": top, "Contents": Ref(num + 1)}
        kids.append(Ref(num + 2))
        num += 2
    doc.objects[top] = {"Type": Name(b"Pages"), "Kids": kids, "Count": len(kids), "Resources": {"Font": {"F1": font}}, "MediaBox": [0, 0, 595, 842]}
    # the page's resources are found on the way up only behind a reference
    doc.objects[top]["Resources"] = Ref(num + 1)
    doc.objects[Ref(num + 1)] = {"Font": {"F1": font}}
    num += 1
    outline, first = Ref(num + 1), num + 2
    marks = [Ref(first + i) for i in range(len(kids))]
    doc.objects[outline] = {"Type": Name(b"Outlines"), "Count": len(kids)} | ({"First": marks[0], "Last": marks[-1]} if marks else {})
    for i, (m, k) in enumerate(zip(marks, kids, strict=True)):
        doc.objects[m] = {"Title": text_string(f"page {i + 1}"), "Parent": outline, "Dest": [k, Name(b"Fit")]} | ({"Next": marks[i + 1]} if i + 1 < len(marks) else {}) | ({"Prev": marks[i - 1]} if i else {})
    num = first + len(kids)
    doc.objects[Ref(num)] = {k: text_string(v) for k, v in (("Title", title), ("Author", author), ("Keywords", keywords)) if v is not None}
    doc.objects[Ref(num + 1)] = {"Type": Name(b"Catalog"), "Pages": top, "Outlines": outline}
    doc.trailer = {"Root": Ref(num + 1), "Info": Ref(num)}
    return doc
