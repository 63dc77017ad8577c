"""Edits of a document, and what its pages hold beside text."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from . import pdf
from .encodings import text_string
from .pdf import Document
from .syntax import Name, Operation, PdfError, Ref, Stream, parse_content, write_content, write_value

# What pages hold


def annotations(doc: Document, page: Ref) -> list[dict]:
    """Entries that are neither dictionaries nor references to one are skipped."""
    got = doc.get(doc.get(page).get("Annots", []))
    return [d for d in map(doc.soft, got if isinstance(got, list) else []) if isinstance(d, dict)]


def annotation_page(doc: Document, annot: Ref) -> Ref:
    """The page that lists the annotation; pages before it must hold a direct array."""
    for page in pdf.pages(doc):
        listed = doc.get(page).get("Annots")
        if not isinstance(listed, list):
            raise PdfError("DictKey", "Annots")
        if annot in listed:
            return page
    raise PdfError("ObjectNotFound", f"{annot.num} {annot.gen}")


def images(doc: Document, page: Ref) -> list[dict]:
    """id, width, height, color_space, filters, bits, size of the page's own images."""
    resources = doc.get(doc.get(page).get("Resources"))
    if not isinstance(resources, dict):
        raise PdfError("DictKey", "Resources")
    out = []
    for v in (doc.get(resources.get("XObject")) or {}).values():
        s = doc.get(v)
        if not isinstance(v, Ref) or not isinstance(s, Stream):
            raise PdfError("ObjectType", "XObject")
        if s.dict.get("Subtype") != Name(b"Image"):
            continue
        space = doc.soft(s.dict.get("ColorSpace"))
        space = space[0] if isinstance(space, list) and space else space
        names = s.dict.get("Filter", [])
        out.append({
            "id": v.num, "width": s.dict.get("Width"), "height": s.dict.get("Height"), "bits": s.dict.get("BitsPerComponent"), "size": len(s.raw),
            "color_space": space.decode("latin-1") if isinstance(space, Name) else None,
            "filters": [n.decode("latin-1") for n in (names if isinstance(names, list) else [names])],
        })
    return out


# Removal


def _without(v, ref: Ref):
    """No entry of a dictionary, and the first of an array, points at ``ref`` any more."""
    if isinstance(v, list):
        v = list(v)
        if ref in v:
            v.remove(ref)
        return [_without(x, ref) for x in v]
    if isinstance(v, dict):
        return {k: _without(x, ref) for k, x in v.items() if x != ref}
    if isinstance(v, Stream):
        v.dict = _without(v.dict, ref)
    return v


def delete_object(doc: Document, ref: Ref):
    """Removes the object and the references to it in everything reachable."""
    for r in pdf.reachable(doc):
        doc.objects[r] = _without(doc.objects[r], ref)
    doc.trailer = _without(doc.trailer, ref)
    return doc.objects.pop(ref, None)


def delete_zero_length_streams(doc: Document) -> list[Ref]:
    gone = [r for r, v in doc.objects.items() if isinstance(v, Stream) and not v.raw]
    for r in gone:
        delete_object(doc, r)
    return gone


def delete_outlines(doc: Document) -> None:
    root = doc.catalog.get("Outlines")
    if not isinstance(root, Ref):
        return
    seen, todo = {}, [root]
    while todo:
        r = todo.pop()
        d = doc.soft(r)
        if isinstance(r, Ref) and r not in seen and isinstance(d, dict):
            seen[r] = None
            todo += [d.get("Next"), d.get("First")]
    for r in seen:
        del doc.objects[r]
    doc.catalog.pop("Outlines")


def remove_annotation(doc: Document, annot: Ref) -> None:
    for page in pdf.pages(doc):
        d = doc.get(page)
        if not isinstance(d.get("Annots"), list):
            raise PdfError("DictKey", "Annots")
        d["Annots"] = [a for a in d["Annots"] if a != annot]
    doc.objects.pop(annot, None)


# Pages


def rotate(doc: Document, angle: int) -> None:
    for page in pdf.pages(doc):
        d = doc.get(page)
        d["Rotate"] = (d.get("Rotate", 0) + angle) % 360


def change_producer(doc: Document, producer: str) -> None:
    info = doc.soft(doc.trailer.get("Info"))
    if isinstance(info, dict):
        info["Producer"] = text_string(producer)


def own_resources(doc: Document, page: Ref) -> dict:
    """The page's resources; made where it has none of its own."""
    d = doc.get(page)
    if "Resources" not in d:
        d["Resources"] = {}
    return doc.get(d["Resources"])


def add_resource(doc: Document, page: Ref, category: str, name: str, target: Ref) -> None:
    """category: XObject, ExtGState and the like."""
    r = own_resources(doc, page)
    doc.get(r.setdefault(category, {}))[name] = target


def add_content(doc: Document, page: Ref, content: bytes) -> None:
    """Another content stream after those the page has."""
    d = doc.get(page)
    had = d.get("Contents", [])
    listed = doc.soft(had) if isinstance(doc.soft(had), list) else [] if had == [] else [had]
    d["Contents"] = [*listed, doc.add(Stream({}, content))]


def form(bbox: list, matrix: list, content: bytes) -> Stream:
    return Stream({"Type": Name(b"XObject"), "Subtype": Name(b"Form"), "BBox": bbox, "Matrix": matrix}, content)


def image(width: int, height: int, samples: bytes, channels: int = 3) -> Stream:
    """8-bit samples by row; gray for one channel, RGB for three."""
    if len(samples) != width * height * channels:
        raise PdfError("InvalidStream", "samples")
    space = {1: b"DeviceGray", 3: b"DeviceRGB", 4: b"DeviceCMYK"}[channels]
    d = {"Type": Name(b"XObject"), "Subtype": Name(b"Image"), "Width": width, "Height": height, "ColorSpace": Name(space), "BitsPerComponent": 8, "Filter": Name(b"FlateDecode")}
    return Stream(d, zlib.compress(samples))


def jpeg(data: bytes) -> Stream:
    """A JPEG file as it is; its size stands in the frame header."""
    at = 2
    while at + 9 < len(data):
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            bits, height, width, channels = struct.unpack(">BHHB", data[at + 4 : at + 10])
            space = {1: b"DeviceGray", 3: b"DeviceRGB", 4: b"DeviceCMYK"}[channels]
            d = {"Type": Name(b"XObject"), "Subtype": Name(b"Image"), "Width": width, "Height": height, "ColorSpace": Name(space), "BitsPerComponent": bits, "Filter": Name(b"DCTDecode")}
            return Stream(d, data)
        at += 2 + size
    raise PdfError("InvalidStream", "no JPEG frame")


def _drawn(doc: Document, page: Ref, target: Stream) -> str:
    ref = doc.add(target)
    name = f"X{ref.num}"
    if "Resources" not in doc.get(page):  # its fonts come from above and must stay in reach
        doc.get(page)["Resources"] = {"Font": {k: v for k, v in pdf.page_fonts(doc, page).items()}}
    add_resource(doc, page, "XObject", name, ref)
    return name


def insert_image(doc: Document, page: Ref, picture: Stream, at: tuple, size: tuple) -> None:
    """Draws at the end of the page's content."""
    ops = parse_content(pdf.page_content(doc, page))
    name = _drawn(doc, page, picture)
    ops += [Operation("q"), Operation("cm", [size[0], 0, 0, size[1], *at]), Operation("Do", [Name(name.encode())]), Operation("Q")]
    pdf.change_content(doc, page, write_content(ops))


def insert_form(doc: Document, page: Ref, target: Stream) -> None:
    """Draws over the page with the graphics state that it began with."""
    ops = parse_content(pdf.page_content(doc, page))
    name = _drawn(doc, page, target)
    pdf.change_content(doc, page, write_content([Operation("q"), *ops, Operation("Q"), Operation("Do", [Name(name.encode())])]))


# Bookmarks


@dataclass
class Bookmark:
    """page: None takes the first page found below."""

    title: str
    page: Ref | None = None
    color: tuple = (0.0, 0.0, 0.0)
    format: int = 0
    children: list[Bookmark] = field(default_factory=list)

    def target(self) -> Ref | None:
        return self.page or next((t for c in self.children if (t := c.target())), None)


def set_outline(doc: Document, marks: list[Bookmark]) -> Ref | None:
    """Writes bookmarks as the document's outline."""
    if not marks:
        return None

    def level(parent: Ref, nodes: list[Bookmark]) -> tuple[Ref, Ref]:
        refs = [doc.add({}) for _ in nodes]
        for i, (r, m) in enumerate(zip(refs, nodes, strict=True)):
            d = {"Title": text_string(m.title), "Parent": parent, "C": list(m.color), "F": m.format}
            if m.target():
                d["A"] = doc.add({"S": Name(b"GoTo"), "D": [m.target(), Name(b"Fit")]})
            d |= ({"Prev": refs[i - 1]} if i else {}) | ({"Next": refs[i + 1]} if i + 1 < len(refs) else {})
            doc.objects[r] = d
            if m.children:
                d["First"], d["Last"] = level(r, m.children)
                d["Count"] = len(m.children)
        return refs[0], refs[-1]

    root = doc.add({})
    first, last = level(root, marks)
    doc.objects[root] = {"Type": Name(b"Outlines"), "First": first, "Last": last, "Count": len(marks)}
    doc.catalog["Outlines"] = root
    return root


# Incremental updates


def save_update(before: bytes, edit, **save) -> bytes:
    """``before`` with the objects that ``edit(document)`` changes or adds after it.

    An object whose text is as it was is not written again.
    """
    doc = pdf.load(before)
    if doc.encrypted:
        raise PdfError("Unimplemented", "update of an encrypted file")
    xref_start, kept = doc.xref_start, {r: write_value(v) for r, v in doc.objects.items()}
    edit(doc)
    delta = Document(doc.version, doc.trailer, {r: v for r, v in doc.objects.items() if kept.get(r) != write_value(v)})
    start = before.find(b"%PDF-")
    out = pdf.save(delta, previous=before[start:], prev_start=xref_start, **save)
    return before[:start] + out
