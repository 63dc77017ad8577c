"""Corpora as tables: files to documents, pages, operations, objects and edges.

Every kernel works on one file at a time inside mapInArrow. Kernels that follow
each other run in one Python worker, file by file: content goes from one to the
next without a batch in between, so a task holds one file, the rows of some
files, and nothing else. Everything after is DataFrame work on ids.
A file that can't be read gives no rows, or fails the job with ``strict``;
``read_errors`` lists what is wrong with each file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import crypto, edit, pdf
from ..functions.encodings import decode_text_string
from ..functions.syntax import Name, PdfError, Str, kind, parse_content


#: Bytes of files whose rows are handed on at once, rows handed on at once, and rows taken at once.
FLUSH, FLUSH_ROWS, TAKE = 4 << 20, 8192, 64


def guarded(rows, content: bytes) -> list:
    """The rows of one file; whatever a damaged file raises is a PdfError."""
    try:
        return list(rows(content))
    except (PdfError, MemoryError):
        raise
    except Exception as x:
        raise PdfError("Damaged", f"{type(x).__name__}: {x}") from x


def each_row(source: DataFrame, schema: str, kernel) -> DataFrame:
    """``kernel(*row)`` gives the tuples that a row becomes. Content that it makes stays in its worker if the next kernel takes it."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        out, size = [], 0
        for taken in batches:
            for at in range(0, taken.num_rows, TAKE):
                for row in zip(*[c.to_pylist() for c in taken.slice(at, TAKE).columns], strict=True):
                    size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    out += kernel(*row)
                    if out and (size > FLUSH or len(out) > FLUSH_ROWS):
                        yield batch(out)
                        out, size = [], 0
        if out:
            yield batch(out)

    made = source.mapInArrow(run, schema)
    if schema.endswith(", content binary"):
        made._made_by = source, kernel
    return made


def each_file(files: DataFrame, schema: str, rows, strict: bool = False) -> DataFrame:
    """``rows(content)`` gives tuples without doc_id; ``files`` has doc_id, of any type, and content."""

    def one(doc_id, content):
        if content is None:
            return []
        try:
            return [(doc_id, *r) for r in guarded(rows, content)]
        except PdfError:
            if strict:
                raise
            return []

    key = files.schema["doc_id"].dataType.simpleString()
    source, kernel = files.select("doc_id", "content"), one
    if "_made_by" in vars(files):
        source, before = files._made_by
        kernel = lambda *row: [x for file in before(*row) for x in one(*file)]
    return each_row(source, f"doc_id {key}, {schema}", kernel)


def each_document(files: DataFrame, schema: str, rows, password: str | None = None, strict: bool = False) -> DataFrame:
    """``rows(document)`` gives tuples without doc_id."""
    return each_file(files, schema, lambda content: rows(pdf.load(content, password, strict)), strict)


def page_texts(files: DataFrame, password: str | None = None) -> DataFrame:
    """doc_id, page_no, text."""
    return each_document(files, "page_no int, text string", lambda d: [(i, pdf.page_text(d, p)) for i, p in enumerate(pdf.pages(d), 1)], password)


def document_texts(files: DataFrame) -> DataFrame:
    """doc_id, text of all pages; a document without pages has no row."""

    def rows(d):
        own = pdf.pages(d)
        return [("".join([pdf.page_text(d, p) for p in own]),)] if own else []

    return each_document(files, "text string", rows)


def operations(files: DataFrame) -> DataFrame:
    """doc_id, page_no, op_idx, operator."""
    return each_document(files, "page_no int, op_idx int, operator string", lambda d: [(n, i, o.operator) for n, p in enumerate(pdf.pages(d), 1) for i, o in enumerate(parse_content(pdf.page_content(d, p)))])


def objects(files: DataFrame) -> DataFrame:
    """doc_id, obj_num, gen, kind, type_name."""
    return each_document(files, "obj_num long, gen int, kind string, type_name string", lambda d: [(r.num, r.gen, kind(v), pdf._type(v).decode("latin-1") or None) for r, v in d.objects.items()])


def edges(files: DataFrame) -> DataFrame:
    """doc_id, src_num, path, dst_num; the trailer is object 0."""

    def rows(d):
        return [(n, path, x.num) for n, v in [(0, d.trailer), *((r.num, v) for r, v in d.objects.items())] for path, x in pdf.references(v)]

    return each_document(files, "src_num long, path string, dst_num long", rows)


def outline(files: DataFrame) -> DataFrame:
    """doc_id, seq, level, title, page_no."""
    return each_document(files, "seq int, level int, title string, page_no int", lambda d: [(i, *t) for i, t in enumerate(pdf.toc(d), 1)])


def metadata(files: DataFrame, password: str | None = None, strict: bool = False) -> DataFrame:
    """doc_id, title, author, keywords, page_count, version, encrypted; reads only what these need."""

    def rows(content):
        m = pdf.metadata(content, password=password)
        yield m["info"].get("Title"), m["info"].get("Author"), m["info"].get("Keywords"), m["pages"], m["version"], m["encrypted"]

    return each_file(files, "title string, author string, keywords string, page_count int, version string, encrypted boolean", rows, strict)


def permissions(files: DataFrame) -> DataFrame:
    """doc_id, flags (P of the Encrypt dictionary; null if there is none), and a column per permission; no password needed."""
    flags = each_file(files, "flags long", lambda content: [(pdf.metadata(content)["permissions"],)])
    return flags.select("*", *[(F.col("flags").bitwiseAND(F.lit(bit)) != 0).alias(name) for name, bit in crypto.PERMISSIONS.items()])


def rewrite(files: DataFrame, change, password: str | None = None, strict: bool = False, **save) -> DataFrame:
    """doc_id, content after ``change(document)`` and a new save."""

    def rows(content):
        doc = pdf.load(content, password)
        change(doc)
        yield (pdf.save(doc, **save),)

    return each_file(files, "content binary", rows, strict)


def read_errors(files: DataFrame, password: str | None = None) -> DataFrame:
    """doc_id, code, detail of each file's first error; nulls for a file that loads and whose pages give text."""

    def rows(content):
        def read(content):
            doc = pdf.load(content, password)
            for p in pdf.pages(doc):
                pdf.page_text(doc, p)
            return []

        try:
            guarded(read, content)
        except PdfError as x:
            return [(x.code, x.detail)]
        return [(None, None)]

    return each_file(files, "code string, detail string", rows)


def page_list(files: DataFrame, numbers: list[int], password: str | None = None) -> DataFrame:
    """doc_id, pos, page_no, text, error: the pages asked for, in that order, as often as they are named."""

    def rows(d):
        for pos, n in enumerate(numbers, 1):
            try:
                yield pos, n, pdf.text_of(d, [n])[0], None
            except PdfError as x:
                yield pos, n, None, x.code

    return each_document(files, "pos int, page_no int, text string, error string", rows, password)


def images(files: DataFrame) -> DataFrame:
    """doc_id, page_no, obj_num, width, height, bits, color_space, filters, size; pages with own resources only."""

    def rows(d):
        for n, p in enumerate(pdf.pages(d), 1):
            if "Resources" in d.get(p):
                for x in edit.images(d, p):
                    yield n, x["id"], x["width"], x["height"], x["bits"], x["color_space"], ",".join(x["filters"]), x["size"]

    return each_document(files, "page_no int, obj_num long, width int, height int, bits int, color_space string, filters string, size long", rows)


def annotations(files: DataFrame) -> DataFrame:
    """doc_id, page_no, idx, subtype, contents."""

    def rows(d):
        for n, p in enumerate(pdf.pages(d), 1):
            for i, a in enumerate(edit.annotations(d, p)):
                subtype, text = a.get("Subtype"), d.soft(a.get("Contents"))
                yield n, i, subtype.decode("latin-1") if isinstance(subtype, Name) else None, decode_text_string(text) if isinstance(text, Str) else None

    return each_document(files, "page_no int, idx int, subtype string, contents string", rows)


def fonts(files: DataFrame) -> DataFrame:
    """doc_id, page_no, name, base_font, subtype: the nearest definition of each name."""
    name = lambda v: v.decode("latin-1") if isinstance(v, Name) else None
    return each_document(files, "page_no int, name string, base_font string, subtype string", lambda d: [(n, k, name(f.get("BaseFont")), name(f.get("Subtype"))) for n, p in enumerate(pdf.pages(d), 1) for k, f in pdf.page_fonts(d, p).items()])


def update(files: DataFrame, change, **save) -> DataFrame:
    """doc_id, content: each file with an incremental update after it; files that can't take one go."""
    return each_file(files, "content binary", lambda content: [(edit.save_update(content, change, **save),)])
