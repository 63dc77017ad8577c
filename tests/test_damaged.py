import random

from foliograph.functions import crypto, pdf
from foliograph.functions.syntax import PdfError, Stream, parse_content
from foliograph.operators import tables


class Plain:
    def decode(self, data):
        return data.decode("latin-1")


def text(content):
    return pdf.ops_text(parse_content(content), {"F1": Plain()})


def test_chunks():
    assert text(b"BT ET") == "\n"
    assert text(b"BT /F1 12 Tf (a) Tj T* /F1 12 Tf T* (b) Tj ET") == "a\n\nb\n"
    assert text(b"BT (a) ' ET") == "\n"
    assert text(b"BT /F1 1 Tf (a) Tj (b) ' 1 2 (c) \" [(d) -101 (e) -100 (f)] TJ ET") == "a\nb\ncd ef \n"


def test_replace_and_pages():
    doc = pdf.build("t", "a", "k", [[b"one", b"two", b"one"], [b"two"]])
    first, second = pdf.pages(doc)
    assert pdf.replace_text(doc, first, "one", "1") == 2 and pdf.replace_text(doc, first, "tw", "2") == 0
    pdf.change_content(doc, second, b"BT /F1 1 Tf [(on) -200 (e)] TJ ET")
    assert pdf.replace_text(doc, second, "on e", "xy") == 1
    ops = parse_content(pdf.page_content(doc, second))
    assert [o.operands for o in ops if o.operator == "TJ"] == [[[b"xy", -200, b""]]]
    assert pdf.text_of(doc, [2, 1, 2]) == ["xy  \n", "1\ntwo\n1\n", "xy  \n"]
    try:
        pdf.text_of(doc, [3])
    except PdfError as x:
        assert x.code == "PageNumberNotFound"


def test_compress_all():
    doc = pdf.build("t", "a", "k", [[b"word " * 99]])
    want = [s.raw for s in doc.objects.values() if isinstance(s, Stream)]
    pdf.compress_all(doc)
    assert all("Filter" in s.dict for s in doc.objects.values() if isinstance(s, Stream))
    pdf.decompress_all(doc)
    assert [s.raw for s in doc.objects.values() if isinstance(s, Stream)] == want


def test_locked_metadata():
    doc = pdf.build("title", "a", "k", [[b"x"]])
    for v in (1, 2, 4, 5):
        locked = pdf.save(doc, security=crypto.Security.create(v, "owner", "user"))
        assert pdf.metadata(locked, password="user")["info"]["Title"] == "title"
        m = pdf.metadata(locked)
        assert m["encrypted"] and m["info"] == {} and m["pages"] == 1


def test_mutations():
    """Damaged bytes give rows or a PdfError, nothing else."""
    rng = random.Random(7)
    doc = pdf.build("t", "a", "k", [[b"one"], [b"two"]])
    files = [pdf.save(doc), pdf.save(doc, object_streams=True), pdf.save(doc, security=crypto.Security.create(2, "o", "")), pdf.save(doc, xref_stream=True)]

    def rows(content):
        pdf.metadata(content)
        d = pdf.load(content)
        pdf.toc(d)
        return [(pdf.page_text(d, p),) for p in pdf.pages(d)]

    for i in range(2000):
        b = bytearray(files[i % 4])
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        try:
            tables.guarded(rows, bytes(b))
        except PdfError:
            pass


def test_error_rows(spark):
    good = pdf.save(pdf.build("t", "a", "k", [[b"one"]]))
    bad = good.replace(b"/Root", b"/Rxxt")
    files = spark.createDataFrame([("a", good, 1), ("b", b"junk", 2), ("c", None, 3), ("d", b"", 4), ("e", bad, 5)], "doc_id string, content binary, code int")
    got = {r.doc_id: r.code for r in tables.read_errors(files).collect()}
    assert got["a"] is None and got["b"] == got["d"] == "Parse" and "c" not in got
    assert [r.doc_id for r in tables.rewrite(files, lambda d: None).collect()][:1] == ["a"]
    assert ("a", "t") in {(r.doc_id, r.title) for r in tables.metadata(files).collect()}
    assert tables.read_errors(files.limit(0)).count() == 0
