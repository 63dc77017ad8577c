"""What keeps a query's memory and seconds in proportion to its input."""

import pyarrow as pa
import pytest

import __spark_entry__
from foliograph.functions import crypto, edit, pdf
from foliograph.functions.syntax import PdfError, Ref, parse_content, parse_value
from foliograph.operators import tables

SF = "/root/testdata/sf0.001"
CHAINS = ("replace_text", "incremental_rotate", "encrypt_roundtrip", "permissions", "document_text", "toc", "image_page_text", "replace_partial", "images", "compress_roundtrip", "dangling", "delete_pages", "page_text", "bookmarks")


@pytest.mark.parametrize("name", CHAINS)
def test_one_python_step(spark, name):
    """Content goes from kernel to kernel in one worker; no texts are shuffled."""
    plan = __spark_entry__.queries()[f"pdf_{name}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1
    assert ("Aggregate" in plan) == (name == "dangling") and "Join" not in plan


def test_batches(spark):
    """Rows leave in batches that are bounded by rows and by the bytes of their files."""

    class Source:
        def mapInArrow(self, run, schema):
            return run

    run = tables.each_row(Source(), "doc_id long, n int", lambda doc_id, content: [(doc_id, k) for k in range(len(content) // 1000)])
    for n, size in ((3000, 20_000), (100, 1_000_000)):
        taken = [pa.RecordBatch.from_pydict({"doc_id": list(range(at, at + n // 2)), "content": [bytes(size)] * (n // 2)}) for at in (0, n // 2)]
        got = list(run(iter(taken)))
        assert sum(b.num_rows for b in got) == n * size // 1000
        assert all(b.num_rows <= tables.FLUSH_ROWS + size // 1000 and b.num_rows * 1000 <= tables.FLUSH + size for b in got)
    assert list(run(iter([]))) == []


def test_chain_equals_single_steps(spark):
    """Kernels in one worker give what they give one by one, also where a step drops a file."""
    good = pdf.save(pdf.build("t", "a", "k", [[b"one"], [b"two"]]))
    files = spark.createDataFrame([("a", good), ("b", b"junk"), ("c", None), ("d", good)], "doc_id string, content binary")

    def change(d):
        pdf.delete_pages(d, [1])

    chained = tables.page_texts(tables.update(tables.rewrite(files, change), lambda d: edit.rotate(d, 90)))
    single = tables.rewrite(files, change).select("*").persist()
    single = tables.page_texts(tables.update(single, lambda d: edit.rotate(d, 90)).select("*"))
    want = [("a", 1, "two\n"), ("d", 1, "two\n")]
    assert sorted(map(tuple, chained.collect())) == sorted(map(tuple, single.collect())) == want
    with pytest.raises(Exception, match="PdfError"):
        tables.page_texts(tables.rewrite(files, change, strict=True)).collect()


def test_numbers_without_a_search(monkeypatch):
    """A new object's number doesn't need a look at all objects each time."""
    doc, looks = pdf.build("t", "a", "k", [[b"one"]]), []
    highest = pdf.Document.max_id.fget
    monkeypatch.setattr(pdf.Document, "max_id", property(lambda d: looks.append(1) or highest(d)))
    first = doc.add({}).num
    assert [doc.add({}).num for _ in range(99)] == list(range(first + 1, first + 100)) and len(looks) == 1
    doc.objects[Ref(first + 500)] = {}
    assert doc.add({}).num == first + 501
    doc.objects.pop(Ref(first + 501))
    doc.objects.pop(Ref(first + 500))
    assert doc.add({}).num == first + 100
    doc.objects = {Ref(3): {}}
    assert doc.add({}).num == 4


def test_comments_are_skipped_whole():
    assert [o.operator for o in parse_content(b"BT % comment\n(a) Tj % (b) Tj\nET %tail")] == ["BT", "Tj", "ET"]
    assert parse_value(b"<</A 1%x /B 2\n/C/D>>")[0] == {"A": 1, "C": b"D"}
    with pytest.raises(PdfError):
        parse_value(b"% tail .25 ")


def test_keys_are_kept(monkeypatch):
    """Files of one producer share their keys: what follows from a key alone is made once."""
    guard, made = crypto.Security.create(2, "owner", "user", random=lambda n: bytes(n)), []
    output = crypto._rc4_output
    monkeypatch.setattr(crypto, "_rc4_output", lambda key, n: made.append(key) or output(key, n))
    files = [pdf.save(pdf.build(f"t{i}", "a", "k", [[b"x" * 40]]), security=guard) for i in range(3)]
    assert [pdf.page_text(d, pdf.pages(d)[0]) for d in (pdf.load(f, "user") for f in files)] == ["x" * 40 + "\n"] * 3
    made.clear()
    assert pdf.metadata(files[1], password="user")["info"]["Title"] == "t1" and pdf.metadata(files[2])["encrypted"]
    pdf.load(files[0], "user")
    assert not made
    for _ in range(2):
        with pytest.raises(PdfError, match="IncorrectPassword"):
            pdf.load(files[0], "wrong")
    monkeypatch.setattr(crypto, "KEPT_ALL", 2000)
    for n in (1, 100, 70_000, 64):
        data = bytes(i * 7 & 255 for i in range(n))
        key = b"key %d" % n
        assert crypto.rc4(key, crypto.rc4(key, data)) == data and crypto.rc4(key, data)[:1] == crypto.rc4(key, data[:1])
    assert crypto._kept_size <= 2000
