"""Files in and out: Spark's reader, the data source and its sink, streams; edits of damaged input."""

import pytest

from foliograph.functions import edit, pdf
from foliograph.functions.syntax import PdfError, Ref, Stream
from foliograph.operators import graph, tables
from foliograph.sources import files
from foliograph.streaming import pages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pdf")
    rows = [(i, bytearray(pdf.save(pdf.build(f"t{i}", "a", "k", [[b"one"], [b"two"]][: i + 1], compressed=True), object_streams=bool(i)))) for i in range(2)]
    files.register(spark)
    spark.createDataFrame(rows, "doc_id long, content binary").write.format("pdf").mode("append").save(str(path))
    (path / "bad.pdf").write_bytes(b"%PDF-1.4\nnothing")
    return str(path)


def test_source(spark, folder):
    got = {r.doc_id.rsplit("/", 1)[1]: (r.pages, r.error is None) for r in spark.read.format("pdf").load(folder).collect()}
    assert got == {"0.pdf": (1, True), "1.pdf": (2, True), "bad.pdf": (None, False)}
    with pytest.raises(Exception, match="PdfError"):
        spark.read.format("pdf").option("strict", "true").load(folder).collect()


def test_binary_files(spark, folder):
    df = files.read_files(spark, folder)
    assert sorted(r.text for r in tables.page_texts(df).collect()) == ["one\n", "one\n", "two\n"]
    assert {r.kind for r in graph.xref_entries(df).select("kind").collect()} == {"Normal", "Compressed"}
    assert tables.images(df).count() == 0 and graph.nodes(df.limit(0)).count() == 0


def test_stream(spark, folder, tmp_path):
    source = files.stream_files(spark, folder)
    for name, df in (("texts", pages.text_stream(source)), ("titles", pages.metadata_stream(source))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.text for r in spark.table("texts").collect()) == ["one\n", "one\n", "two\n"]
    assert sorted((r.title, r.pages) for r in spark.table("titles").collect()) == [("t0", 1), ("t1", 2)]


def test_overlay(spark):
    base = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b")], "doc_id long, obj_num long, gen int, v string")
    delta = spark.createDataFrame([(1, 2, 0, "c"), (1, 3, 0, "d")], base.schema)
    assert sorted(r.v for r in graph.overlay(base, delta).collect()) == ["a", "c", "d"]


def test_update_keeps_bytes():
    old = pdf.save(pdf.build("t", "a", "k", [[b"one"]]))
    for save in ({}, {"object_streams": True}):
        new = edit.save_update(b"junk" + old, lambda d: edit.change_producer(d, "me"), **save)
        assert new.startswith(b"junk" + old)
        d = pdf.load(new)
        assert d.get(d.trailer["Info"])["Producer"] == b"me" and pdf.page_text(d, pdf.pages(d)[0]) == "one\n"


def test_edits():
    d = pdf.build("t", "a", "k", [[b"one"], [b"two"]])
    first, second = pdf.pages(d)
    note = d.add({"Subtype": "x"})
    with pytest.raises(PdfError):
        edit.annotation_page(d, note)
    d.get(first)["Annots"], d.get(second)["Annots"] = [], [note]
    assert edit.annotation_page(d, note) == second
    edit.remove_annotation(d, note)
    assert edit.annotations(d, second) == [] and note not in d.objects
    edit.add_content(d, second, b"q Q")
    assert b"q Q" in pdf.page_content(d, second)
    edit.delete_object(d, d.get(first)["Contents"])
    assert "Contents" not in d.get(first)
    with pytest.raises(PdfError):
        edit.images(d, first)
    head = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x02\x00\x03\x03" + bytes(9)
    assert edit.jpeg(head).dict["Width"] == 3
    with pytest.raises(PdfError):
        edit.jpeg(b"\xff\xd8")
    empty = d.add(Stream({}, b""))
    assert edit.delete_zero_length_streams(d) == [empty] and d.soft(Ref(empty.num)) is None
