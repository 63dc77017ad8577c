import pytest

from foliograph.functions import crypto, dates, encodings, filters, pdf, syntax


def test_values():
    v, _ = syntax.parse_value(b"<</A [1 .5 (x\\053(y)) <901FA> 3 0 R null true]/B#20C/D>>")
    assert v["A"][2:5] == [b"x+(y)", b"\x90\x1f\xa0", syntax.Ref(3)] and v["B C"] == b"D"
    assert syntax.parse_value(syntax.write_value(v))[0] == v
    with pytest.raises(syntax.PdfError):
        syntax.parse_value(b"[" * 200)


def test_filters():
    assert filters.ascii85(b"87cURD_*#4DfTZ)+T~>") == b"Hello, World!"
    assert filters.run_length(bytes.fromhex("0448656c6c6ffe4180")) == b"HelloAAA"
    assert filters.ascii_hex(b"4A5>") == b"JP"
    assert list(filters.tiff_rows(bytes([85, 179]), 1, 6, 2)) == [108, 147]
    with pytest.raises(syntax.PdfError):
        filters.ascii85(b"s8W-\"~>")
    import zlib

    raw = bytearray(zlib.compress(b"text" * 100))
    raw[-4:] = bytes(255 - b for b in raw[-4:])
    assert filters.flate(bytes(raw)) == b"text" * 100
    with pytest.raises(syntax.PdfError):
        filters.flate(zlib.compress(bytes(1 << 20)), 1000)


def test_encodings_and_dates():
    assert encodings.decode_table("WinAnsiEncoding", bytes([0x41, 0xE9, 0x42, 0xFC, 0xDF])) == "AéBüß"
    assert encodings.decode_text_string(bytes.fromhex("FEFF0442043504410442")) == "тест"
    m = encodings.parse_cmap(b"begincmap 1 beginbfrange <0041> <0043> <0061> endbfrange 1 beginbfchar <01> <00660069> endbfchar")
    assert m.decode(b"\x01\x00\x42") == "fib"
    assert dates.parse_date("D:199812231952-08'00'").isoformat() == "1998-12-23T19:52:00-08:00"
    assert dates.parse_date("D:20040229").isoformat() == "2004-02-29T00:00:00+00:00"


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypto.aes_ecb_encrypt(bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"


@pytest.mark.parametrize("v", [1, 2, 4, 5])
def test_round_trips(v):
    doc = pdf.build("t", "a", "k", [[b"h\xe9llo (a", b"w)"], [b"x y"]])
    want = ["héllo (a\nw)\n", "x y\n"]
    for options in ({}, {"xref_stream": True}, {"object_streams": True}):
        back = pdf.load(pdf.save(doc, **options))
        assert [pdf.page_text(back, p) for p in pdf.pages(back)] == want
    locked = pdf.save(doc, security=crypto.Security.create(v, "owner", "user"))
    for password in ("user", "owner"):
        back = pdf.load(locked, password)
        assert [pdf.page_text(back, p) for p in pdf.pages(back)] == want
    with pytest.raises(syntax.PdfError):
        pdf.load(locked, "wrong")


def test_edits():
    doc = pdf.load(pdf.save(pdf.build("t", "a", "k", [[b"one"], [b"two"], [b"three"]])))
    pdf.delete_pages(doc, [2])
    both = pdf.merge([doc, pdf.load(pdf.save(pdf.build("u", "a", "k", [[b"four"]])))])
    assert [pdf.page_text(both, p) for p in pdf.pages(both)] == ["one\n", "three\n", "four\n"]
    assert pdf.prune(both)
    assert pdf.replace_partial(both, pdf.pages(both)[0], "n", "NN") == 1
    assert pdf.page_text(both, pdf.pages(both)[0]) == "oNNe\n"
