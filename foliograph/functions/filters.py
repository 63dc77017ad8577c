"""Stream filters as plain functions over bytes, each with a limit on its output."""

from __future__ import annotations

import zlib

import numpy as np

from .syntax import Name, PdfError, Stream

#: Decoded bytes per stream unless a caller says otherwise.
LIMIT = 256 << 20


def _check(n: int, limit: int | None) -> None:
    if limit is not None and n > limit:
        raise PdfError("MemoryLimitExceeded", str(limit))


def flate(data: bytes, limit: int | None = None) -> bytes:
    """What can be decoded: a bad checksum or a torn end keeps the part before it."""
    for raw, bits in ((data, 15), (data[2:], -15)):
        d, out, n = zlib.decompressobj(bits), [], 0
        try:
            for at in range(0, len(raw), 4096):
                chunk = raw[at : at + 4096]
                while chunk:
                    out.append(d.decompress(chunk, 1 << 20))
                    n += len(out[-1])
                    _check(n, limit)
                    chunk = d.unconsumed_tail
        except zlib.error:
            pass
        if n:
            break
    return b"".join(out)


def lzw(data: bytes, early: int = 1, limit: int | None = None) -> bytes:
    out, n = [], 0
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            break
        out.append(now)
        n += len(now)
        _check(n, limit)
        if last and len(table) < 4096:
            table.append(last + now[:1])
        last = now
        # the decoder's table is one entry behind the encoder's
        width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def ascii85(data: bytes, limit: int | None = None) -> bytes:
    out, group = bytearray(), []
    for c in data:
        if c in b" \t\n\r\x00\x0c":
            continue
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group).to_bytes(4, "big")
                group = []
        else:
            break
        _check(len(out), limit)
    if len(group) > 1:
        n = len(group)
        out += _base85(group + [84] * (5 - n)).to_bytes(4, "big")[: n - 1]
    _check(len(out), limit)
    return bytes(out)


def _base85(group: list[int]) -> int:
    v = 0
    for g in group:
        v = v * 85 + g
    if v >= 1 << 32:
        raise PdfError("Decompress", "ASCII85 group too large")
    return v


def ascii_hex(data: bytes, limit: int | None = None) -> bytes:
    digits = data.split(b">", 1)[0].translate(None, b" \t\n\r\x00\x0c")
    try:
        out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except (ValueError, UnicodeDecodeError):
        raise PdfError("Decompress", "ASCIIHex digit") from None
    _check(len(out), limit)
    return out


def run_length(data: bytes, limit: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        _check(len(out), limit)
    return bytes(out)


def png_rows(data: bytes, bpp: int, row: int) -> bytes:
    """Undoes PNG row filters; a torn last row is filled as far as it goes."""
    out, above = [], np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        how, line = data[at], np.frombuffer(data[at + 1 : at + 1 + row], np.uint8).copy()
        up = above[: len(line)]
        if how == 1:
            for j in range(bpp):
                line[j::bpp] = np.cumsum(line[j::bpp], dtype=np.uint8)
        elif how == 2:
            line += up
        elif how in (3, 4):
            cur = line.tolist()
            u = up.tolist()
            for i in range(len(cur)):
                a, c = (cur[i - bpp], u[i - bpp]) if i >= bpp else (0, 0)
                if how == 3:
                    cur[i] = cur[i] + (a + u[i]) // 2 & 255
                else:
                    p = a + u[i] - c
                    pa, pb, pc = abs(p - a), abs(p - u[i]), abs(p - c)
                    cur[i] = cur[i] + (a if pa <= pb and pa <= pc else u[i] if pb <= pc else c) & 255
            line = np.array(cur, np.uint8)
        elif how:
            raise PdfError("Decompress", f"PNG filter {how}")
        out.append(line.tobytes())
        above = np.zeros(row, np.uint8)
        above[: len(line)] = line
    return b"".join(out)


def tiff_rows(data: bytes, colors: int, columns: int, bits: int) -> bytes:
    if bits not in (1, 2, 4, 8, 16):
        raise PdfError("Decompress", f"TIFF predictor with {bits} bits")
    row = (colors * columns * bits + 7) // 8
    out = []
    for at in range(0, len(data), row):
        line = np.frombuffer(data[at : at + row], np.uint8)
        if bits == 16:
            v = line[: len(line) // 2 * 2].view(">u2").astype(np.uint32)
        elif bits == 8:
            v = line.astype(np.uint32)
        else:
            b = np.unpackbits(line).reshape(-1, bits)
            v = (b * (1 << np.arange(bits)[::-1])).sum(1).astype(np.uint32)
        n = min(len(v), colors * columns)
        for c in range(colors):
            v[c:n:colors] = np.cumsum(v[c:n:colors]) % (1 << bits)
        if bits == 16:
            out.append(v.astype(">u2").tobytes())
        elif bits == 8:
            out.append(v.astype(np.uint8).tobytes())
        else:
            out.append(np.packbits((v[:, None] >> np.arange(bits)[::-1] & 1).astype(np.uint8)).tobytes())
    return b"".join(out)


def unpredict(data: bytes, parms) -> bytes:
    if not isinstance(parms, dict):
        return data
    get = lambda k, d: parms[k] if isinstance(parms.get(k), int) else d
    how, colors, bits, columns = get("Predictor", 1), get("Colors", 1), get("BitsPerComponent", 8), get("Columns", 1)
    if how == 2:
        return tiff_rows(data, colors, columns, bits)
    if 10 <= how <= 15:
        return png_rows(data, max(1, (colors * bits + 7) // 8), (colors * columns * bits + 7) // 8)
    return data


def filter_names(s: Stream) -> list[str]:
    f = s.dict.get("Filter")
    if isinstance(f, Name):
        return [f.decode("latin-1")]
    if isinstance(f, list) and all(isinstance(x, Name) for x in f):
        return [x.decode("latin-1") for x in f]
    raise PdfError("DictKey" if f is None else "ObjectType", "Filter")


def decoded(s: Stream, limit: int | None = LIMIT) -> bytes:
    """The filters' output, in order; without a filter an error, for an empty list nothing."""
    parms = s.dict.get("DecodeParms")
    data, done = s.raw, False
    for name in filter_names(s):
        if name == "FlateDecode":
            data = unpredict(flate(data, limit), parms)
        elif name == "LZWDecode":
            early = parms.get("EarlyChange", 1) if isinstance(parms, dict) else 1
            data = unpredict(lzw(data, early, limit), parms)
        elif name == "ASCII85Decode":
            data = ascii85(data, limit)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data, limit)
        elif name == "RunLengthDecode":
            data = run_length(data, limit)
        else:
            raise PdfError("Unimplemented", name)
        done = True
    return data if done else b""


def plain(s: Stream, limit: int | None = LIMIT) -> bytes:
    """The content without filters; raw if there are none."""
    if not s.dict.get("Filter"):
        _check(len(s.raw), limit)
        return s.raw
    return decoded(s, limit)


def compress(s: Stream, level: int = 9) -> None:
    """Flate, kept only where it saves the bytes of its own entry."""
    if "Filter" not in s.dict:
        small = zlib.compress(s.raw, level)
        if len(small) + 19 < len(s.raw):
            s.raw = small
            s.dict["Filter"] = Name(b"FlateDecode")
            s.dict["Length"] = len(small)


def decompress(s: Stream, limit: int | None = LIMIT) -> None:
    s.raw = decoded(s, limit)
    for k in ("Filter", "DecodeParms"):
        s.dict.pop(k, None)
    s.dict["Length"] = len(s.raw)
