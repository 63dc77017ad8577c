"""RC4, AES and the standard security handler's keys, without libraries."""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np

from .syntax import Name, PdfError, Ref, Stream, Str, parse_value, write_value

#: Fixed value: the padding of passwords up to revision 4.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


#: RC4 outputs that are kept: bytes of one at most, and of all with so many for each one's place.
KEPT_EACH, KEPT_ALL, KEPT_PLACE = 1 << 16, 16 << 20, 256
_kept: dict[bytes, bytes] = {}
_kept_size = 0


def _rc4_output(key: bytes, n: int) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        v = s[i]
        j = (j + v + key[i % len(key)]) & 255
        s[i], s[j] = s[j], v
    j, out = 0, bytearray(n)
    for k in range(n):
        i = (k + 1) & 255
        v = s[i]
        j = (j + v) & 255
        w = s[i] = s[j]
        s[j] = v
        out[k] = s[(v + w) & 255]
    return bytes(out)


def rc4(key: bytes, data: bytes) -> bytes:
    """What is added to the data depends on the key alone, and files of one producer share their keys, so it is kept."""
    global _kept_size
    n = len(data)
    out = _kept.get(key, b"")
    if len(out) < n:
        fresh = _rc4_output(key, -(-n // 64) * 64)
        if n <= KEPT_EACH:
            _kept_size += len(fresh) - len(out) + (0 if out else KEPT_PLACE)
            _kept[key] = fresh
            while _kept_size > KEPT_ALL:
                _kept_size -= len(_kept.pop(next(iter(_kept)))) + KEPT_PLACE
        out = fresh
    return (int.from_bytes(data, "little") ^ int.from_bytes(out[:n], "little")).to_bytes(n, "little")


def _xtime(a):
    return ((a << 1) ^ np.where(a & 128, 0x1B, 0)) & 255


def _boxes():
    """S-box from inverses in GF(256) and the affine map."""
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 128 else 0)
        x &= 255
    exp[255:510] = exp[:255]
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inv = exp[255 - log[v]] if v else 0
        r = 0x63
        for k in range(5):
            r ^= (inv << k | inv >> (8 - k)) & 255
        box[v] = r
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back


SBOX, UNBOX = _boxes()
_SHIFT = np.array([(4 * ((c + r) % 4)) + r for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


def _mul(a: np.ndarray, n: int) -> np.ndarray:
    out, p = np.zeros_like(a), a
    while n:
        if n & 1:
            out = out ^ p
        p = _xtime(p)
        n >>= 1
    return out


def _round_keys(key: bytes) -> np.ndarray:
    n, words, rcon = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(SBOX[b]) for b in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = (rcon << 1) ^ (0x11B if rcon & 128 else 0)
        elif n > 6 and i % n == 4:
            w = [int(SBOX[b]) for b in w]
        words.append([a ^ b for a, b in zip(w, words[i - n], strict=True)])
    return np.array(words, np.int64).reshape(-1, 16)


def _mix(s: np.ndarray, m: tuple[int, int, int, int]) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    return np.stack([_mul(c[..., r], m[0]) ^ _mul(c[..., (r + 1) % 4], m[1]) ^ _mul(c[..., (r + 2) % 4], m[2]) ^ _mul(c[..., (r + 3) % 4], m[3]) for r in range(4)], -1).reshape(-1, 16)


def _encrypt_blocks(keys: np.ndarray, s: np.ndarray) -> np.ndarray:
    s = s ^ keys[0]
    for k in range(1, len(keys)):
        s = SBOX[s].astype(np.int64)[:, _SHIFT]
        if k < len(keys) - 1:
            s = _mix(s, (2, 3, 1, 1))
        s = s ^ keys[k]
    return s


def _decrypt_blocks(keys: np.ndarray, s: np.ndarray) -> np.ndarray:
    for k in range(len(keys) - 1, 0, -1):
        s = s ^ keys[k]
        if k < len(keys) - 1:
            s = _mix(s, (14, 11, 13, 9))
        s = UNBOX[s[:, _UNSHIFT]].astype(np.int64)
    return s ^ keys[0]


def _blocks(data: bytes) -> np.ndarray:
    if len(data) % 16:
        raise PdfError("Decryption", "length isn't a multiple of 16")
    return np.frombuffer(data, np.uint8).astype(np.int64).reshape(-1, 16)


def _columns() -> list[list[int]]:
    """A byte's share of an encrypted column by row: S-box and column mixing in one lookup."""
    out: list[list[int]] = [[], [], [], []]
    for v in SBOX.tolist():
        two = (v << 1 ^ (0x1B if v & 128 else 0)) & 255
        word = bytes([two, v, v, two ^ v])
        for r in range(4):
            out[r].append(int.from_bytes(word[-r:] + word[:-r] if r else word, "big"))
    return out


_COLUMNS = _columns()
_SBOX = SBOX.tolist()


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Blocks follow each other, so each is a few lookups in plain integers."""
    if len(data) % 16:
        raise PdfError("Decryption", "length isn't a multiple of 16")
    keys = [[int.from_bytes(bytes(row[i : i + 4]), "big") for i in (0, 4, 8, 12)] for row in _round_keys(key).astype(np.uint8).tolist()]
    t0, t1, t2, t3 = _COLUMNS
    last, out = int.from_bytes(iv, "big"), []
    for at in range(0, len(data), 16):
        x = int.from_bytes(data[at : at + 16], "big") ^ last
        k = keys[0]
        a, b, c, d = x >> 96 ^ k[0], (x >> 64 & 0xFFFFFFFF) ^ k[1], (x >> 32 & 0xFFFFFFFF) ^ k[2], (x & 0xFFFFFFFF) ^ k[3]
        for k in keys[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        k, s, last = keys[-1], _SBOX, 0
        for i, (p, q, r, u) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
            last = last << 32 | (s[p >> 24] << 24 | s[q >> 16 & 255] << 16 | s[r >> 8 & 255] << 8 | s[u & 255]) ^ k[i]
        out.append(last.to_bytes(16, "big"))
    return b"".join(out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """All blocks at once."""
    if not data:
        return b""
    b = _blocks(data)
    return (_decrypt_blocks(_round_keys(key), b) ^ np.concatenate([_blocks(iv), b[:-1]])).astype(np.uint8).tobytes()


def aes_ecb_encrypt(key: bytes, data: bytes) -> bytes:
    return _encrypt_blocks(_round_keys(key), _blocks(data)).astype(np.uint8).tobytes()


def aes_ecb_decrypt(key: bytes, data: bytes) -> bytes:
    return _decrypt_blocks(_round_keys(key), _blocks(data)).astype(np.uint8).tobytes()


def pad(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpad(data: bytes) -> bytes:
    n = data[-1] if data else 0
    if not 1 <= n <= 16 or data[-n:] != bytes([n]) * n:
        raise PdfError("Decryption", "padding")
    return data[:-n]


def saslprep(password: str) -> bytes:
    import stringprep
    import unicodedata

    mapped = "".join(" " if stringprep.in_table_c12(c) else c for c in password if not stringprep.in_table_b1(c))
    return unicodedata.normalize("NFKC", mapped).encode()[:127]


def prepare(password: str | bytes, revision: int) -> bytes:
    if isinstance(password, bytes):
        return password[: 32 if revision < 5 else 127]
    if revision >= 5:
        return saslprep(password)
    from .encodings import encode_table

    return encode_table("PDFDocEncoding", password)[:32]


def hash_r5(revision: int, password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision == 5:
        return k
    i = 0
    while True:
        block = (password + k + user) * 64
        e = aes_cbc_encrypt(k[:16], k[16:32], block)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    """Keys and filters of one document. v: 1, 2, 4 or 5; r: the revision."""

    def __init__(self, v: int, r: int, key: bytes, entries: dict, stream: str, string: str, filters: dict[str, str], metadata: bool = True):
        self.v, self.r, self.key, self.entries = v, r, key, entries
        self.stream, self.string, self.filters, self.metadata = stream, string, filters, metadata

    @classmethod
    def create(cls, v: int, owner: str, user: str, permissions: int = -4, bits: int = 128, doc_id: bytes = b"", metadata: bool = True, revision: int | None = None, random=os.urandom) -> Security:
        r = revision or {1: 2, 2: 3, 4: 4, 5: 6}[v]
        n = 5 if v == 1 else 32 if v == 5 else 16 if v == 4 else bits // 8
        p = (permissions | -3904 if r > 2 else permissions | -64) & ~3
        e: dict = {"Filter": Name(b"Standard"), "V": v, "R": r, "Length": n * 8, "P": p}
        o, u = prepare(owner or user, r), prepare(user, r)
        if v < 5:
            e["O"] = Str(_owner_value(o, u, r, n), hex=True)
            key = _file_key(u, bytes(e["O"]), p, doc_id, r, n, metadata)
            e["U"] = Str(_user_value(key, doc_id, r), hex=True)
        else:
            key = random(32)
            us, uk, os_, ok = (random(8) for _ in range(4))
            e["U"] = Str(hash_r5(r, u, us) + us + uk, hex=True)
            e["UE"] = Str(aes_cbc_encrypt(hash_r5(r, u, uk), bytes(16), key), hex=True)
            e["O"] = Str(hash_r5(r, o, os_, bytes(e["U"])) + os_ + ok, hex=True)
            e["OE"] = Str(aes_cbc_encrypt(hash_r5(r, o, ok, bytes(e["U"])), bytes(16), key), hex=True)
            e["Perms"] = Str(aes_ecb_encrypt(key, (p & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + (b"T" if metadata else b"F") + b"adb" + random(4)), hex=True)
        filters, name = {}, "Identity"
        if v >= 4:
            name = "StdCF"
            filters = {"StdCF": "AESV2" if v == 4 else "AESV3"}
            e |= {"CF": {"StdCF": {"Type": Name(b"CryptFilter"), "CFM": Name(filters["StdCF"].encode()), "AuthEvent": Name(b"DocOpen"), "Length": n}}, "StmF": Name(b"StdCF"), "StrF": Name(b"StdCF")}
            e["EncryptMetadata"] = metadata
        return cls(v, r, key, e, name, name, filters, metadata)

    @classmethod
    def open(cls, e: dict, doc_id: bytes, password: str | bytes) -> Security:
        """Checks the password as user, then as owner. The answer is kept: a producer's files share their entries."""
        got = _opened(cls, write_value(e), doc_id, password)
        if isinstance(got, PdfError):
            raise PdfError(got.code, got.detail)
        return got

    @classmethod
    def _open(cls, e: dict, doc_id: bytes, password: str | bytes) -> Security:
        if e.get("Filter") != Name(b"Standard"):
            raise PdfError("Decryption", "UnsupportedSecurityHandler")
        v, r, p = e.get("V", 0), e.get("R"), e.get("P")
        if v not in (1, 2, 4, 5) or not isinstance(r, int) or not isinstance(p, int):
            raise PdfError("Decryption", "UnsupportedVersion")
        bits = e.get("Length", 256 if v == 5 else 128) if v != 1 else 40
        if bits % 8 or bits < 40:
            raise PdfError("Decryption", "InvalidKeyLength")
        n = 5 if v == 1 else 16 if v == 4 else 32 if v == 5 else bits // 8
        metadata = e.get("EncryptMetadata", True) is not False
        o, u = bytes(e.get("O", b"")), bytes(e.get("U", b""))
        pw = prepare(password, r)
        key = None
        if r <= 4:
            for attempt in (pw, _user_of(pw, o, r, n)):
                k = _file_key(attempt, o, p, doc_id, r, n, metadata)
                if _user_value(k, doc_id, r)[: 16 if r > 2 else 32] == u[: 16 if r > 2 else 32]:
                    key = k
                    break
        else:
            o, u = o[:48], u[:48]
            if hash_r5(r, pw, o[32:40], u) == o[:32]:
                key = aes_cbc_decrypt(hash_r5(r, pw, o[40:48], u), bytes(16), bytes(e["OE"]))
            elif hash_r5(r, pw, u[32:40]) == u[:32]:
                key = aes_cbc_decrypt(hash_r5(r, pw, u[40:48]), bytes(16), bytes(e["UE"]))
                perms = aes_ecb_decrypt(key, bytes(e["Perms"]))
                if perms[9:12] != b"adb" or perms[:3] != (p & 0xFFFFFFFF).to_bytes(4, "little")[:3]:
                    raise PdfError("Decryption", "InvalidPermissions")
        if key is None:
            raise PdfError("Decryption", "IncorrectPassword")
        name = lambda k: e[k].decode("latin-1") if isinstance(e.get(k), Name) else "Identity"
        filters = {}
        for k, f in (e.get("CF") or {}).items():
            m = f.get("CFM").decode("latin-1") if isinstance(f, dict) and isinstance(f.get("CFM"), Name) else ""
            if m in ("V2", "AESV2", "AESV3", "None", "Identity"):
                filters[k] = m
        return cls(v, r, key, e, name("StmF"), name("StrF"), filters, metadata)

    def method(self, name: str) -> str:
        """A filter that isn't listed falls back to RC4."""
        return self.filters.get(name, "V2")

    def _object_key(self, ref: Ref, method: str) -> bytes:
        if method == "AESV3":
            return self.key
        k = self.key + ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(4, "little")[:2] + (b"sAlT" if method == "AESV2" else b"")
        return hashlib.md5(k).digest()[: min(len(self.key) + 5, 16)]

    def encrypt(self, ref: Ref, data: bytes, method: str, random=os.urandom) -> bytes:
        if method in ("None", "Identity"):
            return data
        k = self._object_key(ref, method)
        if method == "V2":
            return rc4(k, data)
        iv = random(16)
        return iv + aes_cbc_encrypt(k, iv, pad(data))

    def decrypt(self, ref: Ref, data: bytes, method: str) -> bytes:
        if method in ("None", "Identity") or not data:
            return data
        k = self._object_key(ref, method)
        return rc4(k, data) if method == "V2" else unpad(aes_cbc_decrypt(k, data[:16], data[16:]))

    def walk(self, ref: Ref, v, turn, skip_metadata: bool = True):
        """The value with ``turn(ref, bytes, method)`` on its strings and stream."""
        strings = self.method(self.string)
        if isinstance(v, Str):
            return Str(turn(ref, bytes(v), strings), v.hex)
        if isinstance(v, list):
            return [self.walk(ref, x, turn) for x in v]
        if isinstance(v, dict):
            return {k: self.walk(ref, x, turn) for k, x in v.items()}
        if isinstance(v, Stream):
            t = v.dict.get("Type")
            if t == Name(b"XRef") or t == Name(b"Metadata") and not self.metadata:
                return v
            method = self.method(self.stream)
            f = v.dict.get("Filter")
            if f == Name(b"Crypt") or isinstance(f, list) and Name(b"Crypt") in f:
                parms = v.dict.get("DecodeParms")
                name = parms.get("Name") if isinstance(parms, dict) else None
                method = self.method(name.decode("latin-1")) if isinstance(name, Name) and name != b"Identity" else "Identity"
            return Stream(self.walk(ref, v.dict, turn), turn(ref, v.raw, method), v.allows_compression, v.start)
        return v


@lru_cache(256)
def _opened(cls, entries: bytes, doc_id: bytes, password: str | bytes) -> Security | PdfError:
    try:
        return cls._open(parse_value(entries)[0], doc_id, password)
    except PdfError as x:
        return x.with_traceback(None)


def _rounds(key: bytes, data: bytes, order) -> bytes:
    for i in order:
        data = rc4(bytes(b ^ i for b in key), data)
    return data


def _owner_key(password: bytes, r: int, n: int) -> bytes:
    k = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if r > 2 else 0):
        k = hashlib.md5(k).digest()
    return k[:n]


def _owner_value(owner: bytes, user: bytes, r: int, n: int) -> bytes:
    return _rounds(_owner_key(owner, r, n), (user + PAD)[:32], range(20 if r > 2 else 1))


def _user_of(owner: bytes, value: bytes, r: int, n: int) -> bytes:
    return _rounds(_owner_key(owner, r, n), value[:32], range(19 if r > 2 else 0, -1, -1))


def _file_key(user: bytes, owner_value: bytes, p: int, doc_id: bytes, r: int, n: int, metadata: bool) -> bytes:
    k = hashlib.md5((user + PAD)[:32] + owner_value[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + doc_id + (b"\xff" * 4 if r >= 4 and not metadata else b"")).digest()
    for _ in range(50 if r > 2 else 0):
        k = hashlib.md5(k[:n]).digest()
    return k[:n]


def _user_value(key: bytes, doc_id: bytes, r: int) -> bytes:
    if r == 2:
        return rc4(key, PAD)
    return _rounds(key, hashlib.md5(PAD + doc_id).digest(), range(20)) + bytes(16)


# Bits of the permission flags.
PERMISSIONS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill": 256, "accessible": 512, "assemble": 1024, "print_high_quality": 2048}
