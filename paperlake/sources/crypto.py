"""The standard security handler: RC4 and AES-128, opened with the empty user password."""

from __future__ import annotations

import hashlib
import hmac

from paperlake.sources.objects import Hex, Literal, Name, ParseError, Stream, bytes_of, integer

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B) & 255 if x & 128 else x << 1


def _times(x: int, y: int) -> int:
    out = 0
    while y:
        out ^= x if y & 1 else 0
        x, y = _double(x), y >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= _double(p)
        q ^= q << 1
        q ^= q << 2
        q = (q ^ q << 4) & 255
        q ^= 9 if q & 128 else 0
        x = q ^ (q << 1 | q >> 7) ^ (q << 2 | q >> 6) ^ (q << 3 | q >> 5) ^ (q << 4 | q >> 4)
        box[p] = (x ^ 0x63) & 255
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _boxes()
_M = {k: [_times(x, k) for x in range(256)] for k in (9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[list[int]]:
    words, power = [list(key[i : i + 4]) for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = [_BOX[x] for x in w[1:] + w[:1]]
            w[0] ^= power
            power = _double(power)
        words.append([a ^ b for a, b in zip(w, words[-4])])
    return [sum(words[i : i + 4], []) for i in range(0, 44, 4)]


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """AES-128-CBC with the IV in front; padding that isn't right is left in place."""
    keys, out = _round_keys(key), bytearray()
    shift = [(i - 4 * (i % 4)) % 16 for i in range(16)]
    m9, m11, m13, m14 = (_M[k] for k in (9, 11, 13, 14))
    for at in range(16, len(data) - 15, 16):
        s = [a ^ b for a, b in zip(data[at : at + 16], keys[10])]
        for r in range(9, -1, -1):
            s = [_BACK[s[shift[i]]] ^ keys[r][i] for i in range(16)]
            if r:
                s = [v for i in range(0, 16, 4) for a, b, c, d in [s[i : i + 4]] for v in (m14[a] ^ m11[b] ^ m13[c] ^ m9[d], m9[a] ^ m14[b] ^ m11[c] ^ m13[d], m13[a] ^ m9[b] ^ m14[c] ^ m11[d], m11[a] ^ m13[b] ^ m9[c] ^ m14[d])]
        out += bytes(a ^ b for a, b in zip(s, data[at - 16 : at]))
    n = out[-1] if out else 0
    return bytes(out[:-n]) if 1 <= n <= 16 and out[-n:] == bytes([n]) * n else bytes(out)


class Decryptor:
    def __init__(self, entry: dict, first_id: bytes):
        if entry.get(b"Filter") != Name(b"Standard"):
            raise ParseError("this security handler is not supported")
        v, r = integer(entry.get(b"V")), integer(entry.get(b"R"))
        if (v, r) not in ((1, 2), (2, 3), (4, 4)):
            raise ParseError(f"encryption V {v} R {r} is not supported")
        self.aes = v == 4
        owner, user = ((bytes_of(entry.get(k)) or b"").ljust(32, b"\0")[:32] for k in (b"O", b"U"))
        size = 5 if v == 1 else 16 if v == 4 else (integer(entry.get(b"Length")) or 40) // 8
        rights = (integer(entry.get(b"P")) or 0) & 0xFFFFFFFF
        seed = PAD + owner + rights.to_bytes(4, "little") + first_id
        if r >= 4 and entry.get(b"EncryptMetadata") is False:
            seed += b"\xff\xff\xff\xff"
        key = hashlib.md5(seed).digest()
        for _ in range(50 if r >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if r == 2:
            fine = hmac.compare_digest(rc4(self.key, PAD), user)
        else:
            made = rc4(self.key, hashlib.md5(PAD + first_id).digest())
            for i in range(1, 20):
                made = rc4(bytes(k ^ i for k in self.key), made)
            fine = hmac.compare_digest(made, user[:16])
        if not fine:
            raise ParseError("a password is needed")

    def bytes(self, data: bytes, num: int, gen: int) -> bytes:
        seed = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if self.aes else b"")
        key = hashlib.md5(seed).digest()[: min(len(self.key) + 5, 16)]
        return aes_cbc(key, data) if self.aes else rc4(key, data)

    def value(self, value, num: int, gen: int):
        """The object with strings and streams decrypted; strings come out as hexadecimal ones."""
        if isinstance(value, (Literal, Hex)):
            return Hex(self.bytes(bytes_of(value) or b"", num, gen).hex().encode())
        if isinstance(value, list):
            return [self.value(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self.value(v, num, gen) for k, v in value.items()}
        if isinstance(value, Stream):
            if value.dict.get(b"Type") == Name(b"XRef"):
                return value
            return Stream(self.value(value.dict, num, gen), self.bytes(value.data, num, gen))
        return value
