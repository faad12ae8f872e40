"""Ed25519 signatures in plain Python, as the public standard defines them, for checking inside Arrow UDFs."""

from __future__ import annotations

import hashlib

# The curve's field, group order and base point.
P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (not x and odd):
        return None
    return P - x if x & 1 != odd else x


_BY = 4 * pow(5, P - 2, P) % P
_BX = _x_of(_BY, 0)
BASE = (_BX, _BY, 1, _BX * _BY % P)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p):
    q = (0, 1, 1, 0)
    while n:
        if n & 1:
            q = _add(q, p)
        p, n = _add(p, p), n >> 1
    return q


def _packed(p) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpacked(b: bytes):
    n = int.from_bytes(b, "little")
    y = n & ((1 << 255) - 1)
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _halves(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return (int.from_bytes(h[:32], "little") & ((1 << 254) - 8)) | 1 << 254, h[32:]


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def public_key(secret: bytes) -> bytes:
    return _packed(_times(_halves(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _halves(secret)
    public = _packed(_times(a, BASE))
    r = _hash(prefix, message)
    big_r = _packed(_times(r, BASE))
    return big_r + ((r + _hash(big_r, public, message) * a) % L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpacked(public), _unpacked(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(signature[:32], public, message), a))
    return not (left[0] * right[2] - right[0] * left[2]) % P and not (left[1] * right[2] - right[1] * left[2]) % P
