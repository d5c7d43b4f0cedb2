"""Plain versions of the contracts, for small tables."""

import hashlib
import re

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_sha(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()


def removed(texts, n=50):
    """For each (doc_id, text): the bytes covered by an n-byte string that also starts in a document with a smaller id."""
    least = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        out.append((i, b, gone))
    return out


def removal_row(i, b, gone):
    kept = bytes(x for x, g in zip(b, gone) if not g)
    spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
    return i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
