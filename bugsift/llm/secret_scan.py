r"""Secret scans with structural confirmation.

Two layers of spans, in code points with an exclusive end:

* base patterns (fixed rules, see ``ASSIGN``, ``ACCESS``, ``HEX``): leftmost
  non-overlapping matches per kind, those too short dropped;
* confirmed structures: runs that look like base64, hexadecimal, armoured keys
  or dotted tokens are decoded, and reported only when what they decode to
  parses: ``key`` (DER private keys of the PKCS#1, PKCS#8, SEC1 and DSA forms
  with nested lengths that add up, OpenSSH private keys, armoured keys) and
  ``token`` (signed or encrypted tokens whose header is an object naming an
  algorithm).

Null and empty texts have no spans; repeated rows are scanned like any other;
whole texts are scanned, whatever their length. Columns of other names are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_chunks

# The base patterns; letters of the first in either case (ASCII).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")      # maximal runs, so the same as runs of 32 or more
KINDS = ("assign", "access", "hex", "key", "token")

MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
B64_RUN = re.compile(r"[A-Za-z0-9+/_-]{44,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
# The first part of a dotted token ends a run before a dot; exactly 2 or 4 parts follow.
HEADER = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+(?=\.)")
PARTS = [re.compile(r"(?:\.[A-Za-z0-9_-]*+){%d}" % n) for n in (2, 4)]
OBJECT = re.compile(rb"\{\s*\"")
ESCAPED_BREAK = re.compile(r"\\+(?:[nrt]|u000[9AaDd]|(?=[\r\n]))")
ESCAPED_SLASH = re.compile(r"\\+/")
# What stands between the literals of a concatenated string, and before the lines of a quoted one.
LITERALS = re.compile(r"""["'`][ \t]*+[+.,&\\]*+\s*+["'`]""")
QUOTED = re.compile(r"[ \t>|#*]*+(?://[ \t]++(?=\S))?")
# Base64 of 0x30 and a length byte below 0x90: where a DER key may start inside a run.
DER_START = re.compile(r"(?=M[C-I])")
# A text none of these (RE2) matches has no span of any kind.
MAY_HAVE = (r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{32}|[A-Za-z0-9+/_-]{44}"
            r"|(?:[0-9A-Fa-f]{2}){32}|-----BEGIN |ey[A-Za-z0-9_-]{8,}\.")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def from_base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER items whose lengths fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at:at + k], "big")
            if n < 0x80:
                return None
            at += k
        if at + n > len(data):
            return None
        out.append((tag, data[at:at + n]))
        at += n
    return out


def der_size(data: bytes) -> int:
    """Bytes of the DER sequence that ``data`` starts with, by its stated length
    (up to two length bytes); 0 if it holds no version number or sequence first."""
    if len(data) < 24 or data[0] != 0x30:
        return 0
    k = data[1] & 0x7F if data[1] & 0x80 else 0
    if k > 2:
        return 0
    size = 2 + k + (int.from_bytes(data[2:2 + k], "big") if k else data[1])
    return size if 24 <= size <= len(data) and data[2 + k] in (0x02, 0x30) else 0


def der_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key (plain or encrypted)."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(top[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 0x02 and len(parts[0][1]) == 1 and parts[0][1][0] <= 3:
        if len(parts) in (6, 9, 10) and all(t == 0x02 for t in tags[:9]):
            return True                                        # PKCS#1, DSA
        if parts[0][1] == b"\x01" and tags[1] == 0x04 and 16 <= len(parts[1][1]) <= 72:
            return True                                        # SEC1
        if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            inner = der_items(parts[1][1])                     # PKCS#8
            return bool(inner and inner[0][0] == 0x06 and der_items(parts[2][1]))
        return False
    if tags[0] == 0x30 and tags[1] == 0x04 and len(parts) == 2:
        inner = der_items(parts[0][1])                         # encrypted PKCS#8
        return bool(inner and inner[0][0] == 0x06 and len(inner) >= 2)
    return False


def openssh_private_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic and nested lengths."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at:at + 4], "big")
        got = data[at + 4:at + 4 + n]
        at += 4 + n
        return got if len(got) == n else None

    if any(field() is None for _ in range(3)):
        return False
    at += 4                                                    # number of keys
    return field() is not None and bool(field())


def is_key(data: bytes | None, deep: bool = True) -> bool:
    if not data or len(data) < 24:
        return False
    if data[0] == 0x30 and der_private_key(data) or openssh_private_key(data):
        return True
    if deep and b"-----BEGIN " in data[:64]:
        return any(armoured(body) for _, _, body in armours(data.decode("latin-1")))
    return False


def armours(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) between each END mark and the last BEGIN mark before it,
    if their labels agree: an unclosed or merely mentioned header ends nothing.
    One scan over the marks."""
    opened = None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened is not None and opened[2] == m[2]:
            yield opened.start(), m.end(), text[opened.end():m.start()]
            opened = None


def armoured(body: str) -> bool:
    """Whether an armoured key's body decodes to a key. In JSON and env strings
    line breaks (and slashes) are written with backslashes, in source code lines
    are literals put together, in mails and comments lines carry a prefix. Header
    lines are left out; a body without structure of its own is a key only below
    the two headers of an encrypted one, in whole cipher blocks."""
    plain = LITERALS.sub("\n", ESCAPED_SLASH.sub("/", ESCAPED_BREAK.sub("\n", body)))
    # the END mark's own line may carry a prefix too: padding stands for the mark
    lines = [x[QUOTED.match(x).end():] for x in (plain + "=").splitlines()]
    packed = "".join("".join(x.split()) for x in lines if ":" not in x)
    data = from_base64(packed) if packed else None
    if not data:
        return False
    sealed = (any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines)
              and any(x.startswith("DEK-Info:") for x in lines))
    return sealed and len(data) >= 24 and len(data) % 8 == 0 or is_key(data, deep=False)


def inner_key(run: str) -> tuple[int, int] | None:
    """(start, end) of the first DER key that starts inside a base64 run with
    something glued before it, or after it. Starts at offsets of one remainder by
    4 share their decoding; a start is read no further than the length it states."""
    decoded: dict[int, tuple[int, memoryview]] = {}
    body = run.rstrip("=")
    for m in DER_START.finditer(body):
        at = m.start()
        if at % 4 not in decoded:
            own = body[at:]
            decoded[at % 4] = at, memoryview(from_base64(own[:-1] if len(own) % 4 == 1 else own) or b"")
        first, data = decoded[at % 4]
        data = data[(at - first) // 4 * 3:]
        size = der_size(data)
        if size and der_private_key(data[:size]):
            end = at + -(-size * 4 // 3)
            while end < len(run) and run[end] == "=":
                end += 1
            return at, end
    return None


def json_object(data: bytes | None) -> dict:
    try:
        got = json.loads(data or b"")
    except (ValueError, RecursionError):
        return {}
    return got if isinstance(got, dict) else {}


def headers(run: str) -> Iterator[tuple[int, dict]]:
    """(offset, object) of the ends of a run that are a token header: they start
    with ``ey`` and decode to an object naming ``alg``. A run may hold more before
    its header ('id_', '-', the n of an escaped line break). Ends at offsets of one
    remainder by 4 share their decoding."""
    decoded = {}
    for m in re.finditer("ey", run):
        at = m.start()
        if len(run) - at < 10:
            break
        if at % 4 not in decoded:
            data = from_base64(run[at:])
            decoded[at % 4] = at, data if data and data.rstrip().endswith(b"}") else b""
        first, data = decoded[at % 4]
        k = (at - first) // 4 * 3
        if OBJECT.match(data, k):
            head = json_object(data[k:])
            if isinstance(head.get("alg"), str):
                yield at, head


def token_spans(text: str) -> list[tuple[int, int]]:
    """Dotted tokens: 3 parts with a header naming ``alg`` and an object as
    payload, or else 5 parts whose header also names ``enc``. What follows them,
    dots included, is not part of them."""
    out, end = [], 0
    for m in HEADER.finditer(text):
        if m.start() < end:
            continue
        three, five = (p.match(text, m.end()) for p in PARTS)
        for at, head in headers(m[0]) if three else ():
            if json_object(from_base64(three[0].split(".")[1])):
                end = three.end()
            elif five and isinstance(head.get("enc"), str):
                end = five.end()
            else:
                continue
            out.append((m.start() + at, end))
            break
    return out


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret value) of the base patterns."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start) of candidates that decode to a key or a token."""
    taken = [(a, b) for a, b, body in armours(text) if armoured(body)]
    for pattern, decode in ((B64_RUN, from_base64), (HEX_RUN, bytes.fromhex)):
        before, k = sorted(taken), 0
        for m in pattern.finditer(text):
            while k < len(before) and before[k][1] <= m.start():
                k += 1
            if k < len(before) and before[k][0] <= m.start():
                continue
            if is_key(decode(m[0])):
                taken.append((m.start(), m.end()))
            elif pattern is B64_RUN and (part := inner_key(m[0])):
                taken.append((m.start() + part[0], m.start() + part[1]))
    out = [(a, 3, b, a) for a, b in taken]
    out += [(a, 4, b, a) for a, b in token_spans(text)]
    return sorted(set(out))


def written(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _suspects(text: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(text, MAY_HAVE).to_numpy(zero_copy_only=False))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed) per row."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches):
            n = len(text)
            counts = np.zeros((4, n), np.int64)
            sha, spans = [EMPTY_SHA] * n, [""] * n
            for r in _suspects(text):
                t = text[int(r)].as_py()
                base, more = base_spans(t), confirmed_spans(t)
                for s in base:
                    counts[s[1], r] += 1
                counts[3, r] = len(more)
                sha[r] = hashlib.sha256(written(base).encode()).hexdigest()
                spans[r] = written(sorted(base + more))
            yield pa.RecordBatch.from_arrays(
                [cols[0], *(pa.array(c) for c in counts[:3]), pa.array(sha, pa.string()),
                 pa.array(spans, pa.string()), pa.array(counts[3])],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        go, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
            "spans string, n_confirmed long")


def masked(text: str, mark: str) -> str:
    """The text with every secret value replaced by ``mark``; overlapping values once."""
    spans = sorted((a, b) for _, _, b, a in base_spans(text) + confirmed_spans(text))
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with secret values in the text masked; a null
    text stays null."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for cols, text in text_chunks(iter([b]), text=at):
                hit = _suspects(text)
                if len(hit):
                    own = cols[at].to_pylist()
                    for r in hit:
                        own[r] = masked(own[r], mark)
                    cols[at] = pa.array(own, pa.string())
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if k == at else c for k, c in enumerate(cols)],
                                                 names)

    return docs.mapInArrow(go, docs.schema)
