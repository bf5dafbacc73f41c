"""Secret scans with structural confirmation.

Two families of spans come out of a text:

* base: three patterns (assignments of passwords and tokens, access ids, long hex runs), each
  leftmost and without overlaps, kept when long enough;
* confirmed: base64 or hex runs are decoded, and reported only when the bytes are what such a secret
  has to be: a DER private or public key whose nested lengths add up, an OpenSSH key or its wire form
  of length-prefixed fields, a PEM block around such bytes, or a signed token whose header is JSON with
  an algorithm and whose claims are a JSON object. Runs may be wrapped over lines, quoted line by line (source
  code, mail, comments), escaped (JSON, env files) or percent-encoded; hex may be set as colon-separated bytes or byte
  lists; all of it may be base64 once more. A PEM body encrypted under its own headers has no structure left; there the
  headers and whole cipher blocks confirm. Not read: diffs whose lines begin with a bare `+`, keys cut by other words,
  and more than two encodings over each other.

Every block of digits is decoded once a phase and what is known of a place in its bytes is kept, so a text takes linear
time however many starts it holds.

Base spans always stay; confirmed ones are added beside them. Offsets are code points, end exclusive.
Null and empty texts have no spans. Repeated rows get equal results. Every text is scanned whole, and
every run is decoded in full.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.encoded import Block, from_base64
from fleetgauge.llm.tables import add_columns

# The patterns and lengths of the base scan.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
BASE_KINDS = ("assign", "access", "hex")
# Kinds the structure confirms, in the order they are listed after the base kinds.
CONFIRMED_KINDS = ("pem", "der", "ssh", "jwt")

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,100})-----")
_ESCAPED = re.compile(r"(?<!\\)\\++(?:[rn]|(?=[/\s]))|%0[AaDd]")
_QUOTED = re.compile(  # what stands around a line that is quoted in source code, a comment or mail
    r"""\A["'][\x20\t]*+[+,.&;)\\]*+\Z|\A(?:[\x20\t]*+[>\#|*])*+[\x20\t]*+(?:[+,.&][\x20\t]*+(?=["']))?["']?|["'](?:[\x20\t]*+[+,.&;)\\]++)?[\x20\t]*+\Z"""
)
_PERCENT = re.compile(r"%2([BbFf])|%3[Dd]")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):(.*)")
_CIPHER = re.compile(r"[A-Za-z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
# A JSON object begins with a brace and then a quote or white space.
_JWT_HEAD = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.(?=e[wy])")
_JWT_REST = re.compile(r"([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]*+")
_OBJECT = re.compile(r"e(?=[wy])")
# DER starts with a sequence (30): base64 'M', hex '30'. SSH fields start with three zero bytes or the magic.
# Base64 and hex starts count wherever they stand in a run, as '/' and '_' are both base64 and what stands ahead of a key.
_DER_START = re.compile(r"M(?=[A-P][A-Za-z0-9+/_-]{10})")
_SSH_START = re.compile(r"AAAA(?=[B-Za-z0-9+/][A-Za-z0-9+/]{7})|b3BlbnNzaC1rZXktdjEA")
# Base64 of a PEM block, or of base64 that begins as above.
_TWICE_START = re.compile(r"LS0tLS1CRUdJTi|(?:TU[E-Za-z0-9+/]|TV[A-D])(?=[A-Za-z0-9+/]{28})|QUFBQ(?=[A-Za-z0-9+/]{28})|YjNCbGJuTnph")
_PADDING = re.compile(r"(?:=|%3[Dd]){0,2}")
_LEAST_BASE64 = 32
_APART = r"(?::|,?\x20?0[xX]|\\x|\x20)?"  # what may stand between the bytes of a hex list
_HEX_START = re.compile(
    rf"3(?=0(?:{_APART}[0-9A-Fa-f]{{2}}){{8}})|0(?=0(?:{_APART}00){{2}}(?:{_APART}[0-9A-Fa-f]{{2}}){{8}})"
    rf"|6(?=[Ff]{_APART}70{_APART}65{_APART}6[Ee](?:{_APART}[0-9A-Fa-f]{{2}}){{8}})"
)
_SSH_FIELDS = {  # how many fields a public key of each type has
    b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3,
    b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-ed25519", b"sk-ecdsa-sha2-")
_DIGITS = re.compile(r"[A-Za-z0-9+/_-]*+")
_MAGIC = b"openssh-key-v1\0"


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None when it isn't base64."""
    body = "".join(text.split()).rstrip("=")
    if len(body) % 4 == 1 or not _DIGITS.fullmatch(body):
        return None
    return from_base64(body.replace("-", "+").replace("_", "/"))


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the content starts) of the length field at `at`."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    size = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    if size < 0x80 or size >> (8 * (n - 1)) == 0:  # DER takes the shortest form
        return None
    return size, at + 1 + n


def der_items(data: bytes, start: int, end: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, where the content starts, where it ends) of the items that fill data[start:end] exactly, or None."""
    items = []
    while start < end:
        tag = data[start]
        if tag & 0x1F == 0x1F or len(items) == most or (found := der_length(data, start + 1)) is None:
            return None
        size, body = found
        if body + size > end or tag == 0x02 and size == 0:
            return None
        items.append((tag, body, body + size))
        start = body + size
    return items


def der_nests(data: bytes, ranges: list[tuple[int, int]], known: dict) -> bool:
    """Whether items fill all these ranges, at every depth. `known` keeps the answer for each range."""
    above = dict.fromkeys(ranges)
    todo = list(ranges)
    while todo:
        here = todo.pop()
        if known.get(here):
            continue
        items = None if here in known else der_items(data, *here)
        if items is None:
            while here is not None:  # what holds it fails as well
                known[here] = False
                here = above[here]
            return False
        for tag, a, b in items:
            if tag & 0x20 and (a, b) not in above:
                above[a, b] = here
                todo.append((a, b))
    known.update(dict.fromkeys(above, True))
    return True


def is_der_key(data: bytes, start: int = 0, end: int | None = None, known: dict | None = None) -> bool:
    """A sequence that fills data[start:end] and has the items of a key.

    RSA and DSA keys: integers only, at least two (a public key) of which one is long. PKCS8: version,
    algorithm, octets, then attributes and public key; encrypted: algorithm (which begins with its id), octets.
    Public key info: algorithm, bits. EC keys: version, octets, tagged items.
    """
    end = len(data) if end is None else end
    if end - start < 24 or data[start] != 0x30 or (found := der_length(data, start + 1)) is None:
        return False
    size, body = found
    if body + size != end or (items := der_items(data, body, end, 9)) is None:
        return False
    tags = [tag for tag, _, _ in items]
    if tags[:3] == [0x02, 0x30, 0x04]:
        right = all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    elif tags == [0x30, 0x04]:
        right = data[items[0][1]] == 0x06
    elif set(tags) == {0x02}:
        right = len(tags) in (2, 6, 9) and end - start >= 64
    else:
        right = tags == [0x30, 0x03] or tags[:2] == [0x02, 0x04] and all(t in (0xA0, 0xA1) for t in tags[2:])
    nested = [(a, b) for tag, a, b in items if tag & 0x20]
    return right and der_nests(data, nested, {} if known is None else known)


class Fields:
    """Length-prefixed fields in data[:end], each place of a chain of them looked at once."""

    def __init__(self, data: bytes, end: int):
        self.data, self.end = data, end
        self._left: dict[int, tuple[int, bool]] = {}

    def after(self, at: int) -> int | None:
        body = at + 4
        if body > self.end:
            return None
        stop = body + int.from_bytes(self.data[at:body], "big")
        return stop if stop <= self.end else None

    def left(self, at: int) -> tuple[int, bool]:
        """How many fields follow each other from `at` on, and whether the last ends where the data does."""
        path = []
        while at not in self._left:
            path.append(at)
            if (stop := self.after(at)) is None:
                self._left[at] = (0, at == self.end)
                path.pop()
                break
            at = stop
        n, whole = self._left[at]
        for at in reversed(path):
            n += 1
            self._left[at] = (n, whole)
        return self._left[path[0]] if path else (n, whole)

    def skip(self, at: int, count: int) -> int | None:
        """Where `count` fields from `at` on end; a walk is made only when there are as many."""
        if self.left(at)[0] < count:
            return None
        for _ in range(count):
            at = self.after(at)
        return at


def ssh_size(data: bytes, start: int, fields: Fields) -> int | None:
    """Bytes of the SSH key or container at `start` by its own counts; None where they don't say."""
    if data.startswith(_MAGIC, start):
        at = fields.skip(start + len(_MAGIC), 3)  # cipher, derivation, its options
        if at is None or at + 4 > fields.end:
            return None
        keys = int.from_bytes(data[at : at + 4], "big")
        stop = fields.skip(at + 4, keys + 1) if keys else None
        return None if stop is None else stop - start
    first = fields.after(start)
    if first is None or (count := _SSH_FIELDS.get(data[start + 4 : min(first, start + 40)])) is None:
        return None
    stop = fields.skip(start, count)
    return None if stop is None else stop - start


def ssh_fills(data: bytes, start: int, fields: Fields) -> bool:
    """Whether an SSH key or container begins at `start` and its fields end where the data of `fields` does."""
    if data.startswith(_MAGIC, start):
        at = fields.skip(start + len(_MAGIC), 3)
        return at is not None and at + 4 <= fields.end and int.from_bytes(data[at : at + 4], "big") >= 1
    first = fields.after(start)
    if first is None or not data[start + 4 : min(first, start + 40)].startswith(_SSH_TYPES):
        return False
    n, whole = fields.left(start)
    return whole and n >= 2


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH container, or fields that each have a length ahead and fill the bytes."""
    return ssh_fills(data, 0, Fields(data, len(data)))


class Keys:
    """Ends of the keys that begin at given places of a text, in base64 or hex."""

    def __init__(self, text: str, of_hex: bool = False):
        self.text, self.of_hex = text, of_hex
        self._block: Block | None = None
        self._begin = 0

    def _at(self, at: int) -> tuple[Block, int, bytes, int]:
        """Block, number of the digit, bytes and place of the byte at `at`; starts come in ascending order."""
        if self._block is None or not self._begin <= at < self._block.end:
            self._block, self._begin = Block(self.text, at, self.of_hex), at
            self._nests: dict = {}
            self._fields: dict = {}
        index = self._block.index(at)
        return self._block, index, *self._block.bytes_at(index)

    def _chain(self, phase: int, data: bytes, end: int) -> Fields:
        if (phase, end) not in self._fields:
            self._fields[phase, end] = Fields(data, end)
        return self._fields[phase, end]

    def der_end(self, at: int) -> int | None:
        """End of the encoded DER key that begins at `at`; its own length says where that is."""
        block, index, data, start = self._at(at)
        if start + 9 > len(data) or data[start] != 0x30 or not (found := der_length(data, start + 1)):
            return None
        size, body = found
        if body + size > len(data) or body >= len(data) or data[body] not in (0x02, 0x30):
            return None
        if not is_der_key(data, start, body + size, self._nests.setdefault(index % block.group, {})):
            return None
        return block.text_end(block.digit_after(index, body + size - start))

    def ssh_end(self, at: int) -> int | None:
        """End of the encoded SSH key or container that begins at `at`: after its fields, or that of the run they fill."""
        block, index, data, start = self._at(at)
        size = ssh_size(data, start, self._chain(index % block.group, data, len(data)))
        after = None if size is None else block.digit_after(index, size)
        line = block.line_end(at)
        if after is None or line > after:
            size = (line - index) * block.size // block.group
            if block.digit_after(index, size) == line and ssh_fills(data, start, self._chain(index % block.group, data, start + size)):
                after = line
        return None if after is None else block.text_end(after)

    def twice_end(self, at: int) -> tuple[str, int] | None:
        """Kind and end of the key or PEM block that is encoded twice from `at` on."""
        block, index, data, start = self._at(at)
        phase = index % block.group
        if phase not in block.inner:
            found = [s for s in confirmed_spans(data.decode("latin-1"), twice=False) if s[0] != "jwt"]
            block.inner[phase] = {a: (kind, b) for kind, a, b in found}
        if start not in block.inner[phase]:
            return None
        kind, end = block.inner[phase][start]
        return kind, block.text_end(min(block.digit_after(index, end - start), len(block.digits)))


def is_pem_key(label: str, body: str) -> bool:
    """A key in the body of a PEM block: header lines if any, then base64, whose line ends may be escaped."""
    body = _ESCAPED.sub(lambda m: "" if body.startswith("/", m.end()) else "\n", body)
    lines = [x for line in body.splitlines() if (x := _QUOTED.sub("", line.strip()).strip())]
    headers = {}
    while lines and (m := _HEADER.fullmatch(lines[0])):
        headers[m[1].lower()] = m[2].strip()
        lines.pop(0)
    data = decode64(_PERCENT.sub(lambda m: {"b": "+", "f": "/"}.get((m[1] or "").lower(), "="), "".join(lines)))
    if not data:
        return False
    if is_der_key(data) or is_ssh_key(data):
        return True
    cipher = _CIPHER.fullmatch(headers.get("dek-info", ""))
    if not cipher or not label.endswith("PRIVATE KEY") or not headers.get("proc-type", "").endswith("ENCRYPTED"):
        return False
    return len(data) >= 24 and len(data) % 8 == 0


def _is_object(data: bytes, key: str | None = None) -> bool:
    """Whether the bytes are a JSON object, with a text under `key` if one is given."""
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and (key is None or isinstance(found.get(key), str))


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Three base64 parts; header and claims are JSON objects and the header names an algorithm. The header may begin inside a run."""
    out, done = [], 0
    for m in _JWT_HEAD.finditer(text):
        if m.start() < done or not (rest := _JWT_REST.match(text, m.end())) or not (claims := decode64(rest[1])) or not _is_object(claims):
            continue
        head = Block(text[m.start() : m.end() - 1], 0)
        for at in (o.start() for o in _OBJECT.finditer(head.text)):
            data, start = head.bytes_at(at)
            if (len(head.text) - at) % 4 != 1 and len(data) - start >= 8 and data.endswith(b"}", len(data.rstrip()) - 1, len(data.rstrip())) and _is_object(data[start:], "alg"):
                out.append((m.start() + at, rest.end()))
                done = rest.end()
                break
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str, twice: bool = True) -> list[tuple[str, int, int]]:
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            stop, last = text.find("-----", m.end()), f"-----END {m[1]}-----"
            if stop >= 0 and text.startswith(last, stop) and is_pem_key(m[1], text[m.end() : stop]):
                out.append(("pem", m.start(), stop + len(last)))
    blocks = [(a, b) for _, a, b in out]
    for kind, starts in (("der", _DER_START), ("ssh", _SSH_START)):
        keys, done, block = Keys(text), 0, 0
        for m in starts.finditer(text):
            at = m.start()
            while block < len(blocks) and blocks[block][1] <= at:
                block += 1
            if at < done or block < len(blocks) and blocks[block][0] <= at:
                continue  # inside a key or block that is reported as a whole
            end = keys.der_end(at) if kind == "der" else keys.ssh_end(at)
            if end and end - at >= _LEAST_BASE64:
                done = _PADDING.match(text, end).end()
                out.append((kind, at, done))
    keys, done = Keys(text, of_hex=True), 0
    for m in _HEX_START.finditer(text):
        if m.start() >= done:
            kind = "der" if m[0] == "3" else "ssh"
            if end := keys.der_end(m.start()) if kind == "der" else keys.ssh_end(m.start()):
                out.append((kind, m.start(), end))
                done = end
    if twice:
        keys, done = Keys(text), 0
        for m in _TWICE_START.finditer(text):
            if m.start() >= done and (found := keys.twice_end(m.start())):
                done = _PADDING.match(text, found[1]).end()
                out.append((found[0], m.start(), done))
    if ".ey" in text or ".ew" in text:
        out += [("jwt", *span) for span in signed_tokens(text)]
    return out


_RANK = {kind: k for k, kind in enumerate((*BASE_KINDS, *CONFIRMED_KINDS))}


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by start, then kind as listed."""
    text = text or ""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], _RANK[s[0]], s[2]))


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def mask(text: str | None, spans: list[tuple[str, int, int]], by: str = "[secret]") -> str | None:
    """The text with each stretch of overlapping spans replaced."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `secrets`: an array of (kind, start, end) of every text."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        found = [find_secrets(t) for t in batch.column(text).to_pylist()]
        return {"secrets": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]}

    return add_columns(df, work, {"secrets": "array<struct<kind: string, start: long, end: long>>"}, text)


def digest(df: DataFrame) -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, base_sha256, spans` of every row of `documents`."""
    found = scan(df.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    join = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(join(base), 256).alias("base_sha256"), join(F.col("secrets")).alias("spans"),
    )


def masked(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`df` with the secrets of its texts masked and their lengths brought up to date."""
    names = df.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            new = [mask(t, find_secrets(t)) for t in texts]
            columns = dict(zip(names, batch.columns, strict=True))
            columns[text] = pa.array(new, columns[text].type)
            if length in columns:
                kept = columns[length].to_pylist()
                sizes = [n if a == b else len(b) for n, a, b in zip(kept, texts, new, strict=True)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return df.mapInArrow(run, df.schema)


def sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(spans_text([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest()
