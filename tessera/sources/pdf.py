"""Texts of the pages of plain PDF files: objects, compressed streams, the page tree, and the operators that show text.

Files that are encrypted, whose streams use other filters than Flate, or without a page tree raise ValueError, which sends them
to the dead letters. Characters come from a font's ToUnicode map, else from its encoding's Latin range; layout is line by line.
"""

from __future__ import annotations

import re
import zlib

PDF_MAGIC = b"%PDF-"
#: A stream that unpacks to more isn't read.
MOST_BYTES = 256 << 20
_TOKEN = re.compile(rb"""%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|<[0-9A-Fa-f\s]*>|\(|[^\s<>\[\]()/%{}]+""")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """/Name"""


class Ref(int):
    """A reference to the object of this number."""


class Word(str):
    """An operator, or obj, stream, true, null and the like."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """The literal string that begins after `(` at `at`, and where it ends."""
    out, depth = bytearray(), 1
    while True:
        m = re.compile(rb"[^()\\]*").match(raw, at)
        out += m[0]
        at = m.end()
        c = raw[at : at + 1]
        if not c:
            return bytes(out), at
        if c == b"\\":
            n = raw[at + 1 : at + 2]
            if o := re.compile(rb"[0-7]{1,3}").match(raw, at + 1):
                out.append(int(o[0], 8) & 255)
                at = o.end()
                continue
            if n not in b"\r\n" or not n:
                out += _ESCAPES.get(n, n)
            at += 3 if raw[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += 1 if c == b"(" else -1
        at += 1
        if not depth:
            return bytes(out), at
        out += c


def tokens(raw: bytes, at: int = 0):
    """Values and words from `at` on, each with where it ends; dictionaries and arrays whole."""
    stack: list[tuple[bytes, list]] = []
    while m := _TOKEN.search(raw, at):
        t, at = m[0], m.end()
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append((t, []))
            continue
        if t in (b">>", b"]"):
            if not stack:
                continue
            kind, items = stack.pop()
            value = items if kind == b"[" else dict(zip(items[::2], items[1::2], strict=False))
        elif t == b"(":
            value, at = _string(raw, at)
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1"))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif re.fullmatch(rb"[+-]?\d+", t):
            value = int(t)
        elif re.fullmatch(rb"[+-]?\d*\.\d*", t) and t.strip(b"+-.") != b"":
            value = float(t)
        else:
            value = Word(t.decode("latin-1"))
        items = stack[-1][1] if stack else None
        if value == "R" and isinstance(value, Word) and items and len(items) >= 2 and all(type(x) is int for x in items[-2:]):
            items[-2:] = [Ref(items[-2])]
        elif items is not None:
            items.append(value)
        else:
            yield value, at


class Document:
    """The objects of a file, by number. Later ones replace earlier ones, as updates do."""

    def __init__(self, raw: bytes) -> None:
        if not raw.startswith(PDF_MAGIC):
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise ValueError("an encrypted PDF")
        self.raw, self.objects, self.streams = raw, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", raw):
            value, end = next(tokens(raw, m.end()), (None, m.end()))
            self.objects[int(m[1])] = value
            self.streams.pop(int(m[1]), None)
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream(\r\n|\n|\r)").match(raw, end)):
                self.streams[int(m[1])] = s.end()
        for number in [n for n in self.streams if self.objects[n].get("Type") == "ObjStm"]:
            body, head = self.stream(number), self.objects[number]
            first = self.value(head["First"])
            pairs = [v for v, _ in tokens(body[:first])]
            for k, at in zip(pairs[::2], pairs[1::2], strict=False):
                self.objects.setdefault(k, next(tokens(body, first + at), (None, 0))[0])

    def value(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def stream(self, number: int) -> bytes:
        head, at = self.objects[number], self.streams[number]
        n = self.value(head.get("Length"))
        end = at + n if isinstance(n, int) and re.compile(rb"\s*endstream").match(self.raw, at + n) else self.raw.find(b"endstream", at)
        body = self.raw[at:end]
        filters = self.value(head.get("Filter")) or []
        for f in [filters] if isinstance(filters, Name) else map(self.value, filters):
            if f not in ("FlateDecode", "Fl"):
                raise ValueError(f"a stream with filter {f}")
            d = zlib.decompressobj()
            body = d.decompress(body, MOST_BYTES)
            if d.unconsumed_tail:
                raise ValueError(f"a stream of over {MOST_BYTES} bytes")
        return body

    def pages(self) -> list[tuple[dict, dict]]:
        """(page, its resources) in the order of the page tree."""
        root = next((self.value(o.get("Pages")) for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(root, dict):
            raise ValueError("a PDF without a page tree")
        out, seen, todo = [], set(), [(root, {})]
        while todo:
            node, resources = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = self.value(node.get("Resources")) or resources
            kids = self.value(node.get("Kids"))
            if kids is None:
                out.append((node, resources))
            else:
                todo += [(self.value(k), resources) for k in reversed(kids)]
        return out

    def contents(self, page: dict) -> bytes:
        c = page.get("Contents")
        items = c if isinstance(c, list) else self.value(c) if isinstance(self.value(c), list) else [c]
        return b"\n".join(self.stream(int(x)) for x in items if isinstance(x, Ref) and int(x) in self.streams)


def _unicode_map(body: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code -> text) of a ToUnicode map."""
    width, found = 1, {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, part in re.findall(rb"begin(codespacerange|bfchar|bfrange)(.*?)end\1", body, re.S):
        values = [v for v, _ in tokens(part)]
        if kind == b"codespacerange" and values:
            width = len(values[0])
        elif kind == b"bfchar":
            found |= {int.from_bytes(a, "big"): text(b) for a, b in zip(values[::2], values[1::2], strict=False)}
        elif kind == b"bfrange":
            for lo, hi, to in zip(values[::3], values[1::3], values[2::3], strict=False):
                a, z = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                for i in range(a, min(z, a + 65_535) + 1):
                    found[i] = text(to[i - a]) if isinstance(to, list) and i - a < len(to) else text(to[:-2] + (int.from_bytes(to[-2:], "big") + i - a).to_bytes(2, "big")) if isinstance(to, bytes) else ""
    return width, found


class _Page:
    """Shows a page's text: a new line where the vertical place changes, a space where a wide gap is left."""

    def __init__(self, doc: Document, resources: dict) -> None:
        fonts = doc.value(resources.get("Font")) or {}
        self.maps = {}
        for name, ref in fonts.items():
            font = doc.value(ref) or {}
            own = font.get("ToUnicode")
            self.maps[name] = _unicode_map(doc.stream(int(own))) if isinstance(own, Ref) and int(own) in doc.streams else (2 if font.get("Subtype") == "Type0" else 1, None)
        self.font, self.y, self.shown, self.parts = None, 0.0, None, []

    def show(self, raw: bytes) -> None:
        width, known = self.maps.get(self.font, (1, None))
        if self.shown is not None and self.shown != self.y:
            self.parts.append("\n")
        self.shown = self.y
        if known is None:
            self.parts.append(raw.decode("cp1252", "replace") if width == 1 else "�" * (len(raw) // 2))
        else:
            self.parts.append("".join(known.get(int.from_bytes(raw[i : i + width], "big"), "�") for i in range(0, len(raw), width)))

    def run(self, body: bytes) -> str:
        args: list = []
        leading = 0.0
        number = lambda x: float(x) if isinstance(x, int | float) else 0.0
        for v, _ in tokens(body):
            if not isinstance(v, Word):
                args.append(v)
                continue
            if v == "Tf" and len(args) >= 2:
                self.font = args[-2]
            elif v == "TL" and args:
                leading = number(args[-1])
            elif v in ("Td", "TD") and len(args) >= 2:
                self.y += number(args[-1])
                leading = -number(args[-1]) if v == "TD" else leading
                if self.parts and number(args[-1]) == 0 and number(args[-2]) > 0:
                    self.parts.append(" ")
            elif v == "Tm" and len(args) >= 6:
                self.y = number(args[-1])
            elif v == "BT":
                self.y = 0.0
                self.shown = None if self.shown is None else float("nan")
            elif v in ("T*", "'", '"'):
                self.y -= leading or 1.0
            if v in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                self.show(args[-1])
            elif v == "TJ" and args and isinstance(args[-1], list):
                for x in args[-1]:
                    if isinstance(x, bytes):
                        self.show(x)
                    elif number(x) < -200:
                        self.parts.append(" ")
            args = []
        return re.sub(r" +", " ", "".join(self.parts)).strip()


def parse_pdf(content: bytes) -> list[tuple[int, str]]:
    """[(page number from 1, text)] of every page, blank ones included."""
    try:
        doc = Document(content)
        return [(i, _Page(doc, resources).run(doc.contents(page))) for i, (page, resources) in enumerate(doc.pages(), 1)]
    except (zlib.error, KeyError, TypeError, IndexError) as e:
        raise ValueError(f"broken PDF: {type(e).__name__}: {e}") from e
