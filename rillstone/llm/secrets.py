"""Secret scans: three base patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "x"``, ``"name": "x"``, ``export NAME=x``, ``name := 'x'``,
``name => x``, ``env["NAME"] = x``, ``name: type = x``; literals may have a prefix as in ``r"x"``) into pairs of a name
and a literal. A value that is itself the name of an earlier constant of an enclosing block stands for that constant's
literals, and ``+`` joins literals and constants. Values refer to their parts and carry sums of bounded size, so a text
takes time in proportion to its length however its constants build on each other. Each literal is scored by how sensitive its target
name is (its words, split at case changes and separators) and by how much it looks like a key (length, entropy,
character classes, no placeholder). Literals at or above ``MIN_SCORE`` add a span of kind ``literal``, unless a base
span covers it. Spans are code points, end exclusive; a base span is the whole match.

Defined results: null and empty texts have no spans; rows are independent of each other; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, extended, read_table, texts_of

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run has no match, and a longer one is matched whole
HEX_BYTES = re.compile(rb"[0-9a-f]{16,}")
CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS = 12, 18

VALUE = r"""(?:(?:[A-Za-z]{1,2}(?=["'\\`]))?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)|([A-Za-z0-9+/_.=@$%!~^*-]+))"""
PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])(["']?)([A-Za-z_][A-Za-z0-9_.-]*)\1\]?[ \t]*(?::=|=>|[:=])[ \t]*""" + VALUE, re.ASCII)
#: What may follow the type of a declaration: the value proper.
TYPED = re.compile(r"(?:[\[<][^=\n]{0,80}[\]>])?[ \t]*=(?![=>])[ \t]*" + VALUE, re.ASCII)
MORE = re.compile(r"[ \t]*\+[ \t]*" + VALUE, re.ASCII)
LINE = re.compile(r"^([ \t]*)[^ \t\n]", re.MULTILINE)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Words of a name, and pairs of neighbouring words, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.9, "auth": 0.6, "authorization": 0.8, "api key": 1.0, "private key": 1.0, "access key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "session key": 0.8,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|changeme|example.*|your.*|todo|test|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")
MIN_SCORE, MIN_LITERAL = 0.5, 8
CLASS_PATTERNS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]")]
#: Characters kept of a value's beginning and end (a longer value is no one-word placeholder); the largest sum of counts.
CLIP, LARGE = 64, 1 << 40


def name_weight(name: str) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(parts, parts[1:], strict=False))])


class Value:
    """What a name holds: literals and earlier values, with what scoring needs of their concatenation, of bounded size.

    ``literals`` is a chain of (place, earlier value, rest of the chain), so that a value takes up its parts without copying.
    Characters are counted by their low six bits beyond ASCII; counts are halved together when they grow very large.
    """

    __slots__ = ("chain", "counts", "n", "classes", "space", "head", "tail", "told")

    def __init__(self):
        self.chain, self.counts, self.n, self.classes, self.space, self.head, self.tail, self.told = None, {}, 0, 0, False, "", "", False

    def copy(self, last: bool) -> Value:
        """A new value that begins with this one. last: this one's counts are not needed any more and go over."""
        out = Value()
        out.chain, out.counts, out.n, out.classes, out.space, out.head, out.tail = (None, None, self), self.counts if last else self.counts.copy(), self.n, self.classes, self.space, self.head, self.tail
        return out

    def add(self, start: int, end: int, found: str) -> None:
        """A literal at a place."""
        self.chain = ((start, end), self.chain, None)
        counts = self.counts
        for c in found:
            k = ord(c)
            k = k if k < 128 else 128 + (k & 63)
            counts[k] = counts.get(k, 0) + 1
        self._longer(len(found), _classes(found), " " in found, found, found)

    def join(self, other: Value) -> None:
        """All literals of another value."""
        self.chain = (None, self.chain, other)
        counts = self.counts
        for k, n in list(other.counts.items()):
            counts[k] = counts.get(k, 0) + n
        self._longer(other.n, other.classes, other.space, other.head, other.tail)

    def _longer(self, n: int, classes: int, space: bool, head: str, tail: str) -> None:
        if len(self.head) < CLIP:
            self.head += head[: CLIP - len(self.head)]
        self.tail = (self.tail + tail[-CLIP:])[-CLIP:]
        self.n, self.classes, self.space = self.n + n, self.classes | classes, self.space or space
        if self.n > LARGE:
            self.counts = {k: (v + 1) // 2 for k, v in self.counts.items()}
            self.n = sum(self.counts.values())

    def weight(self) -> float:
        """0 to 1: how much the literals, joined, look like a key."""
        n = self.n
        if n < MIN_LITERAL or self.space or not self.classes or PLACEHOLDER.match(self.head if n <= CLIP else self.head + self.tail):
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        return 0.4 * min(1, entropy / 3.5) + 0.3 * min(1, n / 20) + 0.3 * min(1, (self.classes.bit_count() - 1) / 2)

    def tell(self, spans: dict) -> None:
        """Add the places of all literals; what has been told once is not visited again."""
        todo = [self]
        while todo:
            value = todo.pop()
            if value.told:
                continue
            value.told = True
            chain = value.chain
            while chain:
                place, chain, other = chain
                if place:
                    if place[1] > place[0]:
                        spans[place] = None
                elif not other.told:
                    todo.append(other)


def _classes(found: str) -> int:
    """Bits of the classes of characters: small letters, capitals, digits, others."""
    if found.isascii() and found.isalnum():
        return (not found.isupper() and not found.isdigit()) | (not found.islower() and not found.isdigit()) << 1 | (not found.isalpha()) << 2
    return sum(1 << k for k, p in enumerate(CLASS_PATTERNS) if p.search(found))


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that end up in sensitive names, in time proportional to the text.

    A constant is known from its assignment to the end of its block: to the next line that is indented less.
    """
    constants: dict[str, Value] = {}
    blocks: list[tuple[int, list]] = []  # indentation, and what the names were before
    weights: dict[str, float] = {}
    spans: dict = {}
    at = line = indent = 0
    while m := PAIR.search(text, at):
        name, value = m[2], m
        if value.lastindex == 6 and (typed := TYPED.match(text, m.end())):
            value = typed
        # Blocks that end before this line, and its indentation.
        new = text.rfind("\n", at, m.start()) + 1
        if new or not at:
            if blocks:
                for x in LINE.finditer(text, text.find("\n", line, new) + 1, min(len(text), m.start() + 1)):
                    width = x.end(1) - x.start(1)
                    while blocks and blocks[-1][0] > width:
                        for k, old in reversed(blocks.pop()[1]):
                            if old is None:
                                constants.pop(k, None)
                            else:
                                constants[k] = old
            line, k = new, new
            while text[k] in " \t":
                k += 1
            indent = k - new
        held, first = None, True
        while value:
            group = value.lastindex
            found = value[group]
            bare = value.re.groups == group  # the last alternative is unquoted
            known = constants.get(found) if bare else None
            if known is not None:
                if first:
                    held = known.copy(found == name and not indent)
                else:
                    held = held or Value()
                    held.join(known)
            elif bare and not first and not any(c.isdigit() for c in found):
                pass  # an unknown name in a sum
            else:
                held = held or Value()
                held.add(value.start(group), value.end(group), found)
            at, first = value.end(), False
            value = MORE.match(text, at)
        if indent:
            if not blocks or blocks[-1][0] < indent:
                blocks.append((indent, []))
            blocks[-1][1].append((name, constants.get(name)))
        constants[name] = held
        if name not in weights:
            weights[name] = name_weight(name)
        if weights[name] and weights[name] * held.weight() >= MIN_SCORE:
            held.tell(spans)
        at = max(at, m.start() + 1)
    return list(spans)


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret of a text, sorted; kind is an index of ``KINDS``."""
    lower = data.lower()
    cue, key, run = any(c in lower for c in CUES), b"AKIA" in data, HEX_BYTES.search(data)
    pairs = b"=" in data or b":" in data
    if not (cue or key or run or pairs):
        return []
    text = data.decode()
    out = []
    if cue:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if key:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if run:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if pairs:
        base = sorted(out)
        starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
        for a, b in lexed(text):
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                out.append((a, 3, b))
    return sorted(out)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and for each row its spans: array<struct<kind, start, end>>."""
    source = docs.select(*dict.fromkeys([*keep, text]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in chunks(batches, text):
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(x)] for x in texts_of(batch, text)], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), spans], names=[*keep, "spans"])

    return source.mapInArrow(run, extended(source.select(*keep).schema, "spans array<struct<kind:string,start:long,end:long>>"))


def digested(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, counts of the base kinds, the digest of base spans and all spans as a string."""
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in chunks(batches, text):
            found = [scan(x) for x in texts_of(batch, text)]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(3)]
            sha = pa.array([hashlib.sha256(_told([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *counts, sha, pa.array(map(_told, found), pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def masked(data: bytes, mark: str = "[secret]") -> bytes:
    """The text with each maximal run of overlapping secret spans replaced."""
    spans = scan(data)
    if not spans:
        return data
    text, out, at = data.decode(), [], 0
    end = -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark] if a >= at else [mark]
            end = b
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]]).encode()


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(read_table(spark, sf_dir, "documents"), ["doc_id"])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays; secrets in ``text`` are masked and ``n_chars`` follows. A null text stays null."""
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in chunks(batches):
            null = batch.column("text").is_null().to_pylist()
            old = texts_of(batch)
            new = [masked(x) for x in old]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array([None if no else x.decode() for no, x in zip(null, new, strict=True)], pa.string()).cast(batch.column("text").type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if a == b else len(b.decode()) for k, a, b in zip(kept, old, new, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, schema)


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
