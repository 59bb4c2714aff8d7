"""Secret scan by assignment-aware lexing.

Fixed patterns find the base spans. The method then lexes a text into names, literals and operators, pairs
every assigned name with its literal (``name = "x"``, ``name: x``, ``"name": "x"``, ``<name>x</name>``,
``--name x``), follows constants (``name = other`` where ``other`` was given a literal), and scores the literal
by the words of its final name and by its own shape. Literals above the limit are spans of kind ``literal``.
A text without any sensitive word has no such pair and is not lexed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")

# fixed values: base patterns
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# fixed values: words of a sensitive name and their weights
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 0.9, "token": 0.8,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "secretkey": 1.0,
    "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "bearer": 0.7, "authorization": 0.6,
}
NAME_BYTES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"key", b"bearer", b"authorization")
MILD_WORDS = frozenset("count length limit size type name field label id index expiry ttl url path file max min hint".split())
PLACEHOLDER = re.compile(
    r"(?i)^(changeme|change_me|example|placeholder|your[-_ ].*|x{3,}|\*{3,}|\.{3,}|none|null|true|false|todo|redacted|test|dummy)$"
)
LIMIT = 1.2
LEAST = 8

LEXEME = re.compile(
    r"""(?P<comment>\#\ [^\n]*|//\ [^\n]*)
    |(?P<string>[rbfuRBFU]{0,2}(?:\"\"\"(?:[^\\"]|\\.|"(?!\"\"))*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))
    |(?P<name>-{0,2}[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*)
    |(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]<>])
    |(?P<value>[A-Za-z0-9+/_.=@!%^&~-]+)
    |(?P<line>\n)""",
    re.VERBOSE | re.ASCII,
)
BARE = re.compile(r"[A-Za-z0-9+/_.=@!%^&~$-]+", re.ASCII)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """Weight of a target name: its words, alone or joined in pairs; names of sizes and places weigh nothing."""
    parts = [p.lower() for p in PART.findall(name)]
    if not parts or parts[-1] in MILD_WORDS:
        return 0.0
    joined = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max(NAME_WEIGHTS.get(p, 0.0) for p in joined)


def literal_score(text: str) -> float:
    """0 to 1: entropy per character and variety of a literal; placeholders and interpolations score 0."""
    if len(text) < LEAST or PLACEHOLDER.match(text) or "${" in text or "{{" in text or " " in text.strip():
        return 0.0
    counts: dict[str, int] = {}
    for ch in text:
        counts[ch] = counts.get(ch, 0) + 1
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 4.0) * (0.4 + 0.2 * kinds)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    spans = []
    low = raw.lower()
    if any(w in low for w in BASE_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def _unquoted(m: re.Match) -> tuple[int, int]:
    body, start = m.group("string"), m.start("string")
    k = 0
    while body[k] in "rbfuRBFU":
        k += 1
    width = 3 if body[k : k + 3] == '"""' and len(body) - k >= 6 else 1
    return start + k + width, start + len(body) - width


def pairs(text: str) -> Iterator[tuple[str, tuple[int, int] | str]]:
    """(name, literal span) or (name, other name) of every assignment, in order."""
    name: str | None = None
    assigned = closing = False
    at, end = 0, len(text)
    while at < end:
        m = LEXEME.search(text, at)
        if m is None:
            return
        at, kind, token = m.end(), m.lastgroup, m.group()
        if kind == "comment":
            # what stands in a comment may be an assignment that was switched off: lex it like code
            at = m.start() + (1 if token[0] == "#" else 2)
        elif kind == "string":
            a, b = _unquoted(m)
            if assigned and name is not None:
                yield name, (a, b)
                assigned, name = closing, (name if closing else None)
            else:
                name = text[a:b]  # a quoted key
        elif kind == "name":
            if assigned and name is not None:
                bare = BARE.match(text, m.start())
                # a bare word is a constant's name; a longer run of value characters is a literal
                if bare.end() > m.end() or re.search(r"[0-9]", token):
                    yield name, (bare.start(), bare.end())
                    at = bare.end()
                yield name, token
                assigned, name = closing, (name if closing else None)
            else:
                name = token.lstrip("-")
                if token.startswith("--") and text[at : at + 1] == " ":
                    assigned = True
        elif kind == "op":
            if token in ("=", ":", ":=", "=>"):
                assigned = name is not None
            elif token == ">" and name is not None and text[max(0, m.start() - len(name) - 1) : m.start()] == "<" + name:
                assigned = True
            elif token == "+" and closing:
                assigned = True
            elif token not in ("(", "[", "{") or not assigned:
                name, assigned = (name, assigned) if token in ("(", "[", "{") else (None, False)
        elif kind == "value" and assigned and name is not None:
            yield name, (m.start(), m.end())
            assigned, name = False, None
        elif kind == "line":
            name, assigned = None, False


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of kind ``literal``: constants are followed through names, sensitive anywhere along the way."""
    given: dict[str, list[tuple[int, int]]] = {}
    follows: dict[str, set[str]] = {}
    for name, value in pairs(text):
        if isinstance(value, str):
            follows.setdefault(name, set()).add(value)
        else:
            given.setdefault(name, []).append(value)
    weight: dict[str, float] = {}
    # a sensitive target passes its weight to the constants that reach it
    queue = [(n, w) for n in set(given) | set(follows) if (w := name_weight(n)) > 0]
    while queue:
        name, w = queue.pop()
        if weight.get(name, 0.0) >= w:
            continue
        weight[name] = w
        queue += [(source, w) for source in follows.get(name, ())]
    spans = set()
    for name, w in weight.items():
        for a, b in given.get(name, ()):
            if w + literal_score(text[a:b]) >= LIMIT and literal_score(text[a:b]) > 0:
                spans.add((a, 3, b))
    return list(spans)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    found = base_spans(text, raw)
    low = raw.lower()
    if any(w in low for w in NAME_BYTES) and any(c in raw for c in (b"=", b":", b"--", b">")):
        found += literal_spans(text)
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [spans_of(t or "") for t in batch.column(1).to_pylist()]
        base = [[s for s in r if s[1] < 3] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in range(3)],
                pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string()),
                pa.array([_joined(r) for r in rows], pa.string()),
                pa.array([sum(s[1] == 3 for s in r) for r in rows], pa.int64()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
        )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: counts per kind, digest of the base spans, and all spans ``kind:start:end``.

    Positions are code points, ends exclusive, ordered by start, then kind. A null text is empty; an empty text
    has no spans. Rows are scanned one by one, so repeated rows repeat their result; other columns are ignored.
    """
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(
        _scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long",
    ).withColumnRenamed("doc_id", key)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of overlapping spans replaced by ``[secret]``."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with secrets replaced in ``text``; a null text stays null, and so does every other column."""
    place = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t is None else redacted(t, spans_of(t)) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, text, pa.array(clean, batch.column(place).type))

    return docs.mapInArrow(rows, docs.schema)
