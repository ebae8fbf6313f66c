"""Secret scans: base patterns plus an assignment-aware lexer.

The lexer reads name-literal pairs from source and configuration syntax (see
``lexer``), propagates constants through assignments whose right side is a known
name or a chain of names and literals, and scores each literal by the names it
finally reaches and by its own shape or that of the whole value its chain builds.  A
literal under no sensitive name is left alone; a text without a word that makes a
name sensitive is not lexed.

Defined cases: null and empty texts hold no spans; offsets count code points, the
end is exclusive; spans are sorted by start, then kind in the order of ``KINDS``,
then end; texts are scanned whole, in time linear in their length; repeated rows give
repeated results; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairngraph.llm.lexer import Term, assignments
from cairngraph.llm.storage import small_batches

KINDS = ("assign", "access", "hex", "literal")
_ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same runs as HEX of 24 or more, without a match object for every short one.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("passw", "secret", "token", "api")

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weight of a name's word; pairs of words count where neither says enough alone.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 0.9, "token": 0.8, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "auth": 0.5, "signature": 0.4}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("auth", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.9, ("connection", "string"): 0.8}
#: Every name of a score above 0 holds one of these, in either case.
SENSITIVE_PARTS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "key", "credential", "auth", "signature", "connection")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example.*|your[_-].*|<.*>|\$\{.*\}|none|null|true|false|todo|test|dummy)$")
THRESHOLD, MIN_LENGTH = 0.6, 8
#: A chain's value is scored by that many characters at most (doubled names grow without bound); its literals are all found.
SCORED = 4096


def name_score(name: str) -> float:
    """How sensitive an identifier is, 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    return max([0.0, *(SENSITIVE.get(w, 0.0) for w in words), *(PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


def literal_score(value: str) -> float:
    """How much a literal looks generated: length, entropy and mixed character classes, 0 to 1."""
    n = len(value)
    if n < MIN_LENGTH or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, 0.5 * min(entropy / 3.5, 1) + 0.2 * min(n / 20, 1) + 0.15 * (classes - 1))


def _origins(found: list[tuple[str, list[Term]]], feeds: dict[str, list[int]]) -> list[list[int | None]]:
    """For each term of each assignment, the assignment a name takes its constant from: the last before, else the next."""
    origins: list[list[int | None]] = []
    for i, (_, terms) in enumerate(found):
        row: list[int | None] = []
        for t in terms:
            places = feeds.get(t.value, []) if t.is_name else []
            k = bisect_left(places, i)
            later = k + (k < len(places) and places[k] == i)
            row.append(places[k - 1] if k else places[later] if later < len(places) else None)
        origins.append(row)
    return origins


def _constant(i: int, found: list[tuple[str, list[Term]]], origins: list[list[int | None]], memo: dict[int, str]) -> str:
    """The value of assignment i, names replaced by their constants (up to ``SCORED`` characters; names in a circle are empty)."""
    stack, opened = [i], set()
    while stack:
        j = stack[-1]
        todo = [o for o in origins[j] if o is not None and o not in memo and o not in opened] if j not in memo and j not in opened else []
        if todo:
            opened.add(j)
            stack += todo
            continue
        stack.pop()
        if j not in memo:
            parts = [memo.get(o, "") if o is not None else "" if t.is_name else t.value for t, o in zip(found[j][1], origins[j])]
            memo[j] = "".join(parts)[:SCORED] if len(parts) > 1 else parts[0]
    return memo[i]


def lexed(text: str) -> list[tuple[str, int, int]]:
    """Literal spans whose own or propagated target name is sensitive enough.

    A literal is scored alone and, in a chain, by the whole value it is a part of; all literals of a value that
    scores are found, those of the names in it too.
    """
    low = text.lower()
    if not any(part in low for part in SENSITIVE_PARTS):
        return []
    found = assignments(text)
    feeds: dict[str, list[int]] = {}  # name -> assignments that define it
    for i, (target, _) in enumerate(found):
        feeds.setdefault(target, []).append(i)
    score = [name_score(target) for target, _ in found]
    order = [i for i in range(len(found)) if score[i] > 0]
    while order:  # a sensitive target hands its score to what it was assigned from
        i = order.pop()
        for t in found[i][1]:
            for j in feeds.get(t.value, ()) if t.is_name else ():
                if score[j] < score[i]:
                    score[j] = score[i]
                    order.append(j)
    spans: set[tuple[str, int, int]] = set()
    origins: list[list[int | None]] = []
    memo: dict[int, str] = {}
    emitted: set[int] = set()
    for i, ((_, terms), s) in enumerate(zip(found, score)):
        if s <= 0:
            continue
        for t in terms:
            # a lone unquoted word that no assignment defines is a literal too
            if (not t.is_name or (len(terms) == 1 and t.value not in feeds)) and s * literal_score(t.value) >= THRESHOLD * 0.8:
                spans.add(("literal", t.start, t.end))
        if len(terms) == 1:
            continue
        origins = origins or _origins(found, feeds)
        if s * literal_score(_constant(i, found, origins, memo)) >= THRESHOLD * 0.8:
            reached = [i]
            while reached:
                j = reached.pop()
                if j not in emitted:
                    emitted.add(j)
                    spans |= {("literal", t.start, t.end) for t in found[j][1] if not t.is_name and t.end > t.start}
                    reached += [o for o in origins[j] if o is not None]
    return list(spans)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each sorted."""
    if not text:
        return [], []
    base = []
    low = text.lower()
    if any(c in low for c in _CUES):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    by_place = lambda x: (x[1], _ORDER[x[0]], x[2])
    return sorted(base, key=by_place), sorted(lexed(text), key=by_place)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and spans; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                base, added = scan(text.as_py())
                every = sorted(base + added, key=lambda x: (x[1], _ORDER[x[0]], x[2]))
                n = Counter(k for k, _, _ in every)
                rows.append((doc_id.as_py(), n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n["literal"]))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every found span replaced; overlapping spans are merged."""
    base, added = scan(text)
    out, at = [], 0
    for _, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def base_oracle() -> str:
    """Counts and digest of the base spans in DuckDB SQL: matches marked in the text, and their places summed up."""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
    quote = "[\"'']?"
    assign = f"((?:{names}){quote}\\x20*[:=]\\x20*{quote})([A-Za-z0-9+/_.=-]+)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
marked AS (
  SELECT r, 0 AS kind, string_split(regexp_replace(t, '{assign}', chr(1) || '\\1' || chr(3) || '\\2' || chr(2), 'g'), chr(1)) AS parts FROM d
  UNION ALL SELECT r, 1, string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || chr(3) || '\\1' || chr(2), 'g'), chr(1)) FROM d
  UNION ALL SELECT r, 2, string_split(regexp_replace(t, '([0-9a-f]+)', chr(1) || chr(3) || '\\1' || chr(2), 'g'), chr(1)) FROM d),
part AS (SELECT r, kind, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM marked),
placed AS (
  SELECT *, sum(len(replace(replace(p, chr(2), ''), chr(3), ''))) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start,
    len(split_part(p, chr(2), 1)) - 1 AS size, len(split_part(split_part(p, chr(2), 1), chr(3), 2)) AS n FROM part),
span AS (SELECT r, kind, CAST(start AS BIGINT) AS a, CAST(start + size AS BIGINT) AS b FROM placed WHERE i > 1 AND n >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
found AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS spans FROM span GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN found USING (r)"""
