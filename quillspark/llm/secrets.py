"""Secret scanning with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over byte
trigrams that any match must contain. A partition's documents are indexed, a block of 1 MB at a time, by
exactly the trigrams that the queries name, the postings are intersected and
united, and only the documents left are given to the regex engine. A rule from
which no mandatory trigram can be derived is run over every document.

Defined cases: a null or empty text has no hits; a null doc_id is carried
along, and one that is no whole number is reported as null; repeated rows are scanned each on its own; matches of one rule do not
overlap (leftmost first), several rules may report the same place; a very long text is a block of its own and scanned whole; further columns, whatever
their names, are ignored by ``scan`` and kept by ``redact``; an empty table gives an empty result. A private key is taken up to its END line, or
its BEGIN line alone where none follows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from re import _constants as c
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, whole

#: name -> ASCII pattern in the syntax that Python's re and RE2 share.
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[opusr]_[0-9A-Za-z]{36}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}",
    "password_assignment": r"\b(?i:password|passwd)\s*[=:]\s*[^\s\"',;]{8,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----(?:[0-9A-Za-z+/=:,.\s()-]*?-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----)?",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "token_assignment": r"\b(?i:token|secret|api[_-]?key)\s*[=:]\s*[\"'](?i:[0-9a-z_-]{20,})[\"']",
    "hex_digest_key": r"\b[0-9a-f]{40}\b",
}

ALL = ("all",)
#: Strings that an expression may expand to before its trigrams are taken.
MAX_EXACT = 16


def _and(*qs: tuple) -> tuple:
    parts = []
    for q in qs:
        parts += q[1] if q[0] == "and" else [q] if q != ALL else []
    parts = list(dict.fromkeys(parts))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(*qs: tuple) -> tuple:
    if any(q == ALL for q in qs):
        return ALL
    parts = []
    for q in qs:
        parts += q[1] if q[0] == "or" else [q]
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(s: str) -> tuple:
    b = s.encode()
    return _and(*(("tri", b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2)))


def _of_set(strings: set[str]) -> tuple:
    return _or(*(_trigrams(s) for s in sorted(strings)))


def _chars(ch: int, flags: int) -> set[str]:
    s = chr(ch)
    return {s.lower(), s.upper()} if flags & re.IGNORECASE else {s}


def _class(items: list, flags: int) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out |= _chars(arg, flags)
        elif op is c.RANGE and arg[1] - arg[0] < MAX_EXACT:
            for ch in range(arg[0], arg[1] + 1):
                out |= _chars(ch, flags)
        else:
            return None
    return out if len(out) <= MAX_EXACT else None


def _walk(nodes: list, flags: int) -> tuple[set[str] | None, tuple]:
    """(the strings the expression stands for, or None; a query every match satisfies)."""
    exact: set[str] = {""}
    whole, query = True, ALL

    def flush() -> None:
        nonlocal exact, whole, query
        query, exact, whole = _and(query, _of_set(exact)), {""}, False

    for op, arg in nodes:
        strings: set[str] | None = None
        inner = ALL
        if op is c.LITERAL:
            strings = _chars(arg, flags)
        elif op is c.IN:
            strings = _class(arg, flags)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            strings = {""}
        elif op is c.SUBPATTERN:
            _, add, drop, body = arg
            strings, inner = _walk(body, (flags | add) & ~drop)
        elif op is c.BRANCH:
            found = [_walk(b, flags) for b in arg[1]]
            if all(s is not None for s, _ in found) and len(u := set().union(*(s for s, _ in found))) <= MAX_EXACT:
                strings = u
            else:
                inner = _or(*(q if s is None else _of_set(s) for s, q in found))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, body = arg
            part, inner = _walk(body, flags)
            if part is not None and low == high and len(part) ** low <= MAX_EXACT:
                strings = {"".join(x) for x in itertools.product(part, repeat=low)}
            elif part is not None and (low, high) == (0, 1) and len(part) < MAX_EXACT:
                strings = part | {""}
            elif low == 0:
                inner = ALL
            elif part is not None:
                inner = _of_set(part)
        elif op is c.ATOMIC_GROUP:
            strings, inner = _walk(arg, flags)
        if strings is None:
            flush()
            query = _and(query, inner)
            continue
        if len(exact) * len(strings) > MAX_EXACT:
            # the strings so far are used up but for what the next trigrams need
            query, whole = _and(query, _of_set(exact)), False
            exact = {s[-2:] for s in exact} if all(len(s) >= 2 for s in exact) else {""}
            if len(exact) * len(strings) > MAX_EXACT:
                exact = {""}
        exact = {a + b for a in exact for b in strings}
    return (exact, ALL) if whole else (None, _and(query, _of_set(exact)))


def trigram_query(pattern: str) -> tuple:
    """Boolean query over byte trigrams that every match of an ASCII pattern satisfies.

    ``("all",)`` when there is no mandatory trigram; otherwise a tree of
    ``("and", parts)``, ``("or", parts)`` and ``("tri", code)``.
    """
    if not pattern.isascii():
        raise ValueError("patterns are ASCII")
    tree = parser.parse(pattern, re.ASCII)
    exact, query = _walk(list(tree), tree.state.flags)
    return _of_set(exact) if exact is not None else query


def _named(q: tuple) -> set[int]:
    return {q[1]} if q[0] == "tri" else set() if q == ALL else set().union(*map(_named, q[1]))


class Index:
    """Rules compiled for one worker; ``candidates`` indexes a block and answers every rule's query."""

    def __init__(self, rules: dict[str, str]):
        self.rules = [(n, re.compile(p.encode(), re.ASCII), trigram_query(p)) for n, p in rules.items()]
        self.grams = sorted(set().union(set(), *(_named(q) for *_, q in self.rules)))
        self.slot = np.zeros(1 << 24, np.uint16)
        self.slot[self.grams] = np.arange(1, len(self.grams) + 1)
        self.number = {g: i + 1 for i, g in enumerate(self.grams)}

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        wide = data.astype(np.uint32)
        found = self.slot[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        n = len(offsets) - 1
        keys = np.unique(found[at[inside]].astype(np.int64) * n + doc[inside])
        bounds = np.searchsorted(keys, np.arange(1, len(self.grams) + 2) * n)
        return {g: keys[bounds[i] : bounds[i + 1]] - (i + 1) * n for i, g in enumerate(self.grams)}

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, re.Pattern, np.ndarray]]:
        everything = np.arange(len(offsets) - 1)
        posts = self.postings(data, offsets) if len(data) > 2 else {g: everything[:0] for g in self.grams}

        def answer(q: tuple) -> np.ndarray:
            if q == ALL:
                return everything
            if q[0] == "tri":
                return posts[q[1]]
            parts = sorted(map(answer, q[1]), key=len)
            out = parts[0]
            for p in parts[1:]:
                if q[0] == "and" and not len(out):
                    break
                out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
            return out

        for name, rx, q in self.rules:
            yield name, rx, answer(q)


def scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, n_hits, hits): one row per document and rule that matches; hits are joined by a newline."""
    rules = RULES if rules is None else rules
    schema = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("n_hits", pa.int64()), ("hits", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            ids, rows = batch.column(0), ([], [], [], [])
            for first, _, data, offsets in blocks(batch.column(1)):
                raw = data.tobytes()
                for name, rx, cands in index.candidates(data, offsets):
                    for d in cands.tolist():
                        hits = [m[0] for m in rx.finditer(raw[offsets[d] : offsets[d + 1]])]
                        if hits:
                            for column, v in zip(rows, (ids[first + d].as_py(), name, len(hits), b"\n".join(hits).decode("utf-8", "replace"))):
                                column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)

    return docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, rule string, n_hits long, hits string")


def redact(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The documents, each match in ``text`` replaced by ``[rule]`` and ``n_chars`` (if there is one) counted anew where the text changed.

    Rules apply in the order given. No rows are lost and no shuffle is needed.
    """
    rules = RULES if rules is None else rules
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            changed: dict[int, bytes] = {}
            for first, _, data, offsets in blocks(batch.column(at)):
                raw = data.tobytes()
                for name, rx, cands in index.candidates(data, offsets):
                    for d in cands.tolist():
                        old = changed.get(first + d)
                        new, n = rx.subn(f"[{name}]".encode(), raw[offsets[d] : offsets[d + 1]] if old is None else old)
                        if n:
                            changed[first + d] = new
            if changed:
                where = np.zeros(len(batch), bool)
                where[list(changed)] = True
                fresh = [changed[i].decode("utf-8", "replace") for i in sorted(changed)]
                columns = list(batch.columns)

                def put(i: int, values: list) -> None:
                    full = np.full(len(batch), -1, np.int64)
                    full[where] = np.arange(len(values))
                    both = pa.concat_arrays([columns[i], pa.array(values, columns[i].type)])
                    columns[i] = both.take(pa.array(np.where(where, len(batch) + full, np.arange(len(batch)))))

                put(at, fresh)
                if "n_chars" in names:
                    put(names.index("n_chars"), [len(s) for s in fresh])
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(work, docs.schema)


def oracle(rules: dict[str, str] | None = None) -> str:
    """The scan in SQL: every rule over every document."""
    rows = ", ".join(f"('{n}', '{p.replace(chr(39), chr(39) * 2)}')" for n, p in sorted((rules or RULES).items()))
    return (
        f"WITH rules(rule, pattern) AS (VALUES {rows}), "
        "found AS (SELECT doc_id, rule, regexp_extract_all(text, pattern) AS m FROM documents, rules) "
        "SELECT doc_id, rule, len(m)::BIGINT AS n_hits, array_to_string(m, chr(10)) AS hits FROM found WHERE len(m) > 0"
    )
