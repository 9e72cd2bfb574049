"""Secret scans: one minimal automaton for all rules looks at every byte once; only texts in which a rule accepts are looked at closer.

There, the rule's reversed automaton, run from the end, marks all places where a match can begin, and its own automaton
gives the longest match from the leftmost place; the next one begins behind it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Dfa, parse, reverse
from .common import batch_of, map_slices


@dataclass(frozen=True)
class Rule:
    """Matches are head then body; those whose body (or, with whole, all) is shorter than least are dropped after matching."""

    kind: str
    head: str
    body: str
    least: int = 1
    fold_head: bool = False
    quick: str = ""  # something simpler that every match contains, for the combined automaton
    tree: tuple = field(init=False, compare=False, repr=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "tree", ("cat", [parse(self.head, self.fold_head), parse(self.body)]))


BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 14),
    Rule("hex", "", "[0-9a-f]+", 16),
)
_URL = r"[A-Za-z0-9_.%-]+:[^\x00-\x20@:/\"'\x7F-\xFF]+@[A-Za-z0-9_.-]+"
MORE = (
    Rule("github", "gh[opusr]_", "[A-Za-z0-9]{36}", 36),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]{20}", 20),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]{10,}", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]{35}", 35),
    Rule("stripe", "[sr]k_(live|test)_", "[A-Za-z0-9]{24,}", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]{8,}", 8, quick=r"eyJ[A-Za-z0-9_-]{4}"),
    Rule("pem", "-----BEGIN ", "(RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----", 1),
    Rule("url", "(postgres|postgresql|mysql|mongodb|redis|https?|ftp)://", _URL, 1, quick=r"://[^\x00-\x20@/\"'\x7F-\xFF]+@"),
)
RULES = BASE + MORE


class Scanner:
    """Compiled once on the driver; workers get the transition arrays."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Dfa([self._quick(r) for r in rules], unanchored=True)
        self.heads = [Dfa([parse(r.head, r.fold_head)]) for r in rules]
        self.own = [Dfa([r.tree]) for r in rules]
        self.back = [Dfa([reverse(r.tree)], unanchored=True) for r in rules]

    @staticmethod
    def _quick(rule: Rule):
        """What any match that isn't dropped contains: the head and some bytes of a body that is one repeated set.

        Behind a head, a few bytes tell enough; long counts there would multiply the states where heads overlap.
        """
        if rule.quick:
            return parse(rule.quick)
        kind, *rest = parse(rule.body)
        if kind == "cat" and len(rest[0]) == 1 and rest[0][0][0] == "rep" and rest[0][0][1][0] == "set":
            n = min(rule.least, 4) if rule.head else rule.least
            return ("cat", [parse(rule.head, rule.fold_head), ("rep", rest[0][0][1], n, n)])
        return rule.tree

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and then rule."""
        out = []
        for k in self.all.found(data):
            starts = sorted(len(data) - e for e in self.back[k].ends(data[::-1]))
            free = 0
            for s in starts:
                if s >= free and (end := self.own[k].longest(data, s)) > s:
                    free = end
                    if end - max(s, self.heads[k].longest(data, s)) >= self.rules[k].least:
                        out.append((s, end, k))
        return sorted(out, key=lambda x: (x[0], x[2]))


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte positions as code points."""
    place = {0: 0}
    last = points = 0
    for b in sorted({x for s in spans for x in s[:2]}):
        points += len(data[last:b].decode("utf-8", "replace"))
        place[b] = points
        last = b
    return [(place[s], place[e], k) for s, e, k in spans]


def _texts(data: np.ndarray, at: np.ndarray):
    whole = data.tobytes()
    return (whole[at[d] : at[d + 1]] for d in range(len(at) - 1))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, spans array<struct<kind, start, end>>) in code points, end exclusive, for each row.

    Null and empty texts have no spans. Other columns, null or repeated doc_ids don't matter; an empty table gives an empty one.
    """
    compiled = scanner(rules)

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in _points(t, found)] if (found := compiled.spans(t)) else [] for t in _texts(data, at)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return batch_of(batch, ["doc_id"], spans=pa.array(rows, kind))

    return map_slices(docs.select("doc_id", "text"), kernel, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """The counts, digest and list of spans of each row of docs (doc_id, text), from scan()."""
    base = [r.kind for r in BASE]

    def kernel(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for spans in batch.column(1).to_pylist():
                own = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in base]
                for k in base:
                    out[f"n_{k}"].append(sum(s["kind"] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(",".join(own).encode()).hexdigest())
                out["spans"].append(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans))
            yield batch_of(batch, ["doc_id"], **{k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()})

    return scan(docs).mapInArrow(kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text replaced by <kind>, and n_chars, if there, counted again where text changed.

    All rows, also repeated ones, and all columns stay, with their types; null and empty texts stay as they are. An empty
    table gives an empty one.
    """
    compiled = scanner(rules)
    columns = docs.columns

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        changed = {}
        for d, text in enumerate(_texts(data, at)):
            if found := compiled.spans(text):
                out, last = [], 0
                for s, e, k in found:
                    if s >= last:
                        out += [text[last:s], f"<{rules[k].kind}>".encode()]
                    last = max(last, e)
                changed[d] = b"".join([*out, text[last:]]).decode("utf-8", "replace")
        if not changed:
            return batch
        new = {}
        texts = batch.column(columns.index("text")).to_pylist()
        for d, t in changed.items():
            texts[d] = t
        new["text"] = pa.array(texts, batch.schema.field("text").type)
        if "n_chars" in columns:
            sizes = batch.column(columns.index("n_chars")).to_pylist()
            for d, t in changed.items():
                sizes[d] = len(t)
            new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(columns)], schema=batch.schema)

    return map_slices(docs, kernel, docs.schema)


