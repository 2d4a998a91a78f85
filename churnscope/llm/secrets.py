"""Secret scanning with one combined automaton.

All rules are compiled into a single deterministic automaton over bytes (see
``automaton``). Texts are cut at the automaton's reset bytes, over which no
match can reach, and all pieces step through the transition array side by
side. Only pieces in which it has found something get their exact spans from
the rules' regular expressions, leftmost and non-overlapping per kind.

Every document is scanned whole, in the task that reads it; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import textvec
from churnscope.llm.automaton import Automaton, compile_rules

BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``regex`` finds candidates; those whose ``group`` has fewer than ``least`` characters are dropped.

    ``needs`` is what the automaton looks for: a regex that every surviving
    match holds from its beginning.
    """

    kind: str
    regex: str
    needs: str
    group: int = 0
    least: int = 1


VALUE = "[A-Za-z0-9+/_.=-]"
#: The base rules.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", rf"{ASSIGN_HEAD}({VALUE}+)", rf"{ASSIGN_HEAD}{VALUE}{{6}}", 1, 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", 0, 24),
)
#: Further kinds with a fixed prefix.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{8}", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{8}", 0, 20),
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)


def _spans(piece: str, rules: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, regex, group, least in rules for m in regex.finditer(piece) if len(m[group]) >= least]


def find_spans(data: np.ndarray, offsets: np.ndarray, machine: Automaton, rules: list[tuple[str, re.Pattern, int, int]]) -> list[list[tuple[int, int, str, int]]]:
    """Per text (bytes ``offsets[i]`` to ``offsets[i+1]`` of ``data``): (start, rank of kind, kind, end) in code points."""
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return out
    solid = ~machine.resets[data]
    edge = np.diff(solid.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A text's bounds cut too.
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[solid[inner] & solid[inner - 1]]
    start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
    found = np.flatnonzero(machine.scan(data, start, end))
    if not len(found):
        return out
    rank = {kind: i for i, (kind, *_) in enumerate(rules)}
    later = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that continue a character
    doc = np.searchsorted(offsets, start[found], "right") - 1
    for i, d in zip(found.tolist(), doc.tolist()):
        s, e = int(start[i]), int(end[i])
        at = s - int(offsets[d]) - int(later[s] - later[offsets[d]])
        for kind, a, b in _spans(data[s:e].tobytes().decode("ascii", "replace"), rules):
            out[d].append((at + a, rank[kind], kind, at + b))
    for spans in out:
        spans.sort()
    return out


def _scanner(rules: tuple[Rule, ...], machine: Automaton) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r.kind, re.compile(r.regex, re.ASCII), r.group, r.least) for r in rules]
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for lo, hi in textvec.blocks(texts, BLOCK_BYTES):
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]).astype(np.int64)
                found = find_spans(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets, machine, compiled)
                spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in x] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(spans, SPANS)], names=["id", "spans"]
                )

    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per document: ``id_col`` and its spans (kind, start, end in code points, end exclusive).

    Spans are ordered by start, then by the rules' order. A null text is
    empty; a document without secrets has an empty list. Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    machine = compile_rules([r.needs for r in rules])
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(_scanner(rules, machine), "id long, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def mask_secrets(text: str, spans: list[tuple[int, int]], mask: str = "[secret]") -> str:
    """``text`` with the spans replaced; overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
