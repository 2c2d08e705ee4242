"""Token counts by field and section: offset-mapped attribution.

The fields of a document, joined by line ends, are encoded once, as one text. Each token is mapped to the characters it
covers: of bytes a and b, where it starts and ends, the character that holds a and the one that holds b - 1. These spans
are joined to the sections' spans by two binary searches a batch. A token that crosses a boundary goes to the section
that holds most of its characters, the earlier one of two equals (rule ``majority``), or to the one that holds its first
character (rule ``first``). A character that is split between tokens counts for each of them.

Sections: the lines of each field, each with the line end that follows it, so that sections tile the text.
Cases: a null or empty field has one section, which has no token but what its joint gives it; so has null or empty text.
Section totals add up to the document's tokens. Very long texts are encoded whole; repeated rows and rows of null or
equal doc_id have sections of their own. An empty table gives no rows.
Columns other than doc_id and the fields aren't read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bpe import encoder
from siftwell.llm.buffers import portions
from siftwell.session import ship, spread


def character_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character of each token, the one after its last, characters before each byte); tokens tile data at ``bounds``."""
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return before[bounds[:-1] + 1] - 1, before[bounds[1:]], before


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. start, end: spans of tokens; sections: bounds of spans that tile the same stretch from 0."""
    counts = np.zeros(len(sections) - 1, np.int64)
    if not len(start):
        return counts
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end, "left") - 1
    owner = first.copy()
    if rule == "majority":
        cross = np.flatnonzero(last > first)
        best = np.minimum(sections[first[cross] + 1], end[cross]) - start[cross]
        step = first[cross] + 1
        while True:
            live = step <= last[cross]
            if not live.any():
                break
            held = np.where(live, np.minimum(sections[np.minimum(step + 1, len(sections) - 1)], end[cross]) - sections[np.minimum(step, len(sections) - 1)], 0)
            better = held > best
            owner[cross[better]], best[better] = step[better], held[better]
            step = step + 1
    return counts + np.bincount(owner, minlength=len(counts))


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", fields: Sequence[str] = ("text",), plain_specials: bool = False) -> DataFrame:
    """(doc_id, field, section: from 0 in its field, start_char: there, n_chars, n_tokens, split_at_start) of every section.

    split_at_start is 1 where a token begins in the section before and ends in this one or later, else 0.
    """
    if rule not in ("majority", "first"):
        raise ValueError(f"no such rule: {rule}")
    ship(docs.sparkSession)
    parts = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in fields]
    ends = F.array(*[F.octet_length(p).cast("long") + (1 if i + 1 < len(parts) else 0) for i, p in enumerate(parts)])
    k = len(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, plain_specials)
        names = pa.array(list(fields), pa.string())
        for batch, data, offsets in portions(batches):
            ids, _ = bpe.encode(data, offsets)
            tokens = np.concatenate(([0], np.cumsum(bpe.n_bytes[ids], dtype=np.int64)))
            sizes = batch.column("sizes").flatten().to_numpy().reshape(-1, k)
            joints = np.concatenate((offsets[:-1, None], offsets[:-1, None] + np.cumsum(sizes, axis=1)), axis=1)  # bounds of the fields
            begin, end, before = character_spans(data, tokens) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
            bounds = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
            n = attribute(begin, end, before[bounds], rule)
            split = np.zeros(len(n), np.int64)
            split[np.searchsorted(bounds, np.setdiff1d(bounds[1:-1], tokens))] = 1
            # fields in a row, those of no bytes having one section of none
            flat = joints[:, :-1].ravel()
            filled = np.flatnonzero(sizes.ravel() > 0)
            own = filled[np.searchsorted(flat[filled], bounds[:-1], "right") - 1] if len(filled) else np.zeros(0, np.int64)
            empty = np.flatnonzero(sizes.ravel() == 0)
            zero = np.zeros(len(empty), np.int64)
            start, length = before[bounds[:-1]] - before[flat[own]], np.diff(before[bounds])
            own, start, length, n, split = (np.concatenate(x) for x in ((own, empty), (start, zero), (length, zero), (n, zero), (split, zero)))
            order = np.argsort(own, kind="stable")
            own = own[order]
            nth = np.arange(len(own)) - np.searchsorted(own, own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(own // k)), names.take(pa.array(own % k)), *(pa.array(x) for x in (nth, start[order], length[order], n[order], split[order]))],
                ["doc_id", "field", "section", "start_char", "n_chars", "n_tokens", "split_at_start"],
            )

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    joined = spread(docs).select("doc_id", F.concat_ws("\n", *parts).alias("text"), ends.alias("sizes"))
    return joined.mapInArrow(run, f"doc_id {kind}, field string, section long, start_char long, n_chars long, n_tokens long, split_at_start long")
