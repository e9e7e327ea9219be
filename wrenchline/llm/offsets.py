"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. The byte-level tokens tile its bytes, so their spans follow from their lengths, and
are joined with the spans of the sections by binary search. A token belongs to the section in which it begins; one that
also reaches into a later section is counted there as crossing. So the sections of a document add up to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wrenchline.llm.textbytes import chunks
from wrenchline.llm.tokens import PieceEncoder

#: What closes a section; it belongs to the section before it.
LINE_END = rb"\n"

_COUNTS = "section int, start long, stop long, n_tokens long, n_crossing long"


def _attributed(path: str, closing: bytes, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceEncoder(path)
        lengths = encode.lengths
        pattern = re.compile(closing)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                n = chunk.last - chunk.first
                ids = np.concatenate(encode(chunk))
                begins = np.cumsum(lengths[ids]) - lengths[ids]
                # Sections of the chunk: each text begins one, and so does what follows a closing inside a text.
                after = np.array([m.end() for m in pattern.finditer(chunk.data.tobytes())], np.int64)
                text = np.searchsorted(chunk.offsets[1:], after, "right")
                inner = (text < n) & (after > chunk.offsets[np.minimum(text, n - 1)])
                starts = np.concatenate([chunk.offsets[:-1], after[inner]])
                owner = np.concatenate([np.arange(n), text[inner]])
                order = np.lexsort((starts, owner))
                starts, owner = starts[order], owner[order]
                stops = np.append(starts[1:], chunk.offsets[-1])
                edges = np.searchsorted(begins, np.append(starts, chunk.offsets[-1]))
                # Empty texts begin where the next text does: only the last section there has the tokens.
                tokens = np.diff(edges)
                # Of the tokens that begin in a section, only the last can reach over its end.
                some = np.flatnonzero(tokens)
                last = edges[some + 1] - 1
                crossing = np.zeros(len(starts), np.int64)
                crossing[some] = begins[last] + lengths[ids[last]] > stops[some]
                characters = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                origin = characters[chunk.offsets[owner]]
                number = np.arange(len(starts)) - np.searchsorted(owner, owner)
                own = batch.select(passed).take(pa.array(owner + chunk.first))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(number.astype(np.int32)), pa.array(characters[starts] - origin),
                     pa.array(characters[stops] - origin), pa.array(tokens), pa.array(crossing)],
                    [*passed, "section", "start", "stop", "n_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, tokenizer: str, closing: bytes = LINE_END) -> DataFrame:
    """One row per section: ``doc_id``, ``section`` (from 0), its span ``start`` to ``stop`` in characters, ``n_tokens``
    and ``n_crossing``.

    ``closing`` is a bytes pattern that ends a section, by default the end of a line; it must not match across texts. A
    null or empty text has one empty section. Rows are counted one by one, so repeated rows and ids stay; an empty table gives
    no rows; other columns are ignored. ``tokenizer`` is the path of a byte-level tokenizer file that every executor can read.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_attributed(tokenizer, closing, ["doc_id"]), f"doc_id {id_type}, {_COUNTS}")
