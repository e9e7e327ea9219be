"""Line dedup by a log-template tree.

A line is parsed at fixed depth: its token count, then its first ``LEAD`` tokens, lead to a leaf. The other tokens make
``FIELDS`` fields in order (a token each in short lines, a run of tokens in long ones). Tokens with digits are variable
from the start. Within a leaf, a field value that is found in too few documents is variable too; a line's template is its
leaf with the constant fields, if most of the fields that it has are constant, else the line itself. So a template is a matter of counts of
field values, and no task ever holds a leaf.

A template recurs if it is found in several different texts that are not copies of each other: copies are the business
of document dedup and must not make their own lines look like boilerplate. Texts are compared by 8 minima over the word
shingles outside the template's own lines: among copies a minimum takes few values, among independent texts about one
for each. A few texts that share no minimum with each other are enough, however many copies there are besides. The
lines of recurring templates are dropped in all documents alike, so copies stay copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchline.llm.minhash import _SHINGLE_FACTORS, SHINGLE, THRESHOLD
from wrenchline.llm.shared import fresh_name
from wrenchline.llm.textbytes import NOT_SPACE, U64, Chunk, chunks, constants, mix, span_hashes, spans, words
from wrenchline.session import pinned

LEAD = 3
FIELDS = 8
#: Shorter lines (in tokens) have no template and always stay.
LEAST_TOKENS = 3
#: A field value is constant from so many documents on, and a template needs so many constant fields, or that share of
#: them where lines have fewer than ``FIELDS``.
LEAST_SUPPORT = 3
LEAST_CONSTANT = 6
#: A template recurs from so many different texts on ...
LEAST_TEXTS = 3
#: ... if a minimum takes at least this share of the values it could take among them.
LEAST_APART = 0.4
#: ... or if so many texts share no minimum with another one before them.
LEAST_SOURCES = 3
CONTEXTS = 8

_DIGITS = np.zeros(256, np.int64)
_DIGITS[48:58] = 1
_VARIABLE = U64(0x2A)
_LEAD_FACTORS = constants(LEAD, 701)
_FIELD_FACTORS = constants(FIELDS, 709)
_CONTEXT_FACTORS = constants(CONTEXTS, 719)


@dataclass
class Lines:
    """Lines of a chunk: byte spans, text, token count, leaf, fields and the hash of leaf and fields."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    tokens: np.ndarray
    leaf: np.ndarray
    fields: np.ndarray
    kind: np.ndarray


def parsed(chunk: Chunk) -> Lines:
    data, offsets = chunk.data, chunk.offsets
    starts, ends, _ = spans(data, offsets, NOT_SPACE)
    hashes = span_hashes(data, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGITS[data])])
    hashes[digits[ends] > digits[starts]] = _VARIABLE
    begin = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(data == 10) + 1]))
    text = np.searchsorted(offsets, begin, "right") - 1
    # A newline at the very end of a text begins an empty line there, which belongs to no text.
    inside = begin < len(data)
    begin, text = begin[inside], text[inside]
    stop = np.append(begin[1:], len(data))
    n = len(begin)
    line = np.searchsorted(begin, starts, "right") - 1
    tokens = np.bincount(line, minlength=n)
    rank = np.arange(len(line)) - (np.cumsum(tokens) - tokens)[line]
    leaf = mix(tokens.astype(U64) + U64(1))
    for k in range(LEAD):
        at = np.flatnonzero(rank == k)
        leaf[line[at]] += hashes[at] * _LEAD_FACTORS[k]
    leaf = mix(leaf)
    fields = np.zeros((n, FIELDS), U64)
    rest = np.flatnonzero(rank >= LEAD)
    if len(rest):
        place = rank[rest] - LEAD
        field = place * FIELDS // np.maximum(tokens[line[rest]] - LEAD, FIELDS)
        key = line[rest] * FIELDS + field
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        values = mix(hashes[rest] + place.astype(U64) * U64(0x9E3779B97F4A7C15))
        fields.reshape(-1)[key[heads]] = np.add.reduceat(values, heads)
    kind = mix(leaf + (fields * _FIELD_FACTORS).sum(axis=1, dtype=U64))
    return Lines(begin, stop, text, tokens, leaf, (fields >> U64(32)).astype(np.uint32).view(np.int32), kind)


_LINES = "doc_id long, text_hash long, leaf long, kind long, fields array<int>"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for chunk in chunks(batch.column("text")):
            lines = parsed(chunk)
            offsets = chunk.offsets
            whole = span_hashes(chunk.data, offsets[:-1], offsets[1:]).view(np.int64)
            long_enough = np.flatnonzero(lines.tokens >= LEAST_TOKENS)
            order = long_enough[np.lexsort((lines.kind[long_enough], lines.text[long_enough]))]
            head = np.ones(len(order), bool)
            head[1:] = (lines.text[order[1:]] != lines.text[order[:-1]]) | (lines.kind[order[1:]] != lines.kind[order[:-1]])
            own = order[head]
            text = lines.text[own]
            # A short line has the first fields only.
            n_fields = np.minimum(lines.tokens[own] - LEAD, FIELDS)
            fields = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(n_fields)).astype(np.int32)),
                pa.array(lines.fields[own][np.arange(FIELDS) < n_fields[:, None]]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text + chunk.first)), pa.array(whole[text]), pa.array(lines.leaf[own].view(np.int64)),
                 pa.array(lines.kind[own].view(np.int64)), fields], ["doc_id", "text_hash", "leaf", "kind", "fields"])


def minima_without(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` templates the minima of a text without its own lines; ``owner`` has the template of each word or -1.

    Shingles that touch a line of the template do not count. If none is left the other words as a whole do, and a text
    without other words has zeros. So has a text that the template's lines alone make a near copy of others with them.
    """
    out = np.zeros((n, CONTEXTS), U64)
    windows = np.lib.stride_tricks.sliding_window_view
    if len(hashes) >= SHINGLE:
        shingles, owners = mix((windows(hashes, SHINGLE) * _SHINGLE_FACTORS).sum(axis=1, dtype=U64)), windows(owner, SHINGLE)
    else:
        shingles, owners = np.zeros(0, U64), np.zeros((0, SHINGLE), owner.dtype)
    left: dict[int, np.ndarray] = {}

    def outside(template: int) -> np.ndarray:
        if template not in left:
            left[template] = shingles[(owners != template).all(axis=1)]
            if not len(left[template]):
                rest = hashes[owner != template]
                places = np.arange(1, 2 * len(rest), 2).astype(U64)
                left[template] = mix(np.array([(rest * places).sum(dtype=U64)], U64)) if len(rest) else rest
        return left[template]

    for k in range(CONTEXTS):
        own = range(n)
        if len(shingles):
            # The least of all counts for every template but those whose lines it touches.
            values = shingles * _CONTEXT_FACTORS[k]
            least = values.argmin()
            out[:, k] = values[least]
            own = set(owners[least].tolist()) - {-1}
        for template in own:
            out[template, k] = (outside(template) * _CONTEXT_FACTORS[k]).min(initial=U64(2**64 - 1)) \
                if len(outside(template)) else 0
    whole = owners[(owners == owners[:, :1]).all(axis=1) & (owners[:, 0] >= 0), 0]
    inside = np.bincount(whole, minlength=n)
    out[(inside > 0) & (100 * inside >= THRESHOLD * (2 * len(shingles) - inside))] = 0
    return out


_SEEN = "template long, text_hash long, contexts array<long>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column("own").is_valid())
        if not len(batch):
            continue
        listed, hashes_of = batch.column("own").to_pylist(), batch.column("text_hash").to_pylist()
        for chunk in chunks(batch.column("text")):
            lines, found = parsed(chunk), words(chunk, NOT_SPACE)
            line_of = np.searchsorted(lines.starts, found.starts, "right") - 1
            edges = np.searchsorted(lines.text, np.arange(chunk.last - chunk.first + 1))
            kinds = lines.kind.view(np.int64)
            templates, texts, out = [], [], [np.zeros((0, CONTEXTS), U64)]
            for i in range(chunk.last - chunk.first):
                own = listed[chunk.first + i]
                named = list(dict.fromkeys(x["template"] for x in own))
                number = {t: j for j, t in enumerate(named)}
                by_kind = {x["kind"]: number[x["template"]] for x in own}
                # Lines too short to have a template have other kinds than those listed.
                of_line = np.array([by_kind.get(kind, -1) for kind in kinds[edges[i]:edges[i + 1]].tolist()], np.int64)
                at = slice(found.firsts[i], found.firsts[i + 1])
                templates.extend(named)
                texts.extend([hashes_of[chunk.first + i]] * len(named))
                out.append(minima_without(found.hashes[at], of_line[line_of[at] - edges[i]], len(named)))
            flat = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(templates, pa.int64()), pa.array(texts, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(flat) + 1, dtype=np.int32) * CONTEXTS), pa.array(flat.reshape(-1)))],
                ["template", "text_hash", "contexts"])


def _templates(lines: DataFrame) -> DataFrame:
    """Kinds of line (``kind``) that share a ``template`` with others of their leaf."""
    kinds = lines.groupBy("leaf", "kind").agg(F.count("*").alias("n"), F.min("fields").alias("fields"))
    leaves = kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("n").alias("docs"))
    open_kinds = kinds.join(leaves.filter((F.col("kinds") > 1) & (F.col("docs") >= LEAST_SUPPORT)).select("leaf"), "leaf")
    values = pinned(open_kinds.select("leaf", "kind", "n", F.size("fields").alias("n_fields"),
                                      F.posexplode("fields").alias("place", "value")))
    key = ["leaf", "place", "value"]
    constant = values.groupBy(*key).agg(F.sum("n").alias("support")).filter(F.col("support") >= LEAST_SUPPORT)
    held = values.join(constant.select(*key), key)
    return (held.groupBy("leaf", "kind")
            .agg(F.count("*").alias("fixed"), F.first("n_fields").alias("n_fields"),
                 F.sum(F.xxhash64("place", "value") % (1 << 40)).alias("code"))
            .filter(F.col("fixed") * FIELDS >= F.col("n_fields") * LEAST_CONSTANT)
            .select("kind", F.xxhash64("leaf", "fixed", "code").alias("template")))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``kinds``: for each document that has any, the hashes of its lines with a recurring template."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    lines = pinned(docs.mapInArrow(_listed, _LINES))
    placed = pinned(lines.select("doc_id", "text_hash", "kind").join(_templates(lines), "kind", "left")
                    .withColumn("template", F.coalesce("template", "kind")))
    texts = placed.groupBy("template", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    often = texts.groupBy("template").agg(F.count("*").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    often = pinned(often)
    own = (placed.join(often.select("template"), "template").groupBy("text_hash", "template", "kind")
           .agg(F.min("doc_id").alias("doc_id")).groupBy("text_hash")
           .agg(F.min("doc_id").alias("doc_id"), F.collect_list(F.struct("kind", "template")).alias("own")))
    seen = docs.join(own, "doc_id").select("text_hash", "text", "own").mapInArrow(_contexts, _SEEN).select(
        "template", "text_hash", F.posexplode("contexts").alias("place", "least"))
    # Each value counts for one of its texts; a text that all its values count for is a source of its own.
    values = seen.groupBy("template", "place", "least").agg(F.min("text_hash").alias("text_hash")).groupBy(
        "template", "text_hash").agg(F.count("*").alias("led")).groupBy("template").agg(
        (F.sum("led") / CONTEXTS).alias("values"), F.count_if(F.col("led") == CONTEXTS).alias("sources"))
    recurring = often.join(values, "template").filter(
        (F.col("values") - 1 >= LEAST_APART * (F.col("texts") - 1)) | (F.col("sources") >= LEAST_SOURCES)).select("template")
    return (placed.join(recurring, "template").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def _without(names: list[str], kinds_name: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(kinds_name).to_pylist()
            texts = batch.column("text").to_pylist()
            n_lines, n_dropped = [], []
            emptied = np.zeros(len(batch), bool)
            for chunk in chunks(batch.column("text")):
                if counts:
                    n_lines.extend(t.count("\n") + 1 if t else 0 for t in texts[chunk.first:chunk.last])
                    n_dropped.extend([0] * (chunk.last - chunk.first))
                if not any(kinds[chunk.first:chunk.last]):
                    continue
                lines = parsed(chunk)
                edges = np.searchsorted(lines.text, np.arange(chunk.last - chunk.first + 1))
                own_kinds = lines.kind.view(np.int64)
                for i in range(chunk.last - chunk.first):
                    listed = kinds[chunk.first + i]
                    if not listed:
                        continue
                    at = slice(edges[i], edges[i + 1])
                    gone = np.isin(own_kinds[at], np.array(listed, np.int64)) & (lines.tokens[at] >= LEAST_TOKENS)
                    raw, base = texts[chunk.first + i].encode(), int(chunk.offsets[i])
                    kept = [raw[s - base:e - base] for s, e, g in zip(
                        lines.starts[at].tolist(), lines.ends[at].tolist(), gone.tolist(), strict=True) if not g]
                    text = b"".join(kept).rstrip(b"\n") if gone[-1] else b"".join(kept)
                    texts[chunk.first + i] = text.decode()
                    emptied[chunk.first + i] = not text.strip()
                    if counts:
                        n_dropped[chunk.first + i] = int(gone.sum())
            columns = [pa.array(texts, batch.column(n).type) if n == "text" else batch.column(n) for n in names]
            if counts:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                                 [*names, "n_lines", "n_dropped"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(~emptied))

    return run


def without_recurring_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates; a document of which nothing is left but white space goes.

    With ``counts`` only ``doc_id`` and ``text`` and the added ``n_lines`` and ``n_dropped`` are returned, for all
    documents. Null and empty texts have no lines and stay as they are; so do rows with a null ``doc_id``. Rows with the
    same id are treated alike. An empty table gives no rows.
    """
    names = ["doc_id", "text"] if counts else docs.columns
    kinds = fresh_name("kinds", docs.columns)
    found = recurring_lines(docs).select(F.col("doc_id").alias("doc_id"), F.col("kinds").alias(kinds))
    # Rows with an id are shuffled just as ``recurring_lines`` shuffles them, so that Spark does it once for both joins.
    named = docs.filter(F.col("doc_id").isNotNull()).join(found, "doc_id", "left").select(*names, kinds)
    joined = named.unionByName(docs.filter(F.col("doc_id").isNull()).select(
        *names, F.lit(None).cast(found.schema[kinds].dataType).alias(kinds)))
    fields = [docs.schema[n] for n in names]
    if counts:
        fields += [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return joined.mapInArrow(_without(names, kinds, counts), T.StructType(fields))
