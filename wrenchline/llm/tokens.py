"""Byte-level BPE ids of whole texts with a public tokenizer file.

The tokenizer first cuts a text into pieces by a fixed pattern and then works on each piece alone. Here the pieces of a
chunk of texts are cut by the classes of its characters with numpy, the ids of each distinct piece are encoded once and
remembered, and a text's ids are those of its pieces. Texts with characters beyond the first plane or whose class is not
settled between Unicode versions, or with a special token's string, are encoded as a whole by the tokenizer itself.
"""

from __future__ import annotations

import numpy as np
import regex
from tokenizers import Tokenizer

from wrenchline.llm.textbytes import Chunk, SpanHashes, constants

#: Fixed value: white space as the tokenizer's pattern understands it.
_SPACE = r"[\t-\r \x85\xa0  -     　]"
#: Scripts whose letters and digits have been settled for long.
_SETTLED = r"[\x00-ԯ -⁯₠-₿℀-⅏　-ヿ一-龥가-힣]"
SPACE, LETTER, NUMBER, OTHER, UNSETTLED = range(5)
#: Pieces remembered; a full table becomes the older one, and what is used again moves to the new one.
CACHED_PIECES = 300_000

_VALUES = constants(256, 811)
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Class of every code point of the first plane; made once in a process."""
    if not _classes:
        table = np.full(1 << 16, UNSETTLED, np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(1 << 16))
        for pattern, kind in ((_SETTLED, OTHER), (rf"(?V1)[{_SETTLED}&&\p{{L}}]", LETTER),
                              (rf"(?V1)[{_SETTLED}&&\p{{N}}]", NUMBER), (_SPACE, SPACE)):
            table[[m.start() for m in regex.finditer(pattern, every)]] = kind
        table[0xD800:0xE000] = UNSETTLED
        _classes.append(table)
    return _classes[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = character_classes()
    out = table[data]
    wide = data >> 4
    two = np.flatnonzero((wide == 12) | (wide == 13))
    if len(two):
        kind = table[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
        out[two] = out[two + 1] = kind
    three = np.flatnonzero(wide == 14)
    if len(three):
        code = ((data[three] & 0x0F).astype(np.int64) << 12) | ((data[three + 1] & 0x3F).astype(np.int64) << 6)
        kind = table[code | (data[three + 2] & 0x3F)]
        out[three] = out[three + 1] = out[three + 2] = kind
    four = np.flatnonzero(wide == 15)
    for k in range(4):
        out[four + k] = UNSETTLED
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """First byte of every piece of the texts.

    A piece is a run of letters, of numbers or of other characters, with one blank before it if there is one; after an
    apostrophe that begins a piece, the endings s, t, re, ve, m, ll, d belong to it and end it. White space before a
    blank or another last white space character is a piece, and so is that character unless it is a blank taken by a run.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    starts = run & (kinds == SPACE)
    at = np.flatnonzero(run & (kinds != SPACE))
    before = np.maximum(at - 1, 0)
    inner = (at > 0) & ~first[at]
    blank = inner & (data[before] == 32)
    starts[at[~blank]] = True
    starts[before[blank]] = True
    # White space other than a blank right before a run is a piece of its own: find its first byte.
    other = before[inner & (kinds[before] == SPACE) & (data[before] != 32)]
    while len(other):
        tail = (data[other] & 0xC0) == 0x80
        starts[other[~tail]] = True
        other = other[tail] - 1
    quote = np.flatnonzero((data == 39) & starts)
    for ending in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        stop = quote + 1 + len(ending)
        fits = stop <= n
        for k, byte in enumerate(ending):
            place = np.minimum(quote + 1 + k, n - 1)
            fits &= (data[place] == byte) & ~first[place]
        starts[quote[fits] + 1] = False
        stop = stop[fits]
        starts[stop[stop < n]] = True
    return np.flatnonzero(starts)


class PieceEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = self.byte_lengths()
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def byte_lengths(self) -> np.ndarray:
        """Bytes of each id. The vocabulary writes every byte as one character; a special token stands for its string."""
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        out = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = len(token.encode()) if token in self.special else len(token)
        return out

    def whole(self, text: str) -> np.ndarray:
        (one,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without places in the text
        return np.array(one.ids, "<u4")

    def _learn(self, keys: list[int], raw: bytes, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> None:
        """Remember the ids of new pieces. Words with a blank in front (``word``) are encoded in one text, which is cut at
        the same places, and told apart by their bytes; other pieces one by one."""
        spans = list(zip(keys, starts.tolist(), ends.tolist(), word.tolist(), strict=True))
        joined = b"".join([raw[s:e] for _, s, e, w in spans if w])
        if joined:
            ids = self.whole(joined.decode())
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum((ends - starts)[word])) + 1
            packed, stops = ids.tobytes(), (4 * stops).tolist()
            self.known.update(zip([key for key, _, _, w in spans if w],
                                  [packed[s:e] for s, e in zip([0, *stops], stops)], strict=True))
        others = [(key, raw[s:e].decode()) for key, s, e, w in spans if not w]
        got = self.tokenizer.encode_batch_fast([p for _, p in others], add_special_tokens=False)
        for (key, _), one in zip(others, got, strict=True):
            self.known[key] = np.array(one.ids, "<u4").tobytes()

    def __call__(self, chunk: Chunk) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text of the chunk."""
        data, offsets = chunk.data, chunk.offsets
        n = chunk.last - chunk.first
        kinds = byte_classes(data)
        odd = np.concatenate([[0], np.cumsum(kinds == UNSETTLED)])[offsets]
        slow = odd[1:] > odd[:-1]
        raw = data.tobytes()
        for special in self.special:
            if special.encode() in raw:
                slow |= np.array([special.encode() in raw[offsets[i]:offsets[i + 1]] for i in range(n)])
        starts = piece_starts(data, offsets, kinds)
        ends = np.append(starts[1:], len(data))
        if slow.any():
            quick = ~slow[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[quick], ends[quick]
        firsts = np.searchsorted(starts, offsets)
        keys, one, number = np.unique(SpanHashes(data, _VALUES)(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = {}, self.known
        keys = keys.tolist()
        ids = list(map(self.known.get, keys))
        missing = [k for k, found in enumerate(ids) if found is None]
        new = []
        for k in missing:
            if keys[k] in self.older:
                self.known[keys[k]] = self.older[keys[k]]
            else:
                new.append(k)
        if new:
            at, stop = starts[one[new]], ends[one[new]]
            self._learn([keys[k] for k in new], raw, at, stop, (data[at] == 32) & (kinds[stop - 1] == LETTER))
        for k in missing:
            ids[k] = self.known[keys[k]]
        pool = np.frombuffer(b"".join(ids), "<u4")
        counts = np.array([len(i) for i in ids], np.int64) // 4
        begin = (np.cumsum(counts) - counts)[number]
        counts = counts[number]
        upto = np.concatenate([[0], np.cumsum(counts)])
        flat = pool[np.repeat(begin - upto[:-1], counts) + np.arange(upto[-1])]
        edges = upto[firsts]
        return [self.whole(raw[offsets[i]:offsets[i + 1]].decode()) if slow[i] else flat[edges[i]:edges[i + 1]]
                for i in range(n)]
