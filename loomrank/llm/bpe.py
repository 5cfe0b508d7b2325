"""BPE encoding and decoding with content-defined chunk reuse.

Every text is cut where a rolling hash over its last 32 bytes says so. A chunk that any text
brought before is not encoded again (a bounded memo in each Python worker, which lives on from task
to task and lets go of what was longest not used). A cut may fall inside a word, so each join is
repaired: a window around it is encoded anew and grown to both sides, as often as it takes, until
both its ends agree with token boundaries of the chunks at places where any encoding must break,
and only then spliced in.

Such a place is the end of a character of any script that isn't white space, before a blank; or, for
scripts without blanks, that of a Chinese character before a comma or full stop of its own: the
pre-tokenizer's pattern never lets a piece run on there, and looks at nothing before a piece, so
tokens left and right of it don't depend on the other side.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, pieces, text_bytes, widened

CHUNK_BITS = 10  # a cut every 1,024 bytes on average
WINDOW = 32
MEMO_BYTES = 48 << 20

# Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Ends of places as told above, in UTF-8. Behind the first bracket: the white space beyond ASCII. U+4E00 to U+8FFF are letters to every version of the property.
_SAFE = re.compile(rb"[^\s\x1c-\x1f](?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)(?= )"
                   rb"|(?:\xe4[\xb8-\xbf]|[\xe5-\xe8][\x80-\xbf])[\x80-\xbf](?=\xe3\x80[\x81\x82]|\xef\xbc\x8c)")
LONG = 4096
# The characters of the property White_Space. The pattern's look-ahead would take a long run of them one by one on a stack.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones as themselves, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes whole texts by the vocabulary file at `path`."""

    def __init__(self, path: str, chunk_bits: int = CHUNK_BITS, memo_bytes: int = MEMO_BYTES):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told.get("normalizer") or told["model"]["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        letters, vocab = byte_letters(), told["model"]["vocab"]
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
        for i, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if vocab[a + b] != 256 + i:
                raise ValueError("ids must follow the order of the merges")
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for word, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = word
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("special tokens must stand for themselves")
        self.special = {s.encode(): i for s, i in special.items()}
        self.special_at = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")") if special else re.compile(rb"(?!)")
        self.mask, self.memo_bytes = np.uint32((1 << chunk_bits) - 1 << 32 - chunk_bits), memo_bytes
        self.memo: dict[bytes, np.ndarray] = {}
        self.held = self.encoded = self.reused = self.handed = 0

    def encode_whole(self, data: bytes) -> np.ndarray:
        """Of a text that holds special tokens: the stretches between them on their own."""
        parts = self.special_at.split(data)  # odd ones are special tokens
        return np.concatenate([np.array([self.special[x]], np.int32) if i % 2 else self.encode_bytes(x) for i, x in enumerate(parts)])

    def encode_bytes(self, data: bytes) -> np.ndarray:
        """Of a stretch without special tokens. A long run of white space is a piece but for its last character, which belongs to what follows."""
        text = data.decode("utf-8")
        self.handed += len(data)
        if len(data) < LONG or not (found := list(_LONG_SPACE.finditer(text))):
            return np.array(self.engine.encode_ordinary(text), np.int32)
        out, done = [], 0
        for run in found:
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [self.engine.encode_ordinary(text[done : run.start()]), self.engine._core_bpe.encode_single_piece(text[run.start() : end].encode())]
            done = end
        return np.concatenate([np.array(x, np.int32) for x in [*out, self.engine.encode_ordinary(text[done:])]])

    def chunk(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk, and where its tokens end, from 0 on."""
        got = self.memo.get(data)
        if got is None:
            ids = self.encode_bytes(data)
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(self.length[ids], out=ends[1:])
            got = ids, ends
            self.encoded += 1
            self.memo[data] = got
            self.held += len(data) + 2 * ids.nbytes + 400
            while self.held > self.memo_bytes and len(self.memo) > 1:
                oldest = next(iter(self.memo))
                self.held -= len(oldest) + 2 * self.memo.pop(oldest)[0].nbytes + 400
        else:
            self.reused += 1
            self.memo[data] = self.memo.pop(data)  # used last
        return got

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where the rolling hash of the 32 bytes before a place has its upper bits 0, at the start of a character."""
        h = BYTE[data].astype(np.uint32)
        step = 1
        while step < WINDOW:  # h[i] = sum of table[byte[i - j]] * 2^j for j < step, doubled
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
        at = np.flatnonzero(h & self.mask == 0) + 1
        at = at[at < len(data)]
        return at[(data[at] & 0xC0) != 0x80]

    def encode(self, data: bytes, cuts: list[int]) -> np.ndarray:
        """Ids of a whole text, given the places at which it may be cut."""
        if not cuts:
            return self.chunk(data)[0] if data else np.zeros(0, np.int32)
        edges = [0, *cuts, len(data)]
        chunks = [self.chunk(data[a:b]) for a, b in zip(edges, edges[1:])]
        out, done, i, n = [], 0, 0, len(chunks)  # everything before byte `done`, in chunk i, is in out
        skip = 0  # tokens of chunk i before `done`
        while i < n - 1:
            ids, ends = chunks[i]
            left, right, k = edges[i + 1], edges[i + 1], i + 1
            while True:  # grow to both sides until they agree; the start of what is open and the end of the text always do
                left = self._left(data, done, left) or done
                while (further := self._right(data, max(right, edges[k]), edges[k + 1])) is None and k < n - 1:
                    k += 1
                right = len(data) if further is None else further
                q, p = int(ends.searchsorted(left - edges[i])), int(chunks[k][1].searchsorted(right - edges[k]))
                if ends[q] == left - edges[i] and chunks[k][1][p] == right - edges[k]:
                    break
            out += [ids[skip:q], self.encode_bytes(data[left:right])]
            done, i, skip = right, k, p
        out.append(chunks[i][0][skip:])
        return np.concatenate(out)

    @staticmethod
    def _left(data: bytes, low: int, cut: int) -> int | None:
        """The last safe place between low and cut, at which the left chunk's own tokens break too; looked for from the cut back, in wider and wider stretches."""
        width = 256
        while True:
            begin = max(low, cut - width)
            last = None
            for last in _SAFE.finditer(data, begin, cut):
                pass
            if last is not None:
                return last.end()
            if begin == low:
                return None
            width *= 8

    @staticmethod
    def _right(data: bytes, cut: int, high: int) -> int | None:
        """The first safe place in the chunk cut..high; its own encoding breaks there too."""
        found = _SAFE.search(data, cut, high)
        return found.end() if found else None

    def decode(self, ids: np.ndarray) -> str:
        b = self.bytes_of
        return b"".join([b[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


_codecs: dict[tuple, Codec] = {}


def codec(path: str, *more) -> Codec:
    """One codec, with its memo, for each worker process."""
    key = (path, *more)
    if key not in _codecs:
        _codecs[key] = Codec(path, *more)
    return _codecs[key]


def _encoded(c: Codec, column: pa.Array) -> Iterator[np.ndarray]:
    data, off = text_bytes(column)
    raw, cuts = data.tobytes(), c.cuts(data)
    low, high = np.searchsorted(cuts, off[:-1] + WINDOW), np.searchsorted(cuts, off[1:])
    special = c.special_at.search(raw) is not None
    for i in range(len(column)):
        a, b = int(off[i]), int(off[i + 1])
        text = raw[a:b]
        if special and c.special_at.search(text):
            yield c.encode_whole(text)  # a cut could split a special token
        else:
            yield c.encode(text, (cuts[low[i] : high[i]] - a).tolist())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """Adds column `out`, the array of ids of the whole text; null text encodes as empty.

    With `check`, a column of that name tells whether the decoded ids are the text again.

    A map over partitions: no shuffle, state bounded by MEMO_BYTES a worker. A column named `out`
    is replaced; all others pass through, repeated rows included. The vocabulary file's path must
    be readable on the executors.
    """
    more = {out: "array<int>"} | ({check: "boolean"} if check else {})
    docs = docs.drop(*more)
    at = docs.columns.index(text)

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in pieces(batch, at):
                ids = list(_encoded(c, part.column(at)))
                new = [pa.array(ids, pa.list_(pa.int32()))]
                if check:
                    new.append(pa.array([c.decode(x) == (t.as_py() or "") for x, t in zip(ids, part.column(at))], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *more])

    return docs.mapInArrow(run, widened(docs, **more))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds column `out`, the text of the ids; null ids decode as empty. No shuffle."""
    tokens = tokens.drop(out)
    at = tokens.columns.index(ids)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return tokens.mapInArrow(run, widened(tokens, **{out: "string"}))


def round_trip(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per row the columns `keep` and n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without passing ids between processes."""
    docs = docs.select(*(keep or ["doc_id"]), F.col(text).alias("_text"))
    kept = docs.columns[:-1]
    kind = widened(docs.drop("_text"), n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def run(batches):
        c = codec(path)
        at = len(kept)
        for batch in batches:
            for part in pieces(batch, at):
                n, a, b = [], [], []
                for ids in _encoded(c, part.column(at)):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join([c.decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, kind)


def default_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))
