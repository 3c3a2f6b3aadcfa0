"""Byte-level BPE by per-prefix dynamic programming, and its inverse.

For every prefix of a pre-token the last token of its (unique) BPE encoding is stored. The candidates are the vocabulary
entries that end at that position, which a suffix-matching automaton reports longest first; a candidate t after the prefix
p is the right one iff last(p) and t are compatible, that is, iff BPE would leave the pair unmerged and uncut. Following
the back-pointers from the end yields exactly the ids that the merge loop yields.

Defined cases: null text encodes as the empty text (no ids, digest of nothing); a null doc_id is passed on; repeated rows
give repeated results; an empty table gives an empty table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import read_table

#: The pre-tokeniser's pattern (fixed value of byte-level BPE files).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers at most, and the longest one worth remembering; pair tests remembered at most.
CACHE_WORDS, CACHE_CHARS = 600_000, 64
CACHE_PAIRS = 500_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        d = json.loads(spec)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = d["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        # Internal numbers follow merge order: single bytes first, then one per merge.
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        number = {bytes([b]): b for b in range(256)}
        self.merged: dict[int, int] = {}
        for a, b in pairs:
            x, y = as_bytes(a), as_bytes(b)
            k, new = (number[x] << 20) | number[y], len(self.parts)
            if k not in self.merged:
                self.merged[k] = number.setdefault(x + y, new)
            self.parts.append((number[x], number[y]))
        by_bytes = {as_bytes(s): i for s, i in vocab.items() if all(c in letters for c in s)}
        self.packed = {n: int(by_bytes[t]).to_bytes(4, "little") for t, n in number.items() if t in by_bytes}
        self.bytes_of = {i: t for t, i in by_bytes.items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, n in number.items():
            self.machine.add_word(t.decode("latin-1"), (n, len(t)))
        self.machine.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of left's and right's bytes together is just the two: no merge across the cut comes up early enough."""
        key = (left << 20) | right
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the latest merge on either side, again and again; `before` is the number of the merge undone last. A merge
        # across the cut that has a smaller number would have happened first.
        before = 1 << 30
        while True:
            across = self.merged.get((left << 20) | right)
            if across is not None and across < before:
                return False
            open_left, open_right = left > 255, right > 255
            if not (open_left or open_right):
                return True
            if open_left and (left > right or not open_right):
                before, left = left, self.parts[left][1]
            else:
                # on the right a merge with the same number as the one across comes later, being further right
                before, right = right + 1, self.parts[right][0]

    def word(self, w: str) -> bytes:
        """Ids of one pre-token, little-endian, four bytes each."""
        s = w.encode("utf-8").decode("latin-1")
        n = len(s)
        last, size, fits, known = [-1] * (n + 1), [0] * (n + 1), self.compatible, self.fits.get
        for end, (token, length) in self.machine.iter(s):
            e = end + 1
            if last[e] < 0:
                start = e - length
                if start:
                    ok = known((last[start] << 20) | token)
                    if ok is None:
                        ok = fits(last[start], token)
                    if not ok:
                        continue
                last[e], size[e] = token, length
        out, e = [], n
        while e:
            out.append(self.packed[last[e]])
            e -= size[e]
        return b"".join(out[::-1])

    def _plain(self, text: str) -> bytes:
        known, found = self.words, self.find(text)
        if len(known) >= CACHE_WORDS:
            known.clear()
        new = set(found).difference(known)
        for w in new:
            known[w] = self.word(w)
        out = b"".join(map(known.__getitem__, found))
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_codecs: dict[int, Codec] = {}


def _codec(spec) -> Codec:
    key = hash(spec.value)
    if key not in _codecs:
        _codecs[key] = Codec(spec.value)
    return _codecs[key]


def _shared(spark: SparkSession, vocabulary: str | None):
    """The vocabulary file's text (1.5 MB, whatever the input), read once on the driver."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with a column ids array<int>: the token ids of each text."""
    spec = _shared(df.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = _codec(spec)
        return texts.map(lambda t: np.frombuffer(codec.encode(t), "<u4").astype("int32"))

    return df.withColumn("ids", ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """df with a column decoded: the text of each row of ids (null: empty)."""
    spec = _shared(df.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def decoded(rows):
        codec = _codec(spec)
        return rows.map(lambda x: codec.decode(np.asarray([] if x is None else x, "<u4").tobytes()))

    return df.withColumn("decoded", decoded(F.col(ids)))


def encode_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, in one pass without a shuffle."""
    spec = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids array<int>, round_trip): round_trip says that decoding gives the text back."""
    spec = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = part.column(3).to_pylist()
                packed = [codec.encode(t) for t in texts]
                same = [codec.decode(ids) == (t or "") for ids, t in zip(packed, texts, strict=True)]
                n = np.array([len(x) // 4 for x in packed], np.int64)
                flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(n), ids, pa.array(same)], ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, round_trip boolean")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(read_table(spark, sf_dir, "documents"))
