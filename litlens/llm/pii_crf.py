"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels through a document.

Patterns (base spans) find emails, IPv4 addresses, payment cards and phone numbers. The field's nodes are a document's tokens
that hold a digit or an at sign. Neighbouring tokens share chain potentials; tokens with the same normal form (their digits,
or their letters and digits in lower case), or with the same last seven digits, share skip potentials however far apart they
are, each linked to the previous one of its form, so links grow with the tokens and not with their pairs. Loopy sum-product
message passing runs on all documents of a batch at once. A token outside the base spans whose marginal for a kind reaches
`accept` becomes a further span; base spans are observed and always stay.

Weights are trained here: the unary ones by a softmax regression of base labels on token shapes (without the checks that the
patterns make), chain and skip ones from smoothed counts of label pairs, on at most `max_train` documents with digits, in
the order of a hash of their ids.

Defined cases: null text is an empty text without spans; a null doc_id is passed on; repeated rows get equal results; an
empty table gives an empty table (nothing is learned); other columns are ignored. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import read_table

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 3000
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGIT = re.compile(r"[0-9]")
_EDGES = "\"'()[]{}<>,;:.!?|«»“”"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds, then starts."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-9:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, without the marks around them."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        a, b = m.start() + len(t) - len(t.lstrip(_EDGES)), m.end() - (len(t) - len(t.rstrip(_EDGES)))
        if a < b:
            out.append((a, b))
    return out


def shape(t: str) -> list[float]:
    """What a token looks like; nothing that the patterns check beyond form."""
    n = len(_DIGIT.findall(t))
    dots, letters = t.count("."), sum(c.isalpha() for c in t)
    return [1.0, "@" in t, "@" in t and dots > 0, n == len(t), n == 0, 13 <= n <= 19, 7 <= n <= 12, 1 <= n <= 4, dots == 3 and n + 3 == len(t), t[0] == "+", t.count("-") == 1 and n + 1 == len(t), letters / len(t), n / len(t), letters > 0 and n > 0 and "@" not in t, min(len(t), 40) / 40]


def skip_links(words: list[str]) -> list[tuple[int, int]]:
    """Each token with the previous one of its normal form, and with the previous one of its last seven digits."""
    last: dict[str, int] = {}
    out = []
    for i, t in enumerate(words):
        digits = "".join(_DIGIT.findall(t))
        form = digits if len(digits) >= 5 else "".join(c for c in t.lower() if c.isalnum())
        keys = [f"={form}"] if len(form) >= 5 else []
        if len(digits) >= 7:
            keys.append(f"~{digits[-7:]}")
        out += sorted({(last[k], i) for k in keys if k in last})
        last |= dict.fromkeys(keys, i)
    return out


class Field:
    """Potentials of the random field: unary [features, labels], chain and skip [labels, labels]; label 0 is none."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, x: np.ndarray, seen: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 12) -> np.ndarray:
        """x: features; seen: observed label or -1; chain, skip: pairs of nodes. Damped loopy sum-product."""
        k = len(KINDS) + 1
        node = x @ self.unary
        node[seen >= 0] = -30.0
        node[np.flatnonzero(seen >= 0), seen[seen >= 0]] = 0.0
        pairs = np.concatenate([chain, skip]).reshape(-1, 2)
        if not len(pairs):
            return _softmax(node)
        table = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip, (len(skip), k, k))])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        table = np.exp(np.concatenate([table, table.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(src), k))
        for _ in range(rounds):
            belief = node.copy()
            np.add.at(belief, dst, message)
            out = belief[src] - message[back]
            new = np.log(np.einsum("ei,eij->ej", _softmax(out), table) + 1e-12)
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        belief = node.copy()
        np.add.at(belief, dst, message)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _labels(spans: list[tuple[int, int, int]], found: list[tuple[int, int]]) -> np.ndarray:
    """Label of each token: the first kind with a base span that overlaps it, else 0."""
    out = np.zeros(len(found), np.int64)
    starts = np.array([a for a, _ in found])
    for kind, a, b in reversed(spans):
        i = int(np.searchsorted(starts, a, side="right")) - 1
        for j in range(max(i, 0), len(found)):
            if found[j][0] >= b:
                break
            if found[j][1] > a:
                out[j] = kind + 1
    return out


def train(texts: list[str], rounds: int = 150) -> Field:
    k = len(KINDS) + 1
    xs, ys, chain, skip = [], [], np.ones((k, k)), np.ones((k, k))
    for text in texts:
        found = tokens(text)
        if not found:
            continue
        words = [text[a:b] for a, b in found]
        y = _labels(base_spans(text), found)
        xs += [shape(w) for w in words]
        ys.append(y)
        np.add.at(chain, (y[:-1], y[1:]), 1)
        for i, j in skip_links(words):
            skip[y[i], y[j]] += 1
    width = len(shape("0"))
    x, y = (np.array(xs, float), np.concatenate(ys)) if ys else (np.zeros((0, width)), np.zeros(0, np.int64))
    w = np.zeros((width, k))
    target = np.eye(k)[y]
    for _ in range(rounds if len(y) else 0):
        w += 2.0 * (x.T @ (target - _softmax(x @ w)) / len(y) - 1e-3 * w)
    w[0, 0] += 0.0 if len(y) else 5.0
    share = lambda m: np.log(m / m.sum() / (m.sum(1, keepdims=True) / m.sum()) / (m.sum(0, keepdims=True) / m.sum()))
    skip = (skip + skip.T) / 2
    return Field(w, np.clip(share(chain), -2, 2), np.clip(share(skip), -4, 4))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Field:
    """The field trained on some documents with digits: their ids are drawn first, so that tasks send ids and not texts."""
    ids = docs.filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_train).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most max_train ids
    return train([r["text"] for r in some.orderBy("doc_id").collect()])


def find(docs: DataFrame, field: Field, accept: float = 0.8) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def part(texts: list[str | None]) -> tuple[list, list]:
        base, added, x, seen, chain, skip, where = [], [], [], [], [], [], []
        for i, text in enumerate(texts):
            base.append([])
            added.append([])
            if not text or not _MARKED.search(text):
                continue
            base[i] = base_spans(text)
            found = tokens(text)
            if not found:
                continue
            words = [text[a:b] for a, b in found]
            links = skip_links(words)
            if not links and not base[i]:
                continue  # nothing observed, nothing to carry
            y, at = _labels(base[i], found), len(where)
            x += [shape(w) for w in words]
            seen.append(np.where(y > 0, y, -1))
            chain += [(at + j, at + j + 1) for j in range(len(found) - 1)]
            skip += [(at + a, at + b) for a, b in links]
            where += [(i, *f) for f in found]
        if where:
            seen = np.concatenate(seen)
            grid = lambda p: np.array(p, np.int64).reshape(-1, 2)
            m = shared.value.marginals(np.array(x, float), seen, grid(chain), grid(skip))
            best = m[:, 1:].argmax(1) + 1
            for n in np.flatnonzero((seen < 0) & (m[np.arange(len(m)), best] >= accept)):
                i, a, b = where[n]
                added[i].append((int(best[n]) - 1, a, b))
        return base, added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base, added = [], []
            for a in range(0, len(texts), 500):
                b, c = part(texts[a : a + 500])
                base += b
                added += c
            rows = lambda s: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x] for x in s], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows(base), rows(added)], ["doc_id", "base", "added"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<kind: string, start: long, end: long>>"
    return slim.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def written(spans: Column) -> Column:
    """kind:start:end of spans, by kind as listed, then start, joined by commas."""
    rank = lambda kind: F.when(kind == "email", 0).when(kind == "ip", 1).when(kind == "card", 2).otherwise(3)
    key = F.transform(spans, lambda s: F.struct(rank(s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("n")))
    return F.array_join(F.transform(F.array_sort(key), lambda s: F.concat_ws(":", s["n"], s["a"], s["b"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


