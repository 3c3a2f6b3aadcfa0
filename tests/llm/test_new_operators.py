"""License scan, conversation repair and importance resampling against brute force, and their defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from litlens.llm import conversations, importance, licenses
from litlens.llm.common import read_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]


# 11 licenses


def naive_base(text):
    w, found = words_of(text), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_base_of_every_document(spark, sf):
    got = {r["doc_id"]: r for r in licenses.op11_license_scan(spark, sf).collect()}
    want = {d: naive_base(t) for d, t in texts_of(spark, sf)}
    assert {d: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for d, r in got.items()} == want
    assert any(n for _, n, *_ in want.values())


def test_licenses_cases(spark, docs, edge):
    bsd = next(p for p, x in licenses.NOTICES if x == "bsd")
    shifted = bsd.replace("source and", "source code and").replace("with or ", "with ")
    rows = [(20, "CC-BY cc by, CcKBY cc BY"), (21, f"intro {bsd.upper()} end"), (22, f"so {shifted} end"), (23, " ".join(sorted(bsd.split()))), (24, "Released under the Mit Licenſe. released under the mit license!"), (25, "ccé by cc byé"), (26, "cc by " * 5000), (27, "General Public License " * 2), (27, "General Public License " * 2)]
    d = docs(edge + rows)
    out = licenses.scan(d, licenses.templates(spark)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(edge) + len(rows) and set(d.columns) - {"score"} <= set(out[0].asDict())
    for i, t in [(i, t) for i, t in edge + rows if i is not None]:
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == naive_base(t), i
    assert got[21]["labels"] == "bsd" and got[21]["score"] == 1.0
    assert got[22]["labels"] == "bsd" and 0.75 <= got[22]["score"] < 1
    assert got[23]["labels"] == "" and got[23]["score"] == 0
    assert got[24]["labels"] == "mit" and got[26]["n_base"] == 5000 and got[0]["n_words"] == 0
    assert licenses.scan(docs([]), licenses.templates(spark)).count() == 0
    kelvin = licenses.scan(docs([(1, "o\u212a go"), (2, "Ok GO"), (3, "\u0130k go")]), licenses.templates(spark, (("ok go", "x"), ("ik go", "y")), ()))
    assert sorted((r["doc_id"], r["base_labels"]) for r in kelvin.collect()) == [(1, ""), (2, "x"), (3, "")]


def test_licenses_without_broadcast_and_native(spark, docs, edge):
    rows = [(i, f"{p} and {q}") for i, ((p, _), (q, _)) in enumerate(itertools.product(licenses.BASE + licenses.NOTICES, repeat=2))]
    one = licenses.scan(docs(rows), licenses.templates(spark), keep=("doc_id",))
    two = licenses.scan(docs(rows), licenses.templates(spark), keep=("doc_id",), max_broadcast=0)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert not re.search("Python|Pandas|Arrow", one._jdf.queryExecution().toString().split("== Physical Plan ==")[1])


# 12 conversations


def naive_costs(rows):
    """Cheapest (cost, audit) and repaired turns by a search over all edits: best at each (point, rows used)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    layer = {0: (0, "", ())}

    def put(to, p, x):
        if p not in to or x[:2] < to[p][:2]:
            to[p] = x

    def insert(layer):
        for _ in range(4):
            for p, (c, a, out) in list(layer.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    if (p, i) in step:
                        put(layer, step[p, i], (c + 3, a + "I", (*out, (role, ""))))
        return layer

    insert(layer)
    for role, text, fault in rows:
        new = {}
        for p, (c, a, out) in layer.items():
            put(new, p, (c + 4, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (p, role[:1]) in step:
                put(new, step[p, role[:1]], (c + more, a + "K", (*out, (role, text))))
            for i, r in (("u", "user"), ("a", "assistant")):
                if (p, i) in step:
                    put(new, step[p, i], (c + 3 + more, a + "R", (*out, (r, text))))
        layer = insert(new)
    return min(layer[p] for p in (0, 3) if p in layer)


def naive_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out, n = set(), [], dict.fromkeys(conversations.COUNTS, 0)
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        out.append((role, text, fault))
    n["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, turned = naive_costs(out)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turned).encode()).hexdigest()
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **n, "cost": cost, "audit": audit, "repaired_sha256": sha}


def naive_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        some = out.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        role, text, case = name(role), name(text), zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        some += [(turn, "user" if case == 4 else role, text)] * (1 + (case == 3))
    return out


def checked(spark, rows, cols="conv_id long, turn long, role string, text string"):
    table = spark.createDataFrame(rows, cols).repartition(3)
    placed, heads = conversations.repair(conversations.damage(table), table.select(F.col("conv_id").alias("conv")))
    got = {r["conv"]: {k: v for k, v in r.asDict().items() if k not in ("conv", "at")} for r in conversations.digests(placed, heads).collect()}
    want = {c: naive_conversation(some) for c, some in naive_damage([r[:4] for r in rows]).items()}
    assert got == want
    return placed, heads


def test_conversations_query(spark, sf):
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in conversations.op12_conversation_repair(spark, sf).collect()}
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got == {c: naive_conversation(some) for c, some in naive_damage(rows).items()}


def test_conversations_fuzz_and_cases(spark):
    rnd = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn // 2]), rnd.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rnd.choice(["Yes.", "No", "", " \n", "Why?", None, f"text {turn}!", "a.\n"]), 1.5, 7, "x"))
    # a conversation over all partitions, of which many rows are equal
    rows += [(99, t, ("user", "assistant")[t % 2] if t % 7 else "user", "Same." if t % 3 else f"line {t}", 1.5, 7, "x") for t in range(700)]
    rows += [(98, 3, "user", "Again and again.", 1.5, 7, "x")] * 300
    placed, heads = checked(spark, rows, "conv_id long, turn long, role string, text string, conv double, at long, cost string")
    turns = conversations.repaired_turns(placed, heads)
    legal = turns.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("role", 1, 1).alias("i")))), lambda x: x["i"]), "").alias("roles"))
    assert all(re.fullmatch("(s?(ua)+)?", r["roles"]) for r in legal.collect())
    checked(spark, [])


def all_splits(kinds):
    """The chart with every span and every split."""
    n = len(kinds)
    chart = {(i, i + 1): conversations.turn_cell(k) for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = {}
            for k in range(i + 1, i + size):
                for pair, x in conversations.combine(chart[i, k], chart[k, i + size]).items():
                    conversations.better(cell, pair, *x)
            chart[i, i + size] = cell
    return chart[0, n]


def test_one_split_of_a_span_is_enough():
    rnd = random.Random(8)
    for _ in range(120):
        kinds = "".join(rnd.choice("suaxSUAXd") for _ in range(rnd.randint(1, 24)))
        assert conversations.parse(kinds) == all_splits(kinds), kinds


# 13 importance


def naive_importance(docs, target, percent=25, buckets=10_000):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_importance_query(spark, sf):
    target = [r["text"] for r in read_table(spark, sf, "benchmark").collect()]
    got = importance.op13_importance(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == naive_importance(texts_of(spark, sf), target)


def test_importance_cases(spark, docs, edge):
    rnd = random.Random(2)
    rows = edge + [(100 + i, " ".join(rnd.choice(["éa", "Word", "x1", "y" * rnd.choice([1, 63, 64, 65, 900]), "--", "\x00", "\n"]) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    bench = spark.createDataFrame([(1, "one two w5 w6 w7"), (2, None), (3, "")], "item_id long, text string")
    out = importance.resample(docs(rows), bench)
    assert {"node", "_may", "lang"} <= set(out.columns)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()), key=repr)
    assert got == naive_importance(rows, ["one two w5 w6 w7", None, ""])
    assert importance.resample(docs([]), bench).count() == 0
    assert importance.resample(docs(rows), bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_stay_in_their_document(n):
    texts = [b"", b"a b", b"c", b"", b"d E f", b"\xc3\xa9"]
    bucket, owner, n_words = importance.features(texts, n, 1 << 32)
    want = [(i, zlib.crc32(b" ".join(w[a : a + k]))) for i, t in enumerate(texts) for w in [t.lower().split()] for k in range(1, n + 1) for a in range(len(w) - k + 1)]
    assert sorted(zip(owner.tolist(), bucket.tolist(), strict=True)) == sorted(want) and n_words.tolist() == [0, 2, 1, 0, 3, 1]
