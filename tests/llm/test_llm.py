"""The ten operators against brute force, held-out accuracy or exact round trips, and their defined cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litlens.llm import bpe, decontaminate, fuzzy_lines, hnsw, jaccard, pii_crf, rule_quality, suffix_dedup, token_rollup, url_templates
from litlens.llm.common import components, read_table, shared_folder


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]


# 1 PII


def naive_spans(t):
    def luhn(x):
        return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(map(int, x[::-1]))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_pii_base_spans_fuzz():
    rnd = random.Random(3)
    parts = ["a", "b.", "@", "@", ".c", "_", "1", "22", ".", "256", " ", "+", "-", "4111111111111111", "(", ")", "+1 555 1234567", "é", "\n", "%"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        assert [(pii_crf.KINDS[k], a, b) for k, a, b in pii_crf.base_spans(t)] == naive_spans(t), t


def test_pii_query_and_cases(spark, sf, docs, edge):
    got = pii_crf.op1_pii_crf(spark, sf).collect()
    want = {d: ",".join(f"{k}:{a}:{b}" for k, a, b in naive_spans(t)) for d, t in texts_of(spark, sf)}
    assert len(got) == len(want) and all(hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() == r["base_sha256"] for r in got)
    d = docs(edge)
    assert pii_crf.find(d, pii_crf.fit(d)).count() == len(edge)
    assert pii_crf.find(docs([]), pii_crf.fit(docs([]))).count() == 0


def test_pii_skip_links_carry_labels():
    known = ["mail me 4111111111111111 and 4111111111111111"] * 40 + ["page 12 of 340 in 2020"] * 40
    field = pii_crf.train(known)
    x = np.array([pii_crf.shape("4111111111111111"), pii_crf.shape("4111111111111112")], float)
    alone = field.marginals(x, np.array([-1, -1]), np.empty((0, 2), int), np.empty((0, 2), int))
    linked = field.marginals(x, np.array([3, -1]), np.empty((0, 2), int), np.array([[0, 1]]))
    assert linked[1, 3] > alone[1, 3]


# 2 token rollup


def test_rollup_is_idempotent(spark):
    cols = "doc_id long, source string, lang string, tokenizer string, op string, tokens long, old_tokens long"
    first = spark.createDataFrame([(1, "a", "en", "t", "insert", 10, None), (2, None, "en", "t", "insert", None, None), (3, "a", "en", "t", "insert", 5, None)], cols)
    second = spark.createDataFrame([(1, "a", "en", "t", "revise", 12, 10), (3, "a", "en", "t", "delete", 5, None)], cols)
    r = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-test")
    assert r.totals().count() == 0
    assert [r.apply(1, first), r.apply(2, second), r.apply(2, second), r.apply(3, second.limit(0))] == [True, True, False, True]
    assert sorted((x["source"] or "", x["docs"], x["tokens"]) for x in r.totals().collect()) == [("", 1, 0), ("a", 1, 12)]


# 3 decontamination


def test_decontamination(spark, docs, edge):
    item = " ".join(WORDS_A)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    rows = [(10, f"before {item} after"), (11, "nothing here"), (12, "A TINY, item!"), (13, item.replace("alpha20", "beta"))]
    d = docs([*rows, *edge])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(d, bench).collect()}
    assert set(got) >= {(10, 1), (12, 4)} and got[10, 1] == 1.0 and not any(k[0] == 11 for k in got)
    kept = decontaminate.remove(d, bench)
    assert kept.columns == d.columns
    assert kept.filter("doc_id IN (10, 12)").count() == 0 and kept.count() == len(rows) + len(edge) - len({k[0] for k in got})


WORDS_A = [f"alpha{i}" for i in range(40)]


def test_decontamination_finds_all_verbatim(spark, sf):
    items = {r["item_id"]: r["text"] for r in read_table(spark, sf, "benchmark").collect()}
    want = {(d, i) for d, t in texts_of(spark, sf) for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op3_decontaminate(spark, sf).collect()}
    assert want <= got


def naive_matches(texts, items, threshold=0.8):
    """{(document, item): best similarity} over all windows, weights over all items."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    sized = {i: words(t) for i, t in items.items() if words(t)}
    sets = {i: collections.Counter(grams(w, min(5, len(w)))) for i, w in sized.items()}
    df, n = collections.Counter(g for s in sets.values() for g in s), len(sets)
    weight = lambda g: np.log1p(n / df[g]) if g in df else np.log1p(n)
    out = {}
    for d, t in texts.items():
        w = words(t)
        for i, s in sets.items():
            size, k = min(len(sized[i]), len(w)), min(5, len(sized[i]))
            for a in range(len(w) - size + 1):
                x = collections.Counter(grams(w[a : a + size], k))
                low = sum(weight(g) * min(c, s[g]) for g, c in x.items())
                high = sum(weight(g) * max(x[g], s[g]) for g in x | s)
                if low and low / high >= threshold:
                    out[d, i] = max(out.get((d, i), 0), low / high)
    return out


@pytest.mark.parametrize("shard", [3, 2048])
def test_decontamination_brute_force(spark, docs, monkeypatch, shard):
    """Items that share phrases, with words changed, at similarities around the threshold; matches don't depend on shards."""
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    rnd = random.Random(12)
    word = lambda: f"v{rnd.randint(1, 300)}"
    common = [word() for _ in range(12)]
    items = {i: " ".join([*common[: rnd.choice([0, 6, 12])], *(word() for _ in range(rnd.randint(3, 40)))]) for i in range(14)}
    texts = {}
    for d in range(60):
        w = items[rnd.randrange(14)].split()
        for _ in range(rnd.choice([0, 0, 0, 1])):
            w[rnd.randrange(len(w))] = "changed"
        texts[d] = " ".join([*(word() for _ in range(rnd.randint(0, 20))), *w, *(word() for _ in range(rnd.randint(0, 20)))])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = naive_matches(texts, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(docs(list(texts.items())), bench).collect()}
    assert len(want) > 25 and set(got) == {k for k, v in want.items() if v >= 0.8 + 1e-9 or k in got} and set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_multi_index_finds_all_within_radius():
    rnd = np.random.default_rng(1)
    items = decontaminate.Items([(i, " ".join(f"x{rnd.integers(1000)}" for _ in range(12))) for i in range(60)], 0.8, 19)
    probe = items.prints ^ (np.uint64(1) << rnd.integers(0, 64, 60).astype(np.uint64))
    a, b = items.within(probe)
    want = {(i, j) for i in range(60) for j in range(60) if decontaminate.distance(probe[i : i + 1], items.prints[j : j + 1])[0] <= 19}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


# 4 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r["doc_id"]: r for r in rule_quality.op4_rule_quality(spark, sf).collect()}
    held = [(scores[r["doc_id"]], r["quality"]) for r in read_table(spark, sf, "labels").collect() if scores[r["doc_id"]]["held_out"]]
    assert len(held) > 30 and all(0 <= s["score"] <= 1 and s["predicted"] == int(s["score"] >= 0.3) for s, _ in held)
    assert sum(s["predicted"] == q for s, q in held) / len(held) > 0.9


def test_quality_cases(spark, docs, edge):
    one = rule_quality.RuleModel(0.3, [(1.0, ((0, True, 2.0),))])
    got = rule_quality.classify(docs(edge), one).select("doc_id", "score").collect()
    assert len(got) == len(edge) and all(0 < r["score"] < 1 for r in got)
    none = rule_quality.fit(docs([]), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.rules == [] and none.intercept == 0.0


def test_tree_paths():
    tree = "Tree\n  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 1.0\n   Else (feature 1 > 2.0)\n    Predict: 0.0\n"
    assert rule_quality.paths(tree) == {((0, False, 1.5),), ((0, True, 1.5),), ((0, True, 1.5), (1, False, 2.0)), ((0, True, 1.5), (1, True, 2.0))}


# 5 suffix dedup


def naive_cut(rows, length=50):
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for i in range(len(b := (t or "").encode()) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = True
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def cut(d):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.cut(d, suffix_dedup.repeated_spans(d)).collect()), key=str)


def test_suffix_dedup_fuzz(spark, docs):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abé ") for _ in range(rnd.choice([10, 30, 49, 50, 51, 80]))) for _ in range(12)] + ["a" * 70, "ab" * 40]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(120)]
    assert cut(docs(rows)) == naive_cut(rows)


def test_suffix_dedup_collisions(docs):
    """Contexts whose hashes of four bits agree differ in bytes; the comparison finds them and the search starts again."""
    rnd = random.Random(6)
    phrase = "the very same phrase of eighteen letters"
    rows = [(i, "".join(rnd.choice("abcdef ") for _ in range(60)) + phrase + "".join(rnd.choice("abcdef ") for _ in range(60))) for i in range(300)]
    rows += [(i + 300, t) for i, t in rows[:40]]
    found = suffix_dedup.find(docs(rows).select("doc_id", "text"), 50, 2, bits=1).cache()
    runs = suffix_dedup.compare_contexts(docs(rows).select("doc_id", "text"), found, 50)
    text = dict(rows)
    got = runs.collect()
    assert got and all(r["same"] == (text[r["doc_id"]][r["begin"] : r["end"]] == text[r["twin"]][r["twin_begin"] : r["twin_begin"] + r["end"] - r["begin"]]) for r in got)
    d = docs(rows)
    assert sorted(map(tuple, suffix_dedup.cut(d, suffix_dedup.repeated_spans(d, bits=1)).drop("kept").collect()), key=str) == naive_cut(rows)


def test_suffix_dedup_cases(docs, edge):
    rows = [r for r in edge if r[0] != 7]
    assert cut(docs(rows)) == naive_cut(rows)
    assert cut(docs([])) == []
    long = [(7, edge[8][1]), (7, edge[8][1]), (9, edge[8][1][1000:1100])]
    assert cut(docs(long)) == naive_cut(long)


def test_suffix_sort_orders():
    rnd = np.random.default_rng(2)
    text = np.concatenate([rnd.integers(97, 99, 600).astype(np.uint8), np.zeros(60, np.uint8)])
    at = np.arange(600)
    order = suffix_dedup.suffix_sort(text, suffix_dedup.prefix_hashes(text), np.zeros(600, int), at, 50)
    keys = [text[i : i + 50].tobytes() for i in order]
    assert keys == sorted(keys)


# 6 fuzzy lines


def test_fuzzy_lines(docs, edge):
    base = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear"
    rows = [(20, f"{base}\nunique line one here"), (21, f"something else entirely\n{base.replace('angry', 'angrY')}"), (22, f"{base} x\n\nlast"), (23, "last")]
    got = {r["doc_id"]: r["text"] for r in fuzzy_lines.dedup(docs(rows)).collect()}
    assert got == {20: rows[0][1], 21: "something else entirely", 22: "\nlast", 23: ""}
    out = fuzzy_lines.dedup(docs(edge))
    assert out.count() == len(edge) and set(docs(edge).columns) <= set(out.columns)
    texts = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert texts[0, None] == 1 and texts[1, ""] == 1 and texts[8, "\n\n  \n"] == 1 and texts[None, edge[7][1]] == 1 and texts[5, ""] == 1
    assert fuzzy_lines.dedup(docs([])).count() == 0


def test_fuzzy_lines_without_blanks(docs):
    """Lines without blanks, near and below a similarity of 0.8: links by brute force."""
    rnd = random.Random(6)
    rows = []
    for i in range(40):
        tail = "".join(rnd.choice("abcdefghijklmnop0123456789") for _ in range(150))
        changed = "".join("#" if j in (35, 75, 115)[: i % 4] else c for j, c in enumerate(tail))
        rows += [(2 * i, f"https://{tail}"), (2 * i + 1, f"https://{changed}")]
    n = fuzzy_lines.GRAM
    grams = [{t[j : j + n] for j in range(len(t) - n + 1)} for _, t in rows]
    near = {b: any(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for a in range(b)) for b in range(len(rows))}
    got = {r["doc_id"]: r["text"] == "" for r in fuzzy_lines.dedup(docs(rows)).collect()}
    assert 15 < sum(near.values()) < 40 and got == near


def test_fuzzy_lines_banding_recall(docs):
    """Pairs just above a similarity of 0.8, of several lengths, with the bands of production."""
    rnd = random.Random(12)
    rows, n = [], fuzzy_lines.GRAM
    for i in range(400):
        a = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.choice([90, 180, 400, 900])))
        b, at = a, 20
        grams = {a[j : j + n] for j in range(len(a) - n + 1)}
        while at < len(a) - 10:  # as many changes as leave a link
            c = b[:at] + "#" + b[at + 1 :]
            other = {c[j : j + n] for j in range(len(c) - n + 1)}
            if len(grams & other) < 0.8 * len(grams | other):
                break
            b, at = c, at + 45
        rows += [(2 * i, "x" + a + "y"), (2 * i + 1, "x" + b + "y")]
    got = {r["doc_id"]: r["text"] == "" for r in fuzzy_lines.dedup(docs(rows)).collect()}
    assert not any(got[2 * i] for i in range(400)) and sum(got[2 * i + 1] for i in range(400)) >= 0.985 * 400


def test_fuzzy_lines_crowded_buckets(docs, monkeypatch):
    """Near pairs in buckets crowded by unlike lines, every line in all buckets: links by brute force."""
    monkeypatch.setattr(fuzzy_lines, "BAND_BITS", 1)
    monkeypatch.setattr(fuzzy_lines, "CROWD", 16)
    rnd = random.Random(7)
    rows = []
    for i in range(40):
        own = "".join(rnd.choice("abcdefghijklmnop0123456789") for _ in range(60))
        rows += [(2 * i, f"notice of the daily server report: {own} end of line"), (2 * i + 1, f"notice of the daily server report: {own[:30]}#{own[30:]} end of line")]
    rnd.shuffle(rows)
    texts = dict(rows)
    n = fuzzy_lines.GRAM
    grams = {i: {t[j : j + n] for j in range(len(t) - n + 1)} for i, t in texts.items()}
    near = {b: any(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for a in range(b)) for b in range(len(rows))}
    got = {r["doc_id"]: r["text"] == "" for r in fuzzy_lines.dedup(docs(rows)).collect()}
    assert sum(near.values()) == 40 and got == near


def test_fuzzy_lines_is_native(spark, sf):
    plan = fuzzy_lines.op6_fuzzy_lines(spark, sf)._jdf.queryExecution().toString() + url_templates.op9_url_templates(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


# 7 Jaccard join


def naive_join(rows):
    upper = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = {d: (t or "").encode().translate(upper).split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def joined(d, **k):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(d, **k).collect()}


@pytest.mark.parametrize("frequent_from", [2, 32])
def test_jaccard_fuzz(docs, frequent_from):
    rnd = random.Random(frequent_from)
    bases = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.choice([3, 8, 30, 120]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(["zz", f"u{i}"])
        rows.append((i, " ".join(w)))
    assert joined(docs(rows), frequent_from=frequent_from) == naive_join(rows)


def test_jaccard_counts_all_links(docs):
    """A group of near copies with different texts: every document links with every other."""
    rows = []
    for i in range(12):
        w = [f"w{j}" for j in range(200)]
        w[10 * i + 5] = f"changed{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join(docs(rows)).collect()}
    assert got == dict.fromkeys(range(12), 11)


def test_jaccard_equal_buckets_are_one(spark):
    """Buckets of the same members are one with the smallest steps; those of one component go."""
    rows = [(s, n, q, n) for s, q in ((1, 5), (2, 3), (3, 9)) for n in (10, 20)] + [(4, 10, 1, 10), (4, 20, 1, 20), (4, 30, 1, 30), (5, 10, 0, 10), (5, 40, 0, 10)]
    got = jaccard.distinct_buckets(spark.createDataFrame(rows, "sig long, node long, q int, component long")).collect()
    buckets = {}
    for r in got:
        buckets.setdefault(r["sig"], set()).add((r["node"], r["q"], r["held"]))
    assert sorted(map(sorted, buckets.values())) == [[(10, 1, 3), (20, 1, 3), (30, 1, 3)], [(10, 3, 2), (20, 3, 2)]]


def test_jaccard_wide_parities_rule_out_unlike_sets(spark):
    """They bound the tokens that two sets do not share, so a link is never ruled out; unlike sets of any size are."""
    rnd = np.random.default_rng(7)
    draw = lambda n: rnd.integers(0, 1 << 63, n, dtype=np.uint64)
    rows, truth = [], []
    for n in (200, 1_500, 2_700, 9_000):
        base = draw(n)
        for gone in (0, n // 9, n):  # similarity 1, about 0.8 and 0
            x, y = np.unique(base), np.unique(np.r_[base[gone:], draw(gone)])
            common = len(np.intersect1d(x, y))
            truth.append(100 * common >= 80 * (len(x) + len(y) - common))
            rows.append((len(rows), len(x), len(y), *[None if p is None else p.tolist() for s in (x, y) for p in jaccard.wide_parities(s)]))
    kinds = ", ".join(f"{c}_{x} array<long>" for x in "ab" for c in jaccard.WIDE)
    got = spark.createDataFrame(rows, f"i int, n_a long, n_b long, {kinds}").select("i", jaccard.wide_room(80).alias("may")).orderBy("i").collect()
    assert [r["may"] for r in got] == truth


@pytest.mark.parametrize("crowd", [2, 1024])
def test_jaccard_last_pairs(docs, monkeypatch, crowd):
    """Links that only the comparison of all that lies in different components of a bucket finds: no further heads, no second
    centre that would do, sizes of several levels, buckets in several parts."""
    monkeypatch.setattr(jaccard, "HEADS", 1)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rnd, rows = random.Random(5), []
    shared = [f"s{j}" for j in range(60)]
    for i in range(40):
        own = [f"o{i // 2}.{j}" for j in range(rnd.choice([150, 190, 240]))] if i % 2 == 0 else [*own[:-1], "x", *[f"y{i}"] * rnd.randint(0, 3)]  # noqa: F821
        rows.append((i, " ".join(shared + own)))
    assert joined(docs(rows), frequent_from=8) == naive_join(rows)


def test_jaccard_cases(docs, edge):
    rows = [r for r in edge if r[0] is not None]
    assert joined(docs(edge)) == naive_join(rows) | {None: (3, None)}
    assert joined(docs([])) == {}


# 8 BPE


def test_bpe_equals_library(spark, sf, docs, edge):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rnd = random.Random(8)
    parts = ["ab ", "the", "ing", "\n", "  ", "\t", "'s", "é", "ß", "漢", "😀", "01", ".,!", "<|endoftext|>", " ", "̀"]
    for text in ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, edge[8][1], ""]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.op8_bpe(spark, sf).collect()}
    for d, t in texts_of(spark, sf)[:60]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    d = docs(edge)
    both = bpe.decode(bpe.encode(d)).select("text", "decoded").collect()
    assert len(both) == len(edge) and all(r["decoded"] == (r["text"] or "") for r in both)
    assert bpe.encode_digest(docs([])).count() == 0 and bpe.tokenize(d).filter("NOT round_trip").count() == 0


# 9 URL templates


def test_url_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/1"), (2, "http://m.example.com/en/1"), (3, "http://a.net/fr/"), (4, None), (5, "no scheme"), (6, "http://x.com"), (7, "http://y.org/en?q#h")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got == {1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("m.example.com", "/en/1", "example.com/en/", "block"), 3: ("a.net", "/fr/", "net/fr/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("x.com", "", None, "allow"), 7: ("y.org", "/en", None, "allow")}


def test_url_templates_block_pure_branches(spark):
    rules = (("block", "h.org", "/bad/1"),)
    rows = [(i, f"http://h.org/bad/1{i}") for i in range(30)] + [(100, "http://h.org/bad/22"), (101, "http://h.org/good/22")] + [(200, "http://k.org/z")]
    got = {r["page_id"]: r["verdict"] for r in url_templates.judge(spark.createDataFrame(rows, "page_id int, url string"), rules=rules).collect()}
    assert got[100] == "block" and set(got) == {r[0] for r in rows}
    assert url_templates.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def naive_templates(rows, rules, max_children=24, strength=4.0, z=1.96):
    """(verdict by template) of rows (id, host, path, said), built and judged without Spark."""
    shape = lambda p: [("*" if re.search(url_templates.IDENTIFIER, s) else s) for s in p.split("/") if s]
    full = [(i, h, shape(p), said) for i, h, p, said in rows]
    template = {(h, tuple(s)): () for _, h, s, _ in full}
    for level in range(max((len(s) for _, _, s, _ in full), default=0)):
        fan = collections.defaultdict(set)
        for (h, s), t in template.items():
            if len(s) > level:
                fan[h, t].add(s[level])
        template = {(h, s): t + (("*" if len(fan[h, t]) > max_children else s[level]),) if len(s) > level else t for (h, s), t in template.items()}
    n, b = collections.Counter(), collections.Counter()
    for _, h, s, said in full:
        t = template[h, tuple(s)]
        for d in range(len(t) + 1):
            n[h, t[:d]] += said is not None
            b[h, t[:d]] += said == "block"
    merged = {}
    for key in {(h, t[:-1], len(t)) for h, t in n if n[h, t]}:
        kin = sorted((b[x] / n[x], x) for x in n if n[x] and (x[0], x[1][:-1], len(x[1])) == key)
        runs = []
        for rate, x in kin:
            if runs:
                y = runs[-1][-1]
                p = (b[x] + b[y]) / (n[x] + n[y])
            if runs and (rate - b[y] / n[y]) ** 2 <= z * z * p * (1 - p) * (1 / n[x] + 1 / n[y]):
                runs[-1].append(x)
            else:
                runs.append([x])
        for run in runs:
            merged |= {x: (sum(n[y] for y in run), sum(b[y] for y in run)) for x in run}
    total = sum(said is not None for *_, said in full)
    prior = sum(said == "block" for *_, said in full) / total if total else 0.0

    domain = lambda h: ".".join(h.split(".")[-2:])

    def purity(h, t):
        of = collections.defaultdict(lambda: [0, 0])
        for x in n:
            if x[1] == t and n[x] and domain(x[0]) != domain(h):
                of[domain(x[0])][0] += n[x]
                of[domain(x[0])][1] += b[x]
        up = (sum(k / m for m, k in of.values()) + strength * prior) / (len(of) + strength)
        m, k = merged.get((h, t), (0, 0))
        return (k + strength * up) / (m + strength) if m or of else 0.0

    return {i: said or ("block" if purity(h, template[h, tuple(s)]) >= 0.8 else "allow") for i, h, s, said in full}


@pytest.mark.parametrize("max_children", [3, 24])
def test_url_templates_brute_force(spark, sf, max_children):
    rnd = random.Random(4)
    pages = [(r["page_id"], r["url"]) for r in read_table(spark, sf, "pages").collect()]
    pages += [(10_000 + i, f"http://{rnd.choice(['a.net', 'b.net', 'c.org'])}/{rnd.choice(['es', 'fr', 'en', 'x1'])}/{rnd.choice('pqrstu')}/{rnd.randint(1, 99)}/a/b/c{'/d' * rnd.randint(0, 2)}") for i in range(300)]
    got = {r["page_id"]: r for r in url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), max_children=max_children).collect()}
    want = naive_templates([(i, r["host"], r["path"], r["verdict"] if r["rule"] else None) for i, r in got.items()], url_templates.RULES, max_children)
    assert {i: r["verdict"] for i, r in got.items()} == want


def test_url_templates_judge_branches_not_hosts(spark):
    """One blocked branch of a host says nothing of its others; the same template elsewhere does."""
    rules = (("block", "h.org", "/bad/"), ("allow", "k.org", "/"), *(("block", f"m{i}.org", "/spam/") for i in range(15)))
    rows = [(i, f"http://h.org/bad/page{i}x") for i in range(30)] + [(1000 + i, f"http://k.org/news/{i}") for i in range(300)]
    rows += [(100, "http://h.org/other/1"), (101, "http://h.org/news/2"), (102, "http://h.org/spam/7"), (103, "http://q.org/spam/7"), (104, "http://q.org/bad")]
    rows += [(200 + 10 * i + j, f"http://m{i}.org/spam/{j}") for i in range(15) for j in range(10)]
    long = "/".join(f"s{i}" for i in range(200))
    rows += [(900, f"http://h.org/{long}"), (901, f"http://h.org/{long}/more")]
    out = {r["page_id"]: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id int, url string"), rules=rules).collect()}
    assert {i: out[i]["verdict"] for i in (100, 101, 102, 103, 104)} == {100: "allow", 101: "allow", 102: "block", 103: "block", 104: "allow"}
    assert out[900]["template"] == out[901]["template"] and out[900]["template"][-1] == "**" and len(out[900]["template"]) == 33
    seen = {(r["rule_says"], r["template_says"]): r["urls"] for r in url_templates.held_out(spark.createDataFrame(rows, "page_id int, url string"), rules=rules).collect()}
    assert sum(seen.values()) > 15 and seen.get(("allow", "block"), 0) == 0


def test_url_columns(spark):
    d = spark.createDataFrame([(1, "http://a.net/fr/x", "mine", 3), (1, "http://a.net/fr/x", "mine", 3), (2, "http://a.net/" + "s/" * 12, None, None)], "page_id int, url string, verdict string, labelled int")
    got = url_templates.judge(d)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "template", "labelled", "purity"]
    assert [r["verdict"] for r in got.orderBy("page_id").collect()][:2] == ["block", "block"]


# 10 HNSW


def test_hnsw_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in read_table(spark, sf, "embeddings").collect()}
    ids, v = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    got = collections.defaultdict(dict)
    for r in hnsw.op10_hnsw(spark, sf).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    hit = 0
    for q, found in got.items():
        s = v @ rows[q]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(found.values()))
        assert sorted(found) == list(range(1, 21))
    assert set(got) == {i for i in rows if i % 20 == 0} and hit / (20 * len(got)) >= 0.9


def test_hnsw_recall_of_groups():
    """Groups of near-equal vectors, larger than the pool of near candidates, against brute force."""
    rnd = np.random.default_rng(1)
    x = (rnd.normal(size=(60, 64))[rnd.integers(0, 60, 4000)] + 0.05 * rnd.normal(size=(4000, 64))).astype(np.float32)
    sq = (x**2).sum(1)
    lifted = np.concatenate([x, np.sqrt(sq.max() - sq)[:, None]], 1)
    q = np.concatenate([x[:150], np.zeros((150, 1), np.float32)], 1)
    found, _ = hnsw.search(q, lifted, *hnsw.build(lifted), 96)
    want = np.argsort(-(q @ lifted.T), axis=1)[:, :20]
    hits = [len(set(f[:20].tolist()) & set(w.tolist())) for f, w in zip(found, want, strict=True)]
    assert min(hits) > 0 and sum(hits) / (20 * len(hits)) >= 0.98


def test_hnsw_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (None, [1.0, 1.0])]
    part = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(part.filter("id % 20 = 0"), hnsw.index(part)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    none = part.limit(0)
    assert hnsw.nearest(none, hnsw.index(none)).count() == 0


# pipeline and shared pieces


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    d = read_table(spark, sf, "documents")
    start = {r["doc_id"] for r in d.select("doc_id").collect()}
    for name, stage in P.STAGES[:4]:
        path = f"{shared_folder(spark)}/stage-{name}"
        stage(spark, d, sf).write.mode("overwrite").parquet(path)
        d = spark.read.parquet(path)
        assert set(d.columns) == set(P.COLUMNS)
    left = {r["doc_id"]: r["text"] for r in d.collect()}
    items = [r["text"] for r in read_table(spark, sf, "benchmark").collect()]
    assert set(left) < start and len(left) > 0.5 * len(start) and not any(x in t for t in left.values() for x in items)
    groups = naive_join(sorted(left.items()))
    assert all(c == k for k, (_, c) in groups.items())
    out = P.STAGES[4][1](spark, d, sf)
    assert out.count() == len(left) and out.filter("NOT round_trip").count() == 0


def test_pipeline_near_copies_leave_behind_the_lines(spark, docs, sf):
    """Copies whose lines are broken elsewhere have no near lines, so line dedup keeps them; the next stage keeps one of each."""
    import corpus_pipeline as P

    rnd = random.Random(21)
    rows, clean = [], []
    for i in range(12):
        words = [f"{rnd.choice('bcdfghklm')}{rnd.choice('aeiou')}{rnd.randint(100, 999)}" for _ in range(160)]
        wrapped = lambda n, w: "\n".join(" ".join(w[j : j + n]) for j in range(0, len(w), n))
        near = list(words)
        near[80] = "changed"
        rows += [(10 * i, wrapped(16, words)), (10 * i + 1, wrapped(11, words)), (10 * i + 2, wrapped(7, near))]
        clean.append((1000 + i, wrapped(16, [f"w{rnd.randint(0, 10**6)}" for _ in range(150)])))
    d = docs(rows + clean).select(*P.COLUMNS)
    kept = dict(P.STAGES)["lines"](spark, d, sf)
    assert kept.count() == len(rows) + len(clean)
    left = {r["doc_id"] for r in dict(P.STAGES)["near_duplicates"](spark, kept, sf).collect()}
    assert left == {10 * i for i in range(12)} | {i for i, _ in clean}


def test_pipeline_cases(spark, docs, edge, sf):
    import corpus_pipeline as P

    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs(edge), sf).count() <= len(edge)
        assert stage(spark, docs([]), sf).count() == 0
    assert P.STAGES[0][1](spark, docs(edge), sf).count() <= len(edge)


def test_small_helpers(spark):
    assert spark.range(1).select(token_rollup.n_words(F.lit(" a  b\tc d "))).first()[0] == 3


def test_jaccard_repeated_ids(docs):
    """Texts of one doc_id are judged by their own sets."""
    words = [f"w{j}" for j in range(400)]
    swap = lambda at, by: " ".join(f"{by}{j}" if j in at else w for j, w in enumerate(words))
    x, y, z = swap({50}, "x"), swap({100, 150, 200, 250, 300, 350, 30, 60, 90, 120, 180}, "y"), swap({51}, "z")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.join(docs([(3, z), (5, x), (5, y)])).collect())
    assert got == [(3, 3, 1), (5, 3, 1), (5, 5, 0)]


def test_jaccard_counts_links_in_blocks(docs, monkeypatch):
    """Components of several blocks and size classes: links of each set by brute force."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        w = [f"w{j}" for j in range(rnd.choice([60, 70, 80, 100]))]
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = f"u{i}"
        rows.append((i, " ".join(w)))
    sets = {d: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in rows}
    want = {d: sum(100 * len(s & x) >= 80 * len(s | x) for x in set(sets.values()) if x != s) for d, s in sets.items()}
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.join(docs(rows)).collect()}
    assert {d: n for d, (_, n) in got.items()} == want and {d: c for d, (c, _) in got.items()} == {d: c for d, (_, c) in naive_join(rows).items()}
