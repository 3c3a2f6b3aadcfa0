"""Titles whose hashed words cancel out, or that hold no words, are no blank ones."""

from itertools import combinations
from zlib import crc32

import duckdb

from litlens.plans import base, registry


def cancelling(dims=64):
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    place = {w: (crc32(w.encode()) % dims, crc32(w.encode()) >> 31) for w in words}
    return next(f"{a} {b}" for a, b in combinations(words, 2) if place[a][0] == place[b][0] and place[a][1] != place[b][1])


def test_only_blank_titles_have_zero_vectors(spark, tmp_path):
    titles = [cancelling(), "\t", "\r", "\u2028", " ", "\u00a0\u3000", "", None, "two words"]
    spark.createDataFrame([(i, t, "s", "en", 1) for i, t in enumerate(titles)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["id"], r["length"], r["text_hash"]) for r in registry.QUERIES["d4_embed"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    duck.execute("CREATE VIEW conversations AS SELECT 1 AS conv_id, 1 AS turn, 'user' AS role, '' AS text")
    want = duck.execute(f"SELECT id, length, text_hash FROM ({base.ORACLES['d4_embed']})").fetchall()
    assert got == set(want) and sorted(n for _, n, _ in got) == [0, 0, 0, 0, 1, 1, 1, 1, 1]
