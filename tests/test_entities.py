"""HTML entities against html.unescape()."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from litlens.functions import text as T


def test_unescape_like_python(spark):
    rnd = random.Random(6)
    names = sorted(html5)
    parts = ["&", "&amp;", "&amp", "&#", "&#;", "&#x;", "x", ";", " ", "\n", "<", "&notit;", "&NotEqualTilde;", "&zzz;", "&ampersand", "é", "#", "&#65", "&#x41;", "&#X1F600;", "&#0;", "&#13;", "&#xD800;", "&#x110000;", "&#9999999999999999999999;", "&#x00000000000000000041;", "&#xFEFF;", "&#xFFFE;", "&#xFDD0;", "&#127;", "&#1;", "𝔸"]
    texts = ["".join(rnd.choice([*parts, "&" + rnd.choice(names), "&" + rnd.choice(names)[:-1], f"&#{rnd.randint(0, 300)};", f"&#x{rnd.randint(0, 0x11FFFF):x};"]) for _ in range(rnd.randint(0, 9))) for _ in range(4000)]
    texts += [f"&{n}" for n in names] + [f"&#{i};" for i in range(300)] + [f"&{n}zz" for n in names if n[-1] != ";"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").repartition(4).withColumn("u", T.unescape(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    got = {r["i"]: r["u"] for r in df.collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong and got[len(texts)] is None, wrong[:5]
