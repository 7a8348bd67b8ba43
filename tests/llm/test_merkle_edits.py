"""Walking two trees down to where texts differ, against lists."""

import random
import re

from pyspark.sql import functions as F

from cairnledger.llm import merkle

PIECE = re.compile(r" *(?:[^ ]+ *){1,8}| +")


def tree(t):
    return [[PIECE.findall(p) for p in s.split("\n")] for s in t.split("\n\n")]


def pairs(a, b):
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    back = 0
    while back < min(len(a), len(b)) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    out = []
    for i in range(front, max(len(a), len(b)) - back):
        x, y = a[i] if i < len(a) - back else None, b[i] if i < len(b) - back else None
        if x != y:
            out.append((i, x, y))
    return out


def by_hand(a, b):
    out = []
    for s, x, y in pairs(tree(a), tree(b)):
        for p, u, v in pairs(x or [], y or []):
            found = [(s, p, i, m is not None, n is not None) for i, m, n in pairs(u or [], v or [])]
            out += found or [(s, p, None, u is not None, v is not None)]
    return out


def test_edits_are_where_the_texts_differ(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [("", ""), ("a", ""), ("a\n\nb", "a\n\n\n\nb"), ("same text", "same text"), ("a\nb", "a\n\nb")]
    for _ in range(150):
        sections = [["" if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        other = [list(s) for s in sections]
        for _ in range(rng.randrange(3)):
            s = rng.randrange(len(other))
            p = rng.randrange(len(other[s]))
            how = rng.randrange(4)
            if how == 0:
                other[s][p] = " ".join(w if rng.random() > 0.1 else "edited" for w in other[s][p].split(" "))
            elif how == 1:
                other[s].insert(p, "an inserted paragraph")
            elif how == 2:
                other.insert(s, ["an inserted section"])
            elif len(other[s]) > 1:
                del other[s][p]
        rows.append(tuple("\n\n".join("\n".join(s) for s in x) for x in (sections, other)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).collect()
    assert [[tuple(x) for x in r["e"]] for r in got] == [by_hand(r["a"], r["b"]) for r in got]
    assert sum(bool(r["e"]) for r in got) > 80
    one = [r for r in got if len(r["e"]) == 1]
    assert len(one) > 20  # most single edits are one piece, wherever they stand
