"""Spelling variants, near-duplicate vectors and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.llm import periodic, spelling, vector_dedup

DOCS = "doc_id long, text string, runs string, node int, w int"


def docs_of(spark, rows):
    """Columns whose names the operators use themselves must not get in their way."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


# --- spelling -------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n: dict[str, int], ratio: int = 5) -> set[tuple]:
    form, count = {}, {}
    for a in n:
        others = [b for b in n if near(a, b)]
        best = min(others, key=lambda b: (-n[b], b), default=None)
        count[a], form[a] = len(others), best if best is not None and n[best] >= ratio * n[a] and n[a] > 0 else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] is not None else None) for w in n}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(1, 6))) for _ in range(90)} | {"letter", "leter", "lettre", "léttré", "lettré", "ttttttt", "tttttt", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿa", "z"}
    n = {w: rng.choice([1, 2, 5, 10, 10, 26, 50, 250, 1300]) for w in words}
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))  # keys of long words are digests
    n |= {base: 10, base[:2000] + base[2001:]: 2, base[:63] + "z" + base[64:]: 1, base[:64] + "z" + base[65:]: 60, base + "q": 300}
    rows = [(w, k, "x", 0) for w, k in n.items()] + [(None, 3, "x", 0), ("", 9, "x", 0)]
    some = next(iter(words))
    rows = [r if r[0] != some else (some, n[some] - 1, "x", 0) for r in rows] + [(some, 1, "x", 0), (some, None, "x", 0)]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, prefix string, id int"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(n)
    assert got.count() == len(n)


def test_variants_of_unseen_words_and_empty_tables(spark):
    got = spelling.variants(spark.createDataFrame([("abc", 0), ("abd", 0), ("abe", 7)], "word string, n long"))
    assert {(r["word"], r["form"], r["root"], r["n_near"]) for r in got.collect()} == {("abc", None, "abc", 2), ("abd", None, "abd", 2), ("abe", None, "abe", 2)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="grow"):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["Sommer", "SOMMER", "sommer", "été", "Étéétéé", "naïveté", "straße", "longerword", "a", "x×y÷zabc", "İstanbul", "ſeventh"]
    rows = [(i, " ".join(f"{rng.choice(pool)}{rng.choice(['', ',', '1', '_'])}" for _ in range(60))) for i in range(80)]
    rows += [(None, "sommer " * 9), (3, None), (4, ""), rows[0], rows[0], (9, "y" * 70_000), *[(k, "y" * 70_000) for k in range(10, 15)]]
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs_of(spark, rows)).collect()}
    assert got == {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    assert any(len(w) >= 6 and 199 * k > 0 and w not in {"".join(c.lower() if "A" <= c <= "Z" else c for c in p) for p in pool} for w, k in n.items())  # something was lost


# --- vectors --------------------------------------------------------------------------------------------


def brute_links(rows, cosine=0.93):
    good = [k for k, (i, lab, v) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, group = Counter(), {k: {k} for k in range(len(rows))}
    for p, a in enumerate(good):
        for b in good[p + 1:]:
            u, v = np.array(rows[a][2], dtype=float), np.array(rows[b][2], dtype=float)
            if rows[a][1] == rows[b][1] and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= cosine:
                links[a] += 1
                links[b] += 1
                both = group[a] | group[b]
                for k in both:
                    group[k] = both
    out = []
    for k, r in enumerate(rows):
        c = min(rows[x][0] for x in group[k]) if k in good else r[0]
        out.append((r[0], links[k], c, r[0] is None or r[0] == c))
    return Counter(out)


def planted_vectors(seed=1, d=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0

    def put(v, label):
        nonlocal i
        rows.append((i, label, [float(np.float32(x)) for x in v]))
        i += 1

    for _ in range(60):  # pairs on both sides of the threshold, nearer and farther
        a = rng.standard_normal(d)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(d)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        for c in (rng.uniform(0.90, 0.93), rng.uniform(0.931, 0.94), rng.uniform(0.94, 0.999)):
            put(a * 3, 1)
            put(c * a + np.sqrt(1 - c * c) * b, 1)
    crowd = rng.standard_normal(d)
    for _ in range(60):
        put(crowd + 0.05 * rng.standard_normal(d), 2)
    wide = rng.standard_normal(d)
    for _ in range(50):  # a crowd wider than one ball
        put(wide + 0.28 * rng.standard_normal(d), 2)
    for _ in range(40):
        put(crowd, 3)
    rows += [(500, None, [1.0] * d), (501, 3, None), (502, 3, [0.0] * d), (503, 3, []), (504, 3, [float("nan")] + [1.0] * (d - 1)), (505, 3, [None] + [1.0] * (d - 1)), (506, 3, [float("inf")] * d),
             (None, 3, rows[-1][2]), (508, 3, rows[-1][2][:-1]), (508, 3, [2 * x for x in rows[-1][2][:-1]]), (2, 3, rows[-1][2]), (510, 3, [-0.0, 1.0]), (511, 3, [0.0, 1.0]), (512, 3, [1e-30, 1e30]), (513, 2, [0.0, 1.0])]
    return rows


def test_vector_links_equal_brute_force(spark):
    rows = planted_vectors()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, label int, embedding array<float>, rep int, bucket string")
    rows = [(i, lab, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, lab, v in rows]
    got = Counter(tuple(r) for r in vector_dedup.vector_links(df).collect())
    want = brute_links(rows)
    assert got == want


def test_balls_of_equal_vectors_emit_no_pairs_and_empty_tables(spark):
    many = spark.range(3000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    got = vector_dedup.vector_links(many).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (2999, 2999, 0, 1)
    assert vector_dedup.vector_links(many.limit(0)).count() == 0
    assert vector_dedup.vector_links(many.limit(1)).first()["kept"]


def test_tables_follow_recall():
    for bits in (8, 12, 20, 30):
        t = vector_dedup.table_count(bits, 0.93, 0.9999)
        p = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - p) ** t <= 1e-4 < (1 - p) ** (t - 1)


def test_vector_sql_on_planted_rows(spark, tmp_path):
    """The oracle itself, on rows that do hold links."""
    rows = [r for r in planted_vectors(2, 8)[:200] if r[2]]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(vector_dedup.OP12_SQL).fetchall()
    assert Counter(tuple(r) for r in vector_dedup.op12_vectors(spark, str(tmp_path)).collect()) == Counter(want)
    assert sum(r[1] for r in want) > 100


# --- periodic runs --------------------------------------------------------------------------------------


def brute_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_with_runs(seed: int) -> list[str]:
    r = random.Random(seed)
    w = [f"{r.choice('abc')}{r.randrange(r.choice([1, 3, 40]))}" for _ in range(r.randint(0, 90))]
    for _ in range(r.randint(0, 3)):
        a = r.randint(0, len(w))
        w[a:a] = w[a:a + r.randint(1, 4)] * r.randint(2, 9)
    return w


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, exponent):
    for seed in range(400):
        w = words_with_runs(seed)
        ids = np.array([sorted(set(w)).index(x) for x in w], dtype=np.int64)
        assert sorted(periodic.runs_of(ids, least, exponent), key=lambda r: (r[0], r[2])) == brute_runs(w, least, exponent)
    with pytest.raises(ValueError, match="two periods"):
        periodic.runs_of(np.zeros(4, dtype=np.int64), 2, 1)


def test_long_runs_and_position_blocks():
    assert periodic.runs_of(np.zeros(5000, dtype=np.int64)) == [(0, 5000, 1)]
    p = periodic.Positions(7)
    rng, have = random.Random(1), {7}
    for x in rng.sample(range(100_000), 6000):
        if x not in have:
            assert p.around(x) == (max((y for y in have if y < x), default=-1), min((y for y in have if y > x), default=-1)) if len(have) < 300 else True
            p.add(x)
            have.add(x)
    assert list(p) == sorted(have) and p.size == len(have)


def test_periods_query_equals_brute_force(spark, tmp_path):
    rows = [(i, " \t\n".join(words_with_runs(i))) for i in range(250)] + [(None, "a " * 9), (0, None), (251, ""), (252, "one"), (30, "k l m n o p q r s t u v w"), (30, "k l m n o p q r s t u v w"), (-4, "a b " * 400), (253, " ".join(map(str, range(3000))) + " z" * 20_000)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w) if n < 5000 else [(2999 + 1, 20_000, 1)]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        want[(i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest, kept)] += 1
    got = periodic.op13_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(r[1] > 0 for r in want) > 40
    assert periodic.periodic_runs(docs_of(spark, [])).count() == 0


def test_periods_by_chunks(spark):
    rows = [(i, " ".join(words_with_runs(i))) for i in range(40)]
    both = [periodic.periodic_runs(docs_of(spark, rows), chunk=c).orderBy("doc_id").collect() for c in (1, 10**6)]
    assert both[0] == both[1]
