"""Periodic runs, quality rules and spelling variants against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadweave.llm import periods, quality, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ------------------------------------------------------------------


def plain_runs(words, least=12):
    """All runs by comparing the words with themselves at every distance."""
    seen, out = set(), []
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            if words[x] != words[x + q]:
                x += 1
                continue
            a = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x - a >= q and (a, x + q) not in seen:  # seen with a smaller period
                seen.add((a, x + q))
                if x + q - a >= max(least, 2 * q):
                    out.append((a, x + q - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def periodic(r):
    """Texts that are hard for the method: few letters, powers, seams of powers, Fibonacci words."""
    kind, letters = r.randrange(6), r.choice([1, 2, 3, 30])
    d = [b"%d" % r.randrange(letters) for _ in range(r.randrange(0, 240))]
    if kind == 1 and d:
        a = r.randrange(len(d))
        p = r.randrange(1, len(d) - a + 1)
        d = [d[a + (i - a) % p] if i >= a else d[i] for i in range(len(d))]
    if kind == 2:
        u = [b"a", b"b"][: r.randrange(1, 3)]
        d = (u * r.randrange(1, 90) + [b"c"] * r.randrange(2) + u * r.randrange(1, 90))[r.randrange(3) :]
    if kind == 3:
        d, e = [b"b"], [b"a"]
        for _ in range(10):
            d, e = e, e + d
    if kind >= 4:
        u = d[: r.randrange(1, 8)] or [b"x"]
        k = r.randrange(1, len(u) + 1)
        d = (u * 60)[: r.randrange(1, 300)] + (u * 60)[k : k + r.randrange(1, 300)]
        d += [b"zz"] * r.randrange(2) + d * r.randrange(2)
    return d


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_hard_texts(seed):
    r = random.Random(seed)
    texts = [periodic(r) for _ in range(12)]
    for words, got in zip(texts, periods.runs_of(texts, 1), strict=True):
        assert got == plain_runs(words, 1)


@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=90), max_size=6))
@settings(max_examples=150, deadline=None)
def test_runs_of_two_letters(texts):
    assert periods.runs_of(texts, 1) == [plain_runs(t, 1) for t in texts]


def test_runs_of_a_very_long_text():
    r = random.Random(3)
    unit = [b"%d" % r.randrange(50) for _ in range(7_000)]
    words = [b"x%d" % r.randrange(9_000) for _ in range(40_000)] + unit * 6 + [b"end"]
    assert (40_000, 42_000, 7_000) in periods.runs_of([words, unit, []])[0]


def planted_words(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_period_digests(make_docs):
    r = random.Random(11)
    rows = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(0, 200)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "spam " * 500), (204, "é   é x " * 30), (None, "a b " * 9)]
    rows += [rows[3], (None, None), (205, "a b " * 20_000)]
    docs = make_docs(rows, clash=("runs", "n_words"))
    got = periods.digests(periods.periodic_runs(periods.planted(docs))).toPandas()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        if doc_id is not None:
            words = planted_words(doc_id, words)
        runs = plain_runs(words) if len(words) < 2_000 else [(0, 40_000, 2)]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        left = " ".join(plain_collapsed(words, runs)) if len(words) < 2_000 else "a b"
        if doc_id == 205 and zlib.crc32(b"205") % 10 == 0:
            continue
        want.append((doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    none = lambda t: tuple(None if isinstance(v, float) and math.isnan(v) else v for v in t)
    have = Counter(none(t) for t in got.itertuples(index=False))
    assert not Counter(want) - have


def test_period_tables(spark, make_docs):
    docs = make_docs([(1, "a b " * 8 + "c")], clash=("collapsed", "start"))
    out = periods.periodic_runs(docs)
    row = out.first()
    assert row.collapsed == "a b c" and row.start == 2 and row.n_words == 17
    assert [tuple(r) for r in row.runs] == [(0, 16, 2)]
    assert periods.digests(periods.periodic_runs(docs.limit(0))).count() == 0


# --- quality rules ------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), len(lines))


def some_texts(r, n):
    out = []
    for _ in range(n):
        words = [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 120))]
        if r.random() < 0.5 and words:
            a = r.randrange(len(words))
            words += words[a : a + 15]
        seps = [" ", " ", " ", "\n", "\t", "\n\n", " # ", " |"]
        out.append("".join(w + r.choice(seps) for w in words))
    return [*out, None, "", "\n \n", "a" * 50_000, "x " * 30_000, " é | é\n" * 9, "a b c d e f g h", "a b c d e f g h " * 2]


def test_measures(make_docs):
    texts = some_texts(random.Random(5), 120)
    docs = make_docs(list(enumerate(texts)), clash=("_w", "_l", "n_words"))
    got = {r.doc_id: r for r in quality.measures(docs, prefix="m_").collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    for i, t in enumerate(texts):
        assert tuple(got[i][f"m_{n}"] for n in names) == plain_measures(t), t
    assert quality.measures(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 7, 250, 4000])
def test_tail_is_the_binomial_sum(spark, n):
    from pyspark.sql import functions as F

    ks = sorted({0, 1, 3, n // 400, n // 300, n // 200} & set(range(n)))
    rows = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    for r in rows.withColumn("p", quality.tail(F.col("k"), F.col("n"), 0.004)).collect():
        exact = sum(math.comb(n, j) * 0.004**j * 0.996 ** (n - j) for j in range(r.k + 1))
        assert math.isclose(r.p, exact if r.k < n * 0.004 else 1.0, rel_tol=1e-9)


def rejects(rule, measures, cutoff):
    _, top, bottom, cutoffs = rule
    if not measures[bottom]:
        return False
    value = measures[top] / measures[bottom]
    return value < cutoff if cutoffs[-1] > cutoffs[0] else value > cutoff


def plain_thresholds(held, control):
    """Fixed-sequence tests by exact sums over (stratum, good, measures)."""
    strata = {s for s, _, _ in held}
    out = {}
    for s in strata:
        good = [m for t, g, m in held if t == s and g]
        bad = [m for t, g, m in held if t == s and not g]
        for rule, own in enumerate(control.rules):
            level, risk = control.delta / (len(strata) * len(control.rules)), control.risk / len(control.rules)
            best = (0, None)
            for at, c in enumerate(own[-1]):
                k, caught = (sum(rejects(own, m, c) for m in part) for part in (good, bad))
                p = sum(math.comb(len(good), j) * risk**j * (1 - risk) ** (len(good) - j) for j in range(k + 1))
                if k >= len(good) * risk or p > level:
                    break
                if caught - k > best[0]:
                    best = (caught - k, at)
            if best[1] is not None:
                out[s, rule] = best[1]
    return out


def test_rules_limit_false_rejections(spark, make_docs):
    """Strata with enough labels reject junk, others do not; the same cutoffs as a plain version."""
    r = random.Random(8)
    prose = lambda: " ".join("w" * r.randrange(2, 8) + str(r.randrange(10_000)) for _ in range(40))
    junk = lambda: " ".join(f"w{r.randrange(10_000)}###" for _ in range(40))
    rows, labels = [], []
    for i in range(2400):
        bad = i % 8 == 0
        rows.append((i, junk() if bad else prose()))
        labels.append((i, 0 if bad else 1))
    few = [(5000 + i, junk() if i % 2 else prose()) for i in range(40)]
    docs = make_docs(rows).withColumn("_x", quality.F.lit(1)).unionByName(
        make_docs(few).withColumn("lang", quality.F.lit(None).cast("string")).withColumn("_x", quality.F.lit(2))
    )
    docs = docs.unionByName(make_docs([(9000, None), (9001, ""), (9002, "a " * 30), (1, rows[1][1])]).withColumn("_x", quality.F.lit(3)))
    labels += [(5000 + i, i % 2) for i in range(40)] + [(1, None), (None, 1), (3, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    control = quality.Control(risk=0.05)
    got = quality.rules(docs, marks, control=control).collect()
    assert len(got) == docs.count()
    by = {}
    for row in got:
        by.setdefault(row.doc_id, []).append(row)
    measured = {i: dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), plain_measures(t), strict=True)) for i, t in rows + few}
    held = [("en", i % 8 != 0, measured[i]) for i in range(2400)] + [(None, bool(i % 2), measured[5000 + i]) for i in range(40)]
    held = [h for h in held if h[2]["n_words"] >= 20 and 100 * h[2]["n_repeat_words"] <= 30 * h[2]["n_words"]]
    cuts = plain_thresholds(held, control)
    assert any(s == "en" for s, _ in cuts) and not any(s is None for s, _ in cuts)
    for i, text in rows + few:
        m = measured[i]
        lang = "en" if i < 5000 else None
        failed = [own[0] for rule, own in enumerate(control.rules)
                  if (lang, rule) in cuts and rejects(own, m, own[-1][cuts[lang, rule]])]
        for row in by[i]:
            assert row.failed == failed and row.kept == (not failed and not row.base_failed), text
    good = [by[i][0].kept for i in range(2400) if i % 8]
    assert sum(good) >= 0.95 * len(good) and not any(by[i][0].kept for i in range(0, 2400, 8))
    assert all(by[i][0].kept for i in range(5000, 5040))
    assert all(by[i][0].base_failed and not by[i][0].kept for i in (9000, 9001, 9002))
    assert len(by[1]) == 2


def test_rules_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.rules(make_docs([]), none).count() == 0
    assert quality.rules(make_docs([(1, "word " * 5)]), none).first().base_failed


# --- spelling variants --------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words, times=5):
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        top = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= times * n else None
        out[w] = (form[w], n, len(close), words[form[w]] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_variants_equal_all_pairs(spark, letters):
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randrange(6, 11))) for _ in range(150)}
    for w in list(words):  # near ones, also of near ones
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]}
    words |= {"a" * n for n in range(6, 12)}
    words = {w: 5 * 6 ** r.randrange(6) for w in sorted(words) if len(w) >= 6}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(rows)) == plain_variants(words)


def test_long_chain_of_forms(spark):
    words = {"a" * k + "b" * (14 - k): 5**k for k in range(1, 14)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(spelling.variants(rows))
    assert got == plain_variants(words) and {g[1] for g in got.values()} == {"a" * 13 + "b"}
    assert spelling.variants(rows.limit(0)).count() == 0


def test_words_of_texts(spark, make_docs):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(4, 10))) for _ in range(25)]
    rows = []
    for i in range(400):
        words = [r.choice(base) for _ in range(r.randrange(0, 40))]
        rows.append((i, "".join(w.upper() if r.random() < 0.2 else w + r.choice([" ", "-", "1", "œ"]) for w in words)))
    rows += [(None, "abcdefg " * 9), (401, None), (402, ""), (403, "Éclairs ÉCLAIRS"), rows[5]]
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    runs = spelling.letter_runs(make_docs(rows, clash=("word", "n")))
    got = {x.word: x.n for x in spelling.vocabulary(spelling.misspelt(runs)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}


def test_pivots_are_the_rarest_disjoint_pair(spark):
    r = random.Random(4)
    words = [("".join(r.choice("abcd") for _ in range(r.randrange(6, 12))),) for _ in range(200)]
    rows = spark.createDataFrame(sorted(set(words)), "word string").withColumn("n", spelling.F.lit(9).cast("long"))
    freq = Counter(w[i : i + 2] for (w,) in set(words) for i in range(len(w) - 1))
    for x in spelling.grams(rows).collect():
        cost = lambda i: freq[x.word[i : i + 2]]  # noqa: E731, B023
        a, b = x.pivots
        assert b - a >= 2 and {a, b} <= set(x.prefix)
        assert cost(a) + cost(b) == min(cost(i) + cost(j) for i in x.prefix for j in x.prefix if j - i >= 2)


def test_near_pairs_are_not_broadcast(spark):
    """A word has several keys, which the size of its file does not show: both sides are shuffled."""
    words = [("".join(x), 9) for x in itertools.product("abc", repeat=6)]
    near = spelling.near_pairs(spark.createDataFrame(words, "word string, n long"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert near.count() == len(words) * 12  # six places, two other letters
