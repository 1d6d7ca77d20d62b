"""Near-duplicates and repeated passages against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from roadweave.llm import neardup, passages
from roadweave.llm.common import stored
from roadweave.llm.components import components
from roadweave.llm.shingles import batch_hashes, rolled, shingle_set, word_hashes


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def changed(ws, seed, share):
    r = random.Random(seed)
    return [f"x{r.randrange(9999)}" if r.random() < share else w for w in ws]


def corpus():
    rows = [(i, " ".join(words(i, 60 + i % 40))) for i in range(60)]
    base = words(1000, 120)
    rows += [(100 + i, " ".join(changed(base, i, 0.02))) for i in range(40)]
    rows += [(200 + i, " ".join(base)) for i in range(5)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "One"), (305, "two words"), (306, "TWO  words")]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (400, " ".join(words(9, 4000))), (401, " ".join(words(9, 4000)[:-3]))]
    rows += [(500 + i, " ".join(words(77, 12)) + f" {i}" * 3) for i in range(30)]  # a shared line
    return rows


def classes(rows, k, percent):
    ids = [r[0] for r in rows]
    sets = [set(shingle_set(r[1], k).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if ids[x] is None or ids[y] is None:
                continue
            both = len(sets[x] & sets[y])
            if ids[x] == ids[y] or both and 100 * both >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    return [min((ids[y] for y in range(len(rows)) if ids[y] is not None and find(y) == find(x)), default=None) for x in range(len(rows))], sets


@pytest.mark.parametrize("small", [2000, 12])
def test_classes(make_docs, small):
    rows = corpus()
    want, sets = classes(rows, 3, 85)
    docs = make_docs(rows, clash=("id", "node", "items", "component_id", "n"))
    got = neardup.near_duplicates(docs, small=small, levels=2 if small < 100 else 4, trees=8).toPandas()
    assert len(got) == len(rows)
    expected = {(i if i is not None else -1): (len(s), w if w is not None else -1) for (i, _), s, w in zip(rows, sets, want, strict=True)}
    for r in got.itertuples():
        key = -1 if np.isnan(r.doc_id) else int(r.doc_id)
        n, c = expected[key]
        assert r.n_shingles == n
        if key == -1:
            assert np.isnan(r.component_id) and r.kept
        else:
            assert int(r.component_id) == c, key
            assert r.kept == (key == c)


def test_linked_counts_like_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(1, 60, 40)]
    sets += [sets[0], sets[1][:-1], np.array([7], dtype=np.uint64)]
    links = neardup.linked(np.arange(len(sets)), sets, 60)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        s, t = set(sets[a].tolist()), set(sets[b].tolist())
        assert 100 * len(s & t) >= 60 * len(s | t)
        root[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            s, t = set(sets[a].tolist()), set(sets[b].tolist())
            if 100 * len(s & t) >= 60 * len(s | t):
                assert find(a) == find(b)


def test_sketch_keeps_similar_pairs():
    rng = np.random.default_rng(5)
    for n in (3, 20, 300, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.93)], rng.integers(0, 2**64, max(0, int(n * 0.05)), dtype=np.uint64)]))
        if len(np.intersect1d(a, b)) < 0.85 * len(np.union1d(a, b)):
            continue
        c = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drawn = np.frombuffer(b"".join(neardup.sketch(x) for x in (a, b, c)), dtype=np.uint8).reshape(3, -1)
        keep = neardup.promising(np.array([len(a), len(b), len(c)]), drawn, 0.85)
        assert keep[0] and keep[1]
        if n >= 300:
            assert not keep[2]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 10), (20, 5), (5, 6), (6, 5)] + [(i, i + 1) for i in range(30, 60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {2: 1, 3: 1, 8: 7, 9: 7, 10: 7, 20: 5, 6: 5} | {i: 30 for i in range(31, 61)}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(make_docs):
    assert neardup.near_duplicates(make_docs([])).count() == 0
    assert passages.repeated_passages(make_docs([])).count() == 0


def passage_corpus():
    shared, fuzzy = words(2000, 70), words(2001, 90)
    rows = [(i, " ".join(words(3000 + i, 150))) for i in range(10)]
    for n, i in enumerate((20, 21, 22, 23)):
        rows.append((i, " ".join(words(4000 + i, 40) + shared + words(5000 + i, 30 + n))))
    rows.append((30, " ".join(words(6000, 50) + fuzzy + words(6001, 50))))
    near = changed(fuzzy, 1, 0.06)
    rows.append((31, "\n".join(words(6002, 33) + near[:40] + ["extra"] + near[40:] + words(6003, 20))))
    rows += [(40, " ".join(shared)), (41, None), (42, ""), (43, "short text"), (22, rows[12][1]), (None, " ".join(shared))]
    rows += [(50 + i, "a line that many documents share here " + " ".join(words(7000 + i, 80))) for i in range(12)]
    return rows, shared


def test_passages(make_docs):
    rows, shared = passage_corpus()
    docs = make_docs(rows, clash=("id", "_spans", "seed"))
    found = stored(passages.repeated_passages(docs), "test-passages")
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == {21, 22, 23, 31, 40}
    for i in (21, 22, 23):
        assert (got[i].source_id, got[i].similarity) == (20, 1.0)
        assert (got[i].start, got[i].end, got[i].source_start) == (40, 110, 40)
    assert got[31].source_id == 30 and got[31].end - got[31].start >= 80 and 0.8 <= got[31].similarity < 1
    left = passages.without(docs, found)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert 40 not in texts  # no word is left
    assert " ".join(shared) in texts[20] and " ".join(shared) not in texts[21]
    assert len(texts[21].split()) == len(rows[11][1].split()) - 70
    assert texts[0] == rows[0][1] and texts[41] is None and texts[42] == ""


def test_fenwick_and_chains():
    r = np.random.default_rng(2)
    tree, values = passages.Fenwick(40), {}
    for owner in range(200):
        rank, value = int(r.integers(1, 41)), float(r.random())
        tree.put(rank, value, owner)
        values[rank] = max(values.get(rank, (-1.0, -1)), (value, owner))
        at = int(r.integers(0, 41))
        below = [v for k, v in values.items() if k <= at]
        assert tree.upto(at) == (max(below) if below else (-np.inf, -1))
    for _ in range(20):
        pos = np.sort(r.integers(0, 200, 30))
        source = np.clip(pos + r.integers(-15, 15, 30), 0, None)
        found = passages.chains(pos, source)
        for _, path in found:
            assert all(pos[a] < pos[b] and source[a] < source[b] for a, b in zip(path, path[1:], strict=False))
        assert sorted(i for _, path in found for i in path) == list(range(30))
    # two runs on one diagonal with a gap are one chain, a stray match is another
    pos, source = np.array([0, 4, 9, 20, 25, 30]), np.array([100, 104, 109, 500, 125, 130])
    assert [path for _, path in passages.chains(pos, source)] == [[0, 1, 2, 4, 5], [3]]


def test_alignment():
    a = np.array([ord(c) for c in "the quick brown fox jumps over the lazy dog again"], dtype=np.uint64)
    b = np.array([ord(c) for c in "xx the quick brwn fox jumps over the lazy dog agaiN"], dtype=np.uint64)
    pos, source = np.array([0, 20, 30]), np.array([3, 22, 32])
    start, end, source_start, source_end, matched = passages.aligned(a, b, pos, source)
    assert (start, source_start) == (0, 3)
    assert matched == passages.common_words(a[start:end], b[source_start:source_end])
    assert passages.common_words(np.array([1, 2, 3]), np.array([2, 9, 3, 3])) == 2


def matches(copy, source):
    """Places of the seeds that two lists of words share."""
    a, b = (rolled(word_hashes(" ".join(ws)), passages.K) for ws in (copy, source))
    first = {}
    for q in passages.minimizers(b, passages.WINDOW):
        first.setdefault(int(b[q]), int(q))
    found = [(int(p), first[int(a[p])]) for p in passages.minimizers(a, passages.WINDOW) if int(a[p]) in first]
    return np.array([p for p, _ in found]), np.array([q for _, q in found])


@pytest.mark.parametrize("left_out", [40, 80, 150, 400, 1000])
def test_words_left_out(left_out):
    r = random.Random(left_out)
    source = [f"w{r.randrange(10**9)}" for _ in range(700 + left_out)]
    pos, places = matches(source[:300] + source[300 + left_out :], source)
    found = [path for _, path in passages.chains(pos, places) if len(path) > 1]
    covered = np.zeros(700, dtype=bool)
    for path in found:
        covered[pos[path[0]] : pos[path[-1]] + passages.K] = True
        assert all(pos[b] - pos[a] <= passages.FAR and places[b] - places[a] <= passages.FAR for a, b in zip(path, path[1:], strict=False))
    assert len(found) == (1 if left_out == 40 else 2) and covered.sum() >= 650


@pytest.mark.parametrize("between", range(20, 61, 5))
def test_words_between(between):
    r = random.Random(between)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    x, y = new(55), new(55)
    source, copy = (new(30) + x + new(between) + y + new(30) for _ in range(2))
    a, b = word_hashes(" ".join(copy)), word_hashes(" ".join(source))
    pos, places = matches(copy, source)
    found = []
    for _, path in passages.chains(pos, places):
        found += passages.similar(a, b, pos[path], places[path], 50, 0.8)
    covered = np.zeros(len(copy), dtype=bool)
    for start, end, source_start, source_end, matched in found:
        assert matched >= 0.8 * max(end - start, source_end - source_start)
        covered[start:end] = True
    both = list(range(30, 85)) + list(range(85 + between, 140 + between))
    assert covered[both].all()
    if between > 27:  # 110 of 138 words are less than 0.8
        assert sorted(f[:2] for f in found) == [(30, 85), (85 + between, 140 + between)]


def test_weak_ends():
    """An exact passage whose surroundings agree by three quarters is not lost with them."""
    r = random.Random(5)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    exact, around = new(60), new(300)
    source = around[:150] + exact + around[150:]
    copy = [f"x{i}" if i % 4 == 0 and not 150 <= i < 210 else w for i, w in enumerate(source)]
    a, b = word_hashes(" ".join(copy)), word_hashes(" ".join(source))
    pos, places = matches(copy, source)
    (start, end, *_, matched), = passages.similar(a, b, pos, places, 50, 0.8)
    assert start <= 150 and end >= 210 and matched >= 0.8 * (end - start)


@pytest.mark.parametrize("parts, size", [(3, 20), (4, 15), (6, 20)])
def test_passage_of_parts(make_docs, parts, size):
    """A passage of two documents is found though others hold each part of it before."""
    pieces = [words(8000 + i, size) for i in range(parts)]
    rows = [(i, " ".join(words(8100 + i, 40) + piece + words(8200 + i, 40))) for i, piece in enumerate(pieces)]
    whole = [w for piece in pieces for w in piece]
    rows += [(n, " ".join(words(8300 + n, 30) + whole + words(8400 + n, 30))) for n in (20, 21)]
    rows += [(30 + i, " ".join(words(8500 + i, 50) + piece)) for i, piece in enumerate(pieces)]
    (r,) = passages.repeated_passages(make_docs(rows)).collect()
    assert (r.doc_id, r.source_id, r.start, r.end, r.similarity) == (21, 20, 30, 30 + len(whole), 1.0)


def test_links_over_batches(spark):
    r = random.Random(3)
    data = sorted({(r.randrange(6), r.randrange(12), r.randrange(40)) for _ in range(600)})
    first = {}
    for seed, i, pos in data:
        first.setdefault((seed, i), pos)
    want = set()
    for seed, i, pos in data:
        earlier = [x for x in range(i) if (seed, x) in first]
        want |= {(i, x, pos, first[seed, x]) for x in {*earlier[:1], *earlier[-1:]}}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = passages.linked(spark.createDataFrame(data, "seed long, id long, pos int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(x) for x in got} == want


def crowded_corpus():
    """Passages whose other holders stand around the earlier document that holds them whole."""
    rows = []
    for n, (parts, size) in enumerate([(3, 20), (4, 15), (6, 20)]):
        pieces = [words(9000 + 10 * n + i, size) for i in range(parts)]
        alone = lambda at: [(1000 * n + at + i, " ".join(words(9100 + 10 * n + at + i, 40) + x)) for i, x in enumerate(pieces)]
        whole = [w for x in pieces for w in x]
        rows += alone(100) + alone(300) + alone(500)
        rows += [(1000 * n + i, " ".join(words(9500 + n + i, 30) + whole + words(9600 + n + i, 30))) for i in (200, 400, 600)]
    # runs of one word and repeated lines, of which earlier documents hold more, fewer and others
    r, line = random.Random(4), words(9700, 7)
    for i in range(24):
        kinds = [["of"], ["on", "in"], line, [f"r{r.randrange(4)}"]]
        text = [w for _ in range(6) for kind in [r.choice(kinds)] for w in kind * r.randrange(3, 40)]
        rows.append((5000 + i, " ".join(words(9800 + i, 10) + text)))
    return rows


def linked_by_all(rows, least=50, similarity=0.8):
    """For each document the seeds that lie in a passage of any earlier document, all places linked."""
    texts = {i: word_hashes(t) for i, t in rows}
    places = {}
    for i, ws in texts.items():
        found = rolled(ws, passages.K)
        places[i] = [(int(p), int(found[p])) for p in passages.minimizers(found, passages.WINDOW)]
    out = {i: set() for i in texts}
    for i in texts:
        for j in texts:
            if j >= i:
                continue
            of = {}
            for q, seed in places[j]:
                of.setdefault(seed, []).append(q)
            both = [(p, q) for p, seed in places[i] for q in of.get(seed, ())]
            if len(both) < 2:
                continue
            pos, source = np.array(both).T
            for _, path in passages.chains(pos, source):
                if len(path) < 2 or pos[path[-1]] + passages.K - pos[path[0]] < least / 2:
                    continue
                for a, b, *_ in passages.similar(texts[i], texts[j], pos[path], source[path], least, similarity):
                    out[i] |= {p for p in pos[path].tolist() if a <= p and p + passages.K <= b}
    return out


def test_every_earlier_document(make_docs):
    """Seeds that more than two earlier documents hold, or hold more than once, lead to all of them."""
    rows = crowded_corpus()
    covered = {}
    for r in passages.repeated_passages(make_docs(rows)).collect():
        covered.setdefault(r.doc_id, []).append((r.start, r.end))
    covered = {i: passages.joined(spans) for i, spans in covered.items()}
    want = linked_by_all(rows)
    lost = {i: [p for p in found if not any(a <= p and p + passages.K <= b for a, b in covered.get(i, []))] for i, found in want.items()}
    assert sum(map(len, want.values())) > 1000
    assert {i: x for i, x in lost.items() if x} == {}


def test_all_places_of_two_documents():
    r = random.Random(6)
    for _ in range(50):
        p, q = (np.unique([r.randrange(60) for _ in range(r.randrange(1, 12))]) for _ in range(2))
        got = set(zip(*(c.tolist() for c in passages.crossed(p, q)), strict=True))
        assert got <= {(a, b) for a in p.tolist() for b in q.tolist()}
        runs_q, alone_q = passages.stepping(q)
        assert {(a, b) for a in p.tolist() for b in alone_q.tolist()} <= got
        assert sorted({x for run in runs_q for x in run.tolist()} | set(alone_q.tolist())) == q.tolist()
    # of two runs: aligned at their fronts and at their ends
    got = set(zip(*(c.tolist() for c in passages.crossed(np.arange(0, 20, 2), np.arange(100, 112, 2))), strict=True))
    assert {(0, 100), (10, 110), (12, 100), (18, 110), (8, 100)} <= got


def run_corpus():
    """Runs of one word of many lengths, some of which go on as in another document."""
    r, rows = random.Random(12), []
    for i in range(16):
        text = words(11000 + i, 40)
        for n in range(3):
            run = ["of" if n == 1 else r.choice(["on", "in"])] * r.choice([20, 27, 33, 41, 47, 49, 50, 64, 90])
            beside = words(12000 + r.randrange(4), 30)
            beside = changed(beside[: r.choice([1, 2, 5, 30])], i, r.choice([0, 0.2]))
            text += run + beside if r.random() < 0.5 else beside + run
            text += words(13000 + 10 * i + n, 25)
        rows.append((i, " ".join(text)))
    return rows


def test_runs_of_every_earlier_document(make_docs):
    """What lies beside a run of one word is found in every earlier document that has it."""
    rows = run_corpus()
    covered = {}
    for r in passages.repeated_passages(make_docs(rows)).collect():
        covered.setdefault(r.doc_id, []).append((r.start, r.end))
    covered = {i: passages.joined(spans) for i, spans in covered.items()}
    want = linked_by_all(rows)
    lost = {i: [p for p in found if not any(a <= p and p + passages.K <= b for a, b in covered.get(i, []))] for i, found in want.items()}
    assert any(want.values())
    assert {i: x for i, x in lost.items() if x} == {}


def test_short_runs_make_few_pairs(make_docs, monkeypatch):
    """Runs of one word that are no passage, nor begin one, are not compared with each other."""
    rows = [(i, " ".join(words(14000 + i, 40) + ["of"] * (26 + i % 20) + words(15000 + i, 40))) for i in range(40)]
    made, stored_as = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name: made.append((name, out := stored_as(df, name))) or out)
    assert passages.repeated_passages(make_docs(rows)).count() == 0
    assert [df.count() for name, df in made if name == "passage-chains"][-1] == 0


def test_pairs_of_a_large_group(make_docs, monkeypatch):
    """Documents that share a passage, of which earlier ones hold the parts, are not compared all with all."""
    pieces = [words(20000 + i, 20) for i in range(4)]
    whole, n = [w for x in pieces for w in x], 40
    rows = []
    for i in range(n):  # other holders of the parts stand before and behind each of them
        rows += [(100 * i + j, " ".join(words(20100 + 10 * i + j, 40) + x)) for j, x in enumerate(pieces)]
        rows.append((100 * i + 50, " ".join(words(21000 + i, 30) + whole + words(22000 + i, 30))))
    compared = []
    chained = passages.judged

    def counted(named, made, *rest):
        made = stored(made, "test-chains")
        compared.append(made.select("doc_id", "source_id").distinct().count())
        return chained(named, made, *rest)

    monkeypatch.setattr(passages, "judged", counted)
    found = {r.doc_id: r for r in passages.repeated_passages(make_docs(rows)).collect()}
    assert set(found) == {100 * i + 50 for i in range(1, n)}
    assert all((r.end - r.start, r.similarity) == (80, 1.0) for r in found.values())
    assert sum(compared[1:]) <= 4 * n


def test_seeds_of_a_batch():
    r = random.Random(11)
    texts = [" ".join(words(30000 + i, r.randrange(60))) for i in range(200)] + [None, "", " A  b\t", "\x1c a B\x85 x\x0b\x0cY", "É é ß"]
    column = pa.array(["x", *texts]).slice(1)
    hashed = batch_hashes(column)
    assert all(np.array_equal(a, word_hashes(t)) for a, t in zip(hashed, texts, strict=True))
    row, pos, seed = passages.placed_seeds(hashed)
    for i, w in enumerate(hashed):
        own = rolled(w, passages.K) if len(w) >= passages.K else w[:0]
        at = passages.minimizers(own, passages.WINDOW)
        assert pos[row == i].tolist() == at.tolist() and seed[row == i].tolist() == own[at].tolist()


def test_one_chain_and_common_words():
    r = np.random.default_rng(8)
    for _ in range(200):
        pos, source = (np.cumsum(r.integers(1, 25, 12)) for _ in range(2))
        fast = passages.one_chain(pos, source, 0, 12)
        if fast[1]:
            ((score, _, _, path),) = passages.best_chains(pos.tolist(), source.tolist(), 0)
            assert path == fast[1] and abs(score - fast[0]) < 1e-9
        a, b = r.integers(0, 6, r.integers(0, 80)), r.integers(0, 6, r.integers(0, 80))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert passages.common_words(a, b) == row[-1]
