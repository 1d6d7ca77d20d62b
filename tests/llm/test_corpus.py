"""Mixing, sharding, licenses, page text, toxicity and tokens."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from roadweave.llm import html, licenses, mixing, sharding, tokens, toxicity
from roadweave.llm.common import unused
from roadweave.llm.queries import RANKS

CLASH = ("_size", "_source", "size", "copies", "target", "id", "text_crc32")


def mixed_rows():
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(1, 30)), f"s{i % 5}") for i in range(400)]
    rows += [(400 + i, "x y", "tiny") for i in range(3)]
    return rows + [(500, None, "s0"), (501, "", None), (502, "a\tb\nc", None), (None, "q", "s1"), (3, rows[3][1], "s3")]


def test_mixing(make_docs):
    rows = mixed_rows()
    docs = make_docs(rows, clash=CLASH)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows) and set(docs.columns) <= set(out.columns)
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "mix_size", "mix_copies"]
    assert out[key].sort_values(key).to_numpy(float).tolist().__repr__() == again[key].sort_values(key).to_numpy(float).tolist().__repr__()
    per = out.drop_duplicates("source").sort_values("source", na_position="last")
    sizes, total = per.mix_source_size.to_numpy(float), out.mix_size.sum()
    weights, want, open_ = np.array([1.0, 2, 3] * 9)[: len(per)], np.zeros(len(per)), np.ones(len(per), bool)
    while True:  # shared by weight, stopped at the cap, shared again
        left = total - want[~open_].sum()
        want[open_] = left * weights[open_] / weights[open_].sum()
        over = open_ & (want > 3 * sizes)
        if not over.any():
            break
        want[over], open_ = 3 * sizes[over], open_ & ~over
    assert per.mix_target.to_numpy() == pytest.approx(want)
    assert (out.mix_copies <= 3).all()
    rate = (out.mix_target / out.mix_source_size).to_numpy()
    assert ((out.mix_copies >= np.floor(rate - 1e-9)) & (out.mix_copies <= np.floor(rate + 1e-9) + 1)).all()
    assert (out.mix_size * out.mix_copies).sum() == pytest.approx(total, rel=0.1)
    whole = mixing.emit(mixing.mix(docs))
    assert whole.columns == docs.columns and whole.count() == out.mix_copies.sum()
    strange = docs.withColumn("mix_rate", docs["doc_id"])
    prefix = unused(strange, "mix_")
    assert mixing.emit(mixing.mix(strange, prefix=prefix), prefix).columns == strange.columns
    assert mixing.mix(make_docs([])).count() == 0


def test_differencing():
    r = random.Random(2)
    for ways in (1, 2, 5):
        for n in (0, 1, 3, 60):
            sizes = [r.randrange(1, 1000) for _ in range(n)]
            way = sharding.differencing(sizes, ways)
            assert len(way) == n and all(0 <= w < ways for w in way)
            if n == 60:
                sums = [sum(s for s, w in zip(sizes, way, strict=True) if w == x) for x in range(ways)]
                assert max(sums) - min(sums) <= 20
    # the textbook case: 8 7 6 5 4 gives sums 16 and 14
    way = sharding.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum(s for s, w in zip([8, 7, 6, 5, 4], way, strict=True) if w == x) for x in (0, 1)) == [14, 16]


@pytest.mark.parametrize("fine", [1000, 2])
def test_sharding(make_docs, fine):
    r = random.Random(3)
    texts = ["ä" * r.randrange(1, 200) + str(i) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(50)]
    rows += [(2000, None), (2001, None), (2002, ""), (5, texts[5]), (None, texts[6]), (3000, "z" * 2000)]
    out = sharding.shards(make_docs(rows, clash=CLASH[:1]), count=4, fine=fine).toPandas()
    assert len(out) == len(rows)
    bytes_of = {i: len((t or "").encode()) + 8 for i, t in rows if i is not None}
    crc = {i: None if t is None else zlib.crc32(t.encode()) for i, t in rows}
    group = {}
    for x in out.itertuples():
        if not np.isnan(x.doc_id):
            assert x.size == bytes_of[int(x.doc_id)]
            assert (crc[int(x.doc_id)] is None and np.isnan(x.text_crc32)) or crc[int(x.doc_id)] == x.text_crc32
        group.setdefault(None if np.isnan(x.text_crc32) else x.text_crc32, set()).add(x.shard)
    assert all(len(s) == 1 for s in group.values())
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = out.groupby("shard")["size"].sum()
    if fine == 1000:
        assert sums.max() - sums.min() <= 0.02 * sums.sum()
    assert sharding.shards(make_docs([])).count() == 0


def test_licenses(make_docs):
    notice = licenses.TEMPLATES[1][1]
    rows = [
        (1, "Released under the MIT License. MIT licence, mit  license"),
        (2, "x " * 500 + "THIS is free SOFTWARE; you can redistribute it, and/or modify it under terms of the GNU general license " + "y " * 900),
        (3, None),
        (4, ""),
        (5, "cc by cc by-sa, cc-by CC\nBY"),
        (6, "Kmit license Kmit license"),
        (7, notice.upper().replace(" ", " -- ")),
        (8, "license " * 400),
        (1, "Released under the MIT License. MIT licence, mit  license"),
        (None, "apache license"),
    ]
    got = licenses.scan(make_docs(rows, clash=("_norm", "_row", "word"))).toPandas()
    assert len(got) == len(rows)
    by = {int(r.doc_id): r for r in got.itertuples() if not np.isnan(r.doc_id)}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word) == (9, 2, 3, 7)
    assert by[1].labels == "mit,mit-notice" and by[1].base_labels == "mit" and by[1].score == 1.0
    assert by[2].base_labels == "" and by[2].labels == "gpl-notice" and 0.8 <= by[2].score < 1
    assert (by[3].n_words, by[3].labels, by[3].score) == (0, "", 0.0) and np.isnan(by[3].first_word)
    assert (by[5].n_base, by[5].first_word, by[5].last_word) == (4, 0, 7)
    assert by[6].n_base == 0  # the Kelvin sign and k are parts of other words
    assert by[7].base_labels == "gpl" and by[7].labels == "gpl,gpl-notice"
    assert by[8].labels == "" and by[8].n_words == 400
    assert licenses.scan(make_docs([])).count() == 0


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>one</a><li><a>two</a></ul></nav>"
    "<!-- <p>gone</p> --><div class='ad'>buy now</div>{open}<h1>Head &amp; line</h1><p>First  <b>para</b>graph<br>goes\non."
    "<p>Second &eacute;&#233;&copy; with <a href=y>a link</a>.</p><div class=\"newsletter\"><form><input>Join us</form></div>"
    "<script>var t = '</p>';</script><p>Third words stand here to the end.{close}"
    "<section id=comments><p>A reader says much, and more, and more again.</p></section><footer>&copy; me</footer></body></html>"
)
TEXT = "Head & line\nFirst paragraph goes on.\nSecond éé© with a link.\nThird words stand here to the end."


def page(element):
    return PAGE.replace("{open}", f"<{element}>").replace("{close}", f"</{element}>")


def test_pages(spark):
    pages = [(i, f"u{i}", page("article")) for i in range(40)]
    odd = [
        (100, "a", None),
        (101, "b", ""),
        (102, "c", "<nav>only a menu</nav>"),
        (103, "d", page("div")),
        (104, "e", "plain words without any markup"),
        (105, "f", "<article><p>open " + "word " * 20000),
        (106, None, "<p>a<!-- never closed <p>b"),
        (107, "g", "<<<>>></></p></div><p class=>x & y &nosuch; z"),
        (108, "h", "<div>" * 3000 + "deep text" + "</div>" * 3000),
        (0, "u0", pages[0][2]),
    ]
    df = spark.createDataFrame([(*p, 1, "t") for p in pages + odd], "page_id long, url string, html string, h int, text string")
    got = html.extract(df, html.learn(df)).toPandas()
    assert len(got) == len(pages) + len(odd)
    texts = dict(zip(got.page_id, got.text, strict=True))
    assert texts[0] == TEXT and texts[39] == TEXT
    assert texts[103] == TEXT
    assert texts[100] == texts[101] == texts[102] == ""
    assert texts[104] == "plain words without any markup"
    assert texts[105].split() == ["open"] + ["word"] * 20000
    assert texts[106] == "a" and texts[107].endswith("x & y &nosuch; z") and texts[108] == "deep text"
    assert (got.n_chars == got.text.str.len()).all()
    none = df.limit(0)
    assert html.extract(none, html.learn(none)).count() == 0


BODY = "<h1>A title</h1><p>First words of the text.</p><p>More words follow here.</p>"
ENDS = "<section id='comments'><article><p>A reader says much.</p></article></section><footer>me</footer>"


@pytest.mark.parametrize(
    "whole",
    [
        "<div class='layout has-sidebar'><article>{}</article></div>",
        "<div class='layout has-sidebar'><article>{}</article>" + ENDS + "</div>",
        "<article class='post comments-open'>{}</article>" + ENDS,
        "<main class='with-menu'><article class='post related'>{}</article>" + ENDS + "</main>",
        "<article>{}<div class='related'><p>Read this too.</p></div></article>" + ENDS,
        "<div class='has-sidebar'>{}<div class='share'>Share it</div></div>",
    ],
)
def test_marks_do_not_empty_a_page(whole):
    got = html.main_text(whole.replace("{}", BODY), html.Weights({}, {}, 0.5))
    assert got == "A title\nFirst words of the text.\nMore words follow here."


def test_names_of_headings():
    heads = ["<h2 id='related-work'>One</h2>", "<h2 id='form-and-function'>Two</h2>", "<h3><span id='search'>Three</span></h3>"]
    got = html.main_text("<article>" + "".join(h + "<p>Some words of text.</p>" for h in heads) + "</article>", html.Weights({}, {}, 0.5))
    assert got.split("\n")[::2] == ["One", "Two", "Three"]


@pytest.mark.parametrize("element", ["article", "div"])
@pytest.mark.parametrize("links", ["nav", "div class='share'", "aside"])
@pytest.mark.parametrize("inner", ["<li><a href=x>one</a></li>", "<li><a href=x><i></i></a></li>"])
def test_links_inside_an_article(element, links, inner):
    """A list of links between two parts costs neither of them."""
    lead, rest = "lead " * 30, "rest " * 400
    for first, last in ((lead, rest), (rest, lead)):
        middle = f"<{links}><ul>{inner * 60}</ul></{links.split()[0]}>"
        got = html.main_text(
            f"<{element}><h1>Title</h1><p>{first}</p>{middle}<p>{last}</p></{element}>",
            html.Weights({}, {t: 1.0 for t in ("h1", "/h1", "p", "/p")} | {t: 0.3 for t in ("li", "/li", "a", "/a")}, 3.25),
        )
        assert got.split("\n") == ["Title", first.strip(), last.strip()]


def test_region_is_maximal():
    """The scan against all regions."""
    r = random.Random(4)
    w = html.Weights({}, {"p": 0.9, "li": 0.0}, 3.0)
    for _ in range(100):
        found = [html.Block("x", r.randrange(0, 9), "p//", r.random() < 0.3, False, r.choices(["p", "li", "div"], k=r.randrange(0, 4))) for _ in range(12)]

        def total(a, b, found=found):
            return sum(w.words(found[i], False) for i in range(a, b + 1)) + sum(w.tags(found[i]) for i in range(a + 1, b + 1))

        a, b = html.region(found, w)
        best = max(total(x, y) for x in range(12) for y in range(x, 12))
        assert (total(a, b) if b >= a else 0.0) == pytest.approx(max(best, 0.0))


def toxic_rows(n, seed):
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        ws = [f"{r.choice('abcdefgh')}word{r.randrange(300)}" for _ in range(r.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                ws.insert(r.randrange(len(ws)), r.choice(["rotten", "vilest", "Grubly" + r.choice(["an", "est", "ome"])]))
        rows.append((i, " ".join(ws)))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_toxicity(spark, make_docs):
    rows, marks = toxic_rows(600, 1)
    labels = spark.createDataFrame(marks + [(9999, 1, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "rotten " + "word " * 30000 + "VILEST"), (0, rows[0][1]), (None, "rotten vilest grublyan")]
    docs = make_docs(rows + odd, clash=("toxic", "weight", "_key", "tox_score"))
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model).toPandas()
    assert len(out) == len(rows) + len(odd)
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    by = {int(r.doc_id): r for r in out.itertuples() if not np.isnan(r.doc_id)}
    assert all((by[i].tox_score >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert by[1000].tox_score == by[1001].tox_score < 0.3
    text = odd[2][1]
    assert [text[a:b] for a, b in zip(by[1002].tox_starts, by[1002].tox_ends, strict=True)] == ["rotten", "VILEST"]
    assert out[out.doc_id.isna()].tox_score.iloc[0] >= 0.3
    # labels of held out rows change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in marks], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, flipped).weights == pytest.approx(model.weights)
    blank = toxicity.learn(make_docs([]), labels.limit(0))
    assert toxicity.score(docs, blank).select("tox_score").distinct().count() == 1
    assert toxicity.score(make_docs([]), model).count() == 0


def test_marginals_are_those_of_all_words():
    """Jumps over words without features against the recursion over every word."""
    r = np.random.default_rng(1)
    model = toxicity.Model({}, -1.2, r.normal(size=(2, 2)), np.zeros(4))
    for _ in range(30):
        n = int(r.integers(1, 25))
        scores = np.where(r.random(n) < 0.3, r.normal(size=n) * 3, 0.0)
        places = np.nonzero(scores)[0]
        if not len(places):
            continue
        own = np.exp(np.stack([np.zeros(n), model.bias + scores], 1))
        step = np.exp(model.change)
        forward, backward = [own[0]], [np.ones(2)]
        for t in range(1, n):
            forward.append(forward[-1] @ step * own[t])
        for t in range(n - 1, 0, -1):
            backward.insert(0, step @ (own[t] * backward[0]))
        both = np.array(forward) * np.array(backward)
        want = both[:, 1] / both.sum(1)
        assert model.marginals(places, scores[places], n) == pytest.approx(want[places])


def test_field_gradient_learns_context():
    """The same word is toxic after one word and not after another."""
    labels, entries = [], []
    for w in range(200):
        bad = w % 2
        labels.append([bad, bad, 0])
        entries += [(w, 0, 0 if bad else 1), (w, 1, 2)]
    theta, bias, change = toxicity.fit_field(np.array(entries), np.array(labels), 3)
    model = toxicity.Model({}, bias, change, np.zeros(4))
    for bad in (0, 1):
        m = model.marginals(np.array([0, 1]), np.array([theta[0 if bad else 1], theta[2]]), 3)
        assert (m[1] > 0.5) == bool(bad)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(make_docs, reference):
    texts = [None, "", " ", "\n\n  x  \t", "a" * 3000, "ab" * 900 + "é" * 700, "日本語 12345 🙂🙂 don't we'll", "<|endoftext|>", "the " * 5000, "ÅßſḰ‍"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, ""), (None, "no id")]
    docs = make_docs(rows, clash=("ids", "decoded", "w"))
    coded = tokens.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert [c for c in coded.columns if c != "ids"] == [c for c in docs.columns if c != "ids"]
    for r in tokens.decode(coded, RANKS, public_tokenizers.PATTERN).collect():
        assert list(r.ids) == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in tokens.digests(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).filter("doc_id = 6").collect():
        ids = reference.encode_ordinary(texts[6])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[6].encode()).hexdigest()
    assert tokens.encode(make_docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_both_mergers_agree(reference):
    codec = tokens.Codec(tokens.ranks_of(RANKS), public_tokenizers.PATTERN)
    r = random.Random(6)
    words = ["".join(r.choices("abétion sh", k=r.randrange(2, 60))) for _ in range(300)]
    raw = [w.encode() for w in words]
    for w, a in zip(raw, codec.merged(raw), strict=True):
        assert codec.heaped(w) == list(a)


def test_frequent_words_stay_remembered(reference, monkeypatch):
    """A full memory keeps the words met most often, and what is kept and what is met again stay right."""
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    codec = tokens.Codec(tokens.ranks_of(RANKS), public_tokenizers.PATTERN)
    learned, learn = [], codec.learn
    monkeypatch.setattr(codec, "learn", lambda words: (learned.extend(words), learn(words)))
    r = random.Random(7)
    for _ in range(30):
        rare = ["".join(r.choices("qzxvé", k=9)) for _ in range(15)]
        texts = ["often zzqx " * 3 + " ".join(rare) + " wéirdqq zzqx", None, "zzqx"]
        ids = codec.encode(texts).to_pylist()
        assert ids == [reference.encode_ordinary(t or "") for t in texts]
        assert len(codec.number) <= 40 + 21
    assert learned.count(" zzqx") == learned.count(" wéirdqq") == 1


def test_two_vocabularies_of_one_size(spark, make_docs, tmp_path):
    """A worker that is kept never encodes with the vocabulary of another query."""
    single = [bytes([i]) for i in range(256)]
    docs = make_docs([(1, "abcab"), (2, "bca")]).coalesce(1)
    for name, extra in (("one", [b"ab", b"bc"]), ("two", [b"bc", b"ab"]), ("three", [b"ca", b"cab"])):
        ranks = {t: i for i, t in enumerate(single + extra)}
        path = tmp_path / name
        path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
        own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(2):
            got = tokens.encode(docs, str(path), public_tokenizers.PATTERN).collect()
            assert {r.doc_id: list(r.ids) for r in got} == {1: own.encode("abcab"), 2: own.encode("bca")}


def test_tokens_of_given_documents(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in tokens.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert list(r.ids) == reference.encode_ordinary(r.text)


def test_a_worker_remembers_few_words():
    """Two workers of an executor share 3000 MB with its heap of 1800 MB: 60 bytes a word and more add up."""
    ranks = {bytes([i]): i for i in range(256)}
    own = tokens.Codec(ranks, r"\S+")
    for a in range(0, 300_000, 20_000):
        own.encode([" ".join(map(str, range(a, a + 20_000)))])
    assert len(own.number) <= 220_000 and tokens.BYTES <= 500_000 and tokens.WORDS <= 5_000
