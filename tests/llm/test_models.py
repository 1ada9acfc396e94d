"""Packing, extraction, language model, language identification and toxicity."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from panelwise.llm import html_text as ht, language_id as li, language_model as lm, packing as pk, toxicity as tx
from panelwise.llm.subwords import Encoder, default_path

ODD = ["", None, "a", "two  spaces", "a \n b", " lead", "trail ", "a\n\nb c", "tab\t x", "x   y", "<|endoftext|> z", "é ü n", "w " * 4000,
       "don't I'll we've", "\r\n", "12 345,6 %", "日本語 テキスト", "a b c", "y" * 5000]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_ids_equal_the_tokenizer(documents):
    code = Encoder(default_path())
    texts = ODD + [r.text for r in documents.select("text").limit(300).collect()]
    whole = code.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for _ in range(2):  # cold and from the cache
        for raw, e in zip(code.ids(texts), whole):
            assert np.frombuffer(raw, "<u4").tolist() == e.ids


def packed(spark, rows, capacity=64, group=200):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    return df, pk.pack(pk.stored(pk.pieces(df, capacity=capacity)), capacity, group).toPandas()


def test_packing_round_trip(spark):
    rows = [(i, " ".join(["word"] * (i % 90))) for i in range(700)] + [(None, "x"), (5, "again"), (5, "again"), (1, None)]
    _, got = packed(spark, rows)
    code = Encoder(default_path())
    wanted = Counter()
    for doc, raw in zip((r[0] for r in rows), code.ids([r[1] for r in rows])):
        ids = np.append(np.frombuffer(raw, "<u4"), 0).astype("<u4")
        for i, (s, n) in enumerate(pk.cut(len(ids), 64)):
            assert n == 64 or i == 0
            wanted[(doc, i, s, n, zlib.crc32(ids[s:s + n].tobytes()))] += 1
    plain = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert Counter(plain) == wanted
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.length.sum() <= 64 and (seq.offset.to_numpy() == seq.length.cumsum().to_numpy() - seq.length.to_numpy()).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) * 1.03 + 1
    assert len(packed(spark, [])[1]) == 0


def test_local_search_empties_bins():
    size = np.array([40, 30, 30, 20, 60, 44, 34, 10, 4])
    out = pk.improve(size, np.arange(len(size)), 64)
    assert len(set(out)) <= 5 and np.bincount(out, size).max() <= 64
    rng = np.random.default_rng(1)
    size = rng.integers(600, 1100, 300)
    start = pk.best_fit(size, 2048)
    out = pk.improve(size, start, 2048)
    assert len(set(out)) < len(set(start)) and np.bincount(out, size).max() <= 2048


PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu'
        '</a></li></ul></nav><!-- c --><div class="ad">Buy now.</div><article><h1>Head &amp; line</h1><p><b>One  \n two<br><p>Three&nbsp;four</p>'
        '<aside>side</aside><form><label>mail</label><input name=q></form><p>a < b <i>it</i>alic</p><div class="comments"><p>Nice!</p></div>'
        '</article><footer>&copy; me</footer></body></html>')
WEIGHTS = {ht.WORD: 1.0, ht.LINK_WORD: 0.1, ht.ANY_TAG: -0.5, "p": -0.01, "/p": -0.01, "b": -0.01, "h1": -0.01, "/h1": -0.01, "br": -0.01}


def test_extraction():
    assert ht.extract(PAGE, WEIGHTS) == "Head & line\nOne two\nThree four\na < b italic"
    body = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    assert ht.extract(body, WEIGHTS) == "Head & line\nOne two\nThree four\na < b italic"
    assert ht.extract(None, WEIGHTS) == "" and ht.extract("", WEIGHTS) == "" and ht.extract("<nav>x", WEIGHTS) == ""
    assert ht.extract("plain text", WEIGHTS) == "plain text" and ht.extract("<p>open <!-- never", WEIGHTS) == "open"
    assert ht.extract("<script>x</script><p>" + "w " * 50000, WEIGHTS) == " ".join(["w"] * 50000)


def stripped(page):
    return ht.re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_names_around_the_text_and_unclosed_tags():
    text = "Head\n" + "\n".join(f"long text of the page {i} " + "and more of it " * 9 for i in range(5))
    text = "\n".join(x.strip() for x in text.split("\n"))
    inner = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in text.split("\n")[1:])
    menu, end = '<nav><a href="/">home</a></nav>', "<footer>foot note</footer>"
    pages = [
        f'<html><body class="single no-sidebar">{menu}<article>{inner}</article>{end}</body></html>',
        f'<body>{menu}<div class="layout has-sidebar"><article>{inner}</article><div class="sidebar">side words</div></div>{end}</body>',
        f'<body>{menu}<div class="with-footer"><div>{inner}</div></div>{end}</body>',
        f'<body>{menu}<article class="post tag-search">{inner}</article>{end}</body>',
        f'<body><nav><a href="/">home</a><article>{inner}</article>{end}</body>',
        f'<body>{menu}<label>mail<div><article>{inner}</article></div>{end}</body>',
        f'<body>{menu}<form action="x"><div id="all">{inner}</div></form>{end}</body>',
        f'<body>{menu}<article>{inner}</article><div class="comments"><article><p>I agree</p></article> so do I</div>{end}</body>',
        f'<body>{menu}<article>{inner}</article><aside class="sidebar"><article><p>Another text</p></article></aside>{end}</body>',
    ]
    w = {**WEIGHTS, ht.LINK_WORD: 0.0, "article": -4.0, "/article": -4.0, "div": -3.0, "/div": -3.0, ht.WORD: 0.2}
    for p in pages:
        assert ht.extract(p, w) == text, p[:80]
    assert ht.extract("<body><nav><ul><li>only a menu</li></ul></nav></body>", w) == ""


def test_best_region_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(-5, 6, rng.integers(0, 12)).tolist()
        a, b = ht.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])


def test_extraction_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = ht.main_text(pages).select("html", "text").collect()
    for r in got:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        assert r.text.split() == ht.references.unescape(ht.re.sub("<[^>]*>", " ", inner)).split()
    extra = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [r.text for r in ht.main_text(extra).collect()] == ["", ""]
    assert ht.main_text(extra.limit(0)).count() == 0
    clash = pages.limit(5).selectExpr("*", "1 AS held", "'x' AS key", "2 AS n", "0 AS scale")
    assert sorted(r.text for r in ht.main_text(clash.unionAll(clash), ht.weights(pages)).collect()) == sorted(
        2 * [r.text for r in ht.main_text(pages.limit(5), ht.weights(pages)).collect()])


def test_extraction_without_names(spark, monkeypatch):
    """Region by learned weights alone: names taken from the pages, then from the code."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows, w = pages.select("html").collect(), ht.weights(pages)

    def right(weights, change):
        return sum(ht.extract(change(r.html), weights).split() == ht.references.unescape(ht.re.sub(
            "<[^>]*>", " ", r.html.split("<article>")[1].split("</article>")[0])).split() for r in rows) / len(rows)

    assert right(w, stripped) >= 0.95
    assert right(w, lambda p: stripped(p).replace("<article>", "").replace("</article>", "")) >= 0.95
    monkeypatch.setattr(ht, "_FURNITURE_NAMES", set())
    assert right(w, lambda p: p) >= 0.95


def test_extraction_is_not_decided_by_article_tags(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    w = ht.weights(pages)
    assert w["article"] < -1 and w["/article"] < -1 and w["p"] > -1
    for r in pages.select("html").limit(40).collect():
        assert ht.extract(r.html.replace("<article>", "").replace("</article>", ""), w) == ht.extract(r.html, w) != ""
    body = "".join(f"<p>{'long text of the page ' * 12}{i}</p>" for i in range(9))
    teasers = "".join(f"<article><p>see {i}</p></article>" for i in range(4))
    got = ht.extract(f"<html><body>{teasers}<div>{body}</div>{teasers}</body></html>", w)
    assert got.count("long text of the page") == 108 and "see" not in got


def test_language_model_counts_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(120).collect()] + [(None, None), (3, ""), (3, ""), (4, "Ab ab\tAB")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = lm.score(df, df.where(lm.fold(7) != 2)).collect()
    learn = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    wanted = sorted(((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                      round(sum(log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == wanted
    assert all(r.score < 0 for r in got)


def test_language_model_is_a_distribution_and_causal():
    rng = np.random.default_rng(0)
    m = lm.train([rng.integers(0, 7, 80) for _ in range(20)], [np.full(4, 0.25), np.full(4, 0.25)], 5)
    two = [np.array([a, b]) for a in range(7) for b in range(7)]  # class 6 is what lies beyond the last level
    assert abs(np.exp(lm.log_probabilities(two, m)).sum() - 1) < 1e-4
    s = rng.integers(0, 7, 50)
    parts = [lm.log_probabilities([s[:i]], m)[0] for i in range(1, 51)]
    assert (np.diff(parts) < 0).all()
    other = s.copy()
    other[40:] = (other[40:] + 1) % 7
    assert abs(parts[39] - lm.log_probabilities([other[:40]], m)[0]) < 1e-6
    assert abs(lm.log_probabilities([s, other], m)[0] - parts[-1]) < 1e-4


def test_language_model_counts_pairs_of_all_documents(spark, monkeypatch):
    """Also those before and behind the middle of a document and in documents that the sample leaves out."""
    monkeypatch.setattr(lm, "EPOCHS", 0)
    rows = [(i, " ".join(["alpha beta gamma"] * 300 + ["delta one"] * (100 + i % 7) + ["two x"] * 300)) for i in range(30)] + [(None, None), (40, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = lm.id_counts(lm.stored(lm.word_counts(df)), default_path())
    cls, many = lm.classes(n), sum(lm.LEVELS)
    seqs = [cls[s] for s in lm.text_ids(Encoder(default_path()), [lm.split_words(t) for _, t in rows])]
    wanted = np.zeros((lm.INPUT + 3, many + 1), np.int64)
    for s in seqs:
        for a, b in zip([lm.INPUT + 2, *np.minimum(s, lm.INPUT)], s):
            wanted[a, b] += 1
    assert (lm.corpus_pairs(df, default_path(), cls, lm.INPUT, many) == wanted).all() and wanted.sum() == n.sum()
    got = lm.fit(df, lm.stored(lm.word_counts(df)), default_path())["pairs0"]
    share = (n[np.lexsort((np.arange(lm.IDS), -n))] + 0.5)
    prior = np.append(share[:64], share[64:].sum()) / share.sum()
    level = np.column_stack([wanted[:, :64], wanted[:, 64:].sum(1)])
    assert np.allclose(got, np.log((level + 10 * prior) / (level.sum(1, keepdims=True) + 10)), atol=1e-5)


def test_language_model_learns_weights_from_every_training_document(spark, monkeypatch):
    """Documents, and words at the ends of long ones, that a sample of 2,000 middles would leave out move the weights."""
    monkeypatch.setattr(lm, "EPOCHS", 1)
    monkeypatch.setattr(lm, "TASK_IDS", 2000)
    took = []
    plain = lm.trained_round
    monkeypatch.setattr(lm, "trained_round", lambda rows, *a: took.append((rows.count(), rows.selectExpr(
        "coalesce(sum(length(ids)), 0) AS n").first()[0] // 2)) or plain(rows, *a))
    rows = [(i, f"alpha beta w{i % 7}") for i in range(2500)] + [(9000, "one two " * 2000), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = lm.stored(lm.word_counts(df))
    m = lm.fit(df, counts, default_path())
    assert sum(r for r, _ in took) == len(rows) and sum(n for _, n in took) == lm.id_counts(counts, default_path()).sum()
    assert all(np.isfinite(v).all() for k, v in m.items() if isinstance(v, np.ndarray))


@pytest.mark.parametrize("total", [600, 40_000_000, 10**11])
def test_language_model_goes_through_corpora_of_any_size_as_often(spark, monkeypatch, total):
    """Every document takes part in EPOCHS rounds; before, those of more than 30 million ids were seen once."""
    rows = spark.createDataFrame([(i % lm.PARTS, bytearray(np.full(12, i, "<u2").tobytes())) for i in range(50)], "part int, ids binary")
    took = Counter()
    monkeypatch.setattr(lm, "trained_round", lambda some, p, *a: took.update(bytes(r.ids) for r in some.collect()) or p)
    lm.train_corpus(rows, total, [np.full(n + 1, 1 / (n + 1)) for n in lm.LEVELS], lm.INPUT)
    assert len(took) == 50 and set(took.values()) == {lm.EPOCHS}


def test_language_model_mean_of_tasks(spark):
    """The mean of two tasks' weights, by ids; a later round begins where the last one ended."""
    rng = np.random.default_rng(4)
    priors = [np.full(7, 1 / 7), np.full(2, 0.5)]
    seqs = [rng.integers(0, 7, k) for k in (40, 200)]
    fixed, p = lm.pairs(lm.count_pairs(seqs, 6, 7), 6, lm.starts_of(priors), priors), lm.initial(priors, 6)
    raw = [(bytearray(s.astype("<u2").tobytes()),) for s in seqs]
    frames = [spark.createDataFrame(spark.sparkContext.parallelize(r, len(r)), "ids binary") for r in (raw[:1], raw[1:], raw)]
    one, two = (lm.trained_round(f, p, fixed, 6, 0.01) for f in frames[:2])
    both = lm.trained_round(frames[2], p, fixed, 6, 0.01)
    assert all(np.allclose(both[k], (40 * one[k] + 200 * two[k]) / 240, atol=1e-5) for k in p) and np.abs(one["e"] - p["e"]).max() > 0
    nothing = lm.trained_round(frames[0].where("false"), p, fixed, 6, 0.01)
    assert all((nothing[k] == p[k]).all() for k in p)


def test_language_model_sees_sixteen_ids_back():
    """Each id depends on the one 16 places before it, wherever blocks begin; the quick form equals the training's."""
    rng = np.random.default_rng(2)
    m = lm.train([rng.integers(0, 9, 60) for _ in range(20)], [np.full(10, 0.1)], 9)
    s, t = rng.integers(0, 9, 48), rng.integers(0, 9, 9)
    seen = lambda s: lm.attend(lm.blocks([s], 9)[0], m)["o"].reshape(-1, lm.EMBED)
    for i in range(17, 48):
        other = s.copy()
        other[i - 16] = (other[i - 16] + 1) % 9
        assert np.abs(seen(s)[i] - seen(other)[i]).max() > 1e-6
    x = lm.blocks([s, t], 9)[0]
    assert np.allclose(lm.hidden(x, m), lm.attend(x, m)["h"].reshape(-1, lm.HIDDEN), atol=1e-4)


def test_language_model_uses_what_is_further_back():
    """Every second id repeats the id three places before, which pairs of ids can't tell."""
    rng = np.random.default_rng(5)
    seq = []
    for _ in range(1500):
        s = rng.integers(0, 6, 64)
        s[4::2] = s[1:-3:2][:len(s[4::2])]
        seq.append(s)
    m = lm.train(seq[:-50], [np.full(7, 1 / 7), np.full(2, 0.5)], 6)
    assert lm.log_probabilities(seq[-50:], m).mean() / 64 > np.log(1 / 6) * 0.85


def test_language_model_beats_id_shares(spark, documents):
    """Held-out texts against the add-one shares of the same ids; the word base line needs more text than this to lose."""
    got = lm.score(documents, documents.where(lm.fold(7) != 2)).where(lm.fold(7) == 2).agg(F.sum("score")).first()[0]
    code, rows = Encoder(default_path()), documents.select("text", (lm.fold(7) == 2).alias("held")).collect()
    ids = {h: np.concatenate(lm.text_ids(code, [lm.split_words(r.text) for r in rows if r.held == h])) for h in (True, False)}
    n = np.bincount(ids[False], minlength=lm.IDS) + 1.0
    assert got > 0.8 * np.log10(n / n.sum())[ids[True]].sum()


def test_language_id(spark, documents):
    m = li.train(li.sample(documents.where(li.fold(4) != 2), 60))
    held = li.predict(documents.where(li.fold(4) == 2), m).where("lang IS NOT NULL")
    assert held.where("language.lang_pred = lang").count() / held.count() > 0.95
    rows = spark.createDataFrame([(None, None), (1, ""), (2, "12 ½ !!"), (3, "the and of with " * 9000)], "doc_id long, text string")
    out = {r.doc_id: r.language for r in li.predict(rows, m).collect()}
    assert [out[k].lang_pred for k in (None, 1, 2)] == ["und"] * 3 and out[3].lang_pred == "en" and 0 <= out[3].score <= 1
    assert li.predict(rows, li.train([])).where("language.lang_pred <> 'und'").count() == 0


def test_toxicity(spark):
    documents, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = tx.learn_and_score(documents, labels.where(tx.fold(3) != 1))
    held = got.join(labels.where(tx.fold(3) == 1), "doc_id").select("score", "toxic").toPandas()
    pos, neg = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert auc > 0.97 and ((pos >= 0.7).mean() > 0.9) and ((neg >= 0.7).mean() < 0.01) and got.where("score < 0 OR score > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!! ??"), (3, "a" * 100_000), (None, "x")], "doc_id long, text string")
    assert tx.learn_and_score(odd, labels).count() == 5
    assert tx.learn_and_score(odd.limit(0), labels.limit(0)).count() == 0


def test_isotonic_rises():
    rng = np.random.default_rng(2)
    s = rng.normal(size=300)
    x, y = tx.isotonic(s, (s + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


def test_language_model_row_sums_and_gathered_gradients():
    """Short ways of the training step: exponentials without a softmax, also of far rows, and sums by class."""
    rng = np.random.default_rng(4)
    for shift in (0, 200, -200):
        z = rng.normal(0, 3, (7, 30)).astype(np.float32) + np.float32(shift)
        wanted = lm.softmax(z.copy())
        total = lm.exps(z)
        assert np.allclose(z / total[:, None], wanted, rtol=1e-5, atol=1e-7)
    assert lm.exps(np.zeros((0, 5), np.float32)).shape == (0,)
    at, rows = rng.integers(0, 9, 100), rng.normal(size=(100, 3))
    wanted = np.zeros((12, 3))
    np.add.at(wanted, at, rows)
    assert np.allclose(lm.summed(at, rows, 12), wanted)
    assert not lm.summed(at[:0], rows[:0], 12).any()


def test_language_model_gradients_are_derivatives():
    rng = np.random.default_rng(5)
    priors = [np.full(5, 0.2), np.full(4, 0.25)]
    sequences = [rng.integers(0, 8, n) for n in (3, 40, 17)]
    x, y, _ = lm.blocks(sequences, 6)
    fixed = lm.pairs(lm.count_pairs(sequences, 6, 7), 6, lm.starts_of(priors), priors)
    p = {k: v.astype(np.float64) for k, v in lm.initial(priors, 6).items()}
    g, n = lm.gradients(x, y, p, fixed), sum(map(len, sequences))

    def loss():
        return -lm.log_probabilities(sequences, lm.tables(p, fixed)).sum() / n

    for k, v in p.items():
        for i in rng.choice(v.size, 3):
            kept, by = v.flat[i], 1e-3
            v.flat[i] = kept + by
            up = loss()
            v.flat[i] = kept - by
            slope, v.flat[i] = (up - loss()) / (2 * by), kept
            assert abs(slope - g[k].flat[i]) < 1e-3, k
