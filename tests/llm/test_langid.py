import itertools
import math
import re
from collections import Counter

import numpy as np

from riskframe.llm import langid
from riskframe.llm.langid import SWITCH, Words


def test_held_out_accuracy(spark):
    got = langid.op3_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert 150 < len(held) < 350 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def brute_predictions(rows, asked):
    """Counts, word scores and the best path once more, word by word, in plain Python."""
    lower = lambda c: x if len(x := c.lower()) == 1 else c
    script = lambda c: langid._NAMES[langid._SCRIPT[max(k for k, a in enumerate(langid._FROM) if a <= ord(c))]]

    def buckets(word):
        chars = [0, *(ord(lower(c)) for c in word), 0]
        keys = np.array([a << 42 | b << 21 | c for a, b, c in zip(chars, chars[1:], chars[2:], strict=False)], np.uint64)
        return (langid.mixed(keys, 1) >> np.uint64(48)).tolist()

    words = lambda t: re.findall(r"[^\W\d_]+", t or "")
    languages = sorted({x for _, x in rows if x})
    counts, letters = {x: Counter() for x in languages}, {x: Counter() for x in languages}
    for text, x in rows:
        for w in words(text) if x else ():
            counts[x].update(buckets(w))
            letters[x][script(w[0])] += len(w)
    totals = {x: sum(c.values()) for x, c in counts.items()}
    whole = {x: max(1, sum(c.values())) for x, c in letters.items()}

    def score(word, x):
        near = [y for y in languages if letters[y][script(word[0])] >= langid.SCRIPT_SHARE * whole[y]] or languages
        fit = sum(math.log((counts[x][b] + 0.1) / (totals[x] + 0.1 * langid.BUCKETS)) for b in buckets(word))
        return fit - (0 if x in near else 1e6)

    for text in asked:
        own, best = words(text), []
        for k, w in enumerate(own):
            row = {}
            for x in languages:
                if not k:
                    row[x] = (score(w, x), [x])
                else:
                    value, path = max(((v - (SWITCH if y != x else 0), p) for y, (v, p) in best.items()), key=lambda o: o[0])
                    row[x] = (value + score(w, x), [*path, x])
            best = row
        if not own:
            yield "und", 0.0
            continue
        path = max(best.values(), key=lambda o: o[0])[1]
        share = Counter()
        for w, x in zip(own, path, strict=True):
            share[x] += len(w)
        top = max(languages, key=lambda x: (share[x], [-ord(c) for c in x]))
        yield top, share[top] / sum(share.values())


def test_predictions_against_brute_force(spark):
    table = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    asked = [" ".join(t.split()[:60]) for t, _ in table[:50] if t] + [f"{' '.join((a[0] or '').split()[:9])} {' '.join((b[0] or '').split()[:9])}" for a, b in itertools.pairwise(table[50:80])] + [None, "", "12 !", "\U00030000x\U00030001"]
    model = langid.train(corpus(spark, table))
    got = {r.doc_id: r for r in langid.predict(corpus(spark, [(t, None) for t in asked]), model).collect()}
    for k, (name, share) in enumerate(brute_predictions(table, asked)):
        assert got[k].lang_pred == name and abs(got[k].score - share) < 1e-9, asked[k]


def corpus(spark, rows):
    return spark.createDataFrame([(k, t, x, "clash", 0.5) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, lang_pred string, score double")


def test_mixed_text_and_odd_rows(spark):
    en, ru, el = "the quick thing and that other with", "это который был очень хорошо", "και αυτό είναι ένα πολύ"
    rows = [(en * 5, "en"), (ru * 5, "ru"), (el * 5, "el"), (en, None), (None, "en"), ("", "xx"), ("123 !?", "en")]
    docs = corpus(spark, rows)
    model = langid.train(docs)
    assert model.languages == ["el", "en", "ru"]
    tried = corpus(spark, [(f"{en} {ru} {ru} {en}", None), (None, None), ("", None), ("42 ___", None), ("日本", None), (ru * 4000, None), (en, None), (en, None), ("\U0001f600 ẞß İ that with", None)])
    got = {r.doc_id: r for r in langid.predict(tried, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model.languages
    assert got[5].lang_pred == "ru" and got[6].lang_pred == got[7].lang_pred == got[8].lang_pred == "en"
    spans = [r[1:] for r in langid.language_spans(tried, model).where("doc_id = 0").orderBy("start").collect()]
    text = f"{en} {ru} {ru} {en}"
    assert [s[2] for s in spans] == ["en", "ru", "en"] and text[spans[1][0] : spans[1][1]].strip() == f"{ru} {ru}" and spans[-1][1] == len(text)
    assert langid.predict(tried.limit(0), model).count() == 0
    assert langid.predict(tried, model, carry=("score", "doc_id")).columns == ["score_in", "doc_id", "lang_pred", "score"]
    nothing = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(tried, nothing).collect()} == {("und", 0.0)}
    assert langid.language_spans(tried, nothing).count() == 0


def test_paths_against_enumeration():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b", "c"], np.ones((langid.BUCKETS, 3)), np.ones((len(langid._NAMES), 3)))
    texts = ["x " * n for n in (6, 1, 0, 4, 6, 2)]
    w = Words(texts)
    scores = (rng.normal(size=(len(w.first), 3)) * 5).astype(np.float32)
    model.word_scores = lambda _: scores
    labels = model.label(w)
    for a, b in itertools.pairwise(w.bounds):
        own = scores[a:b].astype(float)
        if b > a:
            value = lambda p, own=own: sum(own[k, x] for k, x in enumerate(p)) - SWITCH * sum(x != y for x, y in itertools.pairwise(p))
            best = max(value(p) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(value(labels[a:b]) - best) < 1e-3 and abs(value(langid._path(scores[a:b])) - best) < 1e-3
