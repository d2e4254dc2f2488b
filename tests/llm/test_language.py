"""Language identification: evidence, held-out accuracy and a plain computation of the fusion."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftmill.llm import language

STEMS = {"aa": ["thing", "when", "ous", "ther"], "bb": ["que", "eau", "ment", "oir"], "cc": ["sch", "ung", "keit", "ein"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(frame):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, 60), lang) for i, lang in enumerate(list(STEMS) * 40)] + [(900, None, "aa"), (901, "no label", None)]
    return language.fit(frame(rows))


def test_parts_of_pages():
    assert language.declared_language('<html class=x lang="fr-CA">') == "fr"
    assert language.declared_language("<HTML LANG = de>") == "de" and language.declared_language("<p lang=es>") is None
    assert language.declared_language('<meta http-equiv="Content-Language" content="es">') == "es"
    assert language.visible_text("<script>x<y</script>a&amp;b<!-- <p>no --><b>c</b>").split() == ["a&b", "c"]
    assert language.host_parts("https://m.a.example.fr:80/x?y") == ("m.a.example.fr", "example.fr", "fr")
    assert language.host_parts(None) == language.host_parts("http://[bad") == ("", "", "") and language.host_parts("src1") == ("src1", "src1", "")


def test_trigrams_stay_inside_texts():
    both, ends = language.trigrams(pa.array(["abc", "", "de", "fgh i", "é"], pa.large_string()))
    one, _ = language.trigrams(pa.array(["fgh i"], pa.large_string()))
    assert np.diff(ends).tolist() == [1, 0, 0, 2, 0] and both[1:].tolist() == one.tolist()
    for odd in ([], [""], ["a"], ["ab", "c"]):
        found, ends = language.trigrams(pa.array(odd, pa.large_string()))
        assert not len(found) and not ends.any() and len(ends) == len(odd) + 1


def test_held_out_accuracy(frame, model):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.choice([2, 5, 80])), lang) for i, lang in enumerate(list(STEMS) * 50)]
    truth = {k: lang for k, _, lang in rows}
    out = language.identify(frame(rows), model, "doc_id", "text").collect()
    assert np.mean([truth[r.doc_id] == r.lang for r in out]) > 0.97


def test_fusion_equals_a_plain_computation(frame, model):
    rng = random.Random(6)
    rows = []
    for i in range(90):
        lang = rng.choice(list(STEMS))
        host = rng.choice(["h1.one.aa", "h2.one.aa", "hot.two.bb", "hot.two.bb", "x.three.zz"])
        page = f'<html lang="{rng.choice([lang, lang, lang, "bb", "qq"])}"><body><p>{prose(rng, lang, rng.choice([0, 1, 30]))}</p></body></html>'
        rows.append((i, f"http://{host}/{i}", page))
    rows += [(90, None, None), (91, "::", ""), (None, "http://h1.one.aa", "<p>que</p>"), (5, "http://hot.two.bb", "<p>ung</p>")]
    got = language.identify(frame(rows, "page_id long, url string, html string"), model, "page_id", "html", url="url", html=True).collect()
    assert len(got) == len(rows)
    names = model.languages
    text = [language.visible_text(h or "") for _, _, h in rows]
    told, n = model.log_likelihoods(pa.array(text, pa.large_string()))
    own = np.exp(told - told.max(1, keepdims=True))
    own = own / own.sum(1, keepdims=True) * (n > 0)[:, None]
    parts = [language.host_parts(u) for _, u, _ in rows]
    said = [language.declared_language(h or "") or "" for _, _, h in rows]
    counts = defaultdict(lambda: np.zeros(3))
    for p, d, o in zip(parts, said, own, strict=True):
        for k in (("h", p[0]), ("d", p[1]), ("s", p[2]), ("l", d)):
            counts[k] += o
    overall = (own.sum(0) + 1) / (own.sum() + 3)
    want = Counter()
    for (k, _, _), p, d, o, t in zip(rows, parts, said, own, told, strict=True):
        above = np.maximum(counts["d", p[1]] - o, 0) + language.HOST_WEIGHT * overall
        prior = np.maximum(counts["h", p[0]] - o, 0) + language.HOST_WEIGHT * above / above.sum()
        score = t + np.log(prior / prior.sum())
        for kind, v in (("s", p[2]), ("l", d)):
            expected = np.array([0.9 if v == x else 0.05 for x in names]) if v in names else overall
            c = np.maximum(counts[kind, v] - o, 0)
            score = score + np.log((c + 20 * expected) / (c.sum() + 20) / overall)
        post = np.exp(score - score.max())
        want[k, names[int(post.argmax())], round(float(post.max() / post.sum()), 6)] += 1
    assert Counter((r.page_id, r.lang, round(r.posterior, 6)) for r in got) == want
    assert all(r.kept == (r.posterior >= language.LEAST_POSTERIOR) and math.isfinite(r.posterior) for r in got)


def test_odd_tables(frame, model):
    assert language.identify(frame([]), model, "doc_id", "text", "source", "lang").count() == 0
    nothing = language.fit(frame([(1, "text", None)]))
    assert [r.lang for r in language.identify(frame([(1, "x")]), nothing, "doc_id", "text").collect()] == [None]
    clash = frame([(1, "quement eau", "bb", "s", 7)], "doc_id long, text string, lang string, source string, posterior int")
    kept = language.keep_identified(clash, model).collect()
    assert len(kept) == 1 and kept[0].posterior == 7


FOREIGN = {
    500: "Съешь же ещё этих мягких французских булок да выпей чаю, потом ещё раз. " * 6,
    501: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 6,
    502: "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 8,
    503: "xkcd qwrt zzkp bvnm hjkl wqrtp sdfgh mnbvc lkjhg trwqp " * 8,
}


def test_foreign_texts_are_rejected(frame, model):
    rng = random.Random(12)
    known = [(i, prose(rng, lang, rng.choice([1, 3, 20, 200])), lang, "src") for i, lang in enumerate(list(STEMS) * 40)]
    foreign = [(k, t, lang, "src") for (k, t), lang in zip(FOREIGN.items(), ("aa", "bb", None, "cc"), strict=True)]
    uncertain = [(600, "thing " * 3 + "que eau " * 3, "bb", "src"), (601, None, None, "other")]
    docs = frame(known + foreign + uncertain)
    out = {r.doc_id: r for r in language.identify(docs, model, "doc_id", "text", "source", "lang").collect()}
    assert not any(out[k].kept or out[k].text_lang for k in FOREIGN) and not out[601].kept
    assert all(out[k].kept and out[k].lang == lang for k, _, lang, _ in known)
    left = {r.doc_id for r in language.keep_identified(docs, model).collect()}
    assert not left & {*FOREIGN, 601} and {k for k, *_ in known} <= left


def test_stage_rejects_foreign_texts(spark, frame):
    import corpus_pipeline

    rng = random.Random(13)
    docs = [(i, prose(rng, lang, 60), lang, f"src{i % 3}") for i, lang in enumerate(list(STEMS) * 20)]
    docs = frame(docs + [(k, t, None, "src0") for k, t in FOREIGN.items()])
    assert {r.doc_id for r in corpus_pipeline.identified(spark, docs, "").collect()} == set(range(60))


def test_all_documents_are_counted(frame):
    rng = random.Random(9)
    rows = [(i, prose(rng, "aa", 4), "aa") for i in range(2500)]
    seen = len(language.trigrams(pa.array([t for _, t, _ in rows], pa.large_string()))[0])
    told = np.exp(language.fit(frame(rows)).table)
    assert np.isclose(0.5 / told.min(), seen + 0.5 * language.BUCKETS)
