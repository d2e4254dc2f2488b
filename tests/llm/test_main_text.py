"""Block reading on awkward markup, the labeller's gradients, and held-out extraction."""

import random

import numpy as np
import pytest

from siftmill.llm import main_text

WORDS = "alder birch cedar elm fir hazel juniper larch maple oak pine rowan".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def real_page(rng):
    body = [prose(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 9))]
    title = prose(rng, 4)
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 4))
    page = f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- ad --><div class="ad">{prose(rng, 6)}</div><article><h1>{title}</h1><p><b>{title}<br>{"".join(f"<p>{t}</p>" for t in body)}</article><footer>&copy; {prose(rng, 3)}</footer></body></html>'
    return page, "\n\n".join([title, title, *body])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return main_text.train([real_page(rng)[0] for _ in range(60)])


def texts(page):
    return [b.text for b in main_text.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;c<br>d\n\n e<p>f</p>g") == ["a & b c d e", "f", "g"]
    assert texts("<ul><li>one<li><b>two</b> x</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["one", "two x", "1", "2", "3"]
    assert texts('<div title="a > b">in</div><script>"</div><p>"</script>out<!-- <p>no') == ["in", "out"]
    assert texts("<title>t</title><body>x<textarea>y</textarea> z") == ["x z"] and texts("") == [] == texts("<p> </p>")
    assert texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"] or texts("1 < 2 and 3 > 2")
    nested = main_text.blocks('<div class="Post main"><a href=x>link</a> word</div>')[0]
    assert nested.path == ("div post main", "a") and nested.linked == 4
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 10)) == 1


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = main_text.Labeller(1, inputs=4, hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = main_text.padded([rng.normal(size=(n, 4)) for n in (3, 5)])
    y = (rng.random(mask.shape) < 0.5).astype(float)
    _, grads = model.gradients(x.astype(np.float64), mask, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-3, -1e-3):
            model.weights[k][at] += step
            losses.append(model.gradients(x.astype(np.float64), mask, y)[0])
            model.weights[k][at] -= step
        assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 1e-4


def test_held_out_pages(model):
    rng = random.Random(2)
    pages = [real_page(rng) for _ in range(80)]
    assert main_text.main_texts(model, [p for p, _ in pages]) == [t for _, t in pages]


def test_held_out_layouts(model):
    rng = random.Random(3)
    right = total = 0
    for _ in range(150):
        found = main_text.blocks(main_text.composed_page(rng, [prose(rng, 20) for _ in range(30)], WORDS))
        for b in found:
            b.path = tuple(e for e in b.path if e != "mark-main")
        p = main_text.label(model, [found])[0]
        right += sum((x >= 0.5) == b.main for x, b in zip(p, found, strict=True))
        total += len(found)
    assert right / total > 0.96


def test_whole_table(frame, model):
    rng = random.Random(4)
    page, want = real_page(rng)
    long = page.replace("</article>", "".join(f"<p>{prose(rng, 30)}</p>" for _ in range(3000)) + "</article>")
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (4, "x", long), (5, "y", "<nav><a>menu</a></nav>")]
    out = main_text.extract(frame(rows, "page_id long, url string, html string, text int, n_chars int", 2), model).collect()
    got = {(r.page_id, r.url): r.text for r in out}
    assert len(out) == len(rows) and got[1, "u"] == got[None, "w"] == want and got[2, None] == got[3, "v"] == ""
    assert got[4, "x"].count("\n\n") == want.count("\n\n") + 3000 and all(r.n_chars == len(r.text) for r in out)
    empty = frame([], "page_id long, url string, html string")
    assert main_text.extract(empty, main_text.fit(empty)).count() == 0
