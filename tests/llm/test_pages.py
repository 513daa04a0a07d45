"""The page parser against pages made from known parts, and the pipeline on odd rows."""

import random

import pytest

import corpus_pipeline
from pairloom.llm import common, page_text

FORMS = [
    ("<article><p class='notice'>Ad<p>Real one<p>Real two</article>", ["Real one", "Real two"]),
    ("<div class='layout no-sidebar'><article><p>In</article></div>", ["In"]),
    ("<div class='post share-enabled'><article>In</article></div>", ["In"]),
    ("<div class='sidebar'><article>In</article></div><div class='sidebar'>Out</div>", ["In"]),
    ("<article>Main</article><article class='comment'>Me too</article>", ["Main"]),
    ("<article>It is <span class='alert'>red</span> here</article>", ["It is red here"]),
    ("<nav>menu<article><h1>T</h1>ok</article>", ["T", "ok"]),
    ("<article><div></section>a</div></div>b</article>c", ["a", "b"]),
    ("<article><ul><li class=ad>x<li>y<li>z</ul><table><tr><td class=promo>n<td>o<tr><td>p</table>q</article>", ["y", "z", "o", "p", "q"]),
    ("<article><dl><dt>a<dd class='ads'>b<dt>c</dl><section class=comments><p>d</section>e</article>", ["a", "c", "e"]),
    ("<article><P>One<DIV>two<P>three</DIV>four", ["One", "two", "three", "four"]),
    ("<main id=content><header>Head</header><aside>no<p>no</aside><p>yes</main><header>no</header>", ["Head", "yes"]),
    ("<article><p>a<form><p>b<input value='>'></form>c</article>", ["a", "c"]),
]


@pytest.mark.parametrize("page, want", FORMS)
def test_forms_of_markup(page, want):
    found, inside, _ = page_text.blocks(page)
    assert found and inside == want


def test_pages_made_of_known_parts():
    """Random nesting; what should be found is known from how the page was made."""
    draw = random.Random(6)

    def words():
        return " ".join(f"w{draw.randrange(1000)}" for _ in range(draw.randrange(1, 5)))

    def line(expected):
        plain = words()
        if expected is not None:
            expected.append(plain)
        head, *tail = plain.split(" ", 1)
        return f"<b>{head}</b> " + "".join(f"<span class='alert'>{t}</span>" for t in tail)

    def part(depth, expected):
        kind = draw.randrange(7) if depth else 0
        close = draw.random() < 0.5
        if kind <= 1:
            return f"<p>{line(expected)}" + ("</p>" if close else "")
        if kind == 2:
            end = "</li>" if close else ""
            return "<ul>" + "".join(f"<li>{line(expected)}{end}" for _ in range(draw.randrange(1, 4))) + "</ul>"
        if kind == 3:
            left = draw.choice(["<aside>{}</aside>", "<div class='ad'>{}</div>", "<section id=comments>{}</section>", "<nav>{}</nav>"])
            return left.format("".join(part(depth - 1, None) for _ in range(draw.randrange(1, 3))))
        if kind == 4:
            return f"<li class='promo'>{words()}</li>"
        name = draw.choice(["div class='no-sidebar'", "section", "blockquote", "div"])
        return f"<{name}>" + "".join(part(depth - 1, expected) for _ in range(draw.randrange(1, 4))) + f"</{name.split()[0]}>"

    for _ in range(400):
        expected = []
        body = "".join(part(3, expected) for _ in range(4))
        page = (f"<html><head><title>T</title></head><body><nav><ul><li>{words()}<li>{words()}</ul></nav>"
                f"<div class='layout has-footer'><article>{body}</article></div><footer>{words()}</footer>")
        found, inside, _ = page_text.blocks(page)
        assert found and inside == expected, page


def test_long_pages_are_read_whole():
    lines = [f"line {i}" for i in range(20_000)]
    found, inside, _ = page_text.blocks("<article>" + "".join(f"<p>{x}" for x in lines) + "</article>")
    assert found and inside == lines


def test_pipeline_stages_on_odd_rows(spark):
    long = " ".join(f"the word number {i} and so on" for i in range(3000))
    good = " ".join(f"this is the text of a document with many different words {i} in it" for i in range(12))
    rows = [(1, good, "en", "s", 7), (2, good, "en", "s", 7), (2, good, "en", "s", 7), (None, good + " more", "en", None, None),
            (3, None, None, None, None), (4, "", "en", "s", 0), (5, long, "en", "s", 1), (6, "12 34", None, "s", 2)]
    names = "doc_id long, text string, lang string, _row string, _text long"
    docs = spark.createDataFrame(rows, names).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
        docs = common.stage(after, f"test-{name}")
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert not kept & {3, 4}
    packed = corpus_pipeline.best_fit_packing(spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == kept
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), "").count() == 0
