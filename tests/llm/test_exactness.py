"""Ids against the library's own, and pages against another parser."""

import random
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from corpusloom.llm import html_text, tokens


def test_ids_are_the_librarys_for_control_characters():
    """Signs that one rule or another takes as space: several texts at once, so that an id that moves shows."""
    from tokenizers import Tokenizer

    path = tokens.default_path()
    ours, theirs = tokens.WordTokenizer(path), Tokenizer.from_file(path)
    rnd = random.Random(11)
    signs = list("abcxyz019'.,!?-ABé ñß\n  st") + [chr(i) for i in range(32)] + ["\x7f", "\x85", "\xa0", " ", "　", "﻿"]
    batches = [["x9\x1f", "!\x1f!"], ["\x1c", "a\x1d1", "\v.\f"]] + [["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12))) for _ in range(50)] for _ in range(400)]
    for texts in batches:
        ids, bounds = ours.encode(pa.array(texts))
        want = [e.ids for e in theirs.encode_batch_fast(texts, add_special_tokens=False)]
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><svg/><article><p>all</p></article></body>", "all"),
        ('<article><figure><svg viewBox="0 0 1 1" /></figure><p>tail</p></article>', "tail"),
        ("<article><svg a=1/>in it</svg><p>after</p></article>", "after"),
        ("<p>a<svg><svg><g/></svg>in it</svg>b</p>", "a b"),
        ("<p>a<math/>b<SVG>rest", "a b"),
        ("<article><p>a</p><div class='related-posts'>b</div></article>", "a"),
    ],
)
def test_elements_of_other_languages_end_where_they_are_closed(page, text):
    assert html_text.main_text(html_text.blocks(page)) == text


GONE = ("nav", "aside", "footer", "script", "style", "svg", "math", "button", "select")


class Reader(HTMLParser):
    """The text outside elements that are no main text, of pages without unclosed tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.parts.append(" ")
        if tag in GONE:
            self.depth += 1
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag in html_text.FOREIGN:
            self.parts.append(" ")
        elif tag not in html_text.VOID:
            self.handle_starttag(tag, attrs)
        elif tag in html_text.BLOCK:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.parts.append(" ")
        if tag in GONE:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def page_of(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        word = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))
        if kind < 0.4 or depth > 4:
            out.append(rnd.choice((word, f" {word} ", f"{word}&amp;{word}", f"{word}<br>{word}", f"{word}<!-- {word} -->", "\n", f"<b>{word}</b>{word}")))
        elif kind < 0.55:
            out.append(rnd.choice(("<svg/>", f"<svg a='1' />{word}", f"<svg><title>{word}</title></svg>", f"<svg><svg/><g>{word}</g></svg>", "<math />", "<hr/>", "<img src='x'/>")))
        elif kind < 0.75:
            tag = rnd.choice(("nav", "aside", "footer", "button"))
            out.append(f"<{tag}>{page_of(rnd, depth + 1)}</{tag}>")
        else:
            tag = rnd.choice(("div", "section", "p", "ul", "blockquote", "h2", "article"))
            inner = f"<span>{word}</span>" if tag in ("p", "h2") else page_of(rnd, depth + 1)
            out.append(f"<{tag} class='c'>{inner}</{tag}>")
    return "".join(out)


def test_the_walk_is_another_parsers_on_well_formed_pages():
    rnd = random.Random(4)
    for _ in range(1500):
        page = f"<html><head><title>t</title></head><body>{page_of(rnd)}</body></html>"
        # outside an article all is open: what settles pages takes no part here
        reader = Reader()
        reader.feed(page[page.index("<body>") :])
        reader.close()
        got = " ".join(t for t, kind in html_text.blocks(page) if kind != html_text.OTHER)
        assert got == " ".join("".join(reader.parts).split()), page


def test_pages_with_an_article_go_through_the_array(spark):
    """No block of these pages is open; what their menus share is found all the same."""
    menu = "<nav>home news about us contact help</nav>"
    rows = [(i, "http://h.example/", f"{menu}<article>text {i}</article><footer>Bye</footer>") for i in range(3)] + [(3, "http://h.example/", "<nav>alone here</nav><main>text 3</main>"), (4, "http://other.example/", f"{menu}<main>text 4</main>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.text, r.n_outside, r.n_repeated) for r in got} == {i: (f"text {i}", *((7, 7) if i < 3 else (2, 0) if i == 3 else (6, 0))) for i in range(5)}
