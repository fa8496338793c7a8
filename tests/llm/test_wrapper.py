"""Operator 5 on invented hosts whose main text is known, and its pieces."""

import random
import time

import pytest

from burrow.llm import wrapper


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def host(seed, pages=8):
    """Pages of an invented host, with their main text. Menus, notices, comments and footers mostly have no telling name."""
    r = random.Random(seed)
    menu = r.choice(["<ul>{}</ul>", "<div><ul>{}</ul></div>", "<div class='top-links'>{}</div>", "<nav><ul>{}</ul></nav>"])
    notice = r.choice(["", "<div>{}</div>", "<p>{}</p>", "<section class='x9'>{}</section>"]).format(sentence(r, 12))
    shell = r.choice(["<div class='c{}'>{}</div>", "<article>{1}</article>", "<main><div>{1}</div></main>", "<section>{1}</section>"])
    talk = r.choice(["", "<div class='feedback-list'>{}</div>", "<div>{}</div>", "<section><h3>Voices</h3>{}</section>"])
    foot = r.choice(["<footer>{}</footer>", "<div class='copyright'>{}</div>", "<div>{}</div>"]).format("All rights are kept by the people of this site since 1999")
    out = []
    for k in range(pages):
        blocks, body = [], []

        def add(tag, n, attributes="", blocks=blocks, body=body):
            blocks.append(sentence(r, n))
            body.append(f"<{tag}{attributes}>{blocks[-1]}</{tag}>")

        add("h1", 5)
        for _ in range(r.randrange(3, 9)):
            kind = r.random()
            if kind < 0.15:
                add("h2", 3)
            if kind < 0.25:
                body.append("<ul>")
                for _ in range(r.randrange(2, 5)):
                    add("li", 4)
                body.append("</ul>")
            add("p", r.randrange(15, 50), r.choice(["", "", " class='social'"]))
        if r.random() < 0.3:
            body.append("<div id='related-work'>")
            add("p", 30)
            body.append("</div>")
        links = "".join(("<li>{}</li>" if "ul" in menu else "{} ").format(f"<a href='/{i}'>{sentence(r, 2)}</a>") for i in range(r.randrange(4, 9)))
        said = "".join(f"<div><b>{sentence(r, 2)}</b><p>{sentence(r, r.randrange(5, 14))}</p></div>" for _ in range(r.randrange(5)))
        inner = shell.format(k, "".join(body)) if "{}" in shell else shell.replace("{1}", "".join(body))
        out.append((f"<html><body>{menu.format(links)}{notice if r.random() < 0.8 else ''}{inner}{talk.format(said) if said else ''}{foot}</body></html>", "\n".join(blocks)))
    return out


def test_invented_hosts(spark):
    rows, want = [], {}
    for seed in range(30):
        for k, (page, text) in enumerate(host(seed)):
            rows.append((seed * 100 + k, f"https://host{seed}.example/{k}", page))
            want[seed * 100 + k] = text
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_the_wrapper_decides(spark):
    """A text that is running on its own page is fixed over the host's: only the wrapper tells it."""
    note = "<section>" + "This site will be moved to another place in the next weeks." + "</section>"
    pages = [f"<body>{note}<h1>Title {k} of the page</h1><p>{' '.join(f'word{k}x{i}' for i in range(30))}</p></body>" for k in range(4)]
    rows = [(k, f"http://one.example/{k}", p) for k, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, p in enumerate(pages):
        assert "moved" in wrapper.Wrapper(None).read(p) and "moved" not in got[k] and got[k].startswith(f"Title {k}")


def test_copies_and_shared_lines_keep_their_text(spark):
    """Neither near copies of one page nor a paragraph that many pages share lose text."""
    body = [f"<p>{' '.join(f'w{i}x{j}' for j in range(20))}</p>" for i in range(5)]
    rows = [(k, f"http://copies.example/{k}", f"<article><h1>One title</h1>{''.join(body)}<p>the end {k}</p></article>") for k in range(5)]
    rows += [(10 + k, f"http://lines.example/{k}", f"<article><h1>Title {k}</h1>{body[0]}<p>{' '.join(f'own{k}x{j}' for j in range(40))}</p></article>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith("One title\nw0x0") and got[k].endswith(f"the end {k}") and got[k].count("\n") == 6 for k in range(5))
    assert all(got[10 + k].count("\n") == 2 and "w0x0" in got[10 + k] for k in range(5))


def merged(*pages):
    root = wrapper.of_form(wrapper.Page(pages[0]).form, 1)[0]
    for p in pages[1:]:
        wrapper.merge(root, wrapper.of_form(wrapper.Page(p).form, 1)[0], {})
    return root


def test_wrapper_is_union_free():
    both = merged("<div><p>x</p><p>y</p><ul><li>1</li></ul></div>", "<div><p>x</p><h2>y</h2><p>z</p></div>")
    assert wrapper.expression(both) == "<><div><p>#</p>(<ul><li>#</li></ul>)?(<h2>#</h2>)?(<p>#</p>)?</div></>"
    page = wrapper.Page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert page.form == '["",[],[["dl",[],[["()",[],[["dt",[],["#"]],["dd",[],["#"]]]]]]]]' and page.at == [4, 6] * 3
    whole = merged("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert [k.tag for k in whole.kids[0].kids] == ["()"] and [k.tag for k in whole.kids[0].kids[0].kids] == ["dt", "dd"]


@pytest.mark.parametrize("a, b", [(x, y) for x in range(6) for y in range(6)])
def test_alignment_against_brute_force(a, b):
    """The best alignment of two lists of leaves shares as many as any that brute force finds."""
    r = random.Random(a * 10 + b)
    left, right = ([wrapper.Part(r.choice(["p", "h2", "ul"])) for _ in range(r.randrange(1, 6))] for _ in range(2))

    def brute(i, j, on):
        if i == len(left) or j == len(right):
            return 0
        best = brute(i + 1, j, False)
        if not on:
            best = max(best, brute(i, j + 1, False))
        if left[i].tag == right[j].tag and (not on or left[i].tag != "ul"):
            best = max(best, 2 + brute(i, j + 1, True))
        return best

    assert wrapper.table(left, right, {})[0][0][0] == brute(0, 0, False)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep text", "<ul><li>" * 5_000 + "deep text", "<p>a" * 20_000, "<div><p>x</p><h2>y</h2></div>" * 5_000, "<b " * 20_000, "text " * 400_000])
def test_odd_and_very_long_pages(page):
    began = time.monotonic()
    text = wrapper.Wrapper(None).read(page)
    assert time.monotonic() - began < 10 and isinstance(text, str)
    if "deep text" in page:
        assert text == "deep text"
    if page.startswith("text"):
        assert len(text) == 400_000 * 5 - 1
