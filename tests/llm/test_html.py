import html as references
import random

import pytest
from pyspark.sql import functions as F

from threatspark.llm import html
from threatspark.llm.html import Node, extract, main_text, parse

_BODY = "a word of the text " * 40 + "end"
CASES = [
    (None, ""), ("", ""), ("plain  text &amp; more", "plain text & more"),
    ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"), ("<article><h1>T</h1><p><b>x.<br><p>y</article>z", "T\n\nx.\n\ny\n\nz"),
    ("<nav>n</nav><main><p>m</p></main><footer>f</footer>", "m"), ("<script>var a='<p>no</p>'</script><p>yes", "yes"),
    ("<style>p{}</style><title>t</title><p>1 &lt; 2 &#233;&nbsp;&eacute;", "1 < 2 é é"), ("<!-- <p>no --><p>yes<!-- cut <p>no", "yes"),
    ("<article>a<div class='ad'>no</div><form>no</form><p>b</article", "a\n\nb"), ("<p title='a>b' hidden>no</p><p data-x=\"<p>\">yes</p>", "yes"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a href=\"x", "cut"), ("<div role=navigation>no</div><p>yes", "yes"),
    ("<header>no</header><article><header><h2>T</h2>by</header><p>x</p><footer>no</footer></article>", "T\n\nx"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\n\nb\n\n1\n\n2"),
    ("<article><p>x</p><div class=comments><article>no</article></div></article>", "x"), ("</p></div>a</b>", "a"),
    ("<div class=sidebar-layout><article>x</article></div>", "x"), ("<p>a<!b>c<?d>e</p>1 < 2", "ace\n\n1 < 2"),
    ("<div " * 2000, ""), ("<p>" + "x " * 100_000, ("x " * 100_000).strip()), ("<div>" * 3000 + "deep", "deep"),
    # the page lies in a wrapper
    ("<body><form id=f><input><nav>no</nav><div><p>a b c</p></div></form></body>", "a b c"), ("<form><p>no</p><article><p>x</p></article></form>", "no\n\nx"),
    ("<form action=s>no</form><article><p>a b</p><aside>no</aside></article>", "a b"), ("<dialog open><article>x y</article></dialog>", "x y"),
    ("<body style='display:none'><p>a</p></body>", "a"), ("<div hidden><article>x</article></div><div hidden>no</div>", "x"),
    ("<aside><p>a b c</p></aside><p>d</p>", "a b c\n\nd"), ("<main><p>a b c</p></main><aside><article>no</article></aside>", "a b c"),
    ("<p hidden>no no no</p><p>yes</p>", "yes"), ("<article><p>a b c d</p><form><article>no</article></form></article>", "a b c d"),
    # text outside of an article
    ("<main><h1>T</h1><p>lead</p><article><p>x y z</p></article></main>", "T\n\nlead\n\nx y z"),
    ("<main><header><h1>T</h1>by</header><article>x</article></main>", "T\n\nx"),
    ("<div><h1>T</h1><p>a long text</p></div><article>b</article>", "T\n\na long text\n\nb"), ("loose main text<article>b</article>", "loose main text\n\nb"),
    # names of classes and ids: what holds the page stays, and so does what only has such a word in its name
    (f"<div class='layout has-sidebar'><p>{_BODY}</p><div class=sidebar>no</div></div>", _BODY),
    (f"<div id=page class='no-comments'><article><p>{_BODY}</p></article></div>", _BODY),
    (f"<div role=main class=banner-page><p>{_BODY}</p></div>", _BODY), (f"<div class=social-network-analysis><p>{_BODY}</p></div><p>b</p>", _BODY + "\n\nb"),
    (f"<div class=sidebar><p>{_BODY}</p></div>", _BODY), (f"<p>{_BODY}</p><div class='SideBar-left box'>no</div><div id=cookie-banner>no</div>", _BODY),
    (f"<article><p>{_BODY}</p><section id=related-work>a</section><h2 id=ad-blocking>b</h2><p id=promotion>c</p></article>", _BODY + "\n\na\n\nb\n\nc"),
    (f"<article><p>{_BODY}</p><section class=related-posts>no</section><div class='ad slot'>no</div></article>", _BODY),
    (f"<div class=ad>{_BODY}</div><article><p>a short text</p></article>", "a short text"),
    ("<article><p>x <math><mi>a</mi></math> <label>b</label> <object>c</object></article>", "x a b c"),
    (f"<article><p>x y</p></article><ol class=discussion><li>{_BODY}</li></ol><div class=comment-list>{_BODY}</div>", "x y"),
    ("<section class=discussion><h2>Discussion</h2><p>a</p></section>", "Discussion\n\na"), ("<div class=comments><p>the only text</p></div>", "the only text"),
]


@pytest.mark.parametrize("html,text", CASES, ids=range(len(CASES)))
def test_pages(html, text):
    assert main_text(html) == text


def test_templates_of_a_host(spark):
    def page(k, host):
        return (k, f"http://{host}/{k}", f"<div id=top>Site of {host}</div><div><p>Text {k}</p><p>Shared line</p></div><div><p>All rights</p></div>", "x")

    rows = [page(k, "a.org") for k in range(30)] + [page(100 + k, "b.org") for k in range(4)]
    rows += [(200 + k, f"http://c.org/{k}", f"<article><p>Same line</p><p>{k}</p><div>Follow us</div></article>", "x") for k in range(20)]
    rows += [(300, None, None, "x"), (None, "http://a.org/", "", "x"), (0, "http://a.org/0", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string").repartition(4)
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    text = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert text[3] == "Text 3"  # the shared line is a subtree of every page of the host, too
    assert text[102] == "Site of b.org\n\nText 102\n\nShared line\n\nAll rights"  # too few pages to tell
    assert text[205] == "Same line\n\n5"  # of an article only containers are template
    assert text[300] == text[None] == ""
    assert extract(pages.where(F.lit(False))).count() == 0


def test_template_of_a_large_host(spark):
    def page(k):
        menu = "<div>Section menu</div>" if k % 20 < 3 else ""  # on 15% of the pages
        return (k, f"http://big.org/{k}", f"{menu}<div><h2>Text {k}</h2><table><tr><td>{k % 7}</td><td>of {k}</td></tr></table></div>")

    rows = [page(k) for k in range(400)]
    rows += [(1000 + k, f"http://big.org/copy/{k}", "<div><p>The same page</p></div>") for k in range(30)]
    rows += [(2000 + k, f"http://small.org/{k}", ("<div>Section menu</div>" if k < 15 else "") + f"<p>Text {k}</p>") for k in range(70)]
    text = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert not any("Section menu" in t for t in text.values())
    assert text[1] == "Text 1\n\n1\n\nof 1"  # cells are equal by chance
    assert text[1000] == text[1029] == "The same page"  # copies of a page are one page
    assert text[2001] == "Text 1"


def test_template_beside_articles(spark):
    page = "<main><h1>Head {0}</h1><ul><li>Section menu</li></ul><article><p>Text {0}</p><p>Same line</p></article></main><div>Follow us</div>"
    rows = [(k, f"http://a.org/{k}", page.format(k)) for k in range(12)]
    text = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[3] == "Head 3\n\nText 3\n\nSame line"


def test_loose_text_of_a_host(spark):
    page = "Site of a.org {1}<article><p>Text {0}</p></article>Own words {0}<footer>f</footer>"
    rows = [(k, f"http://a.org/{k}", page.format(k, "" if k else "and more")) for k in range(12)]
    text = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[3] == "Text 3\n\nOwn words 3"  # however much of the page its articles hold
    assert text[0] == "Site of a.org and more\n\nText 0\n\nOwn words 0"


# --- the same by nested loops -----------------------------------------------------------------------
def shape(node):
    """An element as nested tuples, None without text."""
    inner = [s for c in node.children for s in [shape(c) if isinstance(c, Node) else tuple(c.split()) or None] if s is not None]
    return (node.tag, node.marks, *inner) if inner else None


def walked(node, inside=False):
    """Elements that may be template, with whether they are parts only."""
    if html._comparable(node, inside):
        yield shape(node), node.tag in html._PARTS
    for c in node.children:
        if isinstance(c, Node) and not c.boilerplate(html._inner(node, inside)):
            yield from walked(c, html._inner(node, inside))


def loose_blocks(page):
    return [b for b, loose in html._blocks(page) if loose]


def plain(node, template, loose_template, page, inside=False, within=False, only=False, loose=True):
    """Blocks as a list of texts; None stands between blocks."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out += [(c, loose)] if not only else []
            continue
        block = [None] if c.tag in html._BLOCK else []
        if c.boilerplate(inside) or html._comparable(c, inside) and shape(c) in template or c.tag == "header" and not c.has_article and not within:
            out += block
            continue
        head = only and c.tag not in html._HEADINGS or c.tag == "header" and not c.has_article
        below = plain(c, template, loose_template, page, html._inner(c, inside), within or c.tag in ("article", "main"), head, loose and not (block and c.tag not in ("html", "body")))
        out += [*block, *below, *block]
    return out


def brute(rows, least_pages, least_share):
    pages, out = {}, []
    for _, url, source in rows:
        pages.setdefault(url.split("/")[2], set()).add(source)
    for i, url, source in rows:
        host = pages[url.split("/")[2]]
        trees = [parse(s) for s in host]
        template, loose = set(), set()
        for found, part in set(walked(parse(source))):
            n = sum(any(found == other for other, _ in walked(t)) for t in trees)
            if n >= least_pages and (not part or n >= least_share * len(host)):
                template.add(found)
        for block in loose_blocks(parse(source)):
            if sum(block in loose_blocks(t) for t in trees) >= least_pages:
                loose.add(block)
        blocks, run = [], []
        for x in [*plain(parse(source), template, loose, None), None]:
            if x is not None:
                run.append(x)
                continue
            words = references.unescape("".join(t for t, _ in run)).split()
            if words and not (run[-1][1] and " ".join(words) in loose):
                blocks.append(" ".join(words))
            run = []
        out.append((i, "\n\n".join(blocks)))
    return sorted(out)


def random_page(rng, depth=0):
    kinds = ["div", "section", "p", "ul", "li", "article", "main", "nav", "aside", "form", "header", "footer", "span", "b", "h2", "table", "td", "tr"]
    marks = ["", "", "", " class=menu", " class=sidebar", " id=x", " hidden", " role=banner", " class='has-sidebar wide'", " class=comments"]
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth > 3 or rng.random() < 0.4:
            out.append(rng.choice(["alpha ", "beta gamma ", "&amp; x ", "<br>", f"w{rng.randrange(30)} "]))
        else:
            tag = rng.choice(kinds)
            out.append(f"<{tag}{rng.choice(marks)}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_against_nested_loops(spark):
    rng = random.Random(5)
    shared = [random_page(rng, 1) for _ in range(6)]
    rows = [(k, f"http://{rng.choice('ab')}.org/{k}", "".join(rng.choice([random_page(rng, 1), rng.choice(shared), rng.choice(shared)]) for _ in range(4))) for k in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least_pages, least_share in ((3, 0.2), (8, 0.5)):
        got = sorted((r.page_id, r.text) for r in extract(frame, least_pages=least_pages, least_share=least_share).collect())
        assert got == brute(rows, least_pages, least_share)
