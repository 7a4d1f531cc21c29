import random

from shiftcast.llm import wrappers as W


def _site(rng, kind, k):
    say = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    title, paras = say(4), [say(rng.randrange(1, 30)) for _ in range(rng.randrange(0, 6))]
    nav = "".join(f'<li><a href="/{say(1)}">{say(1)}</a></li>' for _ in range(rng.randrange(1, 7)))
    extra = rng.choice(["", '<div class="cookie-notice"><p>We use <b>cookies</b></p></div>', "<form><input name=q><p>Find</p></form>"])
    if kind == 0:
        body = f"<article><header><h1>{title}</h1></header>" + "".join(f"<p>{p}<p>" for p in paras) + "</article>"
    elif kind == 1:
        body = f'<div id="content"><h2>{title}</h2>' + "".join(f"<p>{p}</p>" for p in paras) + '<div class="ad-box">x</div></div>'
    else:  # nothing marks the article: what all pages share is template
        body = f"<div><b>Our daily page</b></div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "</div><div>Made with care</div>"
    page = (f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a<b) '</p>';</script></head><body><nav><ul>{nav}</ul></nav>"
            f"{extra}{body}<section class=comments><p>{say(3)}</p></section><footer>&copy; {say(2)}</footer></body></html>")
    return page, "\n\n".join([title, *paras])


def test_main_text(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(150):
        kind = k % 3
        page, text = _site(rng, kind, k)
        rows.append((k, f"https://User@Host{kind}.example:80/{k}?x", page, "other"))
        want[k] = text
    rows += [(900, None, None, ""), (901, "https://host0.example/", "", ""), (902, "https://host0.example/", "no markup, just text", ""),
             (903, "nonsense", "<article>A &lt;b&gt; &amp;amp; &#233;&nbsp; c<br>d</article><p>out", "")]
    want |= {900: "", 901: "", 903: "A <b> &amp; é c d"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    out = W.main_text(pages)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert {k: got[k] for k in want} == want and got[902] == "no markup, just text"
    assert W.main_text(pages.where("false")).count() == 0


def test_alignment_covers_both_sides():
    def nodes(s):
        keys, leaves = W.fold([(x, "") for x in s.split()])
        return W._to_nodes(keys, iter(range(len(leaves))))

    w = W.infer([nodes("ul li # /li li # /li /ul h1 # /h1"), nodes("ul li # /li /ul h1 # /h1 p # /p"), nodes("ul /ul h1 # /h1")])
    assert W._shape(w) == ("ul", ("+", ("li", "#", "/li")), "/ul", "h1", "#", "/h1", "p", "#", "/p")
    assert [n[3] for n in w] == [False, True, False, False, False, False, True, True, True]


def test_long_and_broken_pages():
    assert W.extract("<article>" + "<p>x</p>" * 20000 + "</article>", None) == "\n\n".join(["x"] * 20000)
    assert W.extract("<article><script>never closed <p>x", None) == ""
    assert W.extract("<article>a < b <!-- open", None) == "a < b"


def _texts(spark, pages):
    rows = [(k, f"https://{host}/{k}", page) for k, (host, page) in enumerate(pages)]
    out = W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    return {r.page_id: r.text for r in out.collect()}


def test_only_texts_of_all_pages_are_template(spark):
    page = "<div><b>Our daily page</b></div><div><h1>{}</h1><p>First of {}</p>{}</div><div>Made with care</div>"
    extra = {1: "<h2>Only here</h2>", 2: "<table><tr><td>Lone cell</td></tr></table>", 5: "<h2>Only here</h2>"}
    odd = [("odd", page.format(f"Title {k}", k, extra.get(k, ""))) for k in range(6)]
    copies = [("copies", "<nav><p>Menu {}</p></nav>".format(k % 2) + page.format("Title", 0, extra[1])) for k in range(4)]
    blank = [("blank", f"<div><b>{k}</b> <i>{k + 10}</i></div><p>{k}</p>") for k in range(3)]
    got = _texts(spark, odd + copies + blank)
    for k in range(6):
        own = {1: ["Only here"], 2: ["Lone cell"], 5: ["Only here"]}.get(k, [])
        assert got[k].split("\n\n") == [f"Title {k}", f"First of {k}", *own]
    for k in range(6, 10):  # copies tell nothing apart
        assert got[k].split("\n\n") == ["Our daily page", "Title", "First of 0", "Only here", "Made with care"]
    for k in range(3):
        assert got[10 + k] == f"{k} {k + 10}\n\n{k}"


def test_marker_is_a_container_that_holds_text():
    body = "<h1>Title</h1><p>One</p><p>Two</p>"
    cards = "<article><h2>Card</h2><p>Teaser</p></article>"
    pages = [f"<nav class='main-nav'><p>Menu</p></nav><div class=content>{body}</div>",
             f"<nav class='main-nav'><p>Menu</p></nav>{body}",
             f"<header id='main-header'><p>Logo</p></header><div class=content>{body}</div>",
             f"<header id='main-header'><p>Logo</p></header><div>{body}</div>",
             f"<main>{body}</main><aside>{cards}</aside>",
             f"<aside>{cards}</aside><div id=content>{body}</div>",
             f"<div id=content>{body}</div><section class=related>{cards}</section>",
             f"<main>{body}</main><section class=comments>{cards}</section>",
             f"<div>{body}</div><aside><main>Not here</main>{cards}</aside>",
             f"<article><a href=x></a> <a href=y></a>&nbsp;</article><main>{body}</main>",
             "<div><h1 class='entry-title'>Title</h1><div><p>One</p><p>Two</p></div></div>"]
    assert [W.extract(p, None) for p in pages] == ["Title\n\nOne\n\nTwo"] * len(pages)
    marked = f"<div>Around</div><article class=post>{body}</article>"
    assert W.extract(marked, None) == "Title\n\nOne\n\nTwo"


def test_named_parts_inside_an_article():
    page = ("<article class='{}'><p>One</p><p class='advert'>Buy</p><p>Two <span class='ad'>Now <span>only</span> here</span>words</p>"
            "<p class='notice'>Closed <b>today</b><p>Three<div class='comment-list'><p>No</p></div></article>")
    for name in ("", "post search", "entry related"):
        assert W.extract(page.format(name), None) == "One\n\nTwo words\n\nThree"
    assert W.extract("<main><div class='story-related-topic'><p>Body</p></div></main><div>Copyright</div>", None) == "Body"
    assert W.extract("<article class='comment'><p>Me too</p></article><div id='content'><p>Body</p></div>", None) == "Body"
    assert W.extract("<article><p class=ad>Buy<div>Body</div></article>", None) == "Body"


def test_time_is_linear_in_broken_pages():
    import time

    began = time.process_time()
    for unit in ("<a ", "<", "<a x=\"", "<a 'b>", "<a \"'>", "<!--", "<script", "<p class=\"x"):
        W.tokens(unit * (1_000_000 // len(unit)) + "<p>end</p>")
    assert time.process_time() - began < 8
    assert W.extract("<article>Body</article>" + "<a " * 300_000, None) == "Body"


def test_tags_end_outside_quotes():
    assert W.tokens("<p title='a > b' class=\"nav\">x</p>") == [("p.nav", ""), ("#", "x"), ("/p", "")]
    assert W.tokens("a < b <i>c</i> <b>") == [("#", "a < b "), ("i", ""), ("#", "c"), ("/i", ""), ("#", " "), ("b", "")]
    # a tag left open: from there on ends are looked up, with the same result
    assert W.tokens("<p>x</p> <q 'open <b title=\"1 > 0\">y</b>")[:4] == [("p", ""), ("#", "x"), ("/p", ""), ("#", " <q 'open ")]


def test_wrapper_covers_every_page_of_its_site():
    """The inferred expression, read as a regular expression over tokens, matches each page it was inferred from."""
    import re

    def pattern(nodes):
        out = ""
        for key, inner, _, optional in nodes:
            one = f"(?:{pattern(inner)})+" if inner is not None else f"(?:<{re.escape(key)}>)"
            out += f"(?:{one})?" if optional else one
        return out

    rng = random.Random(3)
    for kind in range(3):
        streams = [W.tokens(_site(rng, kind, k)[0]) for k in range(12)]
        folded = [W.fold(s) for s in streams]
        wrapper = W.infer([W._to_nodes(keys, iter([0] * len(leaves))) for keys, leaves in folded])
        language = re.compile(pattern(wrapper))
        for s in streams:
            assert language.fullmatch("".join(f"<{key}>" for key, _ in s))
