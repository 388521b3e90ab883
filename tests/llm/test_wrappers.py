from codewarden.llm import wrappers as W

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy &lt;now&gt;</div><div id="cookie-notice">We use cookies</div>'
    "<article><h1>Head</h1><p><b>One  &amp;\n two<br><p>Three&nbsp;<i>fo</i>ur</p><form><label>Mail</label><input></form>"
    '<aside>Side</aside><section class="userComments"><p>First!</p></section><p>x &lt; y &#8212; z</article><footer>F</footer>'
)


def _one(html, host_pages=()):
    rules = W.wrapper_of(html)
    for other in host_pages:
        W.align(rules, W.wrapper_of(other))
    return W.extract(html, W.region(rules))


def test_article():
    assert _one(PAGE) == "Head\nOne & two\nThree four\nx < y — z"


def test_main_and_articles_by_their_text():
    words = "A long paragraph of the story itself, and more of it. " * 4
    main = f"<main><h1>Head</h1><p>{words}</p><article>short related piece</article></main>"
    assert _one(f"<body>{main}</body>") == f"Head\n{words.strip()}\nshort related piece"
    teaser = "<article>Another story begins here</article>"
    assert _one(f"<body><main><article><h1>Head</h1><p>{words}</p></article><p>Share</p></main>{teaser}</body>") == f"Head\n{words.strip()}"
    assert _one(f"<body><main><p>{words}</p></main>{teaser}</body>") == words.strip()
    # A page whose main element has no article, on a host whose pages have: the main element.
    held = f"<body><main><article><p>{words}</p></article></main></body>"
    assert _one(f"<body><main><p>{words}</p></main>{teaser}</body>", [held, held]) == words.strip()
    assert _one(f"<body><article><p>one</p></article>{teaser}</body>") == "one\nAnother story begins here"


def test_nothing_else_is_dropped():
    page = "<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <label>so</label> <svg><text>drawn</text></svg>.</p><noscript>Fallback <b>text</b></noscript><object>in place</object><dialog open>said</dialog></article>"
    assert _one(page) == "If x=1 then so drawn.\nFallback textin place\nsaid"
    assert _one("<article><p>a</p><form><label>Mail</label> <select><option>x</select></form><button>Go</button><template>t</template></article>") == "a"


def test_main_by_mark_and_by_text():
    menu = "<div class=menu><a href=1>Home</a> <a href=2>News</a></div>"
    assert _one(f"<body>{menu}<div id='main-column'><p>Long text here</div><div>other</div>") == "Long text here"
    body = f"<html><body>{menu}<div><p>{'A long paragraph of words. ' * 20}</p><p>Second one.</p></div><div><a href=1>link</a></div></body></html>"
    assert _one(body).split("\n")[-1] == "Second one." and "Home" not in _one(body) and "link" not in _one(body)


def test_marks_are_judged_by_the_host():
    words = [f"Words of page {k} that are long enough to be the body of it. " * 3 for k in range(4)]
    held = ['<body><div class="content has-sidebar"><article><p>{0}</p></article></div><div class="sidebar">S</div></body>', "<article><div class='long-form'>{0}</div></article>"]
    held += ['<article><h1 class="page-header">{0}</h1><p class="lead ad-free">more {0}</p></article>', '<body><div class="notice"><main>{0}</main></div></body>']
    held += ['<body><div id="share-wrapper"><p>{0}</p></div><div class="menu"><a href=1>Home</a></div></body>', "<article><p>{0}</p><p class='form-factor'>more {0}</p></article>"]
    for page in held:
        for others in ([], words[1:]):
            text = _one(page.format(words[0]), [page.format(w) for w in others])
            assert text.split("\n") == [words[0].strip()] + ["more " + words[0].strip()] * page.count("more"), (page, text)
    # What is marked and short, mostly links, or the same on each page is outside, whatever else its class says.
    page = "<article><p>{}</p><div class='ad'>Buy {}</div><div class='share-tools'><a href=1>X</a></div><section class='comments'>{}</section><p class='promo-line'>Read us.</p></article>"
    assert _one(page.format(words[0], 0, words[0]), [page.format(w, w[:16], w) for w in words[1:]]) == words[0].strip()


def test_tables_lists_and_broken_markup():
    assert _one("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></b></article>") == "a\nb\nc\nd"
    assert _one("plain words &amp; more") == "plain words & more"
    assert _one("") == "" and _one("<p>a < b</p>") == "a < b" and _one("<article>cut <b") .startswith("cut")
    assert _one('<article><p class="lead ad-free" title="a>b">kept?</p><p title="x > y">yes</p></article>').endswith("yes")


def test_alignment_finds_optional_and_repeated_groups():
    a = W.wrapper_of("<body><h1>t</h1><p>a</p><p>b</p></body>")
    W.align(a, W.wrapper_of("<body><h1>t</h1><div>x</div><p>c</p></body>"))
    body = a[W.INNER][0]
    assert [(g[W.LABEL], g[W.OPTIONAL], g[W.REPEATED]) for g in body[W.INNER]] == [("h1", False, False), ("div", True, False), ("p", False, True)]


def test_a_table(spark):
    body = "<article><p>ö {}</p></article><div>no</div>"
    rows = [(i, f"http://h{i % 2}.org/{i}", "<body>" + body.format(i)) for i in range(20)]
    rows += [(30, "http://h0.org/x", None), (31, "http://h0.org/y", ""), (32, None, "<main>m</main>"), (3, "http://h1.org/3", "<body>" + body.format(3)), (None, "http://h1.org/n", "<p>loose</p>")]
    rows += [(40, "http://h1.org/long", "<article>" + "<p>word </p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, host string, rule string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in W.main_text(pages.repartition(4)).collect()), key=str)
    texts = {i: f"ö {i}" for i in range(20)} | {30: "", 31: "", 32: "m", None: "loose", 40: "\n".join(["word"] * 20_000)}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    assert W.main_text(pages.limit(0)).count() == 0


def test_texts_that_a_host_repeats_are_its_template(spark):
    page = "<html><body><div>Site name</div><div><p>Story {0} is about the number {0} and others.</p><p>It ends with {0}. Same end.</p></div><div><p>All rights reserved by the paper.</p></div></body></html>"
    rows = [(k, "http://a.org/", page.format(k)) for k in range(9)]
    rows += [(20 + k, "http://same.org/", page.format(5)) for k in range(6)] + [(30, "http://one.org/", page.format(7))]
    rows += [(40 + k, "http://art.org/", f"<article><p>Often said.</p><p>{k}</p></article>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in W.main_text(pages).collect()}
    story = "Story {0} is about the number {0} and others.\nIt ends with {0}. Same end."
    for k in range(9):
        assert got[k] == story.format(k)
    assert all(story.format(5) in got[20 + k] for k in range(6)) and story.format(7) in got[30]
    assert all(got[40 + k] == f"Often said.\n{k}" for k in range(6))


def test_merging_is_associative():
    pages = [f"<body>{'<p>a</p>' * (k % 3)}{'<div><span>x</span></div>' if k % 2 else ''}<article>{'t' * k}</article></body>" for k in range(9)]

    def folded(order):
        out = W.wrapper_of(pages[order[0]])
        for k in order[1:]:
            W.align(out, W.wrapper_of(pages[k]))
        return out

    a, b = folded(range(4)), folded(range(4, 9))
    assert W.region(W.align(a, b)) == W.region(folded(range(9))) == "tag:article"
