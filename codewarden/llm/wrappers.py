"""Main text of web pages by what the pages of a host have in common.

A page is a stream of tags and text slots, made well-formed on the way. A wrapper is a sequence of groups,
each a tag with its own inner sequence, marked optional or repeated. Two wrappers are aligned by their
labels: groups of one label that follow each other are one repeated group, a group that one side lacks is
optional, and texts are slots that keep how often and how long they are, and how much of them is links.
Alignment is associative in what it counts, so wrappers are inferred per input partition and host and then
merged per host; a host with a third of all pages is a few wrappers by then.

From a host's wrapper follow the paths of its main text: the main element if the host has one, or the articles in it
where they hold most of its text; else the articles; else the group with most text outside links, without the host's template: the texts that stand at one place (by
tags, marks and classes) on most of its pages, at least three, where the pages differ. Menus, headers, footers, asides, notices, adverts, forms,
scripts, styles and reader comments are groups of their own label and never part of it. Elements tell this by
their tag; a class, id or role only says so ('?', or '~' beside words that say something else), and the host's
wrapper decides: see ``judged``.

Defined results: null or empty html has an empty text; a page without any tag is its own main text; repeated
rows are rows of their own; a null id or address is carried (pages without a host share a wrapper); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows
from codewarden.session import cut_lineage

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "html", "body"}
# An open element of the key ends where one of these starts (in the same parent list).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ASIDE_TAGS = frozenset("nav header footer aside form button menu fieldset input head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "footer form header menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that leave what stands beside them its meaning, and words before (or, of "free", after) that deny it.
PLAIN_WORDS = frozenset(
    "area bar block body box btn button buttons container content div inner item items left link links list main meta outer page panel right "
    "row section site slot text title top bottom unit user wrap wrapper".split()
)
DENIED = frozenset("no not non without has have with is hide show free".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
MAIN_TAGS = ("article", "main")
TEMPLATE_PAGES = 3
#: In headings, paragraphs and tables these are no parts of a page.
INNER_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p table caption thead tbody tfoot tr th td".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|<(?=[^a-zA-Z/!?]|$)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""(?:\b|(?<=["']))(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKED = re.compile(r"[!*?~]")


def _label(name: str, tag: str) -> str:
    """The tag with '!' if it stands outside the main text, with '?' and words if its marks say so, with '~' and
    words if they may say so, and with '*' if it is marked as the main one."""
    if name in ASIDE_TAGS:
        return name + "!"
    if "=" in tag:
        clear: set[str] = set()
        maybe: set[str] = set()
        said: set[str] = set()
        for m in _MARKS.finditer(tag):
            for token in (m[1] or m[2] or m[3] or "").split():
                words = {w.lower() for w in _WORDS.findall(token)}
                said |= words
                aside = words & ASIDE_WORDS
                if name in INNER_TAGS:
                    aside -= {"header", "footer"}
                if aside and not words & DENIED:
                    (maybe if name == "h1" or words - ASIDE_WORDS - PLAIN_WORDS else clear).update(aside)
        if name not in ("body", "html", "article", "main") and clear:
            return name + "?" + "+".join(sorted(clear))
        if "hidden" in said and name == "div":
            return name + "!"
        if name not in MAIN_TAGS and "main" in said:
            return name + "*"
        if name not in ("body", "html", "article", "main") and maybe:
            return name + "~" + "+".join(sorted(maybe))
    return name


def _tag(label: str) -> str:
    return _MARKED.split(label, maxsplit=1)[0]


def stream(html: str):
    """(kind, value) tokens of a page: '<' label, '>' name, 't' text (references decoded). Well-formed."""
    open_tags: list[str] = []
    skip = ""

    def close(depth: int):
        while len(open_tags) > depth:
            yield ">", open_tags.pop()

    for m in _TOKEN.finditer(html):
        token = m[0]
        if token[0] != "<" or token == "<":
            if not skip:
                yield "t", entities.unescape(token)
            continue
        named = _NAME.match(token)
        if not named:
            continue
        name, end = named[1].lower(), token[1] == "/"
        if skip:
            if end and name == skip:
                skip = ""
            continue
        if end:
            if name in open_tags:
                at = len(open_tags) - 1 - open_tags[::-1].index(name)
                # An inline end tag does not reach past the block it stands in.
                if name in BLOCKS or not any(t in BLOCKS for t in open_tags[at + 1 :]):
                    yield from close(at)
            elif name in ("p", "br"):
                yield "<", "br"
                yield ">", "br"
            continue
        if name in RAW and not token.endswith("/>"):
            skip = name
            continue
        if name in CLOSES_P and "p" in open_tags:
            at = len(open_tags) - 1 - open_tags[::-1].index("p")
            if not any(t in ("table", "button", "object") for t in open_tags[at:]):
                yield from close(at)
        if name in ENDS:
            for at in range(len(open_tags) - 1, -1, -1):
                if open_tags[at] in ("ul", "ol", "dl", "table"):
                    break
                if name in ENDS.get(open_tags[at], ()):
                    yield from close(at)
                    break
        yield "<", _label(name, token)
        if name in VOID:
            yield ">", name
        else:
            open_tags.append(name)
    yield from close(0)


# A wrapper group: [label, optional, repeated, pages, texts, chars, link chars, inner groups, hash of its text, whether it was always that].
LABEL, OPTIONAL, REPEATED, PAGES, TEXTS, CHARS, LINKS, INNER, HASH, SAME = range(10)


def _group(label: str) -> list:
    return [label, False, False, 1, 0, 0, 0, [], 0, True]


def wrapper_of(html: str) -> list:
    """The wrapper of one page: its own stream, with neighbours of one label folded into a repeated group."""
    stack = [_group("#")]
    links = 0
    for kind, value in stream(html):
        if kind == "t":
            n = len(value) - value.count(" ") - value.count("\n")
            if n:
                stack[-1][TEXTS] += 1
                stack[-1][CHARS] += n
                stack[-1][LINKS] += n if links else 0
                stack[-1][HASH] = zlib.crc32(value.strip().encode("utf-8", "surrogatepass"), stack[-1][HASH])
        elif kind == "<":
            stack.append(_group(value))
            links += _tag(value) == "a"
        else:
            done = stack.pop()
            links -= _tag(done[LABEL]) == "a"
            inner = stack[-1][INNER]
            same = next((g for g in inner if g[LABEL] == done[LABEL]), None)
            if same is None:
                inner.append(done)
            else:  # the wrapper keeps one group per label and parent: a repeated one
                align(same, done)
                same[REPEATED] = True
                same[PAGES] = 1
                _once(same)
    return stack[0]


def _once(group: list) -> None:
    for inner in group[INNER]:
        inner[PAGES] = 1
        _once(inner)


def align(a: list, b: list) -> list:
    """``a`` made to match everything ``b`` matches too; counts add up."""
    a[OPTIONAL] |= b[OPTIONAL]
    a[REPEATED] |= b[REPEATED]
    for field in (PAGES, TEXTS, CHARS, LINKS):
        a[field] += b[field]
    a[SAME] = a[SAME] and b[SAME] and a[HASH] == b[HASH]
    own = {g[LABEL]: g for g in a[INNER]}
    theirs = {g[LABEL] for g in b[INNER]}
    for group in a[INNER]:
        group[OPTIONAL] |= group[LABEL] not in theirs
    at = 0
    for group in b[INNER]:
        if group[LABEL] in own:
            align(own[group[LABEL]], group)
            at = a[INNER].index(own[group[LABEL]]) + 1
        else:  # only in b: optional, in b's place
            group[OPTIONAL] = True
            a[INNER].insert(at, group)
            at += 1
    return a


def _text_chars(group: list, dropped=frozenset()) -> tuple[int, int]:
    """Characters and link characters of a group's main parts."""
    if group[LABEL].endswith("!") or id(group) in dropped:
        return 0, 0
    sums = [_text_chars(g, dropped) for g in group[INNER]]
    return group[CHARS] + sum(c for c, _ in sums), group[LINKS] + sum(x for _, x in sums)


def _is_main(group: list) -> bool:
    return _tag(group[LABEL]) in MAIN_TAGS or group[LABEL].endswith("*")


def _holds_main(group: list) -> bool:
    return any(not g[LABEL].endswith("!") and (_is_main(g) and _text_chars(g)[0] > 0 or _holds_main(g)) for g in group[INNER])


def _always_same(group: list) -> bool:
    return group[SAME] and all(_always_same(g) for g in group[INNER])


def judged(wrapper: list) -> tuple[set[int], list[str]]:
    """Of the groups whose marks put them outside: those that are (by ``id``), and the paths of those that are not.

    A group that holds the main element is inside, and so is one that has most of the text outside links of the
    main element around it (of comments: nearly all of it), unless three pages or more that differ all say the
    same there. What else is marked is outside; a group whose marks have other words too ('~') only if it is
    mostly links or says the same on each page.
    """
    dropped: set[int] = set()
    kept: list[str] = []
    differ = not _always_same(wrapper)

    def outside(group, around) -> bool:
        if _holds_main(group):
            return False
        chars, links = _text_chars(group)
        if differ and group[PAGES] >= 3 and _always_same(group):
            return True
        label = group[LABEL]
        comments = set(label.rpartition("?")[2].split("+")) <= COMMENT_WORDS
        if chars - links > (0.9 if comments else 0.5) * around:
            return False
        return "?" in label or 2 * links > chars

    def plain(group):
        return (lambda c, x: c - x)(*_text_chars(group))

    def look(group, path, around):
        for inner in group[INNER]:
            label = inner[LABEL]
            if label.endswith("!"):
                continue
            here = [*path, label]
            if "?" in label or "~" in label:
                if outside(inner, around):
                    dropped.add(id(inner))
                    continue
                kept.append("/".join(here))
            look(inner, here, plain(inner) if _is_main(inner) else around)

    look(wrapper, [], plain(wrapper))
    return dropped, kept


def region(wrapper: list) -> str:
    """What to extract: 'tag:main/article' (articles in the main element), 'tag:main', 'tag:article', 'mark' or 'path:' with
    labels from the root; then, a line each, the paths of marked groups that are part of it all the same."""
    found = dict.fromkeys(("main", "main/article", "article", "*"), 0)
    dropped, kept = judged(wrapper)

    def look(group, within=frozenset()):
        if group[LABEL].endswith("!") or id(group) in dropped:
            return
        name, chars = _tag(group[LABEL]), _text_chars(group, dropped)[0]
        if name in MAIN_TAGS and name not in within:  # one inside another of its kind is part of it
            found[name] += chars
            if name == "article" and "main" in within:
                found["main/article"] += chars
        if group[LABEL].endswith("*"):
            found["*"] += chars
        for inner in group[INNER]:
            look(inner, within | {name})

    def rule(text):
        return "\n".join([text, *kept])

    look(wrapper)
    if found["main"]:
        return rule("tag:main/article" if found["main/article"] >= 0.8 * found["main"] else "tag:main")
    if found["article"]:
        return rule("tag:article")
    if found["*"]:
        return rule("mark")
    path, group = [], wrapper
    while True:  # down to the smallest group that still holds nearly all text outside links
        worth = lambda g: (lambda c, x: c - 2 * x)(*_text_chars(g, dropped))
        best = max(group[INNER], key=worth, default=None)
        if best is None or worth(best) < 0.8 * max(1, worth(group)) or _tag(best[LABEL]) in ("p", "h1", "h2", "h3", "span", "b", "i", "em", "strong", "a", "li", "tr", "td"):
            return rule("path:" + "/".join(path))
        path.append(best[LABEL])
        group = best


def extract(html: str, rule: str, template=frozenset()) -> str:
    """The main text of a page under a host's rule; under 'path:' (the whole page) if the page lacks the region."""
    return "\n".join(text for place, text in blocks_of(html, rule) if not template or slot(place, text) not in template)


def slot(place: str, text: str) -> int:
    """A text at its place, as a 64-bit number."""
    return int.from_bytes(hashlib.blake2b(f"{place}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks_of(html: str, rule: str) -> list[tuple[str, str]]:
    """The blocks of a page's main text, each with its place: under 'path:' the labels from the root, else ''."""
    rule, *kept = rule.split("\n")
    kind, _, value = rule.partition(":")
    path = value.split("/") if value else []
    blocks: list[tuple[str, str]] = []
    at = ""
    held: list[str] = []
    trail: list[str] = []
    inside = outside = links = linked = 0
    seen = False
    inner_marks = set(kept)

    def close_block():
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        # Where no element marks the main text, a block that is mostly links is a menu.
        if text and not (kind == "path" and 2 * linked > len(text)):
            blocks.append((at, text))
        linked = 0

    def aside(label):
        return label.endswith("!") or ("?" in label or "~" in label) and "/".join(trail) not in inner_marks

    def main(label):
        name = _tag(label)
        if kind == "tag":
            *around, wanted = path
            return name == wanted and all(any(_tag(t) == outer for t in trail) for outer in around)
        if kind == "mark":
            return label.endswith("*")
        return trail == path

    if kind == "path" and not path:
        inside, seen = 1, True
    for token, value_ in stream(html):
        if token == "t":
            if inside and not outside:
                if kind == "path" and not held:
                    at = "/".join(trail)
                held.append(value_)
                linked += len(value_.strip()) if links else 0
            continue
        name = _tag(value_) if token == "<" else value_
        if name in BLOCKS and inside:
            close_block()
        links += (name == "a") * (1 if token == "<" else -1)
        if token == "<":
            trail.append(value_)
            if inside or main(value_):
                if aside(value_):
                    outside += 1
                inside += 1
                seen = True
        else:
            out = aside(trail[-1])
            trail.pop()
            if inside and not (kind == "path" and not path and not trail and inside == 1):
                inside -= 1
                if out:
                    outside -= 1
                if not inside:
                    close_block()
    close_block()
    if not seen:  # a page without the host's region
        return blocks_of(html, "\n".join([f"tag:{path[0]}" if kind == "tag" and len(path) > 1 else "path:", *kept]))
    return blocks


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, rule): one row per host."""
    own = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def partly(it):
        held: dict[str, list] = {}
        for host, html in it:
            one = wrapper_of(html or "")
            held[host] = align(held[host], one) if host in held else one
            if len(held) > 5000:
                yield from ((h, json.dumps(w)) for h, w in held.items())
                held = {}
        yield from ((h, json.dumps(w)) for h, w in held.items())

    some = map_rows(own, partly, "host string, wrapper string", 500)

    def whole(frame):
        import pandas as pd

        out = None
        for text in sorted(frame.wrapper):
            out = json.loads(text) if out is None else align(out, json.loads(text))
        return pd.DataFrame({"host": frame.host.iloc[:1], "wrapper": [json.dumps(out)], "rule": [region(out)]})

    return some.groupBy("host").applyInPandas(whole, "host string, wrapper string, rule string")


def templates(own: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, template): of hosts whose rule is a path, the slots that most of their pages have; pages alike count once.

    Each page has some slots, so at most twice as many as a page has on average are on half of the pages.
    """
    loose = own.join(rules.where("rule LIKE 'path:%'"), "host").select("host", "html", "rule")

    def rows(it):
        for host, html, rule in it:
            blocks = blocks_of(html or "", rule)
            if blocks:
                slots = sorted({slot(place, text) for place, text in blocks})
                yield host, slot("", "\n".join(text for _, text in blocks)), slots

    pages = map_rows(loose, rows, "host string, page long, slots array<long>")
    pages = cut_lineage(pages.groupBy("host", "page").agg(F.min("slots").alias("slots")))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {TEMPLATE_PAGES}")
    counted = pages.select("host", F.explode("slots").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n")).where(f"n >= {TEMPLATE_PAGES}")
    often = counted.join(sizes, "host").where("2 * n > pages")
    return often.groupBy("host").agg(F.collect_list("slot").alias("template"))


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    rules = cut_lineage(wrappers(pages, url_col, html_col).select("host", "rule"))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))

    rules = cut_lineage(rules.join(templates(own, rules), "host", "left"))

    def rows(it):
        for page_id, url, html, rule, template in it:
            text = extract(html or "", rule, frozenset(template) if template else frozenset())
            yield page_id, url, text, len(text)

    return map_rows(own.join(rules, "host").select("page_id", "url", "html", "rule", "template"), rows, "page_id long, url string, text string, n_chars long")
