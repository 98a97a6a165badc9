"""Main text of web pages by inferred wrappers, one or more per host.

A wrapper is a union-free regular expression over a page's tokens (tags and texts),
inferred as in RoadRunner (Crescenzi, Mecca, Merialdo, 2001): it starts as one page and
is aligned with further pages of the host. Texts that differ become slots; at a tag
mismatch the side whose last element repeats becomes a repeated group, else the shorter
detour to a common tag becomes optional. Every page is matched as a whole.

The wrappers of a host are aligned with the structures of all its pages, and every page is read
from the places of the first wrapper that matches it. What a place is, all pages of the host
decide: it is content, or not, if it is so on ``PRESENT`` of the pages whose elements say what
their content is; a text of a place outside of groups is template if it stands there on
``PRESENT`` of all pages of the host (it goes from pages without such elements). Fixed element
rules are the tie-break, for other places and for pages that match no wrapper: boilerplate
elements go; the content is the page's ``main``, its ``article`` elements if they hold half of that
(a quarter of a page without ``main``), else all of it. Weak marks (names that only begin like
boilerplate) do not count where they hold most of the content. Matching takes time linear in a
page's tokens, whatever the wrapper.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import saved, tidy

#: Instructions that alignment may bring a wrapper to (twice its first page's, if that is more).
ROOM = 2_000
#: Pages that must agree in a text to make it template. Texts that make up more than this
#: share of a page are not: then the pages are copies of each other.
AGREEING, TEMPLATE_SHARE = 4, 0.5
#: Shares of the text of ``main``, or of a page without it, from which on ``article`` elements are the content.
ARTICLE_IN_MAIN, ARTICLE_IN_PAGE = 0.5, 0.25
#: Share of all pages of a host that hold a template text in its place.
PRESENT = 0.9

# Elements by their meaning in HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template svg iframe object canvas".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub "
             "sup time tt u var br wbr img".split())
BOILERPLATE = set("nav header footer aside form button select textarea dialog menu head title".split()) | RAW
MARKS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie "
            "cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice "
            "pagination pager popup promo promoted promotion related remark replies reply respond share sharing "
            "sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Further names of boilerplate by their beginnings, unless the rest tells a state or a place of the element.
PREFIXES = tuple(f"{w}{c}" for c in "-_" for w in
                 "ad ads advert advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                 "footer login modal nav navbar navigation newsletter pagination popup promo promoted related share "
                 "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
STATES = set("open opened closed on off enabled disabled visible active left right fixed top bottom layout".split())
NAMES = MARKS | set("site-header site-footer site-nav page-footer main-nav main-menu primary-nav primary-menu "
                    "top-nav post-comments".split())
# Elements that no class, id or role marks.
WHOLE = {"html", "body", "main"}
# Elements whose id names their text rather than their part of the page.
TEXTS = {"p", "li", "dt", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"} | INLINE
# Elements whose end tag may be left out, and what opens in their place.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
# Quotes only count right after an equals sign; nothing is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
                    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:(?>=\s*(?:\"[^\"]*\"|'[^']*'))|[^>])*+)>", re.S)
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
# How much an element is boilerplate: by a name that only begins like one, or surely.
WEAK, SURE = 1, 2
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind, value, boilerplate) in page order: kind ``<``, ``>`` or ``t``; comments and the
    insides of raw elements are left out. Missing end tags are supplied. Weak marks are
    dropped where they would take most of the content."""
    found = _graded(page)
    if any(bad == WEAK for _, _, bad in found):
        loose = [(k, v, bad == SURE) for k, v, bad in found]
        inside, content = _scope(loose)
        texts = [(bad, len(v.strip())) for (k, v, bad), i in zip(found, inside) if k == "t" and i and bad != SURE]
        weak, kept = (sum(n for bad, n in texts if bad == level) for level in (WEAK, 0))
        if weak > kept if content else not kept:
            return loose
    return [(k, v, bool(bad)) for k, v, bad in found]


def _scope(toks) -> tuple[list[bool], bool]:
    """Which tokens are the content, and whether an element says so."""
    def within(tag, outer=None):
        out, depth = [], 0
        for i, (k, v, bad) in enumerate(toks):
            if k == "<" and v == tag and not bad and (outer is None or outer[i]):
                depth += 1
            out.append(depth > 0)
            if k == ">" and v == tag and not bad and depth:
                depth -= 1
        return out

    def size(inside):
        return sum(len(v.strip()) for (k, v, bad), i in zip(toks, inside) if i and k == "t" and not bad)

    everything = [True] * len(toks)
    main = within("main")
    outer, named = (main, True) if size(main) else (everything, False)
    article = within("article", outer)
    if size(article) and size(article) >= (ARTICLE_IN_MAIN if named else ARTICLE_IN_PAGE) * size(outer):
        return article, True
    return outer, named


def _graded(page: str) -> list[tuple[str, str, int]]:
    """:func:`tokens` with the strength of the mark."""
    out: list[tuple[str, str, int]] = []
    open_: list[tuple[str, int]] = []
    at, raw_until = 0, None

    def text(s: str):
        if s and (not s.isspace() or (out and out[-1][0] == "t")):
            out.append(("t", s, open_[-1][1] if open_ else 0))
        elif s and out:
            out.append(("t", " ", open_[-1][1] if open_ else 0))

    def close(n: int):
        while len(open_) > n:
            name, bad = open_.pop()
            out.append((">", name, bad))

    while True:
        if raw_until:
            end = re.compile(rf"</{raw_until}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            raw_until = None
        m = _TOKEN.search(page, at)
        text(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            i = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if i is not None:
                close(i)
            continue
        for i in range(len(open_) - 1, -1, -1):
            top = open_[i][0]
            ends = top in CLOSED_BY and (name not in INLINE if CLOSED_BY[top] is None else name in CLOSED_BY[top])
            if ends:
                close(i)
            elif top not in INLINE:
                break
        bad = max(open_[-1][1] if open_ else 0, SURE if name in BOILERPLATE else _marked(name, m[3]))
        if name in RAW:
            raw_until = name
            continue
        out.append(("<", name, bad))
        if name in VOID or m[3].rstrip().endswith("/"):
            out.append((">", name, bad))
        else:
            open_.append((name, bad))
    close(0)
    return out


def _marked(element: str, attributes: str) -> int:
    """Whether the element is hidden, or named as boilerplate by a whole class, id or role
    (``SURE``), or by the beginning of one (``WEAK``; not for ``article`` nor the ids of ``TEXTS``)."""
    if element in ("html", "body"):
        return 0
    grade = 0
    for m in _ATTR.finditer(attributes or ""):
        attribute, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true" \
                or attribute == "style" and _HIDING.search(value):
            return SURE
        if attribute not in ("class", "id", "role") or element in WHOLE:
            continue
        for n in value.lower().split():
            if n in NAMES:
                return SURE
            if not (attribute == "id" and element in TEXTS) and element != "article" and n.startswith(PREFIXES) \
                    and not STATES & set(re.split("[-_]", n)):
                grade = WEAK
    return grade


# A wrapper is a list of nodes: ("<", name), (">", name), ("t", text or None for a slot),
# ("?", nodes), ("+", nodes).

def _simple(toks, places: list | None = None) -> list[tuple]:
    """Block-level tokens, each run of texts and inline tags as one text. ``places`` gets
    the number of each token's text in the result (-1: none)."""
    out: list[tuple] = []
    for kind, value, bad in toks:
        if places is not None:
            text = kind == "t" and not value.isspace()
            places.append(len(out) - (bool(out) and out[-1][0] == "t") if text else -1)
        if kind != "t" and value not in INLINE:
            out.append((kind, value + ("!" if bad and kind == "<" else "")))
        elif kind == "t" and not value.isspace():
            if out and out[-1][0] == "t":
                out[-1] = ("t", out[-1][1] + value)
            else:
                out.append(("t", value))
    return out


def _expression(nodes: list[tuple]) -> str:
    parts = []
    for n in nodes:
        if n[0] in "<>":
            parts.append(re.escape(f"{n[0]}{n[1]}\x01"))
        elif n[0] == "t":
            parts.append("(?:t\x01)?")
        else:
            parts.append(f"(?:{_expression(n[1])}){'?' if n[0] == '?' else '*'}")
    return "".join(parts)


def _encoded(page: list[tuple]) -> str:
    return "".join(f"{k}{v}\x01" if k in "<>" else "t\x01" for k, v in page)


def _program(nodes: list[tuple], fixed: bool = False, every: bool = False) -> tuple[list[tuple], list]:
    """The wrapper as instructions: a tag, an optional text (with the number of its fixed place
    or None), a choice of two ways, a jump; and the texts of the fixed places. With ``every`` all
    texts are numbered, also in groups; then whether each is outside of groups."""
    code: list[tuple] = []
    texts: list = []

    def add(some, top):
        for n in some:
            if n[0] in "<>":
                code.append(("tag", n))
            elif n[0] == "t":
                mark = None
                if every or top and n[1] is not None:
                    mark = len(texts)
                    texts.append(top if every else n[1])
                code.append(("text", mark))
            else:
                at = len(code)
                code.append(())
                add(n[1], False)
                if n[0] == "+":
                    code.append(("jump", at))
                code[at] = ("split", at + 1, len(code))
    add(nodes, fixed or every)
    return code, texts


def _run(code: list[tuple], page: list[tuple], start: int = 0, whole: bool = True,
         by_token: bool = False) -> tuple[int, dict] | None:
    """Match tokens from ``start`` (to the end, if ``whole``): where the match ends and the place
    of every fixed text (``by_token``: the number of the text that each token fills). Each pair of instruction and token is tried once at most."""
    seen, stack = set(), [(0, start, None)]
    n, width = len(page), len(code) + 1
    while stack:
        pc, at, held = stack.pop()
        while True:
            state = at * width + pc
            if state in seen:
                break
            seen.add(state)
            if pc == len(code):
                if whole and at < n:
                    break
                places = {}
                while held:
                    k, place, held = held
                    if by_token:
                        places[place] = k
                    else:
                        places[k] = place
                return at, places
            step = code[pc]
            if step[0] == "tag":
                if at == n or page[at] != step[1]:
                    break
                at, pc = at + 1, pc + 1
            elif step[0] == "text":
                if at < n and page[at][0] == "t":
                    stack.append((pc + 1, at, held))
                    if step[1] is not None:
                        held = (step[1], at, held)
                    at += 1
                pc += 1
            elif step[0] == "split":
                stack.append((step[2], at, held))
                pc = step[1]
            else:
                pc = step[1]
    return None


def _element(seq: list[tuple], end: int) -> int | None:
    """Start of the element that ends just before ``end``."""
    depth = 0
    for i in range(end - 1, -1, -1):
        k = seq[i][0]
        if k == ">":
            depth += 1
        elif k == "<":
            depth -= 1
            if depth == 0:
                return i
            if depth < 0:
                return None
        elif depth == 0:
            return None
    return None


def _span(seq: list[tuple], start: int) -> int | None:
    """End of the element that starts at ``start``."""
    depth = 0
    for i in range(start, len(seq)):
        depth += {"<": 1, ">": -1}.get(seq[i][0], 0)
        if depth == 0:
            return i + 1 if seq[i][0] == ">" else None
    return None


def align(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The wrapper made general enough for the page as well."""
    out: list[tuple] = []
    i = j = 0
    while i < len(wrapper) or j < len(page):
        w = wrapper[i] if i < len(wrapper) else None
        p = page[j] if j < len(page) else None
        if w and p and w[0] in "<>" and w == p:
            out.append(w)
            i, j = i + 1, j + 1
        elif w and w[0] == "t":
            same = p and p[0] == "t"
            out.append(w if same and w[1] == p[1] else ("t", None))
            i, j = i + 1, j + bool(same)
        elif p and p[0] == "t":
            out.append(("t", None))
            j += 1
        elif w and w[0] in "?+":
            j = _run(_program([w])[0], page, j, whole=False)[0]      # may match nothing, but matches
            out.append(w)
            i += 1
        elif p and p[0] == "<" and (e := _span(page, j)) and (r := _repeats(out, page[j:e])) is not None:
            out = r
            j = e
        elif w and w[0] == "<" and (e := _span(wrapper, i)) and (r := _repeats(out, wrapper[i:e])) is not None:
            out = r
            i = e
        elif p and p[0] == "<" and (e := _span(page, j)) and _meets(wrapper, i, page, e):
            out.append(("?", [_slots(n) for n in page[j:e]]))
            j = e
        elif w and w[0] == "<" and (e := _span(wrapper, i)):
            out.append(("?", wrapper[i:e]))
            i = e
        elif p and p[0] == "<" and (e := _span(page, j)):
            out.append(("?", [_slots(n) for n in page[j:e]]))
            j = e
        else:                                     # an end tag that only one side has
            return [*out, *wrapper[i:]]
    return out


def _meets(wrapper, i, page, e) -> bool:
    return i < len(wrapper) and e < len(page) and wrapper[i] == page[e]


def _slots(n: tuple) -> tuple:
    return ("t", None) if n[0] == "t" else n


def _repeats(out: list[tuple], square: list[tuple]) -> list[tuple] | None:
    """If ``square`` repeats the element or group that ``out`` ends with: ``out`` with that
    as a repeated group, made general enough for the square."""
    if out and out[-1][0] == "+":
        group, head = out[-1][1], out[:-1]
    else:
        start = _element(out, len(out))
        if start is None:
            return None
        group, head = out[start:], out[:start]
    if not group or group[0] != square[0]:
        return None
    inside = align(group, square)
    return [*head, ("+", [_slots(n) for n in inside])]


def infer(pages: list[list[tuple]]) -> list[tuple]:
    """The wrapper of several pages' block tokens."""
    wrapper = _fold(pages[0]) if pages else []
    for p in pages[1:]:
        wrapper = align(wrapper, p)
    return wrapper


def _fold(seq: list[tuple]) -> list[tuple]:
    """A page with runs of elements of one structure folded into repeated groups."""
    out: list[tuple] = []
    i = 0
    while i < len(seq):
        e = _span(seq, i) if seq[i][0] == "<" else None
        if e:
            inner = [seq[i], *_fold(seq[i + 1:e - 1]), seq[e - 1]]
            r = _repeats(out, inner) if _alike(out, inner) else None
            out = r if r is not None else out + inner
            i = e
        else:
            out.append(seq[i])
            i += 1
    return out


def _alike(out: list[tuple], inner: list[tuple]) -> bool:
    if not out or out[-1][0] not in "+>":
        return False
    start = _element(out, len(out)) if out[-1][0] == ">" else None
    last = out[-1][1] if out[-1][0] == "+" else out[start:] if start is not None else []
    return bool(last) and _expression(last) == _expression(inner)


def content_tag(pages: list[list[tuple]]) -> str | None:
    """``article`` or ``main``, if every page has exactly one outside boilerplate."""
    return next((x for x in ("article", "main") if all(p.count(("<", x)) == 1 for p in pages)), None)


def _template(places: dict[int, int], page: list[tuple], texts: list[str | None]) -> dict[int, int]:
    """Places of the matched page with the wrapper's text, and that text's number."""
    return {at: k for k, at in places.items() if texts[k] is not None and page[at][1] == texts[k]}


def wrapper_expression(pages: list[list[tuple]]) -> str | None:
    """A host's wrapper as JSON: its content's ``tag``, its ``nodes`` and the ``texts`` of its
    fixed places (null: not on all the pages that match)."""
    if not pages:
        return None
    nodes, tag = infer(pages), content_tag(pages)
    code, texts = _program(nodes, fixed=True)
    agreeing, matched = [0] * len(texts), 0
    for p in pages:
        if m := _run(code, p):
            matched += 1
            for k in _template(m[1], p, texts).values():
                agreeing[k] += 1
    texts = [t if n == matched >= AGREEING else None for t, n in zip(texts, agreeing)]
    if tag is None and not any(texts):
        return None
    return json.dumps({"tag": tag, "nodes": nodes, "texts": texts})


def _nodes(some) -> list[tuple]:
    return [(n[0], _nodes(n[1]) if n[0] in "?+" else n[1]) for n in some]


@functools.lru_cache(maxsize=256)
def _read(wrapper: str) -> tuple[str | None, list[tuple], list]:
    w = json.loads(wrapper)
    return w["tag"], _program(_nodes(w["nodes"]), fixed=True)[0], w["texts"]


def blocks(toks, inside: list[bool] | None = None, without=frozenset()) -> str:
    """Texts outside boilerplate, a line per block; only those ``inside`` (if given) and not
    those whose number is in ``without``."""
    out, line = [], []
    inside = [True] * len(toks) if inside is None else inside

    def end():
        s = re.sub(r"\s+", " ", html.unescape("".join(line)).replace("\xa0", " ")).strip()
        if s:
            out.append(s)
        line.clear()

    for at, (kind, value, bad) in enumerate(toks):
        if kind == "t":
            if inside[at] and not bad and at not in without:
                line.append(value)
        elif value not in INLINE:
            end()
        elif value == "br" and kind == "<" and inside[at] and not bad:
            line.append(" ")
    end()
    return "\n".join(out)


def _found(toks, wrapper: str | None, known=None) -> dict[int, int]:
    """Numbers of the tokens that hold template texts, and these texts' numbers in the wrapper;
    ``known``: the texts that are template."""
    _, code, texts = _read(wrapper)
    places: list[int] = []
    simple = _simple(toks, places)
    m = _run(code, simple)
    if not m:
        return {}
    if known is not None:
        texts = [t if k in known else None for k, t in enumerate(texts)]
    template = _template(m[1], simple, texts)
    return {i: template[at] for i, at in enumerate(places) if at in template}


def page_text(page: str | None, wrapper: str | None = None, known=None) -> str:
    """Main text of a page: the element rules', without the texts that its host's wrapper finds
    in their places. With ``known`` only these of the wrapper's texts go (by number), and only
    from pages where no element says what the content is."""
    toks = tokens(page or "")
    if not toks:
        return ""
    inside, content = _scope(toks)
    if not wrapper or known is not None and (content or not known):
        return blocks(toks, inside)
    gone = {i for i in _found(toks, wrapper, known) if inside[i] and not toks[i][2]}
    held = sum(len(v) for (k, v, bad), i in zip(toks, inside) if k == "t" and i and not bad)
    if sum(len(toks[i][1]) for i in gone) > TEMPLATE_SHARE * held:
        gone = set()                             # a copy of other pages, not a template
    return blocks(toks, inside, gone)


def _lines(toks, inside: list[bool]) -> tuple[list[str], list[bool]]:
    """For every text of :func:`_simple`: its line without boilerplate, and whether the page's own
    element rules hold it for content."""
    places: list[int] = []
    _simple(toks, places)
    number = -1
    parts: list[list[str]] = []
    own: list[bool] = []
    fresh, run = True, []
    for at, (kind, value, bad) in enumerate(toks):
        if kind != "t" and value not in INLINE:
            fresh, run = True, []
            continue
        piece = value if kind == "t" else " " if value == "br" and kind == "<" else ""
        if places[at] >= 0 and fresh:
            number, fresh = number + 1, False
            parts.append(run)
            own.append(False)
        if not bad and piece:
            run.append(piece)
        if kind == "t" and not bad and inside[at] and not fresh:
            own[number] = True
    return [re.sub(r"\s+", " ", html.unescape("".join(p)).replace("\xa0", " ")).strip() for p in parts], own


def _cut(batches):
    """(page_id, url, host, html) -> the page's structure and the lines of its texts."""
    for batch in batches:
        shapes, named, lines, inside, marks = [], [], [], [], []
        for page in batch.column("html").to_pylist():
            toks = tokens(page or "")
            scope, content = _scope(toks)
            own, kept = _lines(toks, scope)
            shapes.append(_encoded(_simple(toks)))
            named.append(content)
            lines.append(own)
            inside.append(kept)
            marks.append([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                         "little", signed=True) for x in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(shapes, pa.string()),
             pa.array(named, pa.bool_()), pa.array(lines, pa.list_(pa.string())), pa.array(inside, pa.list_(pa.bool_())),
             pa.array(marks, pa.list_(pa.int64()))],
            names=["page_id", "url", "host", "shape", "named", "lines", "inside", "marks"])


def _decoded(shape: str) -> list[tuple]:
    """The block tokens of :func:`_encoded`, their texts as slots."""
    return [("t", None) if x == "t" else (x[0], x[1:]) for x in shape.split("\x01")[:-1]]


def _folded(batches):
    """Structures with a hash of their form with runs folded: one of each form is aligned."""
    for batch in batches:
        folds = []
        for shape in batch.column("shape").to_pylist():
            try:
                form = _expression(_fold(_decoded(shape)))
            except RecursionError:               # elements nested beyond Python's stack
                form = None
            folds.append(form and hashlib.md5(form.encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folds, pa.string())], names=[*batch.schema.names, "fold"])


def _extend(found: list[list], page: list[tuple]) -> None:
    """Make one of a host's wrappers (nodes, program, room) fit a further page: the first that matches
    it stays as it is, else the first that has room is aligned with it, else it starts another."""
    if any(_run(code, page) for _, code, _ in found):
        return
    for w in found:
        grown = align(w[0], page)
        code = _program(grown)[0]
        if len(code) <= w[2] and _run(code, page):
            w[0], w[1] = grown, code
            return
    nodes = _fold(page)
    code = _program(nodes)[0]
    if _run(code, page):
        found.append([nodes, code, max(ROOM, 2 * len(code))])


def _learn(batches):
    """Structures in order of their hosts -> (host, wrappers); only one host's wrappers are held."""
    def row(host, found):
        try:
            wrapper = json.dumps([w[0] for w in found]) if found else None
        except RecursionError:
            wrapper = None
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([wrapper], pa.string())],
                                          names=["host", "wrapper"])
    host, found = None, []
    for batch in batches:
        for h, shape in zip(batch.column("host").to_pylist(), batch.column("shape").to_pylist()):
            if h != host:
                if host is not None:
                    yield row(host, found)
                host, found = h, []
            try:
                _extend(found, _decoded(shape))
            except RecursionError:               # this page keeps its own rules
                pass
    if host is not None:
        yield row(host, found)


def learn_wrappers(shapes: DataFrame) -> DataFrame:
    """``host``, ``wrapper``: the wrappers of every host, aligned with all structures of its pages
    (``host``, ``shape``, ``key``, ``n`` pages), the commonest first. Structures that differ only in
    how often something repeats are aligned once. A wrapper that alignment would make longer than
    ``ROOM`` is left as it is and the host gets another, as for pages of another kind."""
    forms = shapes.select("host", "shape", "key", "n").mapInArrow(
        tidy(_folded), "host string, shape string, key string, n long, fold string").where("fold is not null")
    forms = forms.groupBy("host", "fold").agg(F.sum("n").alias("n"), F.min(F.struct("key", "shape")).alias("one"))
    ordered = forms.select("host", "n", "one.*").repartition("host").sortWithinPartitions("host", F.desc("n"), "key")
    return ordered.select("host", "shape").mapInArrow(tidy(_learn), "host string, wrapper string").where("wrapper is not null")


@functools.lru_cache(maxsize=64)
def _programs(wrapper: str) -> list[tuple]:
    return [_program(_nodes(w), every=True) for w in json.loads(wrapper)]


@functools.lru_cache(maxsize=4096)
def _places(wrapper: str, shape: str) -> tuple[int, list[int], list[bool]] | None:
    """Number of the first wrapper that matches, and for every text of the structure its place in
    the wrapper and whether that stands there once."""
    page = _decoded(shape)
    for number, (code, top) in enumerate(_programs(wrapper)):
        if m := _run(code, page, by_token=True):
            at = [m[1][i] for i, t in enumerate(page) if t[0] == "t"]
            return number, at, [top[k] for k in at]
    return None


def _matched(batches):
    """(key, host, shape, wrapper) -> the places of the structure's texts, if a wrapper matches it."""
    for batch in batches:
        found = [(k, h, *m) for k, h, shape, w in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "shape", "wrapper")))
                 if (m := _places(w, shape))]
        keys, hosts, numbers, places, once = zip(*found) if found else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(hosts, pa.string()), pa.array(numbers, pa.int32()),
             pa.array(places, pa.list_(pa.int32())), pa.array(once, pa.list_(pa.bool_()))],
            names=["key", "host", "number", "places", "once"])


def _host(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wrapper_places(cut: DataFrame, matches: DataFrame) -> DataFrame:
    """What the pages say of their wrapper's places: per ``host`` and wrapper ``number`` the places
    that are ``content`` on ``PRESENT`` of the pages whose elements say what it is, those that are
    ``other`` on as many, and the ``known`` template texts ``place mark``."""
    told = cut.select("key", "named", "inside", "marks", F.transform("lines", F.length).alias("sizes")).join(matches, "key")
    told = told.select("host", "number", "named", F.inline(F.arrays_zip("places", "once", "inside", "marks", "sizes")))
    told = told.toDF("host", "number", "named", "place", "once", "inside", "mark", "size").where("size > 0")
    votes = told.where("named").groupBy("host", "number", "place").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("own"))
    votes = votes.where(F.col("n") >= AGREEING)
    content, other = F.col("own") >= F.lit(PRESENT) * F.col("n"), F.col("n") - F.col("own") >= F.lit(PRESENT) * F.col("n")
    votes = votes.groupBy("host", "number").agg(F.collect_list(F.when(content, F.col("place"))).alias("content"),
                                                F.collect_list(F.when(other, F.col("place"))).alias("other"))
    whole = cut.groupBy("host").agg(F.count("*").alias("pages"))
    known = told.where("not named and once").groupBy("host", "number", "place", "mark").agg(F.count("*").alias("n"))
    known = known.where(F.col("n") >= AGREEING).join(whole, "host").where(F.col("n") >= F.lit(PRESENT) * F.col("pages"))
    known = known.groupBy("host", "number").agg(F.collect_list(F.concat_ws(" ", "place", "mark")).alias("known"))
    return votes.join(known, ["host", "number"], "full")


@functools.lru_cache(maxsize=256)
def _facts(facts: str) -> dict[int, tuple[set, set, set]]:
    return {w["number"]: tuple(set(w.get(c) or ()) for c in ("content", "other", "known")) for w in json.loads(facts)}


def _emitted(shape, named, lines, inside, marks, wrapper, facts) -> str:
    """The lines of a page at its wrapper's content places, without template texts."""
    own = [i for i, x in enumerate(lines) if x and inside[i]]
    m = _places(wrapper, shape) if shape and wrapper and facts else None
    if not m or m[0] not in _facts(facts):
        return "\n".join(lines[i] for i in own)
    places, (content, other, known) = m[1], _facts(facts)[m[0]]
    kept = [i for i, x in enumerate(lines) if x and (places[i] in content or inside[i] and places[i] not in other)]
    kept = kept or own                           # unlike its host's pages
    if known and not named:
        rest = [i for i in kept if f"{places[i]} {marks[i]}" not in known]
        if sum(len(lines[i]) for i in rest) >= (1 - TEMPLATE_SHARE) * sum(len(lines[i]) for i in kept):
            kept = rest                          # else a copy of other pages, not a template
    return "\n".join(lines[i] for i in kept)


def _emit(batches):
    names = ("shape", "named", "lines", "inside", "marks", "wrapper", "facts")
    for batch in batches:
        texts = [_emitted(*row) for row in zip(*(batch.column(c).to_pylist() for c in names))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    Null or empty html gives an empty text. Pages without a host share their wrappers.
    Repeated rows are extracted each; an empty table gives no rows; further columns are
    ignored. A very long page is learnt from and extracted whole like any other. A ``header``
    goes wherever it stands, also in an article.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        _host(F.col(url_col)).alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()
    cut = rows.mapInArrow(tidy(_cut), f"page_id {kind}, url string, host string, shape string, named boolean, "
                                      "lines array<string>, inside array<boolean>, marks array<long>")
    cut = saved(cut.withColumn("key", F.md5(F.concat_ws("\n", "host", "shape"))), "page-lines")
    shapes = cut.where("shape <> ''").groupBy("key").agg(
        F.first("host").alias("host"), F.first("shape").alias("shape"), F.count("*").alias("n"))     # equal ones
    shapes = saved(shapes, "page-shapes")
    wrappers = saved(learn_wrappers(shapes), "wrappers")
    matches = shapes.join(wrappers, "host").select("key", "host", "shape", "wrapper").mapInArrow(
        tidy(_matched), "key string, host string, number int, places array<int>, once array<boolean>")
    matches = saved(matches, "wrapper-matches")
    facts = wrapper_places(cut, matches).groupBy("host").agg(
        F.to_json(F.collect_list(F.struct("number", "content", "other", "known"))).alias("facts"))
    facts = saved(wrappers.join(facts, "host"), "wrapper-places")                # one row per host
    return cut.drop("key").join(facts, "host", "left").mapInArrow(
        tidy(_emit), f"page_id {kind}, url string, text string, n_chars long")
