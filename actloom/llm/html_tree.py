"""A page as elements and blocks of text: a small forgiving reader of HTML, and which elements are page furniture."""

from __future__ import annotations

import html
import re
from hashlib import blake2b

# Names of HTML elements and attributes, and words that page authors use for furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
ENCLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
BARRIER = frozenset("table td th caption template".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption colgroup".split())
CONTAINERS = frozenset("body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form script style noscript template button select option textarea iframe object svg canvas dialog menu title audio video map noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
FURNITURE = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pager pagination toolbar topbar header masthead banner footer colophon copyright "
    "sidebar aside rail widget widgets related recommended recommendations trending notice cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup login toast ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo "
    "promotion comment comments reply replies disqus respond discussion share sharing social search form hidden "
    "werbung anzeige publicite publicidad anuncio anuncios hinweis kommentar kommentare commentaire commentaires comentario comentarios".split()
)
HEADERS = frozenset({"header"})
OWN_HEADER = frozenset("article post entry content story main title".split())  # with these, a header is the article's own
NO_ARTICLE = frozenset("comment comments reply replies related recommended ad ads advert advertisement sponsored promo".split())
NOT_THE_PART = ("has-", "with-", "no-", "without-")  # such a class tells of a part, it is not the part
MAIN_WORDS = frozenset("article articlebody content entry main post story text".split())
COMMENTS_HEADING = re.compile(r"\(?\d*\)?\s*(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios?)\s*:?\s*(?:\(\d+\))?:?", re.I)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str):
    """(text, None, None), ("", name, attributes) of start tags and ("", "/name", "") of end tags, in order.

    Comments, declarations and what stands in raw elements give nothing; an unfinished tag or comment ends the page.
    """
    at, size, last = 0, len(page), page.rfind(">")
    begin = 0  # of the text before the next tag
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?") or (follows == "/" and not page[at + 2 : at + 3].isalpha()):
            if begin < at:
                yield page[begin:at], None, None
            comment = page.startswith("<!--", at)
            stop = page.find("-->" if comment and page[at + 4 : at + 5] != ">" else ">", at + (4 if comment else 1))
            if stop < 0:
                return
            at = begin = stop + (3 if page[stop] == "-" else 1)
            continue
        if not (follows.isascii() and follows.isalpha()) and follows != "/":
            at += 1
            continue
        if begin < at:
            yield page[begin:at], None, None
        begin = size
        found = _TAG.match(page, at) if at < last else None
        if not found:
            return
        slash, name, attributes = found.groups()
        name, at = name.lower(), found.end()
        yield "", slash + name, attributes
        if not slash and name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not found:
                return
            at = found.start()
        begin = at
    if begin < size:
        yield page[begin:], None, None


def words_of(value: str) -> set[str]:
    """The words of class and id names: at hyphens and humps, lower-cased."""
    return {w.lower() for name in value.split() if not name.lower().startswith(NOT_THE_PART) for w in _PARTS.findall(name)}


class Page:
    """Elements in page order and the blocks of text between them.

    By element: parent, tag, step (tag, classes and id, digits as #), path (a hash of the steps from the top: the generalised
    tag-class path), mark (furniture by itself) and dropped (furniture, or inside it). blocks holds (element, text,
    characters in links) of what is not dropped.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.step = [-1], ["html"], [b""], ["html"]
        self.mark, self.dropped, self.links = [False], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open, self._text, self._linked = [0], {"html": 1}, [], 0
        self._inline: list[tuple[str, bool]] = []  # open inline elements of the block element on top, and if they are dropped
        self._anchors = self._quiet = 0
        for text, name, attributes in tokens(source):
            if name is None:
                self._add(text)
            elif name[0] == "/":
                self._end(name[1:])
            else:
                self._start(name, attributes)
        self._break()
        self._settle()

    def _add(self, text: str):
        if self._quiet or self.dropped[self._stack[-1]]:
            return
        text = html.unescape(text)
        self._text.append(text)
        if self._anchors:
            self._linked += len(text.strip())

    def _break(self):
        """Ends the block of text at hand."""
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _start(self, name: str, attributes: str):
        if name in INLINE:
            found = self._attributes(attributes) if attributes else {}
            quiet = self._is_furniture(name, found)
            self._inline.append((name, quiet))
            self._quiet += quiet
            self._anchors += name == "a"
            self.links[self._stack[-1]] += name == "a"
            return
        if name in VOID:
            if name == "hr":
                self._break()
            elif name in ("br", "wbr", "img"):
                self._text.append(" " if name == "br" else "")
            return
        self._break()
        if name in CLOSES_P:
            self._close({"p"}, BARRIER | CONTAINERS)
        if name in CLOSES:
            self._close(CLOSES[name], ENCLOSES[name])
        if name in ("article", "main"):
            while self._within("nav", "header"):  # left open
                self._pop()
        if name in ("html", "body") and self._within(name):
            return
        if name == "body":  # a head left open
            while len(self._stack) > 1:
                self._pop()
        found = self._attributes(attributes) if attributes else {}
        up, number = self._stack[-1], len(self.tag)
        mark = self._is_furniture(name, found)
        if name in ("article", "main", "h1") and self._within("form"):  # around the whole page
            for e in self._stack[1:]:
                self.mark[e] = self.mark[e] and self.tag[e] != "form"
                self.dropped[e] = self.mark[e] or self.dropped[self.parent[e]]
        self.parent.append(up)
        self.tag.append(name)
        kinds = sorted({_DIGITS.sub("#", w.lower()) for w in (found.get("class") or "").split()})
        step = ".".join([name, *kinds]) + ("#" + _DIGITS.sub("#", found["id"].strip().lower()) if found.get("id") else "")
        self.step.append(step)
        self.path.append(blake2b(step.encode("utf-8", "surrogatepass"), key=self.path[up], digest_size=8).digest())
        self.mark.append(mark)
        self.dropped.append(mark or self.dropped[up])
        self.links.append(0)
        self._stack.append(number)
        self._open[name] = self._open.get(name, 0) + 1
        self._inline, self._anchors, self._quiet = [], 0, 0

    def _pop(self):
        self._open[self.tag[self._stack.pop()]] -= 1
        self._inline, self._anchors, self._quiet = [], 0, 0

    def _close(self, names, barrier):
        """Ends the nearest open element of ``names``, unless the barrier is met first."""
        if not self._within(*names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if tag in barrier:
                return

    def _end(self, name: str):
        if name in INLINE:
            for i in range(len(self._inline) - 1, -1, -1):
                if self._inline[i][0] == name:
                    for tag, quiet in self._inline[i:]:
                        self._quiet -= quiet
                        self._anchors -= tag == "a"
                    del self._inline[i:]
                    return
            return
        self._break()
        if name == "br":
            return
        if name not in ("html", "body"):
            self._close({name}, frozenset() if name in TABLE else BARRIER)

    @staticmethod
    def _attributes(text: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        return found

    def _within(self, *names) -> bool:
        return any(self._open.get(name) for name in names)

    def _is_furniture(self, name: str, found: dict[str, str]) -> bool:
        if name in DROPPED:
            return True
        if name in ("html", "body", "main"):
            return False
        if name == "header" and not self._within("article", "main"):
            return True
        if not found:
            return False
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or _HIDDEN.search(found.get("style", "")):
            return True
        words = words_of(found.get("class", "")) | words_of(found.get("id", ""))
        marks = words & (NO_ARTICLE if name == "article" else FURNITURE)
        if marks == HEADERS and (words & OWN_HEADER or self._within("article", "main")):
            return False
        return bool(marks)

    def _settle(self):
        """Lists of links and what follows a heading of reader comments are furniture, too."""
        n = len(self.tag)
        chars, linked, links, holds = [0] * n, [0] * n, list(self.links), [t in ("article", "main", "h1") for t in self.tag]
        for e, text, in_links in self.blocks:
            chars[e] += len(text)
            linked[e] += in_links
        for e in range(n - 1, 0, -1):  # children come after their parents
            up = self.parent[e]
            chars[up] += chars[e]
            linked[up] += linked[e]
            links[up] += links[e]
            holds[up] = holds[up] or holds[e]
        stop = [len(self.blocks)] * n  # the block from which on an element holds reader comments
        for i, (e, text, _) in enumerate(self.blocks):
            if self.tag[e] in HEADINGS and self.tag[e] != "h1" and len(text) < 60 and COMMENTS_HEADING.fullmatch(text):
                stop[self.parent[e]] = min(stop[self.parent[e]], i)
        for e in range(1, n):
            up = self.parent[e]
            menu = self.tag[e] in ("ul", "ol", "div", "section", "table", "dl") and links[e] >= 3 and linked[e] >= 0.7 * chars[e] and not holds[e]
            self.dropped[e] = self.dropped[e] or self.dropped[up] or menu
            stop[e] = min(stop[e], stop[up])
        self.blocks = [b for i, b in enumerate(self.blocks) if not self.dropped[b[0]] and i < stop[b[0]]]
