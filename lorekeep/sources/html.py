"""Per-page helper: what an HTML parser reports, as a flat list of elements and one of texts. All rules are Spark's work."""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed values of the HTML standard: elements without content, elements inside a line, and elements that end an open one.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PHRASE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_ROW = {"tr", "td", "th"}
# Attributes that a rule reads.
KEPT = {"role", "hidden", "aria-hidden", "href", "property", "name", "itemprop", "content", "rel", "datetime"}
BREAK = "\v"


class Events(HTMLParser):
    """``nodes``: (tag, numbers from the page down to the element, place among its like, attributes); ``texts``: (element, text)."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [("#page", [0], 0, {})]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]
        self.like: dict[tuple[int, str], int] = {}
        self.feed(source)
        self.close()

    def _leave(self, tags: set[str], through: set[str]) -> None:
        """Closes the nearest open element of ``tags`` if only elements of ``through`` stand in between."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[at]][0]
            if tag in tags:
                del self.open[at:]
                return
            if tag not in through:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in PHRASE and tag not in VOID - {"hr"}:
            self._leave({"p"}, PHRASE)
        if tag in SIBLINGS:
            self._leave(SIBLINGS[tag], PHRASE | {"p"} | (ENDS_ROW - {tag} if tag == "tr" else set()))
        up = self.open[-1]
        nth = self.like[up, tag] = self.like.get((up, tag), 0) + 1
        no = len(self.nodes)
        self.nodes.append((tag, [*self.nodes[up][1], no], nth, {k: v or "" for k, v in attrs if k in KEPT}))
        shown = {"br": BREAK, "hr": "---", "img": dict(attrs).get("alt") or ""}.get(tag)
        if shown:
            self.texts.append((no, shown))
        if tag not in VOID:
            self.open.append(no)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[at]][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], data.replace(BREAK, " ")))
