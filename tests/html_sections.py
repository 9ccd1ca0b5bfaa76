"""Sections of a page by the standard library's parser: the slow way that the expressions are compared with."""

import re
from html.parser import HTMLParser

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
UNSEEN = frozenset(("script", "style"))


class _Sections(HTMLParser):
    """Name and lines of every level-1 heading's part."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found, self.name, self.parts, self.lines = [], None, [], []
        self.pre = self.unseen = 0

    def end_line(self) -> None:
        text, self.parts = re.sub(r"[ \t\n\r\f\v]+", " ", "".join(self.parts)).strip(" "), []
        if self.found and text:
            self.found[-1][1].append(text)

    def end_name(self) -> None:
        if self.name is not None:
            self.found[-1][0] = re.sub(r"[ \t\n\r\f\v]+", " ", "".join(self.name)).strip(" ")
            self.name = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.unseen += tag in UNSEEN
        if tag == "h1":
            self.end_line()
            self.end_name()
            self.found.append(["", []])
            self.name = []
        elif self.name is not None and tag == "br":
            self.name.append(" ")
        elif tag in BLOCKS:
            self.end_name()  # a heading that nothing closed
            self.end_line()
        elif tag in ("td", "th") and "".join(self.parts).strip():
            self.parts.append(" | ")
        self.pre += tag == "pre"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in ("h1", "br", "hr"):  # a slash closes nothing else that holds text
            self.pre -= tag == "pre"
            self.unseen -= tag in UNSEEN

    def handle_endtag(self, tag: str) -> None:
        self.unseen = max(0, self.unseen - (tag in UNSEEN))
        self.pre = max(0, self.pre - (tag == "pre"))
        if tag == "h1":
            self.end_name()
        elif tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.unseen or not self.found:
            return
        if self.name is not None:
            self.name.append(data)
            return
        for k, piece in enumerate(data.split("\n") if self.pre else [data]):
            if k:
                self.end_line()
            self.parts.append(piece)


def sections_of(html: str | None) -> list[tuple[str, str]] | None:
    if html is None:
        return None
    parser = _Sections()
    parser.feed(html)
    parser.close()
    parser.end_name()
    parser.end_line()
    return [(name, "\n".join(lines)) for name, lines in parser.found]
