"""HTML to lines of text: tables as rows with bars, navigation, references and hidden parts left out."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import tidy

#: Elements whose content is no text, and those that end a line (fixed values).
SILENT = frozenset(("script", "style", "nav", "sup", "noscript", "template", "head"))
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 section article header footer br tr table blockquote pre dd dt figure".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.text: list[str] = []
        self.cells: list[str] | None = None
        self.quiet: list[str] = []  # open elements below, and with, a silent one

    def flush(self) -> None:
        line = tidy("".join(self.text))
        self.text.clear()
        if line:
            self.lines.append(line)

    def handle_starttag(self, tag, attrs):
        if self.quiet:
            if tag not in VOID:
                self.quiet.append(tag)
            return
        style = (dict(attrs).get("style") or "").replace(" ", "").lower()
        if tag in SILENT or "display:none" in style:
            if tag not in VOID:
                self.quiet.append(tag)
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th"):
            self.text.clear() if self.cells is not None else self.flush()
        elif tag in BLOCKS and self.cells is None:
            self.flush()

    def handle_endtag(self, tag):
        if self.quiet:
            if tag in self.quiet:
                del self.quiet[len(self.quiet) - 1 - self.quiet[::-1].index(tag) :]
            return
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(tidy("".join(self.text)))
            self.text.clear()
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.lines.append(" | ".join(self.cells))
            self.cells = None
        elif tag in BLOCKS and self.cells is None:
            self.flush()

    def handle_data(self, data):
        if not self.quiet:
            self.text.append(data)


def lines(html: str | None) -> list[str]:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def html_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, lines): the text lines of every whole page."""
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([lines(h.as_py()) for h in batch.column("html")], pa.list_(pa.string()))], names=["id", "lines"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, lines array<string>").withColumnRenamed("id", id_col)
