"""What runs inside tasks for each Arrow batch of pages; imports nothing of Spark."""

from __future__ import annotations

import pyarrow as pa

from jobtide.functions import phrases as P
from jobtide.operators.markup import Page, parse_selector

_SPAN = pa.struct([("start", pa.int32()), ("size", pa.int32())])
#: Places of an element's texts in the text of its page, in bytes; null where a selector has no hit.
_TEXTS = ("own", "title", "heading", "location", "dated", "description")
_NODE = pa.struct([*((name, _SPAN) for name in _TEXTS), ("href", pa.string()), ("date_attribute", pa.string())])
_PAGES_PER_BATCH = 200


def _first(page: Page, selector: str, node: int) -> int | None:
    hit = page.find(selector, node, first=True)
    return hit[0] if hit else None


def _first_place(page: Page, selector: str, node: int) -> tuple[int, int] | None:
    """Text of the first match below a node; null when there is none, an empty one when the selector cannot be used."""
    try:
        hit = _first(page, selector, node)
    except ValueError:
        return 0, 0
    return None if hit is None else page.place(hit)


def _node(page: Page, node: int, cfg: dict) -> dict:
    anchor = _first(page, "a", node)
    href = page.attrs[anchor].get("href") if anchor is not None else None
    try:
        dated = _first(page, cfg["job_date_selector"], node)
    except ValueError:
        dated = None
    return {
        "own": page.place(node),
        "title": _first_place(page, cfg["job_title_selector"], node),
        "heading": _first_place(page, P.HEADING_SELECTOR, node),
        "location": _first_place(page, cfg["job_location_selector"], node),
        "dated": None if dated is None else page.place(dated),
        "description": _first_place(page, P.DESCRIPTION_SELECTOR, node),
        "href": href or page.attrs[node].get("href"),
        "date_attribute": None if dated is None else page.attrs[dated].get("datetime"),
    }


def _nodes_of(page: Page, cfg: dict) -> tuple[str, list[dict]]:
    """Elements of one page: first listing selector with a hit, else job-like links, else JSON-LD blocks."""
    for selector in cfg["job_listing_selector"].split(", "):
        try:
            nodes = page.find(selector)
        except ValueError:
            continue
        if nodes:
            return "selector", [_node(page, n, cfg) for n in nodes]
    nodes = page.find(P.JOB_LINK_SELECTOR)
    if nodes:
        return "link", [_node(page, n, cfg) for n in nodes]
    return "jsonld", [{"own": page.place(n)} for n in page.find('script[type="application/ld+json"]')]


def _scanned(cfg: dict) -> tuple[str, bytes, list[dict]]:
    """Which way found the elements of a page, the text around them all, and their places in it."""
    page = Page(cfg["html"] or "")
    source, nodes = _nodes_of(page, cfg)
    if not nodes:
        return source, b"", nodes
    low, high = min(n["own"][0] for n in nodes), max(n["own"][1] for n in nodes)
    for node in nodes:
        for name in _TEXTS:
            if place := node.get(name):
                node[name] = {"start": max(0, place[0] - low), "size": place[1] - place[0]}
    return source, page.data[low:high], nodes


def scan_pages(batches):
    """A row for each page: source, its text once, its elements; ``fetched`` tells whether there was any html."""
    keep = ("company_id", "page_num")
    for whole in batches:
        for batch in (whole.slice(i, _PAGES_PER_BATCH) for i in range(0, whole.num_rows, _PAGES_PER_BATCH)):
            rows = batch.to_pylist()
            source, text, nodes = zip(*map(_scanned, rows))
            fetched = pa.array([r["html"] is not None for r in rows])
            columns = [*(batch.column(c) for c in keep), fetched, pa.array(source), pa.array(text, pa.binary()), pa.array(nodes, pa.list_(_NODE))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "fetched", "source", "page_text", "nodes"])


def unusable(frames):
    """The selectors that cannot be parsed."""
    for frame in frames:
        yield frame[[not _parses(selector) for selector in frame["selector"]]]


def _parses(selector: str) -> bool:
    try:
        parse_selector(selector)
    except ValueError:
        return False
    return True


def _main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    dropped = page.find(", ".join(P.DROPPED_TAGS))
    gone = set()
    for node in dropped:
        gone.update(range(node, page.end[node]))
    main = [n for n in page.find(P.MAIN_SELECTOR) if n not in gone] or page.find("body", first=True)
    if main:
        return page.kept_text(main[0], dropped)
    return page.kept_text(None, dropped + page.find("head, title"))


def main_texts(html):
    """The main content of each page as written, without dropped nodes, breaks marked."""
    return html.map(_main_text)
