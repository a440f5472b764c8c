"""Small HTML helper used inside tasks: a tolerant tree and the CSS selectors site configs use."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
)
# start tag -> (open tags it ends, tags the search stops at)
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDERS = _BLOCKS - {"body", "dd", "dt", "li", "tr", "figcaption"}
#: What stands for breaks among the text pieces.
LINE, BLOCK, PARAGRAPH = "\x00", "\x01", "\x02"


class Page(HTMLParser):
    """Nodes in document order; node ``i`` holds the nodes ``i+1 .. end[i]-1`` and its text pieces."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end, self.span = [], [], [], [], []
        self.pieces, self._stack, self._open = [], [], Counter()
        # marked sections are no part of HTML: like browsers, take them for comments
        self.feed(html.replace("<![", "<! ["))
        self.close()
        self._pop_to(0)
        written = [b"" if p in (LINE, BLOCK, PARAGRAPH) else p.encode() for p in self.pieces]
        # all text of the page, as written
        self.data, self._offsets = b"".join(written), [0, *accumulate(map(len, written))]

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            node = self._stack.pop()
            self._open[self.tag[node]] -= 1
            self._mark(self.tag[node])
            self.end[node] = len(self.tag)
            self.span[node][1] = len(self.pieces)

    def _mark(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.pieces.append(PARAGRAPH if tag == "p" else BLOCK)

    def _depth_of(self, wanted, stops) -> int | None:
        if not any(self._open[tag] for tag in wanted):
            return None  # spares pages with thousands of unclosed tags the walk
        for depth in range(len(self._stack) - 1, -1, -1):
            tag = self.tag[self._stack[depth]]
            if tag in wanted:
                return depth
            if tag in stops:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        rule = _ENDS.get(tag) or (({"p"}, {"td", "th", "button"}) if tag in _P_ENDERS else None)
        if rule:
            depth = self._depth_of(*rule)
            if depth is not None:
                self._pop_to(depth)
        self.tag.append(tag)
        values = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        self.attrs.append(values)
        self.parent.append(self._stack[-1] if self._stack else -1)
        self.end.append(len(self.tag))
        if tag == "br":
            self.pieces.append(LINE)
        self._mark(tag)
        self.span.append([len(self.pieces), len(self.pieces)])
        if tag not in _VOID:
            self._stack.append(len(self.tag) - 1)
            self._open[tag] += 1

    def handle_endtag(self, tag):
        depth = self._depth_of({tag}, ())
        if depth is not None:
            self._pop_to(depth)

    def handle_data(self, data):
        self.pieces.append(data)

    def place(self, node: int) -> tuple[int, int]:
        """Where the text below a node starts and ends in ``data``."""
        first, last = self.span[node]
        return self._offsets[first], self._offsets[last]

    def kept_text(self, node: int | None, dropped: list[int]) -> str:
        """Text below a node, or all of it, with its breaks and without dropped nodes."""
        first, last = self.span[node] if node is not None else (0, len(self.pieces))
        kept, at = [], first
        # a dropped block takes the line break before it along
        for lo, hi in sorted((self.span[d][0] - (self.tag[d] in _BLOCKS), self.span[d][1]) for d in dropped):
            if hi > at and lo < last:
                kept += self.pieces[at:max(lo, at)]
                at = max(at, hi)
        return "".join(kept + self.pieces[at:last])

    def find(self, selector: str, inside: int | None = None, first: bool = False) -> list[int]:
        """Nodes matching a selector list in document order, below one node or in the whole page."""
        choices = parse_selector(selector)
        lo, hi = (0, len(self.tag)) if inside is None else (inside + 1, self.end[inside])
        found = []
        for node in range(lo, hi):
            if any(self._matches(node, steps, len(steps) - 1) for steps in choices):
                found.append(node)
                if first:
                    break
        return found

    def _matches(self, node: int, steps, at: int) -> bool:
        link, tag, tests = steps[at]
        if tag and self.tag[node] != tag:
            return False
        values = self.attrs[node]
        if not all(test(values) for test in tests):
            return False
        if at == 0:
            return True
        up = self.parent[node]
        while up >= 0:
            if self._matches(up, steps, at - 1):
                return True
            if link == ">":
                return False
            up = self.parent[up]
        return False


_SIMPLE = re.compile(
    r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
      |\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]""",
    re.X,
)
_COMPOUND = re.compile(rf"\s*(?P<link>>)?\s*(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:{_SIMPLE.pattern})*)", re.X)
_OPS = {
    "=": lambda have, want: have == want,
    "*=": lambda have, want: want != "" and want in have,
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def _test(m: re.Match):
    if m["cls"]:
        return lambda values, c=m["cls"]: c in values.get("class", "").split()
    if m["id"]:
        return lambda values, i=m["id"]: values.get("id") == i
    name, op = m["name"].lower(), m["op"]
    if not op:
        return lambda values: name in values
    want = next(v for v in (m["dq"], m["sq"], m["bare"]) if v is not None)
    return lambda values, f=_OPS[op]: name in values and f(values[name], want)


@lru_cache(maxsize=4096)
def parse_selector(selector: str):
    """Alternatives of a selector list, each a tuple of (link to the step before, tag, attribute tests)."""
    choices = []
    for part in re.split(r",(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", selector):
        steps, at, part = [], 0, part.strip()
        while at < len(part):
            m = _COMPOUND.match(part, at)
            if not m or m.end() == at or not (m["tag"] or m["rest"]):
                raise ValueError(f"unsupported selector: {selector!r}")
            tag = None if m["tag"] in (None, "*") else m["tag"].lower()
            steps.append((m["link"], tag, tuple(_test(s) for s in _SIMPLE.finditer(m["rest"]))))
            at = m.end()
        if not steps:
            raise ValueError(f"empty selector: {selector!r}")
        choices.append(tuple(steps))
    return tuple(choices)
