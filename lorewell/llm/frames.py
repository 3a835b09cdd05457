"""Labels of page-frame lines for the labeller's training, from recurrence over the pages of a sample.

No wording is given: what belongs to a frame is told by how it recurs. A line recurs if it is on
several distinct pages with its numbers masked. Recurring lines that reach a page's first or last
line without a break are frame; so are those that interrupt the text after lines of no fixed kind
(code that recurs always follows the same kind of line). Menus are made of entries that are frame
lines themselves, breadcrumbs begin with one, and lists of other pages follow lines that titles
mostly follow.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import regex

#: Distinct pages that a line must be on to recur.
LEAST_PAGES = 3

#: A block of recurring lines inside a page is frame if fewer than this share of its places follow one kind of line.
SAME_BEFORE = 0.5

#: Share of a heading's places that titles must follow, and share of a line's word pairs that must be a frame's.
TITLES_AFTER, PAIRS = 0.6, 0.7

#: Entries of a list that are labelled as frame; title-like lines after them are left to the labeller.
SURE_ENTRIES = 5

FRAME, BODY, UNSURE = 1, 0, -1

# numbers by themselves; those within names tell lines apart
_DIGITS = regex.compile(r"(?<![A-Za-z\p{N}_])\p{N}+(?![A-Za-z\p{N}_])")
_IDENT = regex.compile(r"\b[\p{L}\d]*_[\p{L}\d_]*\b")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{N}]")
_TEASER = regex.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\])\s*$")
_SENTENCE = regex.compile(r"[.!?。！？()]\s*$|^\s*[-*•#\d]|[;；:：=<>{}]|0x")
_SEPARATORS = regex.compile(r"\s*[|｜·•>»/›,]\s*|\s+[–-]\s+")


def key(line: str) -> str:
    return _DIGITS.sub("0", line.strip().lower())


def _kind(line: str) -> str:
    """The line without what names something: identifiers and numbers masked."""
    return _DIGITS.sub("0", _IDENT.sub("ident", line.strip().lower()))


def _title_like(line: str) -> bool:
    s = line.strip()
    return len(s) <= 70 and not _SENTENCE.search(s) and not _TEASER.search(s)


def _pairs(line: str) -> set[tuple[str, str]]:
    w = _WORD.findall(_kind(line))
    return set(zip(w, w[1:], strict=False))


def frame_keys(pages: list[list[str]]) -> set[str]:
    """Keys of the recurring lines that are frame. A page's lines are its non-blank ones; equal pages count once."""
    distinct = list({"\n".join(p): p for p in pages}.values())
    on: dict[str, set[int]] = defaultdict(set)
    keys = [[key(line) for line in p] for p in distinct]
    for n, ks in enumerate(keys):
        for k in ks:
            on[k].add(n)
    recurs = {k for k, at in on.items() if len(at) >= LEAST_PAGES}
    edge, places = Counter(), Counter()
    before: dict[str, Counter] = defaultdict(Counter)
    for ks, page in zip(keys, distinct, strict=True):
        yes = [k in recurs for k in ks]
        top = next((i for i, y in enumerate(yes) if not y), len(ks))
        bottom = next((len(ks) - i for i, y in enumerate(reversed(yes)) if not y), 0)
        start = 0
        for i, k in enumerate(ks):
            if not yes[i]:
                start = i + 1
                continue
            places[k] += 1
            edge[k] += i < top or i >= bottom
            before[k][_kind(page[start - 1]) if start else ""] += 1
    return {k for k in recurs if edge[k] or max(before[k].values()) < SAME_BEFORE * places[k]}


def label_pages(pages: list[list[str]]) -> list[list[int]]:
    """FRAME, BODY or UNSURE for every line of every page (non-blank lines)."""
    frame = frame_keys(pages)
    entries = {e for k in frame for e in ({k} | set(_SEPARATORS.split(k))) if 0 < len(e) <= 30 and not _SENTENCE.search(e)}
    entry = "(?:" + "|".join(map(regex.escape, sorted(entries, key=lambda e: (-len(e), e)))) + ")" if entries else "(?!)"
    menu = regex.compile(rf"{entry}(?:\s*[|｜·•>»/,–-]?\s*{entry})+")
    crumbs = regex.compile(rf"{entry}(?:\s*[|｜·•]\s*{entry})*(?:\s*[>»/›]\s*[^>»/›]{{1,80}})+")
    frame_pairs, body_pairs = Counter(), Counter()
    for k in {key(line) for p in pages for line in p}:
        for g in _pairs(k):
            (frame_pairs if k in frame else body_pairs)[g] += 1

    def like_frame(line: str) -> bool:
        pairs = _pairs(line)
        return len(pairs) >= 3 and sum(frame_pairs[g] >= 2 and frame_pairs[g] * 4 >= body_pairs[g] for g in pairs) >= PAIRS * len(pairs)

    known: dict[str, bool] = {}

    def is_frame(line: str) -> bool:
        k = key(line)
        if k not in known:
            known[k] = k in frame or menu.fullmatch(k) is not None or crumbs.fullmatch(k) is not None or like_frame(line)
        return known[k]

    def title(p: list[str], i: int) -> bool:
        return i < len(p) and _title_like(p[i]) and not is_frame(p[i])

    def width(p: list[str], i: int) -> int:
        """Lines of the entry that begins at i: a title and a teaser, a title, or none."""
        return 0 if not title(p, i) else 2 if i + 1 < len(p) and _TEASER.search(p[i + 1]) else 1

    follows, places = Counter(), Counter()
    for p in pages:
        for i, line in enumerate(p):
            if key(line) in frame and _title_like(line):
                w = width(p, i + 1)
                follows[key(line)] += w == 2 or w == 1 and width(p, i + 2) == 1
                places[key(line)] += 1
    headings = {k for k in follows if follows[k] >= LEAST_PAGES and follows[k] >= TITLES_AFTER * places[k]}

    out = []
    for p in pages:
        y, i = [BODY] * len(p), 0
        while i < len(p):
            if not is_frame(p[i]):
                i += 1
                continue
            y[i] = FRAME
            k = key(p[i])
            i += 1
            if k not in headings:
                continue
            w, n = width(p, i), 0
            # a title without a teaser after entries with teasers is a heading of the body
            while w and width(p, i) == w:
                y[i : i + w] = [FRAME if n < SURE_ENTRIES else UNSURE] * w
                i, n = i + w, n + 1
        out.append(y)
    return out
