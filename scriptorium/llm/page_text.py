"""Flat text blocks of a page and their features: words, link density, shape, and the same of the neighbouring blocks.

Crawled text is flat: most links have lost their marks. The link density of a block is the share of its words inside links where
links are left, else the probability that its words stand in links of a site, learned word by word from the labelled pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence

LINK = re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)")
SPLIT = re.compile(r"\s*[|·/›>»•]\s*|\s{2,}")
ARROW = re.compile(r"^[←«‹]|[→»›↑▾]$")
WORD = re.compile(r"[^\W_]+")
HAN = re.compile(r"[぀-ヿ㐀-鿿]")
HEADING = re.compile(r"^#{1,6}\s+(.*)$")
LIST = re.compile(r"^(?:[-*+•]|\d+[.)])\s+(.*)$")
SENTENCE = re.compile(r"[.!?:;。！？：；…)”\"»]\s*$")
STRIP = "﻿\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ​               　"

#: Order of the features.
FEATURES = (
    "words", "density", "sentence", "list", "marked", "repeats", "arrow", "parts", "run",
    "before_title", "prose_after", "prev_words", "prev_density", "next_words", "next_density",
)
#: Words of a line of a run, the most blocks of prose counted after a block, and the least log-odds of a word (plain words stand in
#: either kind of line, so no word speaks strongly for the article).
SHORT, FAR, FLOOR = 12, 20, -0.5


def count_words(text: str) -> int:
    """Words of a text; two characters of a script without spaces count as one."""
    han = len(HAN.findall(text))
    return len(WORD.findall(HAN.sub(" ", text) if han else text)) + (han + 1) // 2


def anchor_words(text: str) -> set[str]:
    """Words of a block, and pairs of characters of scripts without spaces."""
    lower = text.lower()
    if not HAN.search(lower):
        return set(WORD.findall(lower))
    return set(WORD.findall(HAN.sub(" ", lower))) | {lower[i : i + 2] for i in range(len(lower) - 1) if HAN.match(lower[i]) and HAN.match(lower[i + 1])}


def blocks(text: str) -> list[dict]:
    """The non-blank lines of a page: number, body, shape and words; headings, tables, code and callouts are ``marked``."""
    out, last, fence = [], -1, False
    for number, raw in enumerate(text.split("\n")):
        line = raw.strip(STRIP)
        if not line:
            continue
        marks = line.startswith(("```", "~~~"))
        code = fence or marks
        fence ^= marks
        item = LIST.match(line)
        body = item[1] if item else line
        heading = None if code else HEADING.match(line)
        table = not code and line.startswith("|")
        callout = not code and body.startswith("**")
        out.append({
            "number": number, "body": body, "list": bool(item), "code": code, "heading": bool(heading), "title": heading[1].strip().lower() if heading else None,
            "marked": bool(code or heading or table or callout), "words": count_words(body), "sentence": bool(SENTENCE.search(body)), "apart": number - last > 1,
        })
        last = number
    return out


def learn_anchors(pages: Iterable[tuple[str, Sequence[int]]]) -> dict[str, float]:
    """Log-odds of each word to stand in a line of the site rather than in one of the article, from labelled pages."""
    seen: Counter = Counter()
    total = [0, 0]
    for text, labels in pages:
        for block, label in zip(blocks(text), labels, strict=True):
            if not block["marked"]:
                total[label] += 1
                seen.update((word, label) for word in anchor_words(block["body"]))
    share = lambda word, label: (seen[word, label] + 0.5) / (total[label] + 1)
    return {word: max(FLOOR, math.log(share(word, 1) / share(word, 0))) for word in {word for word, _ in seen}}


def link_density(body: str, anchors: dict[str, float]) -> float:
    """Share of the words inside links where links are left, else the probability that the words stand in links."""
    links = LINK.findall(body)
    if links:
        inside = sum(map(count_words, links)) / max(1, count_words(LINK.sub(r"\1", body)))
        if inside > 0.5:
            return inside
    odds = sum(anchors.get(word, 0.0) for word in anchor_words(body))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def page_features(text: str, anchors: dict[str, float]) -> tuple[list[int], list[tuple[float, ...]]]:
    """Line numbers and features of the non-blank lines of a page."""
    found = blocks(text)
    titles = {b["title"] for b in found if b["title"]}
    title_at = next((i for i, b in enumerate(found) if b["heading"]), 0)
    for i, b in enumerate(found):
        b["density"] = link_density(b["body"], anchors) if not b["marked"] else 0.0
        b["repeats"] = not b["marked"] and b["body"].strip().lower() in titles
        b["arrow"] = bool(ARROW.search(b["body"]))
        b["parts"] = sum(bool(p.strip()) for p in SPLIT.split(b["body"]))
        b["before_title"] = i < title_at
        b["short"] = not b["marked"] and not b["sentence"] and not b["list"] and b["words"] <= SHORT
    # runs of short lines without a blank line between them
    i = 0
    while i < len(found):
        j = i + 1
        while j < len(found) and not found[j]["apart"] and found[j]["short"] == found[i]["short"]:
            j += 1
        for b in found[i:j]:
            b["run"] = j - i if b["short"] else 0
        i = j
    after = 0
    for b in reversed(found):
        b["prose_after"] = min(after, FAR)
        after += b["marked"] or b["words"] >= 8 and b["sentence"] and b["density"] < 0.5
    out = []
    none = {"words": 0, "density": 0.0}
    for i, b in enumerate(found):
        before, behind = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        out.append((*(float(b[name]) for name in FEATURES[:11]), float(before["words"]), before["density"], float(behind["words"]), behind["density"]))
    return [b["number"] for b in found], out
