"""Main text of web pages by two-pass block rules.

Pass one splits a page into blocks at block-level tags and classifies each by stop-word density, length and link density,
within what the page's own containers say (navigation, footers, forms and the like are never text; an article's
blocks are text unless they are link lists). Pass two gives ambiguous short blocks the label of the nearest decided
neighbours, inside the same article if they are in one.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Stop words by language.
STOP_WORDS = {
    "en": "a about all also an and any are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so some that the their there they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais même ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur te tout un une vous y",
    "es": "a al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya yo",
}
_STOP = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.15
LINK_HIGH, LINK_ARTICLE = 0.2, 0.5

_DROP = "script|style|noscript|template|svg|math|canvas|iframe|object|audio|video|select|textarea|head"
_GONE = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|<[/a-zA-Z][^<>]*\Z|<({_DROP})\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"\b(class|id|role|lang|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav footer aside form menu dialog button fieldset".split())
_TEXT = frozenset("article main".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BAD_NAME = re.compile(
    r"^(?:ads?|adverts?|advertisements?|advertising|adsense|banner|breadcrumbs?|byline-share|captcha|comments?|commentlist|consent|cookies?|copyright|disqus|donate|dropdown|feedback|footer|gdpr|header|login|masthead|menu|message-bar|meta-nav|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|pager|pagination|paywall|popup|popular|promo|promoted|promotion|related|recommended|recommendations|replies|reply|respond|search|share|sharing|shares|sidebar|signup|site-header|site-footer|social|sponsor|sponsored|subscribe|subscription|tags|teaser|toolbar|topbar|trending|widget|widgets)(?:$|[-_]|\d)"
    r"|(?:^|[-_])(?:ads?|advert|comments?|cookie|footer|sidebar|menu|nav|navbar|navigation|notice|newsletter|popup|promo|related|share|social|sponsor|sponsored|subscribe|widget)$",
    re.I,
)
_TEXT_NAME = re.compile(r"^(?:article|article[-_]?(?:body|content|text)|post[-_]?(?:body|content|text)|entry[-_]?(?:content|body)|story[-_]?(?:body|content)|main[-_]?content|content[-_]?(?:body|main))$", re.I)
_LETTER = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("links", "region", "state", "text")

    def __init__(self, text: str, links: int, state: str | None, region: int):
        self.text, self.links, self.state, self.region = text, links, state, region


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): next((x for x in m.groups()[1:4] if x is not None), "") for m in _ATTR.finditer(raw)} if raw and raw.strip(" /") else {}


def _says(tag: str, attr: dict[str, str], inside: str | None) -> str | None:
    """What a container says about its blocks: bad, text or nothing."""
    if "hidden" in attr or attr.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attr.get("style", ""), re.I):
        return "bad"
    if tag in _NEVER or (tag == "header" and inside != "text"):
        return "bad"
    if tag in _TEXT or attr.get("role", "").lower() in ("main", "article"):
        return None if inside == "bad" else "text"
    if attr.get("role", "").lower() in _BAD_ROLES:
        return "bad"
    if tag in ("html", "body"):
        return None
    names = f"{attr.get('class', '')} {attr.get('id', '')}".split()
    if any(_BAD_NAME.search(n) for n in names):
        return "bad"
    return "text" if inside is None and any(_TEXT_NAME.match(n) for n in names) else None


def blocks(page: str) -> tuple[list[_Block], str | None]:
    """Blocks of a page in order with what their containers say, and the page's language if it names one."""
    page = _GONE.sub(lambda m: "<hr>" if m[1] else "", page)
    out: list[_Block] = []
    stack: list[tuple[str, str | None, int]] = []  # tag, state inside, region
    words: list[str] = []
    linked: list[int] = []
    link, regions, lang = 0, 0, None
    at = 0

    def flush():
        nonlocal link
        text = " ".join(_html.unescape("".join(words)).split())
        if text:
            state, region = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
            out.append(_Block(text, min(sum(linked), len(text)), state, region))
        words.clear()
        linked.clear()

    def say(text):
        words.append(text)
        if link:
            linked.append(len(" ".join(_html.unescape(text).split())))

    for m in _TAG.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        end, tag, raw = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if tag == "a":
            link = 0 if end else 1
            continue
        if tag == "br":
            if words and words[-1] == "\n":
                flush()
            else:
                words.append("\n")
            continue
        if tag in ("td", "th"):
            words.append(" ")
            continue
        if tag not in _BLOCK:
            continue
        flush()
        link = 0
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag in ("p", "li", "dd", "dt"):
                    break
            continue
        if tag in _VOID:
            continue
        if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and stack[-1][0][0] == tag[0]:
            stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "dd", "dt", "tr", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        inside, region = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
        attr = _attributes(raw)
        if tag == "html" and attr.get("lang"):
            lang = attr["lang"].lower()[:2]
        state = inside if inside == "bad" else _says(tag, attr, inside) or inside
        if state == "text" and inside != "text":
            regions += 1
            region = regions
        if not raw.rstrip().endswith("/") or tag in _BLOCK:
            stack.append((tag, state, region))
    if at < len(page):
        say(page[at:])
    flush()
    return out, lang


def _density(text: str, stop: frozenset) -> float:
    words = _LETTER.findall(text.lower())
    return sum(w in stop for w in words) / len(words) if words else 0.0


def _neighbours(labels: list[str], regions: list[int], voters: list[bool]):
    """The nearest decided block (label, place) before and behind each block, within its region."""
    sides = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        side: list[tuple[str, int] | None] = [None] * len(labels)
        last: dict[int, tuple[str, int]] = {}
        for i in order:
            side[i] = last.get(regions[i])
            if voters[i] and labels[i] in ("good", "bad"):
                last[regions[i]] = (labels[i], i)
        sides.append(side)
    return sides


def extract(page: str | None) -> str:
    """The main text: its blocks in page order, joined by line feeds; white space inside a block is one space."""
    if not page:
        return ""
    found, lang = blocks(page)
    if not found:
        return ""
    stop = _STOP.get(lang or "")
    if stop is None:
        sample = [b for b in found if b.state != "bad"]
        stop = max(_STOP.values(), key=lambda s: sum(_density(b.text, s) * len(b.text) for b in sample))
    labels: list[str] = []
    for b in found:
        links, n = b.links / len(b.text), len(b.text)
        if b.state == "bad":
            labels.append("bad")
        elif b.state == "text":
            labels.append("bad" if links > LINK_ARTICLE else "good" if n >= LENGTH_LOW or _density(b.text, stop) >= STOP_HIGH else "short")
        elif links > LINK_HIGH:
            labels.append("bad")
        elif n < LENGTH_LOW:
            labels.append("bad" if b.links else "short")
        else:
            d = _density(b.text, stop)
            labels.append(("good" if n > LENGTH_HIGH else "near") if d >= STOP_HIGH else "near" if d >= STOP_LOW else "low")
    # Pass two. Blocks of navigation and the like have no say. Near-text is text unless decided blocks on both sides
    # aren't, text of few stop words only if those on both sides are; then short blocks follow the nearest decided block,
    # and are text where there is none: in an article, or on a page without any decided text.
    regions = [b.region for b in found]
    voters = [b.state != "bad" for b in found]
    before, behind = _neighbours(labels, regions, voters)
    both = lambda a, b, label: bool(a and b and a[0] == b[0] == label)
    labels = [("bad" if both(a, b, "bad") else "good") if x == "near" else x for x, a, b in zip(labels, before, behind)]
    before, behind = _neighbours(labels, regions, voters)
    labels = [("good" if both(a, b, "good") else "bad") if x == "low" else x for x, a, b in zip(labels, before, behind)]
    before, behind = _neighbours(labels, regions, voters)
    final = []
    for i, label in enumerate(labels):
        if label == "short":
            near = [x for x in (before[i], behind[i]) if x]
            label = min(near, key=lambda x: (abs(x[1] - i), x[0] != "good"))[0] if near else "good" if regions[i] or "good" not in labels else "bad"
        final.append(label)
    return "\n".join(b.text for b, label in zip(found, final) if label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row. Null and empty html give an empty text. Repeated rows each come back."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([extract(h) for h in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
