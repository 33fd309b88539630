"""Personal data by a semi-Markov conditional random field.

Fixed patterns with their checks give the plain findings. The field then looks
at the stretches of text with digits or an at-sign, spelt out or not: it scores whole segments
of up to ``LONGEST`` tokens by features of the span (digit groups, separators,
checksums, neighbours), and a dynamic program over segments of bounded length
chooses boundaries and types jointly. What it chooses beside the plain
findings is added to them.

The weights are learned by conditional likelihood from the plain findings of a
sample of documents, bounded by ``sample``, and from rewritten copies of them:
numbers without their plus sign, other separators, spelt-out at-signs, and
spoilt copies (wrong check digit, too large a part) as counter-examples.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import documents, find_spans

KINDS = ("email", "ip", "card", "phone")

# The plain patterns. A match can only start where a run of
# digits starts, which the look-behind says at once.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A stretch the field looks at, its tokens, and the most tokens of a segment.
#: It starts at a word with either, or at one before a spelt-out at-sign and a domain.
SPELT = r"(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:\.|\x20dot\x20)[A-Za-z]"
STRETCH = re.compile(rf"(?<!\S)(?:\S+{SPELT}\S*|\S*[0-9@]\S*)(?:\x20\S*[0-9@(]\S*|\x20(?:at|dot)\x20\S+)*")
NUMERIC = re.compile(rf"[0-9@]|{SPELT}")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
LONGEST = 20
#: Tokens of a stretch that are decoded at once; longer ones go on behind the last chosen segment.
BLOCK = 400


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def plain(text: str) -> list[tuple[str, int, int]]:
    """The findings of the fixed patterns, by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_LOCAL.match(text, start) if start < at else None
        if m:
            out.append(("email", *m.span()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(_small(x) for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# -- whole-span features ------------------------------------------------------

FEATURES = (
    "bias", "one at", "spelt at", "dotted domain", "letters last", "four groups", "parts small",
    "dots only", "digits 7-9", "digits 10-12", "digits 13-19", "other count", "checksum", "fours",
    "three-four", "brackets", "country", "hyphens or blanks", "odd character", "letters", "tied left",
    "tied right",
)
_SEPARATORS = frozenset(" .-()+")


def span_features(text: str, start: int, stop: int) -> np.ndarray | None:
    """Features of a whole segment; None if nothing personal can look like it."""
    span = text[start:stop]
    first, last = span[0], span[-1]
    spelt = " at " in span or "[at]" in span or "(at)" in span
    digits = "".join(x for x in span if "0" <= x <= "9")
    if not (first.isalnum() or first in "+(") or not last.isalnum():
        return None
    if "@" not in span and not spelt and len(digits) < 4:
        return None
    groups = re.findall(r"[0-9]+", span)
    between = {x for x in span if not x.isalnum()}
    letters = any(x.isalpha() for x in span)
    domain = re.split(r"@| at |\[at\]|\(at\)", span)[-1]
    sizes = [len(x) for x in groups]
    n = len(digits)
    left = text[start - 1] if start else " "
    right = text[stop] if stop < len(text) else " "
    then = text[stop + 1] if stop + 1 < len(text) else " "
    return np.array(
        [
            1,
            span.count("@") == 1 and " " not in span,
            spelt and "@" not in span and span.count(" ") <= 6,
            "." in domain or " dot " in domain,
            last.isalpha(),
            len(groups) == 4 and not letters,
            all(_small(x) for x in groups),
            between == {"."},
            7 <= n <= 9,
            10 <= n <= 12,
            13 <= n <= 19,
            n < 7 or n > 19,
            n >= 13 and luhn(digits),
            len(sizes) > 1 and all(x == 4 for x in sizes[:-1]),
            sizes[-2:] == [3, 4],
            "(" in span and ")" in span and span.index("(") < span.index(")"),
            first in "+(" or (len(sizes) > 1 and sizes[0] <= 2),
            bool(between) and between <= set(" -"),
            bool(between - _SEPARATORS - {"@", "_", "%", "[", "]"}),
            letters,
            left.isalnum() or left in "@+_" or (left in ".-" and start > 1 and text[start - 2].isalnum()),
            right.isalnum() or right in "@_" or (right in ".-" and then.isalnum()),
        ],
        float,
    )


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """First token, token behind the last, and features of every segment that may be an entity."""
    out = []
    for i, (start, _) in enumerate(tokens):
        head = text[start]
        if not (head.isalnum() or head in "+("):
            continue
        for j in range(i, min(len(tokens), i + LONGEST)):
            if text[tokens[j][1] - 1].isalnum():
                x = span_features(text, start, tokens[j][1])
                if x is not None:
                    out.append((i, j + 1, x))
    return out


def viterbi(n: int, segments: list[tuple[int, int, np.ndarray]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """First token, token behind the last, and type of the best segmentation; other tokens score 0."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    by_stop: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for s in segments:
        by_stop.setdefault(s[1], []).append(s)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for i, _, x in by_stop.get(t, ()):
            scores = weights @ x
            k = int(scores.argmax())
            if best[i] + scores[k] > best[t]:
                best[t], back[t] = best[i] + scores[k], (i, t, k)
    out, t = [], n
    while t > 0:
        if back[t] is None:
            t -= 1
        else:
            out.append(back[t])
            t = back[t][0]
    return out[::-1]


def decode(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The segments that the field chooses in a whole text."""
    out = []
    for m in STRETCH.finditer(text):
        tokens = [(m.start() + x.start(), m.start() + x.end()) for x in TOKEN.finditer(m[0])]
        at = 0
        while at < len(tokens):
            block = tokens[at : at + BLOCK]
            chosen = viterbi(len(block), candidates(text, block), weights)
            more = at + BLOCK < len(tokens)
            # A segment near the end of a block may go on behind it: decide it with the next block.
            kept = [x for x in chosen if not more or x[1] <= BLOCK - LONGEST]
            out += [(KINDS[k], block[i][0], block[j - 1][1]) for i, j, k in kept]
            at += max(BLOCK - 2 * LONGEST, kept[-1][1] if kept else 0) if more else BLOCK
    return out


# -- learning -----------------------------------------------------------------


def rewritten(kind: str, span: str) -> list[tuple[str, bool]]:
    """Other spellings of a finding (true) and spoilt copies (false)."""
    digits = "".join(x for x in span if x.isdigit())
    if kind == "phone":
        body = re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", span) if len(digits) > 9 else span[1:]
        dashed = f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"
        return [(body, len(digits) >= 10), (dashed, len(digits) >= 10), (digits[-8:], False), (digits[-10:], False)]
    if kind == "card":
        spoilt = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [(".".join(fours), True), (spoilt, False), (" ".join(spoilt[i : i + 4] for i in range(0, len(spoilt), 4)), False)]
    if kind == "ip":
        parts = span.split(".")
        return [(".".join(["999", *parts[1:]]), False), (".".join(parts[:3]), False), ("-".join(parts), False)]
    local, _, domain = span.partition("@")
    return [
        (f"{local} at {domain.replace('.', ' dot ')}", True),
        (f"{local}[at]{domain}", True),
        (domain, False),
        (f"{local} {domain}", False),
    ]


def examples(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Stretches around plain findings, and rewritten ones, with the spans to be found in them."""
    out = []
    spans = plain(text)
    for kind, a, b in spans:
        before, behind = text[max(0, a - 12) : a], text[b : b + 12]
        near = [(k, x - a + len(before), y - a + len(before)) for k, x, y in spans if x >= a - len(before) and y <= b + len(behind)]
        out.append((before + text[a:b] + behind, near))
        for other, right in rewritten(kind, text[a:b]):
            at = len(before.rstrip("0123456789+@.-_%("))
            head, tail = before[:at] + " ", " " + behind.lstrip("0123456789@.-_%)")
            out.append((head + other + tail, [(kind, len(head), len(head) + len(other))] if right else []))
    return out


def _fit(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60) -> np.ndarray:
    """Conditional likelihood by gradient ascent; sums over segmentations by forward and backward passes."""
    data = []
    for text, spans in rows:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        at = {a: i for i, (a, _) in enumerate(tokens)} | {len(text): len(tokens)}
        ends = {b: i + 1 for i, (_, b) in enumerate(tokens)}
        segments = candidates(text, tokens)
        place = {(i, j): n for n, (i, j, _) in enumerate(segments)}
        gold = []
        for kind, a, b in spans:
            n = place.get((at.get(a), ends.get(b)))
            if n is not None:
                gold.append((n, KINDS.index(kind)))
        if segments:
            data.append((len(tokens), [(i, j) for i, j, _ in segments], np.array([x for *_, x in segments]), gold))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -2
    step, squares = 0.5, np.full_like(weights, 1e-6)
    for _ in range(rounds):
        gradient = -0.05 * weights
        for n, places, x, gold in data:
            scores = x @ weights.T
            total = np.log(np.exp(scores).sum(1))
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0
            by_stop: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for s, (i, j) in enumerate(places):
                by_stop.setdefault(j, []).append(s)
                by_start.setdefault(i, []).append(s)
            for t in range(1, n + 1):
                ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[places[s][0]] + total[s] for s in by_stop.get(t, ()))])
            for t in range(n - 1, -1, -1):
                behind[t] = np.logaddexp.reduce([behind[t + 1], *(behind[places[s][1]] + total[s] for s in by_start.get(t, ()))])
            mass = np.array([ahead[i] + behind[j] for i, j in places])[:, None] + scores - ahead[n]
            gradient -= np.exp(np.minimum(mass, 0)).T @ x
            for s, k in gold:
                gradient[k] += x[s]
        squares += gradient**2
        weights += step * gradient / np.sqrt(squares)
    return weights


def train(docs: DataFrame, sample: int = 60) -> np.ndarray:
    """Weights by type and feature from at most ``sample`` findings of each kind.

    The documents are taken by the hash of their text, those of up to 10,000
    characters. Without any finding the weights choose nothing.
    """
    shapes = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "phone": r"\+[0-9]"}
    short = documents(docs).select("text", F.xxhash64("text").alias("dealt")).where(F.length("text") <= 10_000)
    found: dict[str, list[str]] = {}
    for kind, shape in shapes.items():
        rows = short.where(F.col("text").rlike(shape)).orderBy("dealt", "text").limit(sample).collect()
        found[kind] = list(dict.fromkeys(r.text for r in rows))
    picked = []
    for kind, texts in found.items():
        n = 0
        for text in texts:
            for spans in examples(text):
                if n < 8 * sample and (not spans[1] or any(k == kind for k, *_ in spans[1])):
                    picked.append(spans)
                    n += 1
    return _fit(picked)


def finder(weights: np.ndarray) -> Callable[[str], list[tuple[str, int, int, bool]]]:
    """The plain findings and those of the field that overlap none of them, by kind, then start."""

    def find(text: str) -> list[tuple[str, int, int, bool]]:
        if not NUMERIC.search(text):
            return []
        base = plain(text)
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        out = [(*x, True) for x in base]
        for kind, a, b in decode(text, weights):
            n = int(np.searchsorted(starts, b))
            if not n or reach[n - 1] <= a:
                out.append((kind, a, b, False))
        return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))

    return find


def scan(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` of every row; weights are learned if not given.

    Spans have kind, start, stop (code points, stop exclusive) and plain. A null text
    is the empty one and has no spans. Repeated rows and rows without an id
    each give a row. Other columns are not read.
    """
    return find_spans(docs, finder(train(docs) if weights is None else weights))
