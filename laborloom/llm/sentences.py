"""Sentence boundaries across languages and scripts: candidates, classified by a maximum-entropy model.

Every end mark, line break and (in Thai) space is a candidate. The model's features are the tokens around it, their
case, length, digits and script, the mark and the line's shape. It is trained on boundaries of the same corpus that
its structure makes reliable, whatever the features say: paragraph ends, read together with the next paragraph's start,
against marks within numbers and addresses or before small letters, after short forms that are known or that
collocation finds, and breaks of lines that are full. Marks before capitals in the middle of a paragraph and breaks of
short lines are ambiguous and never labelled; the model decides on them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, parts_for, scanned, table

#: Bounds of the sample that the classifier is trained on: documents, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 3_000, 20_000

# Short forms that always go with what follows, and such as may also end a sentence.
BINDING = frozenset(
    "dr mr mrs ms st prof rev hon gen col sgt capt lt mme mlle mm m sra srta dra fr hr frau no nos nr núm num art abs sec fig eq ch vol p pp pág pag pg ext wk approx aprox env ca vs "
    "z z.b d d.h u u.a i.d o.g s.o bzw vgl evtl ggf inkl bspw e.g i.e cf ee jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun डॉ श्री د".split()
)
ENDING = frozenset("a.m p.m am pm inc co corp ltd llc l.l.c jr sr etc u.s u.k ee.uu usw ave blvd bros dept univ est".split())
# Words before an ordinal in German, and words of speech in scripts without capitals.
ORDINAL = frozenset("am im der dem den des vom zum bis ab seit die das zur beim".split())
SPEECH = re.compile(r"^[^。！？।.]{0,24}?(?:问|说|道|答|写|喊|と|कहा|पूछा|बोल|बताया|قال|سأل)")

_MARK = re.compile(r"[.!?…。！？｡।؟۔]+")
_ITEM = re.compile(r"(?:[-*•–‣·▪◦]|(\d{1,2})[.)]|[a-zA-Z][)])[ \t ]+(?=\S)")
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》"}
_CLOSERS = "”“»」』）)]】》\"'’'"
_BLANK = re.compile(r"\n[ \t\r ]*(?:\n[ \t\r ]*)+|[ \x0c]+")
_GLUED = re.compile(r".*[^\W\d_]{3}[.!?]+(?=[^\W\d_])")
_BRACKETS = frozenset("（([【")
_PAIRED = re.compile("[" + re.escape("".join({*_OPEN, *_OPEN.values(), '"'})) + "]")
_LEFT = re.compile(r'[\s"“„«(（\[「,;:!?]')
_SPACES = re.compile(r"\s*")
_LINE = re.compile(r"[^\n]+")
_ENDED = re.compile(r"[.!?…。！？｡।؟۔]['\"”“»」』）)\]’]*$")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[  \n]+(?=[ก-ะาเ-ไ])")
_DOTTED = re.compile(r"[^\W\d_]\.[^\W\d_]")


class _Remembered(dict):
    """A function of one character, each character computed once."""

    def __init__(self, f) -> None:
        self.f = f

    def __missing__(self, ch: str) -> str:
        value = self[ch] = self.f(ch)
        return value


def _script(ch: str) -> str:
    """A letter's script, as far as it matters here: cased, thai, han (with kana and hangul), other, or none."""
    if not ch or not ch.isalpha():
        return "none"
    if ch.lower() != ch.upper():
        return "cased"
    o = ord(ch)
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    return "han" if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF else "other"


def _kind(ch: str) -> str:
    """A character's kind as the first of what may be a sentence."""
    if not ch:
        return "end"
    if ch.isdigit():
        return "digit"
    if ch in "¿¡":
        return "upper"
    if ch in _OPEN or ch == '"':
        return "open"
    if ch.isalpha():
        s = _script(ch)
        return ("upper" if ch.isupper() or ch.istitle() else "lower") if s == "cased" else s
    return "emoji" if unicodedata.category(ch) in ("So", "Sk") else "mark"


SCRIPT, KIND = _Remembered(_script), _Remembered(_kind)


def pairs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a bracket) of the quotations and brackets of a paragraph whose both ends are there."""
    stack: list[tuple[str, int, str]] = []
    out: list[tuple[int, int, bool]] = []
    for m in _PAIRED.finditer(text):
        i, ch = m.start(), m[0]
        if stack and any(ch == s[0] for s in stack[-3:]):
            while stack[-1][0] != ch:
                stack.pop()
            _, at, opener = stack.pop()
            out.append((at, i, opener in _BRACKETS))
        elif ch == '"':
            if i + 1 < len(text) and not text[i + 1].isspace():
                stack.append(('"', i, ch))
        elif ch in _OPEN:
            stack.append((_OPEN[ch], i, ch))
            if ch == "„" and "”" in text[i : i + 400] and "“" not in text[i : i + 400]:
                stack[-1] = ("”", i, ch)
    return out


class Sweep:
    """The pairs around each of rising positions, the innermost last."""

    def __init__(self, spans: list[tuple[int, int, bool]]) -> None:
        self.rest = sorted(spans, reverse=True)
        self.open: list[tuple[int, int, bool]] = []

    def at(self, i: int) -> list[tuple[int, int, bool]]:
        while self.rest and self.rest[-1][0] < i:
            self.open.append(self.rest.pop())
        self.open = [s for s in self.open if s[1] > i]
        return self.open


def left_token(text: str, i: int) -> str:
    """What stands before text[i] up to white space or a bracket, inner full stops kept, in small letters."""
    part = text[i - 24 if i > 24 else 0 : i]
    token = part.rsplit(None, 1)[-1] if part and not part[-1].isspace() else ""
    if token.isalnum():
        return token.lower()
    token = _LEFT.split(token)[-1].lower()
    if "." in token or "!" in token or "?" in token:
        glued = _GLUED.match(token)  # a missing space after a full stop
        return token[glued.end() :] if glued else token
    return token


def at_mark(text: str, i: int, j: int) -> tuple:
    """What the features are made of at the end marks text[i:j] with what follows at j."""
    marks = text[i:j].rstrip(_CLOSERS) or text[i]
    core = text[i]
    end = _SPACES.match(text, j).end()
    token = left_token(text, i)
    bare = token.strip(".'’")
    before = text[i - 1] if i else ""
    previous = ""
    if token and (len(bare) <= 5 or bare[-1:].isdigit()):
        previous = left_token(text, max(i - len(token) - 1, 0)).rstrip()
        if previous + bare in BINDING or previous + bare in ENDING or _DOTTED.fullmatch(previous + bare):
            bare = previous + bare  # such as z. B. or p. m.
    first = text[end : end + 1]
    k = KIND[first]
    if k == "open":
        inner = text[end + 1 : end + 3].lstrip("¿¡  ")
        k = "open_" + KIND[inner[:1]]
    if core == ".":
        mark = "ellipsis" if len(marks) > 1 and not marks.strip(".…") else "stop"
    elif core == "…":
        mark = "ellipsis" if not marks.strip(".…") else "call"
    else:
        mark = "sure" if core in "。｡।۔" else "call"
    n = len(bare)
    size = "0" if not n else "1" if n == 1 else "2" if n <= 3 else "3"
    digit = bare[-1:].isdigit()
    single = before.isupper() and (n == 1 or (n == 3 and bare[1] == "." and text[i - 2 : i - 1].isspace()))
    binding = bare in BINDING
    shape = "digit" if digit else "initial" if single and not binding else "dotted" if "." in bare else "word"
    known = "binding" if binding else "ending" if bare in ENDING else "plain"
    gap = "none" if end == j else "line" if "\n" in text[j:end] else "space"
    nxt = text[end : end + 8].split(None, 1)
    return (mark, k, gap, known, shape, size, bare, SCRIPT[before], nxt[0].lower() if nxt else "", digit and previous in ORDINAL)


def type_of(key: tuple, text: str, i: int) -> tuple | None:
    """The type of a full stop's token that collocation is counted for: the token, or of a number the word before it.

    Short forms that may also end a sentence have none.
    """
    mark, _, _, known, shape, size, bare, *_ = key
    if mark != "stop" or not bare or known == "ending":
        return None
    if shape == "digit":
        return ("number", left_token(text, max(i - len(left_token(text, i)) - 1, 0)).rstrip(), len(bare) <= 2)
    return ("initial",) if shape == "initial" else ("word", bare)


def negative(key: tuple) -> bool:
    """Whether the marks are no boundary for sure: inside a number, an address or a dotted token, or before a small letter."""
    mark, k, gap, known, shape, size, *_ = key
    inside = gap == "none" and (k in ("lower", "digit", "mark") or mark == "ellipsis" or (mark == "stop" and (shape in ("dotted", "initial") or size in ("0", "1"))))
    return inside or (k == "lower" and mark in ("stop", "ellipsis", "call")) or (mark == "stop" and known == "binding")


def token_features(bare: str, k: str, nxt: str) -> tuple[str, str, str]:
    """The features that name tokens: the one before, that with the kind of what follows, and the one after."""
    return f"t={bare}", f"t={bare}&k={k}", f"n={nxt}"


def features_of(key: tuple) -> list[str]:
    """The features' names, from what at_mark() or at_break() gives."""
    if key[0] == "break":
        _, k, colon, caps, item, heading, size, before = key
        return [f"br&k={k}", f"br&colon={colon}", f"br&caps={caps}&k={k}", f"br&item={item}&k={k}", f"br&heading={heading}", f"br&size={size}", f"br&sb={before}&k={k}", f"br&heading={heading}&item={item}&colon={colon}&caps={caps}&k={k}"]
    mark, k, gap, known, shape, size, bare, before, nxt, ordinal = key
    return [*shape_features(mark, k, gap, known, shape, size, before, ordinal), *token_features(bare, k, nxt)]


def shape_features(mark: str, k: str, gap: str, known: str, shape: str, size: str, before: str, ordinal: bool) -> list[str]:
    """The features of a mark that name no token."""
    return [
        f"m={mark}", f"m={mark}&k={k}&g={gap}", f"m={mark}&known={known}&k={k}", f"m={mark}&shape={shape}&k={k}", f"m={mark}&size={size}&known={known}",
        f"known={known}", f"ordinal={ordinal}&k={k}", f"sb={before}&k={k}&m={mark}", f"g={gap}&m={mark}", f"m={mark}&known={known}&shape={shape}&ordinal={ordinal}&k={k}&g={gap}",
    ]


def at_break(text: str, i: int, end: int, line: str, item: bool, heading: bool) -> tuple:
    """What the features are made of at the line break text[i:end] after a line without an end mark.

    `heading` tells that the line is one of the corpus's headings.
    """
    k = KIND[text[end : end + 1]]
    before = SCRIPT[text[i - 1]] if i else "none"
    colon = line.endswith((":", "：")) and k != "open"
    caps = line.isupper() and len(line.split()) > 1 and k != "lower"
    return ("break", k, colon, caps, item, heading, min(len(line) // 12, 5), before)


class Model:
    """A maximum-entropy classifier over named features, as weights by name, and the corpus's headings."""

    def __init__(self, weights: dict[str, float] | None = None, headings: frozenset[str] = frozenset()) -> None:
        self.weights = weights or {}
        self.headings = headings
        self.known: dict[tuple, float] = {}
        #: Weights of the features that name tokens, so that no name is put together for a token that has none.
        self.tokens = {f[2:] for f in self.weights if f.startswith("t=")} | {f[2:].rsplit("&k=", 1)[0] for f in self.weights if f.startswith("t=")}
        self.next = {f[2:]: w for f, w in self.weights.items() if f.startswith("n=")}

    def yes(self, key: tuple) -> bool:
        """Whether a candidate is a boundary; the scores of what names no token are remembered."""
        if key[0] == "break":
            rest, extra = key, 0.0
        else:
            mark, k, gap, known, shape, size, bare, before, nxt, ordinal = key
            rest = (mark, k, gap, known, shape, size, before, ordinal)
            extra = self.next.get(nxt, 0.0)
            if bare in self.tokens:
                extra += self.weights.get(f"t={bare}", 0.0) + self.weights.get(f"t={bare}&k={k}", 0.0)
        base = self.known.get(rest)
        if base is None:
            base = self.known[rest] = self.score(features_of(key) if key[0] == "break" else shape_features(*rest))
        return base + extra > 0

    def score(self, features: list[str]) -> float:
        w = self.weights
        return w.get("", 0.0) + sum(w.get(f, 0.0) for f in features)

    @classmethod
    def fit(cls, examples: Counter, headings: frozenset[str] = frozenset(), rounds: int = 300, l2: float = 1e-3) -> Model:
        """`examples` counts (features, label); fitted by gradient descent with a step for each weight (Adagrad)."""
        if not examples:
            return cls(headings=headings)
        names = {n: k for k, n in enumerate(sorted({f for fs, _ in examples for f in fs}))}
        rows, cols, y, c = [], [], [], []
        for r, ((fs, label), n) in enumerate(sorted(examples.items())):
            y.append(label)
            c.append(n)
            for f in fs:
                rows.append(r)
                cols.append(names[f])
        rows, cols, y, c = np.array(rows), np.array(cols), np.array(y, float), np.log1p(np.array(c, float))
        w, bias, g2, b2 = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(rows, w[cols], len(y)) + bias
            d = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(cols, d[rows], len(w)) + l2 * w
            g2 += grad * grad
            b2 += d.sum() ** 2
            w -= 0.8 * grad / np.sqrt(g2)
            bias -= 0.8 * d.sum() / np.sqrt(b2)
        return cls({n: float(w[k]) for n, k in names.items() if abs(w[k]) > 1e-6} | {"": float(bias)}, headings)


def candidates(text: str, headings: frozenset[str]) -> list[tuple[int, tuple | None, int, int, tuple[int, int] | None]]:
    """(position after, key of features, start and end of the marks or break, quotation) of each candidate in a paragraph, in order.

    Positions count from the paragraph's start. Without a key, the candidate is a boundary. `quotation` is the span of a
    quotation that the marks close, in a script without capitals, where what follows may still belong to it.
    """
    spans = pairs(text)
    found: list[tuple[int, tuple | None, int, int, tuple[int, int] | None]] = []
    marked_ends = set()
    size = len(text)
    sweep = Sweep(spans) if spans else None
    for m in _MARK.finditer(text):
        i, j = m.span()
        if j < size and text[j] == "️":
            j += 1
        closed = None
        inside = False
        if sweep:
            for s in reversed(sweep.at(i)):
                if s[1] == j or text[j : s[1]].isspace():
                    j = s[1] + 1
                    closed = s
                else:
                    inside = True
                    break
            if inside:
                continue
        while j < size and text[j] in "’'" and not text[j + 1 : j + 2].isalnum():
            j += 1
        end = _SPACES.match(text, j).end()
        marked_ends.add(end)
        if closed:
            nxt = KIND[text[end : end + 1]]
            if closed[2] and nxt not in ("upper", "end", "open"):  # a bracket's own marks end nothing outside, unless a capital follows
                continue
            if end < size and text[end] in ",;:–—-，、；：":
                continue
            if not closed[2] and nxt in ("han", "other", "thai", "open"):
                found.append((j, None, i, j, (closed[0], closed[1])))
                continue
        found.append((j, at_mark(text, i, j), i, j, None))
    if "\n" in text:
        found += breaks(text, headings, spans, marked_ends)
    if not text.isascii():
        sweep = Sweep(spans) if spans else None
        for m in _THAI_GAP.finditer(text):
            if sweep is None or not sweep.at(m.start()):
                found.append((m.start(), None, m.start(), m.end(), None))
    found.sort(key=lambda x: (x[0], x[1] is not None))
    return found


def breaks(text: str, headings: frozenset[str], spans: list, marked_ends: set[int]) -> list:
    """The candidates at a paragraph's line breaks, as from candidates()."""
    found: list = []
    sweep = Sweep(spans)
    lines = list(_LINE.finditer(text))
    number = 0
    fresh = True
    for a, b in zip(lines, lines[1:]):
        line = a[0].strip()
        head = _ITEM.match(a[0].lstrip())
        item = bool(head) and (head[1] is None or int(head[1]) in (1, number + 1))
        number = int(head[1]) if item and head[1] else 0 if not item else number
        nxt = _ITEM.match(b[0].lstrip())
        start = b.start() + len(b[0]) - len(b[0].lstrip())
        next_item = bool(nxt) and (nxt[1] is None or int(nxt[1]) in (1, number + 1)) and not (nxt[1] is None and not fresh and not item and not line.endswith((".", "!", "?", ":")) and nxt[0].strip() in "–-" and len(line) > 50)
        ended = bool(_ENDED.search(line))
        sure = next_item or (item and ended and bool(nxt))
        if sure:
            found.append((a.end(), None, a.end(), start, None))
        elif start not in marked_ends and not sweep.at(a.end()):
            found.append((a.end(), at_break(text, a.end(), start, line, item, fresh and line in headings), a.end(), start, None))
        fresh = ended or item or sure or line.endswith((":", "：")) or line in headings or (line.isupper() and len(line.split()) > 1)
    return found


def split(text: str, model: Model) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence unit of the text, without white space around it."""
    at = 0
    yes = model.yes
    for gap in [*_BLANK.finditer(text), None]:
        para, offset = (text[at : gap.start()], at) if gap else (text[at:], at)
        at = gap.end() if gap else at
        start = 0
        cuts = []
        for pos, key, _, _, quotation in candidates(para, model.headings):
            if pos <= start:
                continue
            if quotation is not None and not para[start : quotation[0]].strip() and SPEECH.match(para[quotation[1] + 1 :].lstrip()):
                continue
            if key is None or yes(key):
                cuts.append((start, pos))
                start = pos
        cuts.append((start, len(para)))
        for a, b in cuts:
            piece = para[a:b]
            bare = piece.lstrip()
            if bare:
                a += len(piece) - len(bare) + offset
                yield a, a + len(bare.rstrip())


def headings_of(texts: list[str], least: int = 3) -> frozenset[str]:
    """Headings of a corpus: short lines without an end mark that are a paragraph of their own in `least` texts."""
    seen: Counter = Counter()
    for text in texts:
        seen.update(x for x in {p.strip() for p in _BLANK.split(text)} if may_head(x))
    return frozenset(x for x, n in seen.items() if n >= least)


def may_head(x: str) -> bool:
    """Whether a line (without white space around it) has the form of a heading."""
    return 0 < len(x) <= 48 and "\n" not in x and not _MARK.search(x[-2:]) and not _ITEM.match(x)


def lines_of(text: str) -> dict[str, bool]:
    """The text's lines that have the form of a heading and are a paragraph of their own (True) or are followed by others."""
    out: dict[str, bool] = {}
    for para in _BLANK.split(text):
        whole = para.strip()
        if may_head(whole):
            out[whole] = True
        for line in para.split("\n")[:-1]:
            line = line.strip()
            if may_head(line):
                out.setdefault(line, False)
    return out


def document_headings(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, headings): each document's lines that are headings of the whole corpus, for those that have some.

    Headings are those of headings_of(), over all documents of any length; a document delivered twice counts once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(doc, line, alone) for doc, text in zip(pdf["doc_id"], pdf["text"]) for line, alone in lines_of(text).items()]
            ids, lines, alone = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "line": pd.Series(lines, dtype=object), "alone": np.array(alone, bool)})

    lines = scanned(docs).mapInPandas(run, "doc_id long, line string, alone boolean")
    lines = materialize(lines.groupBy("doc_id", "line").agg(F.max("alone").alias("alone")), "lines")
    headings = lines.groupBy("line").agg(F.count_if("alone").alias("n")).filter(F.col("n") >= least)
    return lines.join(headings, "line", "left_semi").groupBy("doc_id").agg(F.collect_list("line").alias("headings"))


def paragraphs(text: str) -> list[str]:
    """The text's paragraphs that are not blank."""
    return [p for p in _BLANK.split(text) if p.strip()]


class Collocations:
    """How often full stops follow each type of token, in all and at paragraph ends, and tokens without one.

    A type is bound to what follows it if its stops end paragraphs far less often than other stops do, by a likelihood
    ratio, and, of words, if they are short and hardly ever stand without a stop.
    """

    def __init__(self) -> None:
        self.stops: Counter = Counter()
        self.ends: Counter = Counter()
        self.plain: Counter = Counter()

    def add(self, text: str) -> None:
        for para in paragraphs(text):
            body = para.rstrip()
            for _, key, i, j, _ in candidates(body, frozenset()):
                kind = type_of(key, body, i) if key and key[0] != "break" else None
                if kind and key[2] != "none":
                    self.stops[kind] += 1
                    self.ends[kind] += j == len(body)
                elif kind and j == len(body):
                    self.stops[kind] += 1
                    self.ends[kind] += 1
            self.plain.update(w.strip("\"“”'(),;:!?") for w in para.lower().split() if not w.endswith("."))

    def bound(self, least: int = 20) -> frozenset[tuple]:
        """The types that are bound to what follows."""
        n, e = sum(self.stops.values()), sum(self.ends.values())
        if not n or not 0 < e < n:
            return frozenset()
        rate = e / n
        out = set()
        for kind, m in self.stops.items():
            k = self.ends[kind]
            if m < least or k * 4 > m * rate:
                continue
            p = k / m
            ratio = 2 * ((k * np.log(p / rate) if k else 0.0) + (m - k) * np.log((1 - p) / (1 - rate)))
            word = kind[1] if kind[0] == "word" else ""
            if ratio > 10.83 and (not word or ((len(word) <= 6 or "." in word) and self.plain[word] * 9 <= m)):
                out.add(kind)
        return frozenset(out)


def examples_of(text: str, headings: frozenset[str], bound: frozenset[tuple] = frozenset()) -> Counter:
    """Labelled examples of a text, from where its structure or collocation tells what a candidate is.

    Boundaries: marks and lines at a paragraph's end, read with the start of the next paragraph behind them, after a
    blank, a line break or (as where a space is missing) nothing; and lines that elsewhere are headings of their own.
    No boundaries: marks inside numbers, addresses and dotted tokens, before small letters, after known short forms and after types in
    `bound`, and breaks of lines that the next word would have made longer than the paragraph's longest line. Marks in the
    middle of a paragraph before a capital tell nothing, nor do breaks of short lines; they are left out.
    """
    out: Counter = Counter()
    paras = paragraphs(text)
    for para, after in zip(paras, [*paras[1:], ""]):
        body = para.rstrip()
        after = after.lstrip()
        item = _ITEM.match(after)
        follow = after[item.end() :][:40] if item else after[:40]
        width = max(len(x.rstrip()) for x in body.split("\n"))
        ended = False
        for _, key, i, j, _ in candidates(body, headings):
            if key is None:
                ended = ended or j == len(body)
                continue
            if key[0] == "break":
                first = body[j:].split(None, 1)[0]
                line = body[body.rfind("\n", 0, i) + 1 : i].rstrip()
                if key[5]:
                    out[(tuple(features_of(key)), 1)] += 1
                elif len(line) >= 40 and len(line) + 1 + len(first) > width and not key[2] and not key[4]:
                    out[(tuple(features_of(key)), 0)] += 1
            elif j == len(body):
                ended = True
                for gap in (" ", "\n", "") if follow else ():
                    at_end = at_mark(body + gap + follow, i, j)
                    if at_end[1] != "lower" and (gap or at_end[1] in ("upper", "open_upper", "han", "other")) and not (not gap and negative(at_end)):
                        out[(tuple(features_of(at_end)), 1)] += 1
            elif negative(key) or (bound and type_of(key, body, i) in bound):
                out[(tuple(features_of(key)), 0)] += 1
        if not ended and follow and len(body) <= 60:
            line = body[body.rfind("\n") + 1 :].strip()
            key = at_break(body + "\n" + follow, len(body), len(body) + 1, line, bool(_ITEM.match(line)), line == body.strip() and line in headings)
            if key[1] not in ("lower", "end"):
                out[(tuple(features_of(key)), 1)] += 1
    return out


#: Reliable boundaries that every corpus is trained with, for those that have few of their own.
SEED = "The long desk is open.\n\nCall the front office today!\n\nWill they hire someone soon?\n\n请今天申请。\n\n需要驾照吗？\n\nA version such as 2.5 works, e.g. here and approx. there."


def train(docs: DataFrame, n: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, headings: DataFrame | None = None) -> Model:
    """The model of a corpus (doc_id, text), fitted on `n` of its documents of up to `chars` characters.

    The documents are those of the smallest hashes, the same ones in every run. `headings` is as from
    document_headings(), which counts over all documents; the model has those of its own documents.
    """
    headings = document_headings(docs.select("doc_id", "text").dropna()) if headings is None else headings
    some = docs.filter(F.length("text") <= chars).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "text").limit(n)
    texts = [(r["text"], frozenset(r["headings"] or ())) for r in some.join(headings, "doc_id", "left").collect()]
    seen, examples = Collocations(), examples_of(SEED, frozenset())
    for text, _ in texts:
        seen.add(text)
    bound = seen.bound()
    for text, own in texts:
        examples.update(examples_of(text, own, bound))
    return Model.fit(examples, frozenset().union(*(own for _, own in texts)))


def sentence_units(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit of every document, in code points from 0.

    Null and empty texts, texts of white space only, and documents without an id have no units. Repeated rows give repeated units. A very
    long text is one task's work, in memory in proportion to its length. A given model's headings are used as they are; else every
    document comes with those of its lines that are headings of the corpus, so that their number is not bounded by a task's memory.
    """
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    given = model.headings if model else None
    if model is None:
        headings = materialize(document_headings(docs), "headings")
        model = train(docs, headings=headings)
        # both sides are dealt out alike, so that the texts are shuffled once, for the join and the work in Python together
        n = parts_for(docs)
        docs = docs.repartition(n, "doc_id").join(headings.repartition(n, "doc_id"), "doc_id", "left")
    else:
        docs = scanned(docs).withColumn("headings", F.lit(None).cast("array<string>"))
    weights = model.weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(weights)
        for pdf in batches:
            ids, starts, ends = [], [], []
            for doc, text, own in zip(pdf["doc_id"], pdf["text"], pdf["headings"]):
                m.headings = given if given is not None else frozenset(() if own is None else own)
                for a, b in split(text, m):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start_char": np.array(starts, "int64"), "end_char": np.array(ends, "int64")})

    return docs.mapInPandas(run, "doc_id long, start_char long, end_char long")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Every sentence unit of every document."""
    return sentence_units(table(spark, root, "documents"))
