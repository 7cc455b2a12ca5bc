"""Personal data by a semi-Markov conditional random field over spans.

Base kinds come from fixed patterns with checks; their spans always stay. The field then reads the stretches
of text around digits and @ signs, scores whole candidate spans (their shape, length, digit count, checks and
neighbours) for each type, and a dynamic program over spans of at most MOST_TOKENS tokens picks boundaries and
types jointly. An entity must hold a digit or an @ sign, so the program splits exactly into the groups of
overlapping candidates: text outside of them is never an entity. Spans of the best path that touch no base
span are added, such as telephone numbers without a country code.

The field is trained here by stochastic gradient on the likelihood of generated sentences (EXAMPLES of them,
from a fixed seed) that set entities and look-alikes (dates, digests, prices, versions) among words.

Null texts count as empty and have no spans. Offsets count code points, the end exclusive. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches

#: The kinds, as listed.
KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns of the base kinds, in forms that need linear time; the first is the part after the sign.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The longest entity, in tokens; and the fewest digits of an entity without an @ sign.
MOST_TOKENS, FEWEST_DIGITS = 14, 6
#: Training sentences and passes over them.
EXAMPLES, PASSES = 900, 4
#: Span shapes whose scores a Python worker remembers.
REMEMBERED = 50_000


def digits_of(text: str) -> str:
    """The ASCII digits of a text."""
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the base kinds, by kind and start."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# ---- candidate spans

#: Stretches of characters that an entity can consist of; they hold single spaces, and a digit or an @ sign.
STRETCH = re.compile(r"[0-9+(@](?:\x20?[0-9().@+-])*")
AFTER = re.compile(r"[^\s@]+")
SPLIT = re.compile(r"[0-9]+|[^0-9]")


def _shape(text: str) -> str:
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", text))


def _class(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be entities, by end: parts of a stretch, on the bounds of its tokens.

    A span begins with a digit, + or ( and ends with a digit; spans of letters around an @ sign are whole words.
    """
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        before, m = text[done:at], AFTER.match(text, at + 1)
        if m:
            start, end = at - (0 if not before or before[-1].isspace() else len(before.split()[-1])), m.end()
            while end > start and not text[end - 1].isalnum():
                end -= 1
            while start < end and not text[start].isalnum():
                start += 1
            if "@" in text[start:end]:
                found.append((start, end))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in STRETCH.finditer(text):
        if sum("0" <= c <= "9" for c in m[0]) < FEWEST_DIGITS:
            continue
        tokens = [(t.start() + m.start(), t.end() + m.start()) for t in SPLIT.finditer(m[0])]
        for i, (start, _) in enumerate(tokens):
            if text[start] not in "+(0123456789":
                continue
            count = 0
            for j in range(i, min(len(tokens), i + MOST_TOKENS)):
                end = tokens[j][1]
                if "0" <= text[end - 1] <= "9":
                    count += end - tokens[j][0]
                    if count >= FEWEST_DIGITS:
                        found.append((start, end))
    return sorted(found, key=lambda s: (s[1], s[0]))


def span_key(text: str, start: int, end: int) -> tuple:
    """All that a span's features depend on."""
    part = text[start:end]
    digits = digits_of(part)
    before = re.search(r"([^\W\d_]+)\W{0,2}$", text[max(0, start - 16) : start])
    octets = part.split(".")
    return (
        _shape(part),
        len(digits),
        13 <= len(digits) <= 19 and luhn(digits),
        len(octets) == 4 and all(o.isascii() and o.isdecimal() and len(o) < 4 and int(o) < 256 for o in octets),
        bool(DOMAIN.search(part.partition("@")[2])) if "@" in part else False,
        _class(text, start - 1),
        _class(text, end),
        before[1].lower() if before else "",
    )


def span_features(key: tuple) -> list[str]:
    """Whole-span features of a key."""
    shape, digits, valid, octets, domain, left, right, before = key
    return ["bias", "shape=" + shape, f"digits={digits}", f"luhn={valid}", f"octets={octets}", f"domain={domain}", "left=" + left, "right=" + right, "before=" + before, f"first={shape[:1]}", f"plain={shape == f'd{digits}'}", f"kinds={''.join(sorted(set(re.sub('[a-z0-9]', '', shape))))}"]


def groups(spans: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Candidates in groups that do not touch each other."""
    group, reach = [], -1
    for span in sorted(spans):
        if group and span[0] >= reach:
            yield sorted(group, key=lambda s: (s[1], s[0]))
            group = []
        group.append(span)
        reach = max(reach, span[1])
    if group:
        yield sorted(group, key=lambda s: (s[1], s[0]))


# ---- the field


def _sum(a: float, b: float) -> float:
    top = a if a > b else b
    return top + log(exp(a - top) + exp(b - top)) if top > -1e300 else top


@dataclass
class Field:
    """Weights of (feature, type), and of the type that follows a type in the same group; outside scores 0."""

    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    moves: list[list[float]] = field(default_factory=lambda: [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)])
    known: dict[tuple, list[float]] = field(default_factory=dict)

    def scores(self, key: tuple) -> list[float]:
        """The score of a span as each type."""
        found = self.known.get(key)
        if found is None:
            names = span_features(key)
            found = [sum(self.weights.get((f, y), 0.0) for f in names) for y in range(len(KINDS))]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return found

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """(type, start, end) of the best path."""
        out = []
        outside = len(KINDS)
        for group in groups(candidates(text)):
            places = sorted({p for s in group for p in s})
            ending: dict[int, list[int]] = {}
            for start, end in group:
                ending.setdefault(end, []).append(start)
            best = {places[0]: [float("-inf")] * outside + [0.0]}
            came: dict[tuple[int, int], tuple[int, int]] = {}
            for before, at in zip(places, places[1:], strict=False):
                row = [float("-inf")] * (outside + 1)
                for y, score in enumerate(best[before]):
                    if score + self.moves[y][outside] > row[outside]:
                        row[outside] = score + self.moves[y][outside]
                        came[at, outside] = (before, y)
                for start in ending.get(at, ()):
                    each = self.scores(span_key(text, start, at))
                    for k in range(outside):
                        for y, score in enumerate(best[start]):
                            if score + self.moves[y][k] + each[k] > row[k]:
                                row[k] = score + self.moves[y][k] + each[k]
                                came[at, k] = (start, y)
                best[at] = row
            at, y = places[-1], max(range(outside + 1), key=lambda k: (best[places[-1]][k], k))
            while at != places[0]:
                start, before = came[at, y]
                if y != outside:
                    out.append((y, start, at))
                at, y = start, before
        return out

    def learn(self, text: str, gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the likelihood of a text's entities."""
        outside = len(KINDS)
        for group in groups(candidates(text)):
            places = sorted({p for s in group for p in s})
            number = {p: i for i, p in enumerate(places)}
            arcs = [(i, i + 1, outside, 0.0, None) for i in range(len(places) - 1)]
            for start, end in group:
                key = span_key(text, start, end)
                names = span_features(key)
                arcs += [(number[start], number[end], y, sum(self.weights.get((f, y), 0.0) for f in names), names) for y in range(outside)]
            arcs.sort(key=lambda a: a[1])
            never = float("-inf")
            forward = [[never] * (outside + 1) for _ in places]
            backward = [[never] * (outside + 1) for _ in places]
            forward[0][outside] = 0.0
            backward[-1] = [0.0] * (outside + 1)
            for i, j, y, score, _ in arcs:
                for x in range(outside + 1):
                    if forward[i][x] > never:
                        forward[j][y] = _sum(forward[j][y], forward[i][x] + self.moves[x][y] + score)
            for i, j, y, score, _ in sorted(arcs, key=lambda a: -a[0]):
                if backward[j][y] > never:
                    for x in range(outside + 1):
                        backward[i][x] = _sum(backward[i][x], backward[j][y] + self.moves[x][y] + score)
            total = backward[0][outside]
            here = {(number[s], number[e]): y for y, s, e in gold if s in number and e in number}
            change: dict[tuple[str, int], float] = {}
            path, at, before = {}, 0, outside
            while at < len(places) - 1:
                step = next(((e, y) for (s, e), y in here.items() if s == at), (at + 1, outside))
                path[at, step[0], step[1]] = before
                if (before, step[1]) != (outside, outside):
                    self.moves[before][step[1]] += rate
                at, before = step
            for i, j, y, score, names in arcs:
                p = 0.0
                for x in range(outside + 1):
                    if forward[i][x] > never and backward[j][y] > never:
                        q = exp(min(50.0, forward[i][x] + self.moves[x][y] + score + backward[j][y] - total))
                        p += q
                        if (x, y) != (outside, outside):
                            self.moves[x][y] -= rate * min(q, 1.0)
                if names:
                    by = ((i, j, y) in path) - min(p, 1.0)
                    if abs(by) > 1e-4:
                        for f in names:
                            change[f, y] = change.get((f, y), 0.0) + by
            for k, by in change.items():
                self.weights[k] = self.weights.get(k, 0.0) * (1 - rate * 1e-3) + rate * by


# ---- training sentences


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card(rng: random.Random, n: int, valid: bool) -> str:
    while True:
        digits = rng.choice("3456") + _number(rng, n - 1)
        if luhn(digits) == valid:
            return digits


def _entity(rng: random.Random, word) -> tuple[int, str]:
    kind = rng.randrange(4)
    if kind == 0:
        return 0, f"{word()}.{rng.randint(0, 99)}@{word()}{rng.choice(['', '5', '.co'])}.{rng.choice(['com', 'org', 'net', 'de'])}"
    if kind == 1:
        return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = _card(rng, rng.choice([13, 15, 16, 16, 16, 19]), True)
        glue = rng.choice(["", "", " ", "-"])
        return 2, glue.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = rng.randint(200, 999), rng.randint(200, 999), _number(rng, 4)
    return 3, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(2, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"1-{a}-{b}-{c}"])


def _other(rng: random.Random, word) -> str:
    y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice(
        [
            lambda: f"{y}-{m:02}-{d:02}", lambda: f"{d:02}.{m:02}.{y}", lambda: f"{d}-{m:02}-{y}", lambda: hashlib.md5(_number(rng, 9).encode()).hexdigest(), lambda: _card(rng, rng.choice([13, 16, 16]), False),
            lambda: _number(rng, rng.randint(6, 12)), lambda: f"{rng.randint(1, 30)}.{rng.randint(0, 20)}.{_number(rng, 4)}", lambda: f"{_number(rng, 3)} {_number(rng, 3)}", lambda: f"{y} {y + 1}", lambda: f"({y}) {_number(rng, 3)}",
            lambda: f"{y}-{y + 3}", lambda: " ".join(_number(rng, rng.randint(1, 5)) for _ in range(rng.randint(2, 7))), lambda: f"978-{_number(rng, 1)}-{_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 1)}", lambda: f"{_number(rng, 3)}-{_number(rng, 2)}.{_number(rng, 3)}",
            lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{_number(rng, 3)}.{_number(rng, 3)}", lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{_number(rng, 4)}.{_number(rng, 6)}", lambda: f"-{_number(rng, 2)}.{_number(rng, 5)}",
        ]
    )()


def train(examples: int = EXAMPLES, passes: int = PASSES) -> Field:
    """A field fitted to the generated sentences; the same at each call."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ou"], k=rng.randint(1, 4)))
    made = []
    for _ in range(examples):
        text, gold = "", set()
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + rng.choice([" ", " ", ": ", ", ", " (", ' "'])
            if rng.random() < 0.5:
                kind, entity = _entity(rng, word)
                gold.add((kind, len(text), len(text) + len(entity)))
            else:
                entity = _other(rng, word)
            text += entity + rng.choice([" ", ". ", ", ", "\n", ") ", '" ', "### "])
        made.append((text, gold))
    model = Field()
    for step in range(passes):
        rng.shuffle(made)
        for text, gold in made:
            model.learn(text, gold, 0.3 / (1 + step))
    model.known.clear()
    return model


# ---- columns


def all_spans(text: str, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and the added ones, (kind's number, start, end)."""
    base = base_spans(text)
    added = []
    for kind, start, end in model.decode(text) if DIGIT.search(text) else []:
        if not any(s < end and start < e for _, s, e in base):
            added.append((kind, start, end))
    return base, added


DIGIT = re.compile("[0-9@]")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def digests(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, the counts and digest of the base spans, and all spans."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # bounded by the training sentences

    @F.pandas_udf(DIGEST)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                base, added = all_spans(text or "", shared.value)
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", found("text").alias("d")).select("doc_id", "d.*")


def redacted(text: str, model: Field) -> str:
    """The text with each span replaced by its kind's name; overlapping spans become one, named by the first."""
    base, added = all_spans(text, model)
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in base + added):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(spark: SparkSession, docs: DataFrame, model: Field | None = None) -> DataFrame:
    """The documents with personal data replaced in their texts; null texts stay null, all other columns stay."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else redacted(x, shared.value) for x in batch], dtype=object)

    return docs.withColumn("text", replaced("text"))
