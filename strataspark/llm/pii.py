"""Personal data: patterns, and a semi-Markov conditional random field that adds what is written in other ways."""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .sample import least_hashes

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 2_000  # documents that the field learns from
SNIPPETS = 8  # places of one of them
MADE = 700  # further snippets, made by rule from a fixed seed
EPOCHS = 6
RATE = 0.3
DECAY = 1e-4
MOST_TOKENS = 24  # of an entity
MOST_CHARS = 72
REACH = 48  # characters before and after an at sign that may belong to an address
MARGIN = 0.5  # by which the best reading must beat the one without an entity
BUCKETS = 1 << 14
SEED = 42

# ---- the base patterns ---------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match cannot begin inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order; each is leftmost and does not overlap others of its kind.

    An address is found from its at sign, as what stands before it cannot hold one: work follows the length of the text.
    """
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- lattices ------------------------------------------------------------------------------------

_TOKEN = re.compile("[0-9]+|[^\x00-\x40\x5b-\x60\x7b-\x7f]+|.", re.S)
_NUMBERS = re.compile(r"[+(]?[0-9]++(?:[ ()./+\[\]-]{1,3}[0-9]++)*+")
_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]| at (?=\w{1,40} dot )", re.I)
_LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_NUMBER = frozenset("0123456789")
_JOINTS = frozenset(" ()./+[]-")
_DOTTED = re.compile(r"\.|[(\[{] ?(?:dot|\.) ?[)\]}]| dot ", re.I)
_CUES = 12  # letters of the word before an entity that count


class Lattice:
    """The tokens of ``text[low:high]``, and the segments from each that may be entities; none overlaps ``taken`` (in order, apart)."""

    def __init__(self, text: str, low: int, high: int, taken: list[tuple[int, int]], numbers: bool):
        self.text, self.numbers, self.cuts, self.words = text, numbers, [low], []
        for m in _TOKEN.finditer(text, low, high):
            self.words.append(m.group())
            self.cuts.append(m.end())
        self.blocked, n, k = [0], 0, 0  # tokens before each that overlap what is taken
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            n += k < len(taken) and taken[k][0] < b
            self.blocked.append(n)

    def outside(self, i: int) -> list[int]:
        """Features of a token that is in no entity."""
        w = self.words[i]
        shape = "digits" if w[0].isdigit() else "word" if w.isalpha() else w
        return [_feature("out", shape, min(len(w), 9) if w[0].isdigit() else 0)]

    def segments(self, i: int) -> list[tuple[int, int, list[int]]]:
        """``(end token, kind, features)`` of the entities that may begin with a token; they have at most ``MOST_TOKENS`` tokens."""
        words, cuts, blocked, text = self.words, self.cuts, self.blocked, self.text
        first, found = words[i], []
        if blocked[i + 1] > blocked[i]:
            return found
        most = min(len(words), i + MOST_TOKENS)
        if self.numbers:
            if not (first[0] in _NUMBER or first in "+("):
                return found
            digits = groups = 0
            for j in range(i, most):
                w = words[j]
                if blocked[j + 1] > blocked[i] or not (w[0] in _NUMBER or w in _JOINTS):
                    break
                if w[0] in _NUMBER:
                    digits, groups = digits + len(w), groups + 1
                    if digits > 19:
                        break
                    kinds = [k for k, fits in ((1, groups == 4 and digits <= 12), (2, digits >= 13), (3, 7 <= digits <= 15)) if fits]
                    found += [(j + 1, k, _span_features(text, cuts[i], cuts[j + 1], k)) for k in kinds]
        elif first.isalnum():
            for j in range(i + 2, most):
                if blocked[j + 1] > blocked[i] or cuts[j + 1] - cuts[i] > MOST_CHARS or words[j] in "\r\n":
                    break
                if words[j].isalnum():
                    span = text[cuts[i] : cuts[j + 1]]
                    mark = _AT.search(span)
                    if mark and 0 < mark.start() and mark.end() < len(span) and _DOTTED.search(span, mark.end()) and " " not in span[: mark.start()].strip():
                        found.append((j + 1, 0, _span_features(text, cuts[i], cuts[j + 1], 0)))
        return found

    def edges(self) -> list[tuple[int, int, int, list[int]]]:
        """``(first token, end token, label, features)`` of all tokens outside (label 0) and all segments (kind + 1), by first token."""
        return [e for i in range(len(self.words)) for e in [(i, i + 1, 0, self.outside(i)), *[(i, j, k + 1, f) for j, k, f in self.segments(i)]]]


def _feature(*words) -> int:
    return zlib.crc32("|".join(map(str, words)).encode("utf-8", "surrogatepass")) % BUCKETS


def _beside(c: str) -> str:
    return "edge" if not c or c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "\"'#$%&*!,.;:()" else "mark"


def _span_features(text: str, start: int, end: int, kind: int) -> list[int]:
    """What a whole span says of one kind: its form, its check digits, what stands beside it and the word before."""
    span = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    words = _LETTERS.findall(text[max(0, start - 24) : start])
    says = [("left", _beside(before)), ("right", _beside(after)), ("cue", words[-1].lower()[-_CUES:] if words else "")]
    if kind == 0:
        mark = _AT.search(span)
        domain = _DOTTED.split(span[mark.end() :])
        says += [
            ("mark", mark.group().lower()), ("labels", min(len(domain), 4)), ("tail", len(domain[-1]) if domain[-1].isalpha() else "odd"),
            ("local", min(mark.start() // 4, 5)), ("blanks", "dot" in span.lower() or " " not in span), ("whole", all(d and not d.isspace() for d in domain)),
        ]
    else:
        groups = re.findall("[0-9]+", span)
        digits = "".join(groups)
        joints = re.findall("[^0-9]+", span[1:] if span[0] in "+(" else span)
        says += [
            ("digits", len(digits)), ("form", ",".join(str(len(g)) for g in groups[:8])), ("joints", "".join(sorted(set("".join(joints))))), ("groups", min(len(groups), 8)),
            ("head", span[0] if not span[0].isdigit() else ""), ("luhn", len(digits) >= 13 and luhn(digits)),
            ("bytes", len(groups) == 4 and all(map(_small, groups)), len(set(joints)) == 1 and "." in joints[0] if joints else False), ("plain", not joints),
            ("zero", digits[0] == "0" and len(groups) > 1),
        ]
    return [_feature(kind, *s) for s in [("bias",), *says]]


def stretches(text: str) -> list[tuple[int, int, bool]]:
    """Parts of a text in which an entity may stand; outside them every token is outside, and the dynamic program splits there without loss."""
    found = []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), True) for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    low = high = -1
    for m in _AT.finditer(text):
        if m.start() - REACH > high:
            if high > 0:
                found.append((low, high, False))
            low = max(0, m.start() - REACH, high)
        high = min(len(text), m.end() + REACH)
    if high > 0:
        found.append((low, high, False))
    return found


# ---- the field -----------------------------------------------------------------------------------


class Field:
    """Weights of span features, of tokens outside, and of what follows what (outside, then the kinds)."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS)
        self.turn = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """The segmentation of highest score, boundaries and kinds chosen jointly: ``(start, kind, end)`` of its entities.

        Scores go forward token by token, so only what ends at each token is kept. An entity stays if it beats the same tokens
        outside by ``MARGIN``.
        """
        n, states, w, turn = len(lattice.words), len(KINDS) + 1, self.weights, self.turn
        score = np.full((n + 1, states), -np.inf)
        score[0, 0] = 0.0
        back = np.zeros((n + 1, states, 2), np.int64)
        gain = np.zeros((n + 1, states))
        some = False
        for i in range(n):
            into = score[i][:, None] + turn
            before, best = into.argmax(0), into.max(0)
            for j, label, f in [(i + 1, 0, lattice.outside(i)), *[(j, k + 1, f) for j, k, f in lattice.segments(i)]]:
                value = w[f].sum()
                if best[label] + value > score[j, label]:
                    score[j, label] = best[label] + value
                    back[j, label] = i, before[label]
                    gain[j, label] = value
                    some = some or label > 0
        if not some:
            return []
        at, label, out = n, int(score[n].argmax()), []
        while at > 0:
            i, k = back[at, label].tolist()
            if label:
                plain = sum(w[lattice.outside(x)].sum() + turn[0, 0] for x in range(i, at))
                if gain[at, label] + turn[0, label] + turn[label, 0] - turn[0, 0] - plain > MARGIN:
                    out.append((lattice.cuts[i], label - 1, lattice.cuts[at]))
            at, label = i, k
        return out[::-1]

    def slope(self, edges: list, n: int, gold: set[tuple[int, int, int]]) -> tuple[float, dict[int, float], np.ndarray]:
        """Log likelihood of the segmentation ``gold`` (first token, end token, kind), and how it rises with each weight and turn; by forward and backward sums."""
        states, turn = len(KINDS) + 1, self.turn
        values = [self.weights[f].sum() for *_, f in edges]
        ahead, behind = np.full((n + 1, states), -np.inf), np.full((n + 1, states), -np.inf)
        ahead[0, 0], behind[n] = 0.0, 0.0
        for (i, j, label, _), value in zip(edges, values, strict=True):
            ahead[j, label] = np.logaddexp(ahead[j, label], np.logaddexp.reduce(ahead[i] + turn[:, label]) + value)
        for (i, j, label, _), value in zip(edges[::-1], values[::-1], strict=True):
            behind[i] = np.logaddexp(behind[i], turn[:, label] + value + behind[j, label])
        total = np.logaddexp.reduce(ahead[n])
        inside = {k for a, b, _ in gold for k in range(a, b)}
        label_at = dict.fromkeys((k + 1 for k in range(n) if k not in inside), 0) | {0: 0} | {b: kind + 1 for _, b, kind in gold}
        up, turns, true_score = {}, np.zeros_like(turn), 0.0
        for (i, j, label, features), value in zip(edges, values, strict=True):
            into = np.exp(ahead[i] + turn[:, label] + value + behind[j, label] - total)
            true = (i, j, label - 1) in gold if label else i not in inside
            turns[:, label] -= into
            if true:
                turns[label_at[i], label] += 1
                true_score += value + turn[label_at[i], label]
            push = float(true) - float(into.sum())
            if abs(push) > 1e-9:
                for f in features:
                    up[f] = up.get(f, 0.0) + push
        return float(true_score - total), up, turns

    def learn(self, edges: list, n: int, gold: set[tuple[int, int, int]], grown: list[np.ndarray]) -> None:
        """One step up the log likelihood, each weight by its own rate."""
        _, slope, turns = self.slope(edges, n, gold)
        at = np.fromiter(slope, np.int64, len(slope))
        up = np.fromiter(slope.values(), float, len(slope)) - DECAY * self.weights[at]
        grown[0][at] += up**2
        self.weights[at] += RATE * up / np.sqrt(grown[0][at] + 1e-8)
        grown[1][:] += turns**2
        self.turn += RATE * turns / np.sqrt(grown[1] + 1e-8)


def _made(words: list[str], rng: random.Random, count: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Snippets with entities in many written forms, and with numbers that are none; ``(text, spans)``."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(words)
    cut = lambda d, sizes, joint: joint.join(d[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes)))

    def card(good: bool) -> str:
        while True:
            d = rng.choice("3456") + digits(rng.choice([13, 14, 15, 15, 15, 18]))
            if luhn(d) == good:
                return d

    def phone() -> str:
        d, j = rng.choice("23456789") + digits(9), rng.choice("- .")
        return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", cut(d, (3, 3, 4), j), f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+{rng.choice(['33', '34', '44', '49'])} {cut(d, (3, 3, 4), ' ')}", f"0{cut(d, (3, 3, 4), rng.choice(' -/'))}", f"001 {cut(d, (3, 3, 4), j)}"])

    def ip() -> str:
        return rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randrange(1, 256)) for _ in range(4))

    def email() -> str:
        at, dot = rng.choice([("@", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")])
        return f"{word().lower()}{rng.choice(['', '.' + digits(2), '_x', digits(1)])}{at}{rng.choice(['mail', 'example', word().lower(), 'mail' + digits(1)])}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'example' + dot + 'com'])}"

    def grouped_card() -> str:
        d = card(True)
        return rng.choice([d, cut(d, (4, 4, 4, len(d) - 12), rng.choice([" ", "-", ".", "/"]))])

    entities = (email, ip, grouped_card, phone)
    others = [
        lambda: card(False), lambda: cut(card(False), (4, 4, 4, 3), rng.choice(" -")), lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)} {rng.randrange(10, 24)}.{digits(2)}",
        lambda: f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.{rng.randrange(1900, 2100)}", lambda: digits(rng.randrange(7, 13)), lambda: digits(rng.randrange(20, 30)), lambda: f"{digits(3)}.{digits(6)}",
        lambda: f"{rng.randrange(300, 999)}.{digits(3)}.{digits(3)}.{rng.randrange(300, 999)}", lambda: f"{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", lambda: " ".join(digits(rng.randrange(1, 6)) for _ in range(rng.randrange(3, 9))),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"{digits(4)}/{digits(2)} ({digits(4)})", lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{word()} (at) {word()}", lambda: f"{word()} @ {word()}. {word()}", lambda: f"@{word()}", lambda: f"{digits(5)} + {digits(4)} - {digits(3)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(4)}",
    ]
    cues = {0: ["mail", "email", "write to", ""], 1: ["host", "IP", "from", ""], 2: ["card", "Visa", "paid with", ""], 3: ["call", "Tel.", "phone:", "fax", ""]}
    out = []
    for _ in range(count):
        kind = rng.randrange(-3, 4)
        left = " ".join(word() for _ in range(rng.randrange(5))) + rng.choice([" ", " ", "", ": ", "\n", " \""])
        if left and not left.strip():
            left = ""
        right = rng.choice([" ", " ", ".", ",", "!!", "\n", "###", ""])
        right += " ".join(word() for _ in range(rng.randrange(4))) if right in (" ", "\n") else ""
        if kind < 0:
            out.append((left + rng.choice(others)() + right, []))
            continue
        if cue := rng.choice(cues[kind]):
            left += ("" if not left or left[-1].isspace() else " ") + cue + " "
        if left and left[-1].isalnum():
            left += " "
        body = entities[kind]()
        out.append((left + body + right, [(len(left), kind, len(left) + len(body))]))
    return out


def _snippets(batches):
    """Places of sampled documents: text around them, with the base spans as labels."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            spans, taken = base_spans(text), 0
            for low, high, _ in sorted(stretches(text)):
                a, b = max(0, low - 24), min(len(text), high + 24)
                if taken >= SNIPPETS or b - a > 400:
                    continue
                taken += 1
                inside = [s for s in spans if a <= s[0] and s[2] <= b]
                rows[0].append(key)
                rows[1].append(text[a:b])
                rows[2].append([n for s in inside for n in (s[0] - a, s[1], s[2] - a)])
                rows[3].append(a)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.int64())], names=["key", "snippet", "spans", "at"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Learn from the rows with the ``sample_rows`` least hashes of their id, and from snippets made by rule.

    Base spans of the sample are labels for their surroundings, and so are numbers there in which neither the patterns nor
    the half-trained field see an entity; the made snippets show other ways of writing. At most ``sample_rows * SNIPPETS`` snippets of 400 characters come to the driver.
    """
    ship_package(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    found = least_hashes(rows, "key", sample_rows).mapInArrow(_snippets, "key long, snippet string, spans array<long>, at long").collect()
    real = sorted({(r["key"], r["at"], r["snippet"], tuple(r["spans"])) for r in found})
    return train([(r[2], [tuple(r[3][k : k + 3]) for k in range(0, len(r[3]), 3)]) for r in real])


def train(real: list[tuple[str, list[tuple[int, int, int]]]], made: int = MADE) -> Field:
    rng = random.Random(SEED)
    words = sorted({w for text, _ in real for w in _LETTERS.findall(text) if 1 < len(w) < 16}) or ["alpha", "Beta", "the", "of", "Gamma", "delta"]
    examples, open_ones = [], []
    for k, (text, spans) in enumerate([*_made(words, rng, made), *real[: 4 * made]]):
        for low, high, numbers in stretches(text):
            lattice = Lattice(text, low, high, [], numbers)
            edges = lattice.edges()
            held = {(i, j, label - 1) for i, j, label, _ in edges if label}
            if not held:
                continue
            at = {c: k for k, c in enumerate(lattice.cuts)}
            own = [s for s in spans if low <= s[0] and s[2] <= high and (s[1] > 0) == numbers]
            gold = {(at.get(s[0], -1), at.get(s[2], -1), s[1]) for s in own}
            taken = sorted(gold)
            if gold <= held and all(a[1] <= b[0] for a, b in zip(taken, taken[1:], strict=False)):
                example = (edges, len(lattice.words), gold)
                if k < made or gold:
                    examples.append(example)
                else:
                    open_ones.append((lattice, example))
    field, grown = Field(), [np.zeros(BUCKETS), np.zeros((len(KINDS) + 1, len(KINDS) + 1))]
    for epoch in range(EPOCHS):
        if epoch == EPOCHS // 2:  # the patterns do not know all forms, so of their blanks those are learned that read as blanks by now
            examples += [example for lattice, example in open_ones if not field.best(lattice)]
        rng.shuffle(examples)
        for edges, n, gold in examples:
            field.learn(edges, n, gold, grown)
    return field


def _apart(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover, in order and apart."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Entities of the field's best reading around the base spans, which stay as they are; numbers are read before addresses."""
    found, places = [], stretches(text)
    for numbers in (True, False):
        more = []
        starts, ends = _apart([*base, *found])
        for low, high, kind in places:
            if kind is not numbers:
                continue
            first, last = bisect_right(ends, low), bisect_left(starts, high)
            taken = list(zip(starts[first:last], ends[first:last], strict=True))
            if len(taken) == 1 and taken[0][0] <= low and high <= taken[0][1]:
                continue
            more += field.best(Lattice(text, low, high, taken, numbers))
        found += more
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scan(sent):
    def run(batches):
        field = sent.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base, field)
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[4].append(sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(sorted(base + more)))
                cols[6].append(len(more))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row, from its whole text.

    Counts and digest are of the base spans (addresses, IPv4, cards that pass Luhn's check, phones with a plus); ``spans``
    holds these and the ``n_added`` ones of the field, as ``kind:start:end`` in code points, by start, then kind.
    The field reads what the patterns leave: phones without a plus, addresses with ``(at)`` and ``[dot]``, IPv4 with
    ``[.]``, cards cut by dots. It never moves or drops a base span and adds none that overlaps one.

    Null text is empty: no span, the digest of the empty string. Rows without id and repeated rows are answered each.
    The result of a row depends on its text and the fitted field alone; an empty table gives no rows. Other columns are
    not looked at. No shuffle; the field (some 130 KB) is broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    field = field or fit(docs, id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(spark.sparkContext.broadcast(field)), OUT)
