"""Personal data by fixed patterns and a semi-Markov conditional random field over what they leave.

Base spans come from the contract's patterns. The field then reads each text as a sequence of segments: entities of
bounded length, and whatever lies between. Candidate entities are stretches of up to ``MAX_GROUPS`` groups of digits,
and addresses with their signs spelt out, with every start and end that they could have (up to two words of a local
part before the sign, up to three parts of a domain after it). Features look at the whole candidate (counts and sizes
of groups, separators, check digits, forms of signs, the word before). Candidates of all sorts that meet lie in one
lattice, and dynamic programming over it chooses boundaries and kinds together. Segments outside entities score 0,
so text without candidates needs no work and the choice stays exact. Base spans are kept as they are; the field adds
spans only where none lies.

The weights are fitted here, by the gradient of the field's log-likelihood on generated stretches whose spans are
known. Null and empty texts have no spans. Positions are code points. Of segmentations with the same score the one
with the later first difference loses; spans that start together are listed in the order of KINDS. Every row gives a
row, repeated rows each their own, also those without an id; extra columns pass through ``redacted`` and are ignored
by ``found``. A long text takes time in proportion to its length: a group of digits starts MAX_GROUPS candidates at
most, and candidates of one shape are scored once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import trim

KINDS = ("email", "ip", "card", "phone")
MAX_GROUPS, EPOCHS, RATE, STRETCHES = 8, 4, 0.3, 900

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at:
            yield "email", start, m.end()
            last = m.end()


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then by kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


# --- candidates and features -------------------------------------------------------------------------------
#: Groups of digits with up to three signs between them; and signs of addresses, spelt or bracketed. Fixed values.
_STRETCH = re.compile(r"[+(]?[0-9]+(?:[ ().:/-]{1,3}[0-9]+)+|[+(]?[0-9]{9,}")
_AT = r"(?: ?[\[(<{] ?(?:at|@) ?[\])>}] ?| at | ?@ ?)"
_DOT = r"(?: ?[\[(<{] ?(?:dot|\.) ?[\])>}] ?| dot | ?\. ?)"
_LABEL = r"[a-z0-9-]{2,24}(?![a-z0-9-])"
_SIGN = re.compile(f"(?i){_AT}[a-z0-9-]{{1,40}}(?={_DOT}[a-z0-9-]{{2}})")
_DOMAIN_PART = re.compile(f"(?i){_DOT}{_LABEL}")
_LOCAL_PART = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,40}\Z")
_LOCAL_BEFORE = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,40}(?: dot | ?[\[(<{] ?dot ?[\])>}] ?)\Z")
_SPLIT_SIGN = re.compile(f"(?i)({_AT})")
_SPLIT_DOT = re.compile(f"(?i)({_DOT})")
_TOP = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk"))
_HINTS = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "credit": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "mail": "email", "email": "email", "contact": "email", "write": "email", "order": "none", "invoice": "none", "version": "none", "isbn": "none", "date": "none", "id": "none", "on": "none"}
_GROUP, _PLAIN = re.compile(r"[0-9]+"), re.compile(r"[0-9+ ().:/-]+")
_LETTER = re.compile(r"[A-Za-z]")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}\Z")
_ZEROS = str.maketrans("123456789", "000000000")
_SIGNS = str.maketrans({c: " " for c in "+().:/-"})
#: Shapes whose scores are kept at a time.
_KEPT_SHAPES = 50_000


def _hint(text: str, start: int) -> str:
    if not _LETTER.search(text, max(0, start - 4), start):
        return "other"
    m = _WORD_BEFORE.search(text, max(0, start - 24), start)
    return _HINTS.get(m[1].lower(), "other") if m else "other"


def _shape(text: str, start: int, end: int, hint: str) -> tuple:
    """What the features of a candidate of digits depend on: its signs and sizes of groups, its checks, the word before."""
    part = text[start:end]
    groups = part.translate(_SIGNS).split()
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    checked = 14 <= sum(map(len, groups)) <= 19 and luhn("".join(groups))
    return part.translate(_ZEROS), checked, octets, len(groups[0]) == 4 and groups[0][:2] in ("19", "20"), hint


def _digit_features(shape: tuple) -> list[str]:
    """Features of a whole candidate; each weight is for a kind and one of these."""
    masked, passes, octets, year, hint = shape
    sizes = [len(g) for g in masked.translate(_SIGNS).split()]
    n, between = sum(sizes), "".join(sorted(set(masked) - {"0"}))
    out = ["any", f"n{min(n, 20)}", f"g{len(sizes)}", f"sizes{'-'.join(map(str, sizes[:6]))}", f"signs[{between[:4]}]", f"first{masked[0] if masked[0] in '+(' else 'd'}", f"hint {hint}"]
    if 14 <= n <= 19:
        out.append(f"luhn{int(passes)}")
    if len(sizes) == 4:
        out.append(f"octets{int(octets)}")
    return [*out, "year"] if year else out


def _form(sign: str) -> str:
    """Of a sign in an address: spelt or not, in brackets or not, and with blanks or not."""
    return f"{'word' if sign.strip('[](){}<> ').isalpha() else 'sign'}{'()' if sign.strip()[0] in '[({<' else ''}{'_' if ' ' in sign else ''}"


def _address_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate address."""
    local, sign, domain = _SPLIT_SIGN.split(text[start:end], maxsplit=1)
    parts = _SPLIT_DOT.split(domain)
    dots = sorted({_form(d) for d in parts[1::2]})
    before = sum(_form(d).startswith("word") for d in _SPLIT_DOT.split(local)[1::2])
    last = parts[-1]
    out = ["spelt", f"at {_form(sign)}", *(f"dot {d}" for d in dots), f"at {_form(sign)} dot {dots[0]}", f"top {last.lower() in _TOP}", f"parts{len(parts) // 2}", f"words before{before}", f"more before{int(bool(_LOCAL_BEFORE.search(text, max(0, start - 60), start)))}"]
    out += [f"more after {m[0][len(_split(m[0])):].lower() in _TOP}" if (m := _DOMAIN_PART.match(text, end)) else "no more after", f"hint {_hint(text, start)}"]
    return [*out, "sentence"] if any(d.endswith(". ") for d in parts[1::2]) else out


def _split(part: str) -> str:
    return _SPLIT_DOT.match(part)[0]


def _outside(text: str, start: int, end: int) -> bool:
    return (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The entities that a stretch could hold: runs of up to MAX_GROUPS of its groups, with an opening sign or without."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    out = []
    for i, (a, _) in enumerate(groups):
        opened = a - 1 if a > start and text[a - 1] in "+(" else a
        if opened - 1 >= start and text[opened - 1] == "+":
            opened -= 1
        for _, b in groups[i : i + MAX_GROUPS]:
            if b - a >= 7 and _outside(text, a, b):
                out += [(a, b)] if opened == a else [(a, b), (opened, b)]
    return out


def spelt(text: str) -> Iterator[tuple[int, int]]:
    """The spelt addresses that a text could hold: round each sign, all its starts with all its ends."""
    m = _SIGN.search(text)
    while m:
        starts, ends, at = [], [], m.end()
        if local := _LOCAL_PART.search(text, max(0, m.start() - 41), m.start()):
            starts.append(local.start())
            while len(starts) < 3 and (local := _LOCAL_BEFORE.search(text, max(0, starts[-1] - 60), starts[-1])):
                starts.append(local.start())
        while len(ends) < 3 and (part := _DOMAIN_PART.match(text, at)):
            at = part.end()
            ends.append(at)
        yield from ((a, b) for a in starts for b in ends)
        m = _SIGN.search(text, m.start() + 1)


class Field:
    """Weights by (kind, feature), and the choice of segments."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}
        self.shapes: dict[tuple, tuple[str, float]] = {}

    def score(self, kind: str, features: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def judged(self, text: str, start: int, end: int, hint: str) -> tuple[str, float]:
        """The best kind of a candidate, with its score; shapes seen before are looked up."""
        if not _PLAIN.fullmatch(text, start, end):
            features = _address_features(text, start, end)
            return max(((k, self.score(k, features)) for k in KINDS), key=lambda x: x[1])
        shape = _shape(text, start, end, hint)
        if (found := self.shapes.get(shape)) is None:
            if len(self.shapes) >= _KEPT_SHAPES:
                self.shapes.clear()
            features = _digit_features(shape)
            found = self.shapes[shape] = max(((k, self.score(k, features)) for k in KINDS), key=lambda x: x[1])
        return found

    def best(self, text: str, spans: list[tuple[int, int]]) -> list[Span]:
        """The segmentation of the highest score: over the ends in order, the best so far with or without a last entity."""
        ends, totals, back = [-1], [0.0], [None]
        hints = {a: _hint(text, a) for a in {a for a, _ in spans}}
        for a, b in sorted(spans, key=lambda s: (s[1], s[0])):
            kind, score = self.judged(text, a, b, hints[a])
            if score <= 0:
                continue
            j = len(ends) - 1
            while ends[j] > a:
                j -= 1
            if totals[j] + score > totals[-1]:
                ends.append(b)
                back.append((j, (kind, a, b)))
                totals.append(totals[j] + score)
        out, j = [], len(ends) - 1
        while back[j] is not None:
            j, span = back[j]
            out.append(span)
        return out[::-1]

    def gradient(self, spans: list[tuple[int, int]], features: list[list[str]], gold: set[Span]) -> dict[tuple[str, str], float]:
        """Of the log-likelihood of the gold segmentation: its features less those expected under the field."""
        order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
        points = sorted({0, *(p for s in spans for p in s)})
        at = {p: i for i, p in enumerate(points)}
        scores = {(i, k): self.score(k, features[i]) for i in order for k in KINDS}
        forward, backward = [0.0] * len(points), [0.0] * len(points)

        def log_sum(values: list[float]) -> float:
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        for p in range(1, len(points)):
            forward[p] = log_sum([forward[p - 1], *(forward[at[spans[i][0]]] + scores[i, k] for i in order if at[spans[i][1]] == p for k in KINDS)])
        for p in range(len(points) - 2, -1, -1):
            backward[p] = log_sum([backward[p + 1], *(backward[at[spans[i][1]]] + scores[i, k] for i in order if at[spans[i][0]] == p for k in KINDS)])
        out: dict[tuple[str, str], float] = {}
        for i in order:
            for k in KINDS:
                a, b = spans[i]
                share = ((k, a, b) in gold) - math.exp(forward[at[a]] + scores[i, k] + backward[at[b]] - forward[-1])
                for f in features[i]:
                    out[k, f] = out.get((k, f), 0.0) + share
        return out


def stretches(n: int, seed: int = 11) -> Iterator[tuple[str, set[Span]]]:
    """Generated stretches with the spans that they hold, and others that look alike and hold none."""
    draw = random.Random(seed)
    d = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    name = lambda k: "".join(draw.choice("abcdefghilmnoprstuv") for _ in range(draw.randint(3, k)))
    top = lambda: draw.choice(sorted(_TOP))

    def card(sep: str) -> str:
        body = draw.choice("3456") + d(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def cased(text: str) -> str:
        return draw.choice([text, text, text.upper(), text.title()])

    octet = lambda: str(draw.randint(1, 255))
    address = [
        lambda: f"{name(8)} at {name(8)} dot {top()}", lambda: f"{name(8)}.{name(5)} [at] {name(8)} [dot] {top()}", lambda: f"{name(8)}(at){name(8)}.{top()}", lambda: f"{name(6)}{d(2)} at {name(8)} dot {name(7)} dot {top()}",
        lambda: f"{name(8)}[at]{name(8)}[dot]{top()}", lambda: f"{name(8)} <at> {name(8)} <dot> {top()}", lambda: f"{name(8)}{{at}}{name(8)}{{dot}}{top()}", lambda: f"{name(8)}@{name(8)} dot {top()}", lambda: f"{name(8)} (@) {name(8)} . {top()}",
        lambda: f"{name(8)} dot {name(8)} at {name(8)} dot {top()}", lambda: f"{name(8)}[dot]{name(8)}[at]{name(8)}[dot]{top()}", lambda: f"{name(8)} @ {name(8)} . {top()}", lambda: f"{name(8)} [at] {name(8)}.{name(7)}.{top()}", lambda: f"{name(8)}{d(4)} (at) {name(8)} (dot) {top()}",
    ]
    none = [
        lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}.{d(4)}", lambda: d(draw.randint(9, 19)), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)} {d(2)}",
        lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", lambda: f"{d(5)} {d(5)}", lambda: f"look at {name(8)}.{top()}", lambda: f"was at {name(6)}.{top()}", lambda: f"{name(7)} at {name(7)}. {name(7).title()}",
        lambda: f"1999-2004 {d(4)}", lambda: f"{name(7)} at {name(7)}. {top().title()} {name(5)}", lambda: f"{name(7)} at {name(5)}. {name(4)}", lambda: f"{name(7)}at. {name(7).title()}", lambda: f"{name(7)} at {name(5)} dot {name(7)}", lambda: " ".join(d(2) for _ in range(draw.randint(4, 14))), lambda: f"{name(7)} @ {name(7)}. {name(7).title()}",
    ]
    makers = {
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}"],
        "card": [lambda: card("."), lambda: card("/"), lambda: card(" . ")],
        "ip": [lambda: f"{octet()} . {octet()} . {octet()} . {octet()}", lambda: f"{octet()}-{octet()}-{octet()}-{octet()}"],
        "email": [lambda m=m: cased(m()) for m in address],
        "": none,
    }
    hints = {"phone": ["call", "phone", "tel"], "card": ["card", "visa"], "ip": ["host", "ip", "server"], "email": ["write", "mail", "contact"], "": ["order", "invoice", "version", "on", "date"]}
    for _ in range(n):
        kind = draw.choice(["phone", "card", "ip", "email", "email", "", "", ""])
        before = draw.choice([draw.choice(hints[kind]), name(7), name(7)])
        part = draw.choice(makers[kind])()
        text = f"{before} {part}{draw.choice(['', ' ', ' ', '. '])}{name(7)}" if draw.random() < 0.8 and not part[-1].isdigit() else f"{before} {part} {name(7)}"
        text = text if not text[len(before) + 1 + len(part)].isalnum() else f"{before} {part} {name(7)}"
        start = len(before) + 1
        yield text, ({(kind, start, start + len(part))} if kind else set())


def _free(spans: list[Span] | tuple):
    """Whether none of the spans, given by start, meets a place: a search among the starts, then the largest end before."""
    starts = [s for _, s, _ in spans]
    ends = list(itertools.accumulate((e for _, _, e in spans), max))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or ends[i - 1] <= a

    return free


def lattices(text: str, taken: list[Span] | tuple = ()) -> Iterator[list[tuple[int, int]]]:
    """The candidates that base spans leave, in groups that don't meet; a group is a lattice of its own."""
    free = _free(taken)
    spans = {s for m in _STRETCH.finditer(text) for s in candidates(text, *m.span())}
    spans.update(spelt(text))
    group: list[tuple[int, int]] = []
    reach = 0
    for s in sorted(spans):
        if not free(*s):
            continue
        if group and s[0] >= reach:
            yield group
            group = []
        group.append(s)
        reach = max(reach, s[1])
    if group:
        yield group


@functools.lru_cache(1)
def fitted() -> Field:
    """The field, fitted on STRETCHES generated stretches by stochastic gradient."""
    field = Field()
    rows = []
    for text, gold in stretches(STRETCHES):
        for spans in lattices(text):
            features = [_digit_features(_shape(text, *s, _hint(text, s[0]))) if _PLAIN.fullmatch(text, *s) else _address_features(text, *s) for s in spans]
            rows.append((spans, features, gold))
    for epoch in range(EPOCHS):
        for spans, features, gold in rows:
            for key, g in field.gradient(spans, features, gold).items():
                if g:
                    field.weights[key] = field.weights.get(key, 0.0) * (1 - 1e-4) + RATE / (1 + epoch) * g
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and the field's), both in order."""
    base = base_spans(text)
    added = [s for spans in lattices(text, base) for s in field.best(text, spans)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _weights(field: Field) -> list[tuple[str, str, float]]:
    return [(k, f, w) for (k, f), w in field.weights.items() if abs(w) > 1e-3]


def _loaded(weights: list[tuple[str, str, float]]) -> Field:
    field = Field()
    field.weights = {(k, f): w for k, f, w in weights}
    return field


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans."""
    weights = docs.sparkSession.sparkContext.broadcast(_weights(fitted()))

    def run(batches):
        field = _loaded(weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column("text"):
                    base, every = all_spans(text.as_py() or "", field)
                    rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of the first's kind."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in text, and n_chars, if there is such a column, counted anew."""
    weights = docs.sparkSession.sparkContext.broadcast(_weights(fitted()))

    def run(batches):
        field = _loaded(weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for text in part.column("text"):
                    text = text.as_py()
                    spans = all_spans(text, field)[1] if text else []
                    texts.append(redact(text, spans) if spans else text)
                yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
        trim()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
