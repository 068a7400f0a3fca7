"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail and IP addresses, card numbers that pass their check digit, and
international phone numbers. The field finds what they miss (numbers without a country code,
numbers that run into their neighbours, addresses written "name (at) host (dot) org"). It is trained
from the small labelled table below and decoded by Viterbi in numpy batches.

The whole text is searched for triggers (digits, @, and the spelt-out signs); the field reads
the words around each. Elsewhere nothing can begin a span: every kind holds a trigger. Spans of
the field never overlap or replace those of the patterns.

Spans count code points, end exclusive. Null texts count as empty and have no spans; equal
texts have equal spans; an empty table gives no rows. Other columns are ignored or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import require_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# -- patterns ----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match that could start within a run of digits could start at the run's first digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with its longest local part before and domain after; linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail its check."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


# -- the field -----------------------------------------------------------------------------

#: The labelled table: # is a digit, w a word; spans stand in <kind ...>.
LABELLED = (
    "w w <email w.##@w#.w.com> w w.",
    "w w, <email w@w.org>, w w",
    "w: <email w (at) w (dot) com> w w",
    "w w <email w.w (at) w (dot) org>. w",
    "w <email w [at] w [dot] net> w w w",
    "w w <email w##[at]w[dot]com> w",
    "w w <email w (at) w.com> w w",
    "w <email w at w dot com> w w",
    "<email w.w at w dot fr> w",
    "<email w.w (at) w.net>, w",
    "w w w <email w.w at w dot org>, w",
    "W W <email W.##@W#.W.COM>!! W W",
    "w w <email w at w dot de> w w",
    "w <email w.w at w dot fr>. W w",
    "w w: <email w at w dot es>, w",
    "w <email w (at) w (dot) de> w w",
    "w w <email w.w [at] w [dot] fr> w",
    "w, <email w## at w dot es> w",
    "w w <email w at w dot w dot com> w",
    "w <email w AT w DOT com> w w",
    "<email w at w dot de>",
    "<email w at w dot com>.",
    "<email w.w at w dot org> w w w",
    "w w w: <email w at w dot fr>",
    "w <email w arroba w punto es> w w",
    "w w <email w.w arroba w punto com>, w",
    "<email w arroba w punto es>",
    "w: <email w (arroba) w (punto) es> w",
    "w <email w arobase w point fr> w w",
    "w w <email w.w arobase w point com>. W",
    "<email w arobase w point fr>",
    "w w <email w (arobase) w (point) fr> w",
    "w <email w at w punkt de> w w",
    "w w <email w (at) w (punkt) de>, w",
    "w w <ip ##.###.##.#> w w",
    "w w <ip ###.###.###.###>, w",
    "w w <ip #.##.###.##>. W w",
    "w <ip ##.##.#.##>:#### w w",
    "w w <card ################> w w",
    "w, w <card ################>. W w",
    "w w <card #### #### #### ####> w w",
    "w w <card ####-####-####-####>, w",
    "w <card #### ###### #####> w",
    "w w <card ###############> w w",
    "W W <card ################>!! W",
    "w <card ################> <card ################> w",
    "w w <card #############> w",
    "w | <card ################> | w | w",
    "w$$$ <card ################>&&& w%%%",
    "w w <phone +# (###) ###-####> w w",
    "w <phone +## ## #######> w w.",
    "w w <phone (###) ###-####> w w",
    "w w <phone (###) ###-####>. W w",
    "w w <phone ###-###-####> w w",
    "w w, <phone ###-###-####>, w",
    "w w <phone ###.###.####> w w",
    "w w <phone ### ### ####> w w",
    "w: <phone ###-###-####> w",
    "w <phone 00## ## #######> w w",
    "w <phone # (###) ###-####> w",
    "w w <phone 0### #######> w w",
    "w <phone 0### ########>, w",
    "w: <phone 0##/#######> w w",
    "w w <phone 0## #######> w",
    "w <phone 0###-#######>. W w",
    "w w <phone (0##) #######> w",
    "w <phone 0# ## ## ## ##> w w",
    "w w <phone 0#.##.##.##.##>, w",
    "<phone 0### #######>",
    "w w: <phone 0# ## ## ## ##>",
    "w <phone #-###-###-####> w w",
    "w%%% <phone (###) ###-####>&&& w$$$",
    "W W!! <phone (###) ###-####>!! W",
    "w | <phone ###-###-####> | w",
    "<phone +# (###) ###-####> <card ################> w",
    "<phone +# (###) ###-####> w w w",
    "w <phone +# (###) ###-####> <phone +# (###) ###-####> w",
    "w <ip ##.###.#.##> <card ################> w",
    "<phone (###) ###-####> w w",
    "<card ################> <phone +# (###) ###-####> w",
    "<ip ##.###.##.#> w w",
    # Numbers that are no personal data.
    "w w 19## w w 20##, w",
    "w w ## w w",
    "w ### w, ## w #",
    "w w #,### w w ##.# w",
    "w ##.##.20## w w",
    "w 20##-##-## w w ##:## w",
    "w w v#.#.# w w",
    "w (19##) w w (w, 20##)",
    "w w $##.## w ##% w",
    "w [#] w w [##], w",
    "w w ##-## w w ###-### w",
    "# w w\n## w w\n### w",
    "w token = \"##w#w##w####w#w##\" w w",
    "w w ##### w w ######",
    "w w #######, w w ########",
    "w https://w.w.com/w/#### w",
    "w §## w (#) w #.# w w",
    "w w @w w w #w w",
    "w @ w w @w",
    "w w (w at w) w dot w w",
    "w at w w, w at ## w",
    "w w dot de w w es w",
    "w de w dot w fr w",
    "w w at w de w. W w",
    "w w at the dot com w w w w",
    "w at the dot w w, w w",
    "w at a dot com w w",
    "w w point de w w, w point w",
    "w punto de w w en el punto es w",
    "w w Punkt der w w. W",
    "w w at w, w the dot w",
    "w 0,## w w 0.### w",
    "w w 0## w w w 0#",
    "w ##0 ##0 w #0 0## w",
    "w w w dot com w w",
    "w ###### w #### w w ### w ## w",
    "w 20##.##.##.## w",
    "w ## ## w ### ### w",
)
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: Fixed words that carry meaning for the field; all others count by their shape only.
LEXICON = (
    "at", "dot", "com", "org", "net", "de", "fr", "es", "http", "https", "www", "v", "token", "arroba", "arobase", "punto", "point", "punkt",
    "the", "a", "der", "el", "le",
)
#: Signs that are spelt out, and words that name no domain or person.
AT_SIGN, DOT_SIGN = ("at", "arroba", "arobase"), ("dot", "punto", "point", "punkt")
NO_NAME = frozenset("the a an der die das el la lo le les un une en de du des y et und and or at dot".split())
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: What every span holds: a digit, an @, or one of the spelt-out signs, before any ending.
_TRIGGER = re.compile(rf"[0-9@]|[(\[](?:{'|'.join(AT_SIGN + DOT_SIGN)})[)\]]|(?<![^\W_])(?:{'|'.join(DOT_SIGN)}) [A-Za-z]{{2}}", re.I)
REACH = 40
OFFSETS = range(-3, 4)


def shape(token: str) -> str:
    """Digits by their number; letters by case and length; other signs stand for themselves."""
    if token[0] in "0123456789":
        return f"d{min(len(token), 20)}" + ("z" if token.startswith("00") else "o" if token[0] == "0" and len(token) > 1 else "")
    if token[0].isalpha():
        case = "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "x"
        return case + str(min(len(token), 3))
    return token


def tokenise(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


@dataclass
class Field:
    """Emission weights by attribute and offset, transition and start weights."""

    attributes: dict[str, int]
    emit: np.ndarray  # offsets x attributes x labels
    step: np.ndarray  # labels x labels
    start: np.ndarray

    def numbers(self, text: str, spans: Sequence[tuple[int, int]]) -> np.ndarray:
        """Three attributes of each token: its shape, its word, whether a space stands before."""
        get, words = self.attributes.get, frozenset(LEXICON)
        out = np.zeros((len(spans), 3), np.int64)
        end = -1
        for i, (a, b) in enumerate(spans):
            t = text[a:b]
            low = t.lower()
            out[i, 0] = get("s:" + shape(t), 0)
            out[i, 1] = get("w:" + low, 0) if low in words else 0
            out[i, 2] = get("gap", 0) if a != end else 0
            end = b
        return out

    def emissions(self, batch: np.ndarray) -> np.ndarray:
        """batch: sequences x length x 3, padded by -1; attribute 0 is unknown and weighs nothing."""
        n, size, _ = batch.shape
        total = np.zeros((n, size, len(LABELS)))
        edge = self.attributes["edge"]
        for k, o in enumerate(OFFSETS):
            for c in range(3):
                moved = np.full((n, size), edge if c == 0 else 0)
                if abs(o) < size:
                    moved[:, max(0, -o) : size - max(0, o)] = batch[:, max(0, o) : size + min(0, o), c]
                moved[moved < 0] = edge if c == 0 else 0
                total += self.emit[k][moved]
        return total

    def viterbi(self, batch: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best label of each token, for all sequences of the batch at once."""
        e = self.emissions(batch)
        n, size, k = e.shape
        best = self.start + e[:, 0]
        back = np.zeros((n, size, k), np.int8)
        for t in range(1, size):
            all_ = best[:, :, None] + self.step
            back[:, t] = all_.argmax(1)
            new = all_.max(1) + e[:, t]
            # Beyond a sequence's end its state stays.
            live = (t < sizes)[:, None]
            back[:, t] = np.where(live, back[:, t], np.arange(k))
            best = np.where(live, new, best)
        path = np.zeros((n, size), np.int8)
        path[:, -1] = best.argmax(1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path


def expand(seed: int = 3, times: int = 8) -> list[tuple[str, list[Span]]]:
    """Texts and their spans from the labelled table, with drawn digits and words."""
    rng = np.random.default_rng(seed)
    syllables = ("an", "er", "th", "in", "ou", "re", "on", "lé", "ti", "ß", "en", "ñ")
    out = []
    for line in LABELLED * times:
        text, spans, kind, start, i = "", [], "", 0, 0
        while i < len(line):
            c = line[i]
            if c == "<" and (m := re.match(r"<(email|ip|card|phone) ", line[i:])):
                kind, start = m[1], len(text)
                i += m.end()
                continue
            if c == ">" and kind:
                spans.append((kind, start, len(text)))
                kind = ""
            elif c == "#":
                text += str(rng.integers(0, 10))
            elif c in "wW" and not (line[i - 1 : i].isalpha() or line[i + 1 : i + 2].isalpha()):
                word = "".join(rng.choice(syllables, rng.integers(1, 4)))
                text += word.upper().replace("SS", "S") if c == "W" and "W W" in line else word.capitalize() if c == "W" else word
            else:
                text += c
            i += 1
        out.append((text, spans))
    return out


def pad(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    batch = np.full((len(rows), int(sizes.max()), 3), -1, np.int64)
    for i, r in enumerate(rows):
        batch[i, : len(r)] = r
    return batch, sizes


def train(examples: Sequence[tuple[str, list[Span]]], epochs: int = 60, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Penalised maximum likelihood by full-batch Adam; forward-backward over padded batches."""
    attributes: dict[str, int] = {"": 0, "edge": 1, "gap": 2}
    for text, _ in examples:
        for a, b in tokenise(text):
            attributes.setdefault("s:" + shape(text[a:b]), len(attributes))
    for w in LEXICON:
        attributes.setdefault("w:" + w, len(attributes))
    k = len(LABELS)
    field = Field(attributes, np.zeros((len(OFFSETS), len(attributes), k)), np.zeros((k, k)), np.zeros(k))
    rows, gold = [], []
    for text, spans in examples:
        tokens = tokenise(text)
        y = np.zeros(len(tokens), np.int64)
        for kind, a, b in spans:
            first = True
            for i, (s, e) in enumerate(tokens):
                if s >= a and e <= b:
                    y[i] = LABELS.index(("B-" if first else "I-") + kind)
                    first = False
        rows.append(field.numbers(text, tokens))
        gold.append(y)
    batch, sizes = pad(rows)
    n, size, _ = batch.shape
    live = np.arange(size) < sizes[:, None]
    y = np.zeros((n, size), np.int64)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    onehot = np.eye(k)[y] * live[..., None]
    gold_step = np.einsum("ntk,ntl->kl", onehot[:, :-1], onehot[:, 1:])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.step, field.start)]
    edge = attributes["edge"]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for it in range(1, epochs + 1):
        e = field.emissions(batch)
        alpha = np.zeros((n, size, k))
        alpha[:, 0] = field.start + e[:, 0]
        for t in range(1, size):
            new = lse(alpha[:, t - 1][:, :, None] + field.step, 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t][:, None], new, alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        beta = np.zeros((n, size, k))
        expected_step = np.zeros((k, k))
        for t in range(size - 1, 0, -1):
            inner = field.step + (e[:, t] + beta[:, t])[:, None, :]
            on = live[:, t][:, None]
            both = np.exp(alpha[:, t - 1][:, :, None] + inner - z[:, None, None]) * on[..., None]
            expected_step += both.sum(0)
            beta[:, t - 1] = np.where(on, lse(inner, 2), 0)
        prob = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        off = prob - onehot
        grad = np.zeros_like(field.emit)
        for j, o in enumerate(OFFSETS):
            for c in range(3):
                moved = np.full((n, size), edge if c == 0 else 0)
                if abs(o) < size:
                    moved[:, max(0, -o) : size - max(0, o)] = batch[:, max(0, o) : size + min(0, o), c]
                moved[moved < 0] = edge if c == 0 else 0
                np.add.at(grad[j], moved[live], off[live])
        grad[:, 0] = 0
        grads = (grad, expected_step - gold_step, off[:, 0].sum(0))
        for p, g, (m, v) in zip((field.emit, field.step, field.start), grads, moments):
            g = g / n + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    field.emit[:, 0] = 0
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained from the labelled table (a few seconds, once a driver)."""
    return train(expand())


_DOT_WORD = re.compile(rf"(?<![^\W_])(?:{'|'.join(DOT_SIGN)})(?![^\W_])", re.I)
_ANY_DOT = rf"(?:\.|\s*[(\[]?\s*(?:{'|'.join(DOT_SIGN)})\s*[)\]]?\s*)"
_SPELT = re.compile(rf"([\w.+-]*\w)\s*[(\[]?\s*(?<![^\W_])(?:{'|'.join(AT_SIGN)})\s*[)\]]?\s*([\w-]+)(?:{_ANY_DOT}[\w-]+)*{_ANY_DOT}[A-Za-z]{{2,}}", re.I)
_NUMBER = re.compile(r"\+?[0-9(][0-9() ./-]*[0-9]")


def plausible(kind: str, text: str, before: str = "", after: str = "") -> bool:
    """An exact check on what the field found; before and after: the characters beside it."""
    digits = _NOT_DIGIT.sub("", text)
    if kind != "email":
        if before.isalnum() or after.isalnum() or not _NUMBER.fullmatch(text):
            return False
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return text.count(".") == 3 and len(digits) >= 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if "@" in text:
        return "." in text or bool(_DOT_WORD.search(text))
    # Spelt out: a name, a sign, a domain with an ending after a dot; no article or conjunction is one.
    m = _SPELT.fullmatch(text)
    return bool(m) and m[1].lower() not in NO_NAME and m[2].lower() not in NO_NAME


def windows(text: str) -> list[tuple[int, int]]:
    """Merged ranges of REACH characters around each trigger, widened to white space (at most
    by as much again)."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    wide = []
    for a, b in out:
        low, high = max(0, a - REACH), min(len(text), b + REACH)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < high and not text[b].isspace():
            b += 1
        if wide and a <= wide[-1][1]:
            wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
        else:
            wide.append((a, b))
    return wide


def field_spans(texts: Sequence[str], field: Field, base: Sequence[list[Span]], batch_tokens: int = 1 << 15) -> list[list[Span]]:
    """What the field finds in each text beside its base spans."""
    jobs = []
    for k, text in enumerate(texts):
        for a, b in windows(text):
            spans = [(a + x, a + y) for x, y in tokenise(text[a:b])]
            if spans:
                jobs.append((k, spans, field.numbers(text, spans)))
    jobs.sort(key=lambda j: len(j[1]))
    out: list[list[Span]] = [[] for _ in texts]
    i = 0
    while i < len(jobs):
        j = i + 1
        while j < len(jobs) and len(jobs[j][1]) * (j - i + 1) <= batch_tokens:
            j += 1
        path = field.viterbi(*pad([job[2] for job in jobs[i:j]]))
        for (k, spans, _), labels in zip(jobs[i:j], path):
            at = 0
            while at < len(spans):
                name = LABELS[labels[at]]
                if name == "O":
                    at += 1
                    continue
                kind, end = name[2:], at + 1
                while end < len(spans) and LABELS[labels[end]] == "I-" + kind:
                    end += 1
                a, b = spans[at][0], spans[end - 1][1]
                if plausible(kind, texts[k][a:b], texts[k][max(0, a - 1) : a], texts[k][b : b + 1]) and not any(a < y and x < b for _, x, y in base[k]):
                    out[k].append((kind, a, b))
                at = end
        i = j
    return out


def find(texts: Sequence[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed, then start."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = [base_spans(t) for t in texts]
    more = field_spans(texts, field, base)
    key = lambda s: (order[s[0]], s[1])
    return [(sorted(b, key=key), sorted(b + m, key=key)) for b, m in zip(base, more)]


def span_text(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: Sequence[Span]) -> str:
    """Each span becomes its kind in angle brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), field: Field | None = None) -> DataFrame:
    """The ``keep`` columns with ``base`` and ``spans``, arrays of (kind, start, end)."""
    require_columns(docs, [text, *keep])
    sent = docs.sparkSession.sparkContext.broadcast(field or default_field())
    item = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 512):
                few = part.slice(i, 512)
                got = find([t or "" for t in few.column(few.num_columns - 1).to_pylist()], sent.value)
                cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in g[c]] for g in got], arrow) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*few.columns[:-1], *cols], names=[*few.schema.names[:-1], "base", "spans"])

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("raw"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("base", item), T.StructField("spans", item)])
    return plain.mapInArrow(run, schema).toDF(*keep, "base", "spans")


def mask(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """The same rows and columns with all spans of the text redacted; null texts stay null."""
    require_columns(docs, [text])
    sent = docs.sparkSession.sparkContext.broadcast(field or default_field())
    names, at = docs.columns, docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = part.column(at).to_pylist()
            texts: list[str | None] = []
            for i in range(0, len(raw), 512):
                few = raw[i : i + 512]
                found = find([t or "" for t in few], sent.value)
                texts += [None if t is None else redact(t, spans) for t, (_, spans) in zip(few, found)]
            cols = [pa.array(texts, part.schema.field(at).type) if i == at else part.column(i) for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
