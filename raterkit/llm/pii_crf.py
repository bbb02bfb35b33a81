"""Personal data: exact base patterns, and a linear-chain conditional random field on top.

Base spans follow fixed patterns (email, IP address, payment card with check digit, phone
number), leftmost and non-overlapping per kind; they are always kept. The field adds spans of
the same kinds in forms that the patterns miss: phone numbers without a country code, addresses
spelt with "at" and "dot", cards with a wrong check digit, IP addresses with a part over 255.

Tokens are runs of letters or digits and single symbols; a token is known by its word shape
(kind, case, length class, space before) and by being one of a few ``CUES`` (at, dot, tel ...).
The field has a weight per label and shape at five offsets and one per pair of labels
(begin/inside tags of each kind and outside); a shape never labelled as part of a kind cannot
become one. It is trained by Adam on the conditional likelihood over a small labelled table,
``labelled_table``: marked examples of each form, and numbers and words that are none (dates,
prices, versions, references), with digits and words drawn by a fixed seed. So the model is the
same whatever the corpus. Decoding is Viterbi over lines (no kind spans a line break) in numpy
batches; every line is looked at. A token whose shape no kind has is outside whatever stands
around it, so a line falls into stretches between such tokens, which are decoded on their own
with the same result; stretches in which no token can gain from leaving the outside label are
outside throughout. Both are exact, and a long line is no large matrix.

Null and empty texts have no spans. Repeated rows give repeated results. Added spans never overlap
base spans, their labels must beat leaving them outside by ``MIN_GAIN`` in log odds, they must
have as many digits as their kind needs (``DIGITS``), and an address must have one @ or word at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.tables import table

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 12  # of each form in the labelled table
DIGITS = {"email": (0, 99), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}  # of an added span
MIN_GAIN = 2.0
EPOCHS = 30
RATE = 0.1
DECAY = 1e-3

Span = tuple[int, int, str]

# --- base patterns ----------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile("[0-9]").search


def _emails(text: str) -> list[Span]:
    """From each @ backwards over the local part: linear, where a search from the left is not."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans (start, end, kind) by start, then kind as listed in ``KINDS``."""
    out = _emails(text)
    if _DIGIT(text):
        if "." in text:
            for m in _IP(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in _CARD(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# --- tokens and word shapes -------------------------------------------------------------

_SYMBOLS = "@.-+():/_=\"'#%&*$!?,|;"
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_DIGIT_CLASS = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 8])  # by length, 17 and more last
_LETTER_CLASS = np.array([0, 0, 1, 1, 2, 2, 2, 2, 2, 3])
CUES = ("at", "dot", "tel", "phone", "call", "fax", "mobile", "ip", "host", "server", "card", "visa", "email", "mail", "com", "org", "net")
_FIRST_CUE = 16 + 9 + 1 + len(_SYMBOLS)
SHAPES = 2 * (_FIRST_CUE + len(CUES)) + 1  # the last one stands beyond the ends of a line
_BEYOND = SHAPES - 1
_tables: tuple[np.ndarray, np.ndarray] | None = None
_CUE_CODES = np.array([int.from_bytes(c.encode(), "little") for c in CUES], dtype=np.uint64)
_CUE_ORDER = np.argsort(_CUE_CODES)


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character (space, letter, digit, other, then the symbols), and upper case."""
    global _tables
    if _tables is None:
        kinds, upper = np.full(0x110000, _OTHER, np.uint8), np.zeros(0x110000, np.uint8)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isspace():
                kinds[c] = _SPACE
            elif ch.isalpha():
                kinds[c] = _LETTER
                upper[c] = ch.isupper()
        kinds[48:58] = _NUMBER
        for k, ch in enumerate(_SYMBOLS):
            kinds[ord(ch)] = _OTHER + 1 + k
        _tables = kinds, upper
    return _tables


@dataclass
class Tokens:
    """Starts, ends (in the chunk's characters) and shapes of the tokens; first token of each line."""

    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray
    lines: np.ndarray


def tokens(points: np.ndarray) -> Tokens:
    kinds, upper = _char_tables()
    k = kinds[points]
    first = np.empty(len(k), dtype=bool)
    first[0] = True
    np.not_equal(k[1:], k[:-1], out=first[1:])
    first |= k >= _OTHER
    at = np.flatnonzero(first)
    end = np.concatenate((at[1:], [len(k)]))
    kind = k[at].astype(np.int64)
    is_token = kind != _SPACE
    space_before = np.concatenate(([True], ~is_token[:-1]))[is_token]
    at, end, kind = at[is_token], end[is_token], kind[is_token]
    length = end - at
    capitals = np.concatenate(([0], np.cumsum(upper[points], dtype=np.int64)))
    n_upper = capitals[end] - capitals[at]
    case = np.where(n_upper == 0, 0, np.where(n_upper == length, 1, np.where((n_upper == 1) & (upper[points[at]] == 1), 2, 3)))
    shape = np.where(
        kind == _LETTER, 4 * case + _LETTER_CLASS[np.minimum(length, 9)],
        np.where(kind == _NUMBER, 16 + _DIGIT_CLASS[np.minimum(length, 17)], 25 + kind - _OTHER),
    )
    short = np.flatnonzero((kind == _LETTER) & (length <= 6))
    code = np.zeros(len(short), dtype=np.uint64)
    for i in range(6):  # letters of a short word as one number, in lower case
        has = length[short] > i
        c = points[np.minimum(at[short] + i, len(points) - 1)].astype(np.uint64)
        code |= np.where(has, np.where(c < 128, c | np.uint64(32), np.uint64(255)), np.uint64(0)) << np.uint64(8 * i)
    place = _CUE_ORDER[np.minimum(np.searchsorted(_CUE_CODES, code, sorter=_CUE_ORDER), len(CUES) - 1)]
    cue = _CUE_CODES[place] == code
    shape[short[cue]] = _FIRST_CUE + place[cue]
    breaks = np.flatnonzero(points == 10)
    lines = np.unique(np.searchsorted(at, np.concatenate(([0], breaks))))
    return Tokens(at, end, 2 * shape + space_before, lines[lines < len(at)])


# --- the field --------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
OFFSETS = (-2, -1, 0, 1, 2)
_NEVER = -1e4


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a number that no path can make up for."""
    rule = np.zeros((LABELS, LABELS))
    for inside in range(2, LABELS, 2):
        rule[:, inside] = _NEVER
        rule[[inside - 1, inside], inside] = 0
    return rule


@dataclass
class Field:
    """``emit[offset, shape, label]`` and ``move[label, next]``."""

    emit: np.ndarray
    move: np.ndarray

    def gain(self, shapes: np.ndarray, labels: np.ndarray, lo: int, hi: int) -> float:
        """Log odds of the labels of tokens ``lo .. hi - 1`` of a line against leaving them outside."""
        around = np.concatenate(([_BEYOND] * 2, shapes, [_BEYOND] * 2))
        at = np.arange(lo, hi)
        emitted = sum((self.emit[k, around[at + k], labels[at]] - self.emit[k, around[at + k], 0]).sum() for k in range(len(OFFSETS)))
        moved = 0.0
        for i in range(max(lo, 1), min(hi, len(labels) - 1) + 1):
            moved += self.move[labels[i - 1] if i > lo else 0, labels[i] if i < hi else 0] - self.move[0, 0]
        return float(emitted + moved)

    def decode(self, t: Tokens) -> np.ndarray:
        """Best label of every token, line by line."""
        n = len(t.shapes)
        best = np.zeros(n, dtype=np.int8)
        if not n:
            return best
        line_of = np.zeros(n, dtype=np.int64)
        line_of[t.lines[1:]] = 1
        line_of = np.cumsum(line_of)
        shifted = [self._shape_at(t, line_of, o) for o in OFFSETS]
        gain = np.zeros(n)
        lead = (self.emit[:, :, 1:] - self.emit[:, :, :1]).max(axis=2)
        for k in range(len(OFFSETS)):
            gain += lead[k][shifted[k]]
        free = np.where(_allowed() == 0, self.move - self.move[0, 0], -np.inf)
        gain += 2.0 * max(0.0, float(free.max()))
        # a stretch: tokens of one line that may be inside, between tokens that cannot
        able = (self.emit[OFFSETS.index(0), :, 1:] > _NEVER / 2).any(axis=1)[t.shapes]
        first_of_line = np.zeros(n, dtype=bool)
        first_of_line[t.lines] = True
        begins = np.flatnonzero(able & (first_of_line | ~np.concatenate(([False], able[:-1]))))
        ends = np.flatnonzero(able & (np.append(first_of_line[1:], True) | ~np.append(able[1:], False))) + 1
        if not len(begins):
            return best
        bounds = np.stack((begins, ends), axis=1).reshape(-1)
        likely = np.maximum.reduceat(np.append(gain, -np.inf), bounds)[::2] > 0
        begins, ends = begins[likely], ends[likely]
        sizes = ends - begins
        order = np.argsort(sizes, kind="stable")
        begins, ends, sizes = begins[order], ends[order], sizes[order]
        last_of_line = np.append(first_of_line[1:], True)
        at = 0
        while at < len(begins):
            to = at + 1
            while to < len(begins) and (to - at + 1) * sizes[to] <= 20_000 and sizes[to] <= 2 * sizes[at] + 8:
                to += 1
            width = int(sizes[to - 1])
            real = np.arange(width)[None, :] < sizes[at:to, None]
            place = np.where(real, begins[at:to, None] + np.arange(width)[None, :], 0)
            inner = ~first_of_line[begins[at:to]], ~last_of_line[ends[at:to] - 1]
            found = self._viterbi(lambda lo, hi: sum(self.emit[k][shifted[k][place[:, lo:hi]]] for k in range(len(OFFSETS))), real, inner)
            best[place[real]] = found[real]
            at = to
        return best

    @staticmethod
    def _shape_at(t: Tokens, line_of: np.ndarray, offset: int) -> np.ndarray:
        out = np.full(len(t.shapes), _BEYOND)
        n = len(out)
        if abs(offset) >= n and offset:
            return out
        here, there = slice(max(0, -offset), n - max(0, offset)), slice(max(0, offset), n - max(0, -offset))
        out[here] = np.where(line_of[here] == line_of[there], t.shapes[there], _BEYOND)
        return out

    def _viterbi(self, scores, real: np.ndarray, inner: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Best labels of stretches side by side; beyond a stretch's end the state stays as it is.

        ``scores(lo, hi)`` gives the emissions of a range of places, asked for in blocks; ``inner``:
        whether an outside token of the line stands before, and after, each stretch.
        """
        lines, width = real.shape
        move = self.move + _allowed()
        start = np.zeros(LABELS)
        start[2::2] = _NEVER
        back = np.zeros((width, lines, LABELS), dtype=np.int8)
        value = np.where(inner[0][:, None], move[0], start)
        for lo in range(0, width, 2048):
            block = scores(lo, min(width, lo + 2048))
            for i in range(lo, min(width, lo + 2048)):
                if i == 0:
                    value = value + block[:, 0]
                    continue
                paths, inside = value[:, :, None] + move, real[:, i, None]
                back[i] = np.where(inside, paths.argmax(axis=1), np.arange(LABELS))
                value = np.where(inside, paths.max(axis=1) + block[:, i - lo], value)
        value = value + np.where(inner[1][:, None], move[:, 0], 0.0)
        out = np.zeros((lines, width), dtype=np.int8)
        out[:, -1] = value.argmax(axis=1)
        rows = np.arange(lines)
        for i in range(width - 1, 0, -1):
            out[:, i - 1] = back[i][rows, out[:, i]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE) -> Field | None:
    """Maximise the conditional likelihood of ``(shapes, labels)`` windows; None without any span."""
    if not any(labels.any() for _, labels in windows):
        return None
    width = max(len(s) for s, _ in windows)
    shapes = np.full((len(windows), width + 4), _BEYOND)
    labels = np.zeros((len(windows), width), dtype=np.int64)
    real = np.zeros((len(windows), width), dtype=bool)
    for i, (s, y) in enumerate(windows):
        shapes[i, 2 : 2 + len(s)], labels[i, : len(y)], real[i, : len(s)] = s, y, True
    rule, start = _allowed(), np.where(np.arange(LABELS) % 2 + (np.arange(LABELS) == 0), 0.0, _NEVER)
    weights = [np.zeros((len(OFFSETS), SHAPES, LABELS)), np.zeros((LABELS, LABELS))]
    never = np.full((SHAPES, LABELS), _NEVER)  # for shapes not seen with a label
    never[:, 0] = 0.0
    for s, y in windows:
        never[s, y] = 0.0
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rng, step = np.random.default_rng(3), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            emit, move = weights
            s, y, r = shapes[pick], labels[pick], real[pick]
            own = [s[:, k : k + width] for k in range(len(OFFSETS))]
            scores = sum(emit[k][own[k]] for k in range(len(OFFSETS))) + never[own[2]]
            m = move + rule
            forward, backward = np.empty_like(scores), np.zeros_like(scores)
            forward[:, 0] = scores[:, 0] + start
            for i in range(1, width):
                step_on = _log_sum(forward[:, i - 1, :, None] + m, 1) + scores[:, i]
                forward[:, i] = np.where(r[:, i, None], step_on, forward[:, i - 1])
            for i in range(width - 2, -1, -1):
                step_back = _log_sum(m + (scores[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
                backward[:, i] = np.where(r[:, i + 1, None], step_back, 0.0)
            total = _log_sum(forward[:, -1], 1)
            node = np.exp(forward + backward - total[:, None, None])
            node[~r] = 0.0
            expected = -node
            rows, cols = np.nonzero(r)
            expected[rows, cols, y[rows, cols]] += 1.0
            g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
            for k in range(len(OFFSETS)):
                np.add.at(g_emit[k], own[k][r], expected[r])
            for i in range(1, width):
                both = r[:, i]
                if both.any():
                    edge = forward[both, i - 1, :, None] + m + (scores[both, i] + backward[both, i])[:, None, :] - total[both, None, None]
                    g_move -= np.exp(edge).sum(axis=0)
                    np.add.at(g_move, (y[both, i - 1], y[both, i]), 1.0)
            step += 1
            for w, g, mean, square in zip(weights, (g_emit, g_move), means, squares):
                g = g / len(pick) - DECAY * w
                mean *= 0.9
                mean += 0.1 * g
                square *= 0.999
                square += 0.001 * g * g
                w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[0][2] += never
    return Field(*weights)


# --- labelled table ---------------------------------------------------------------------


def _labels(t: Tokens, spans: list[Span]) -> np.ndarray:
    """Begin and inside labels of the tokens within the spans (earlier spans first)."""
    y = np.zeros(len(t.starts), dtype=np.int64)
    for start, end, kind in spans:
        lo, hi = np.searchsorted(t.starts, start), np.searchsorted(t.starts, end)
        if lo < hi and not y[lo:hi].any():
            y[lo:hi] = 2 + 2 * KINDS.index(kind)
            y[lo] -= 1
    return y


# Forms of each kind that the base patterns miss, and text that is none of them. ``0`` stands for a digit,
# ``1`` for a digit from 3 to 9, ``w`` for a word in lower case, ``W`` for one with a capital.
FORMS = {
    "phone": ("(110) 100-0000", "(110)100-0000", "110-100-0000", "110.100.0000", "1-110-100-0000", "010 1000 0000", "0110 100000", "0110 100 000", "0110/1000000",
              "0110-1000000", "+10 100 000", "0010 100 100 0000", "110 100 0000", "(010) 1000 0000", "(0110) 100000"),
    "email": ("w at w dot com", "w.w at w dot org", "w at w dot w", "w.w at w.com", "w (at) w.w", "w(at)w.org", "w [at] w [dot] w", "w.w [at] w.com", "w @ w.net", "w@w",
              "w00 at w dot net", "w (at) w (dot) com"),
    "card": ("1000 0000 0000 0000", "1000-0000-0000-0000", "1000 000000 00000", "1000000000000000"),
    "ip": ("10.0.0.400", "110.116.0.00", "110.00.110.900", "10.00.00.310", "116.110.90.500", "100.900.0.0"),
}
BEFORE = {
    "phone": ("", "", "w ", "call ", "Call w w ", "tel ", "tel. ", "Tel.: ", "phone: ", "W phone ", "w w w fax ", "mobile ", "w at ", "w w, "),
    "email": ("", "w ", "mail ", "email: ", "w w to ", "W w w: ", "w w, "),
    "card": ("", "w ", "card ", "visa ", "w w card: ", "w with ", "W no. "),
    "ip": ("", "w ", "ip ", "host ", "server at ", "W w from ", "w w: ", "w the "),
}
AFTER = ("", "", ".", " w w", ", w w w", " w", "!", " w.", ") w", " and w")
OTHERS = (
    "w w 2010-00-10 w w", "W 10/00/2010, w w", "w 10.00.2010 w w", "w at 10:00 w", "w 10:00:00 w w", "w 2010-00-10T10:00:00 w", "$1,000.00 w w", "1.000,00 w", "w 10,000 w",
    "w 100 000 w", "1 000 000 w w", "version 1.0.0 w", "v1.10.0", "w 1.0.0.0 w", "w w 1.0.1 w", "1.10000 w w", "w w 1990-1990 w", "w (1990) 100-100, w", "W. 10 (0): 100-100",
    "isbn 900-0-10-100000-0 w", "w id 20100010101010 w", "w 100000 w w", "w 10000000 w", "45.0% w w", "pages 10-10 w", "w 10-0 w w", "10 x 10 w", "1/0 w w", "52.1000, 13.1000",
    "img_0000.jpg w", "w #10000 w", "W 1000 w 1000 w 1000", "w 1990 1990 w", "w w 1000, 1000, 1000 w", "(100) w w", "w (10) w w 1000", "no. 1000-100 w", "w at w w w 1000 w w",
    "w w dot w w at w", "W w at w. W w dot w w", "w at the w dot w w w", "the dot at the w", "a dot w w w at w w w", "w at w and w at w, 1000 w", "w 1000 at w w dot", "dot w dot w",
    "w w at 1000 w w", "@ w w 1000", "w @ 10.00 w", "@w w w", "w w @w, w", "1000 w w", "w 10 w 100 w 1000 w 10000", "1000-1000 w", "w w 0000", "w 1000w0w0", "0w000w 1000",
    "w 10 10 10 10 w", "1 0 0 0 0 0 w", "10 100 10 w w w", "w-1000-w 1000", "w w w 1000.", "1000: w w, 1000: w", "|w|1000|10.0|w|", "w,10,1000,w,1.0", "w w 110-100 w", "w 10000 W w",
)
_MARKS = re.compile("[01wW]")


def labelled_table(examples: int = EXAMPLES) -> list[tuple[str, list[Span]]]:
    """Lines with their spans: ``examples`` of each form in changing surroundings, and as many of each other text."""
    rng = np.random.default_rng(17)
    letters = "etaoinshrdlucmfwypvbgkjqxz"

    def drawn(m: re.Match) -> str:
        if m[0] in "01":
            return str(rng.integers(3 if m[0] == "1" else 0, 10))
        word = "".join(letters[min(25, int(rng.exponential(7)))] for _ in range(int(rng.integers(2, 12))))
        return word.title() if m[0] == "W" else word

    rows: list[tuple[str, list[Span]]] = []
    for _ in range(examples):
        for kind, forms in FORMS.items():
            for form in forms:
                before, after = (_MARKS.sub(drawn, x[rng.integers(len(x))]) for x in (BEFORE[kind], AFTER))
                span = _MARKS.sub(drawn, form)
                if not base_spans(span):  # what the patterns find is theirs
                    rows.append((before + span + after, [(len(before), len(before) + len(span), kind)]))
        rows += [(_MARKS.sub(drawn, x), []) for x in OTHERS]
    return rows


@functools.cache
def train(examples: int = EXAMPLES) -> Field:
    """The field that ``labelled_table`` teaches."""
    windows = []
    for text, spans in labelled_table(examples):
        t = tokens(grams.code_points([text])[0])
        windows.append((t.shapes, _labels(t, spans)))
    return fit(windows)


# --- finding ----------------------------------------------------------------------------


def find_spans(texts: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    out = []
    for lo, hi in grams.chunks(texts):
        base = [base_spans(t) for t in texts[lo:hi]]
        added: list[list[Span]] = [[] for _ in base]
        if field is not None:
            points, starts = grams.code_points(texts[lo:hi])
            _add_spans(field, points, starts, base, added)
        out += zip(base, added)
    return out


# shapes of what every form of an address has once: @, or the word at
_AT = [2 * shape + space for shape in (25 + 1 + _SYMBOLS.index("@"), _FIRST_CUE + CUES.index("at")) for space in (0, 1)]


def _add_spans(field: Field, points: np.ndarray, starts: np.ndarray, base: list[list[Span]], added: list[list[Span]]) -> None:
    t = tokens(points)
    y = field.decode(t)
    line_ends = np.append(t.lines[1:], len(y))
    inside = y * (y % 2 == 0)
    for b in np.flatnonzero(y % 2).tolist():
        e = b + 1
        while e < len(y) and inside[e] and inside[e] == y[b] + 1:
            e += 1
        line = int(np.searchsorted(t.lines, b, side="right")) - 1
        # the odds of a span depend on it and the two tokens at either side
        first, last = max(int(t.lines[line]), b - 4), min(int(line_ends[line]), e + 4)
        if field.gain(t.shapes[first:last], y[first:last].astype(int), b - first, e - first) < MIN_GAIN:
            continue
        kind = KINDS[(y[b] - 1) // 2]
        digits = points[t.starts[b] : t.ends[e - 1]]
        least, most = DIGITS[kind]
        if not least <= int(((digits >= 48) & (digits <= 57)).sum()) <= most:
            continue
        if kind == "email" and np.isin(t.shapes[b:e], _AT).sum() != 1:
            continue
        start, end = int(t.starts[b]), int(t.ends[e - 1])
        text = int(np.searchsorted(starts, start, side="right")) - 1
        s, f = start - int(starts[text]), end - int(starts[text])
        if all(f <= x or z <= s for x, z, _ in base[text]):
            added[text].append((s, f, kind))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=_order))


RESULT = [*((f"n_{kind}", "long") for kind in KINDS), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long"), ("n_spans", "long")]


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, base span counts by kind, digest of the base spans, all spans, number added and of all."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, added in find_spans(grams.texts_of(batch.column("text")), shared.value):
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added), len(base) + len(added)))
            columns = list(zip(*rows)) if rows else [[]] * len(RESULT)
            arrays = [pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, RESULT)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *(n for n, _ in RESULT)])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, " + ", ".join(f"{n} {t}" for n, t in RESULT))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one,
    named after the first."""
    out, last = [], 0
    for start, end, kind in sorted(spans, key=_order):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; everything else is left as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at, schema = docs.columns.index(text), docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], shared.value)
            clean = [redacted(t, b + a) if t and (b or a) else t for t, (b, a) in zip(texts, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(task, schema)


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(table(spark, sf_dir, "documents"), train())


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the texts; ``n_chars`` follows the text."""
    return with_length(redact(docs, train()))


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, as the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    length: Column = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length)
