"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained here, in numpy, from labelled spans that a seeded generator makes: carrier prose, values
of each kind in many spellings, and look-alikes that are none. Training doesn't depend on the
data, is bounded by TRAINING, and is done once for each driver process; its weights (a few
kilobytes) go out with the function.

Whole texts are tagged in overlapping windows. Each character takes its scores from the window in
which it stands nearest to the middle; the scores are then decoded together over the whole text, so that no
span is cut by a window. A stretch is decoded only where a path other than all "outside" can win
at all: a bound on the gain of each interval, exact, is computed from running sums.

The base patterns' spans stay as they are. A span of the tagger's is added where it overlaps none of
them and passes its kind's check. Null texts are empty and have no spans; bytes that aren't UTF-8 count as U+FFFD; repeated rows each
give their row; columns other than the id and the text don't matter, whatever their names.
A text takes about 40 bytes of memory for each of its characters.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import by_row, parts_of, ship, texts_of

KINDS = ("email", "ip", "card", "phone", "secret")
OUTSIDE = 0  # the tag of other characters; kind k has tag k + 1
TAGS = len(KINDS) + 1
HIDDEN = 8
SYMBOLS = 131  # ASCII, other letters, other characters, what lies outside the text
PAD = 130
SIDE, STRIDE = 24, 272  # characters on either side of those that a window scores
WINDOW = STRIDE + 2 * SIDE
#: Characters tagged at once.
CHUNK = 270_000

TRAINING = {"steps": 700, "batch": 32, "length": 112, "rate": 0.03, "seed": 7}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind. Each pattern takes a number of steps in proportion to the text."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- the tagger ---------------------------------------------------------------------------------


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): in (-1, 1) as tanh, for a fraction of its time. Its slope is (1 - |y|)^2 at a result y."""
    return x / (1 + np.abs(x))


@dataclass
class Weights:
    table: np.ndarray  # 2, SYMBOLS, 4 H: of both directions, what a character adds to the gates
    inner: np.ndarray  # 2, H, 4 H
    out: np.ndarray  # 2 H, TAGS
    bias: np.ndarray  # TAGS
    moves: np.ndarray  # TAGS, TAGS: from, to


def symbols(text: str) -> np.ndarray:
    """The symbol of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129)).astype(np.uint8)


class _Maker:
    """Labelled text: carrier prose with values of each kind and look-alikes."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, chars: str, n: int) -> str:
        return "".join(chars[i] for i in self.rng.integers(0, len(chars), n))

    def n(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def word(self) -> str:
        r = self.rng.random()
        letters = "aaabcdeeeeefghiiijklmnnoooprrssttttuuvwyz" + ("éèàçäöüßñóí" if r < 0.25 else "")
        word = self.pick(letters, self.n(1, 11))
        r = self.rng.random()
        word = word.upper() if r < 0.08 else word.capitalize() if r < 0.2 else word
        r = self.rng.random()
        return word + (self.pick(".,;:!?)", 1) if r < 0.15 else self.pick("#$%&*!", 1) * 3 if r < 0.19 else "")

    def value(self) -> tuple[str, str, int, str]:
        """What stands before, the value, its kind and what stands after."""
        digits, hexa, lower = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
        kind, r = self.n(0, 4), self.rng.random()
        if kind == 0:
            name = self.pick(lower, self.n(1, 9)) + self.pick("._+-", 1) * int(r < 0.6) + self.pick(lower + digits, self.n(1, 8))
            if r < 0.3:
                name = self.pick(lower, self.n(2, 9)) + "." + self.pick(digits, self.n(1, 3))
            return "", name + "@" + self.pick(lower + digits, self.n(2, 9)) + "." * int(r < 0.7) + self.pick(lower, self.n(2, 9)) * int(r < 0.7) + "." + self.pick(lower, self.n(2, 3)), kind, ""
        if kind == 1:
            return "", ".".join(str(self.n(0, 255)) for _ in range(4)), kind, ""
        if kind == 2:
            groups = [self.pick(digits, 4) for _ in range(4)]
            return "", (groups[0] + groups[1] + groups[2] + groups[3]) if r < 0.6 else (" " if r < 0.8 else "-").join(groups), kind, ""
        if kind == 3:
            a, b, c = self.pick(digits, 3), self.pick(digits, 3), self.pick(digits, 4)
            country = "+" + self.pick("123456789", 1) + self.pick(digits, self.n(0, 1))
            return "", [f"{country} ({a}) {b}-{c}", f"{country} {a} {b} {c}", f"{country}-{a}-{b}-{c}", f"({a}) {b}-{c}"][self.n(0, 3)], kind, ""
        names = ["token", "api_key", "secret", "password", "access_key", "auth"]
        value = self.pick(hexa, self.n(24, 48)) if r < 0.6 else self.pick(lower + lower.upper() + digits, self.n(20, 40))
        quote = '"' if r < 0.3 or 0.6 < r < 0.9 else "'" if r < 0.5 else ""
        return names[self.n(0, 5)] + [" = ", "=", ": "][self.n(0, 2)] + quote, value, kind, quote

    def decoy(self) -> str:
        digits = "0123456789"
        return [
            lambda: self.pick(digits, self.n(1, 7)), lambda: f"{self.n(0, 999)}.{self.n(0, 99)}", lambda: f"20{self.pick(digits, 2)}-0{self.n(1, 9)}-1{self.n(0, 9)}", lambda: f"v{self.n(0, 9)}.{self.n(0, 20)}.{self.n(0, 9)}",
            lambda: f"{self.n(0, 23)}:{self.pick('012345', 1)}{self.pick(digits, 1)}", lambda: f"@{self.word()}", lambda: f"{self.word()}_{self.word()}", lambda: f"{self.n(1, 99)}%", lambda: f"= {self.word()}", lambda: f"({self.n(1, 999)})", lambda: f'"{self.word()}"', lambda: "| " + self.word(), lambda: f"https://{self.word()}.com/{self.n(1, 99)}",
        ][self.n(0, 12)]()

    def sample(self, length: int, values: float = 0.12) -> tuple[str, np.ndarray]:
        """A text of this length and its tags."""
        text, tags = "", []
        while len(text) < length:
            r = self.rng.random()
            if r < values:
                before, value, kind, after = self.value()
                text += before + value + after
                tags += [0] * len(before) + [kind + 1] * len(value) + [0] * len(after)
            else:
                word = self.decoy() if r < values + 0.1 else self.word()
                text += word
                tags += [0] * len(word)
            gap = "\n" if self.rng.random() < 0.07 else " "
            text += gap
            tags.append(0)
        skip = self.n(0, min(12, len(text) - length))
        return text[skip : skip + length], np.array(tags[skip : skip + length])


def _scores(w: Weights, ids: np.ndarray) -> tuple[np.ndarray, list]:
    """Scores (T, B, TAGS) of windows ids (T, B), and what training needs of each step."""
    steps, batch = ids.shape
    h = np.zeros((2, batch, HIDDEN), np.float32)
    c = np.zeros((2, batch, HIDDEN), np.float32)
    hidden = np.empty((2, steps, batch, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        z = np.stack([w.table[0][ids[t]], w.table[1][ids[steps - 1 - t]]]) + h @ w.inner
        a = _squash(z)
        gates, new = a[..., : 3 * HIDDEN] * 0.5 + 0.5, a[..., 3 * HIDDEN :]
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        before, old = h, c
        c = f * c + i * new
        squashed = _squash(c)
        h = o * squashed
        hidden[0, t], hidden[1, steps - 1 - t] = h
        kept.append((before, old, i, f, o, new, squashed))
    return np.concatenate([hidden[0], hidden[1]], -1) @ w.out + w.bias, [kept, hidden]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _gradients(w: Weights, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags (T, B), and its gradients in the order of Weights."""
    steps, batch = ids.shape
    scores, (kept, hidden) = _scores(w, ids)
    ahead, back = np.empty_like(scores), np.empty_like(scores)
    ahead[0], back[-1] = scores[0], 0
    for t in range(1, steps):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, :, None] + w.moves, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = _log_sum(w.moves + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    d_scores = np.exp(ahead + back - total[:, None])
    pairs = np.exp(ahead[:-1, :, :, None] + w.moves + (scores[1:] + back[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
    rows, columns = np.indices((steps, batch))
    gold = scores[rows, columns, tags].sum() + w.moves[tags[:-1], tags[1:]].sum()
    np.subtract.at(d_scores, (rows, columns, tags), 1)
    np.subtract.at(pairs, (tags[:-1], tags[1:]), 1)
    d_scores, d_moves = (d_scores / batch).astype(np.float32), (pairs / batch).astype(np.float32)
    both = np.concatenate([hidden[0], hidden[1]], -1)
    d_out = np.tensordot(both, d_scores, ([0, 1], [0, 1]))
    d_hidden = d_scores @ w.out.T
    d_table, d_inner = np.zeros_like(w.table), np.zeros_like(w.inner)
    dh, dc = np.zeros((2, batch, HIDDEN), np.float32), np.zeros((2, batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before, old, i, f, o, new, squashed = kept[t]
        dh = dh + np.stack([d_hidden[t, :, :HIDDEN], d_hidden[steps - 1 - t, :, HIDDEN:]])
        dc = dc + dh * o * (1 - np.abs(squashed)) ** 2
        gate = lambda y: (1 - np.abs(2 * y - 1)) ** 2 / 2
        dz = np.concatenate([dc * new * gate(i), dc * old * gate(f), dh * squashed * gate(o), dc * i * (1 - np.abs(new)) ** 2], -1)
        d_inner += before.transpose(0, 2, 1) @ dz
        np.add.at(d_table[0], ids[t], dz[0])
        np.add.at(d_table[1], ids[steps - 1 - t], dz[1])
        dh, dc = dz @ w.inner.transpose(0, 2, 1), dc * f
    return float((total.sum() - gold) / batch), [d_table, d_inner, d_out, d_scores.sum((0, 1)), d_moves]


@lru_cache(maxsize=4)
def trained(steps: int = TRAINING["steps"], batch: int = TRAINING["batch"], length: int = TRAINING["length"], rate: float = TRAINING["rate"], seed: int = TRAINING["seed"]) -> Weights:
    """The tagger's weights, by Adam over batches of made samples."""
    rng, maker = np.random.default_rng(seed), _Maker(seed + 1)
    w = Weights(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (2, SYMBOLS, 4 * HIDDEN)), (0.3, (2, HIDDEN, 4 * HIDDEN)), (0.3, (2 * HIDDEN, TAGS)), (0.01, TAGS), (0.01, (TAGS, TAGS)))))
    w.table[..., HIDDEN : 2 * HIDDEN] += 3
    parts = [w.table, w.inner, w.out, w.bias, w.moves]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        made = [maker.sample(length) for _ in range(batch)]
        _, grads = _gradients(w, np.stack([symbols(x) for x, _ in made], 1), np.stack([y for _, y in made], 1))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        now = rate * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for p, g, a, b in zip(parts, grads, first, second, strict=True):
            g = g * min(1.0, 5 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return w


def window_scores(w: Weights, ids: np.ndarray) -> np.ndarray:
    """Scores (TAGS, STRIDE, B) of the middles of windows ids (WINDOW, B); as _scores, features first, in reused buffers."""
    steps, batch = ids.shape
    hidden = np.empty((STRIDE, 2 * HIDDEN, batch), np.float32)
    z, added, squashed = np.empty((4 * HIDDEN, batch), np.float32), np.empty((4 * HIDDEN, batch), np.float32), np.empty((HIDDEN, batch), np.float32)
    i, f, o, new = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    gates = z[: 3 * HIDDEN]
    for side in (0, 1):
        table, inner = np.ascontiguousarray(w.table[side].T), np.ascontiguousarray(w.inner[side].T)
        h, c = np.zeros((HIDDEN, batch), np.float32), np.zeros((HIDDEN, batch), np.float32)
        # the windows' last SIDE characters tell nothing to a pass that comes to them last
        for t in range(SIDE + STRIDE) if side == 0 else range(steps - 1, SIDE - 1, -1):
            np.take(table, ids[t], 1, out=z, mode="clip")
            np.matmul(inner, h, out=added)
            z += added
            np.abs(z, out=added)
            added += 1
            z /= added
            gates *= 0.5
            gates += 0.5
            c *= f
            np.multiply(i, new, out=squashed)
            c += squashed
            np.abs(c, out=squashed)
            squashed += 1
            np.divide(c, squashed, out=squashed)
            np.multiply(o, squashed, out=h)
            if SIDE <= t < SIDE + STRIDE:
                hidden[t - SIDE, side * HIDDEN : (side + 1) * HIDDEN] = h
    scores = np.matmul(w.out.T, hidden) + w.bias[:, None]
    return scores.transpose(1, 2, 0)


def text_scores(w: Weights, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (TAGS, cells) of texts, where each text's first cell is, and which cells hold characters.

    A text has a cell for each character and at least one more; each cell's scores come from the
    window whose middle holds it.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n_windows = lengths // STRIDE + 1
    first = (np.cumsum(n_windows) - n_windows) * STRIDE
    cells = int(n_windows.sum()) * STRIDE
    flat = symbols("".join(texts))
    held = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
    ids = np.full(cells, PAD, np.uint8)
    ids[held] = flat
    # windows look SIDE cells to either side, but never into another text
    of = np.repeat(np.arange(len(texts)), n_windows)
    rows = ids.reshape(-1, STRIDE)
    pad = np.full((len(rows), SIDE), PAD, np.uint8)
    before, after = pad.copy(), pad
    same = of[1:] == of[:-1]
    before[1:][same] = rows[:-1][same, -SIDE:]
    after[:-1][same] = rows[1:][same, :SIDE]
    windows = np.ascontiguousarray(np.concatenate([before, rows, after], 1).T).astype(np.intp)
    out = np.empty((TAGS, cells), np.float32)
    for k in range(0, len(rows), 1024):
        part = np.ascontiguousarray(windows[:, k : k + 1024])
        out.reshape(TAGS, -1, STRIDE)[:, k : k + 1024] = window_scores(w, part)
    filled = np.zeros(cells, bool)
    filled[held] = True
    return out, first, filled


def decode(w: Weights, scores: np.ndarray, filled: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end), in cells, of the best path over each text's scores.

    A path that leaves "outside" in an interval gains at most the sum of each cell's best other score over
    that of "outside", the moves into and out of the interval, and `stay` for each move in it. Only cells in an
    interval whose bound is over 0 are decoded.
    """
    outside = w.moves[0, 0]
    stay, around = float(w.moves[1:, 1:].max() - outside), float(w.moves[0, 1:].max() + w.moves[1:, 0].max() - 2 * outside)
    gain = (scores[1:].max(0) - scores[0]).astype(np.float64) + stay
    gain[~filled] = -1e5  # no interval holds the cells between texts
    sums = np.concatenate(([0.0], np.cumsum(gain)))
    up_to = sums[1:] - np.minimum.accumulate(sums[:-1])
    from_ = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
    open_ = (up_to + from_ - gain - stay + around > -1e-3) & filled
    edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.astype(np.int8), [0]))))
    stretches = sorted(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True), key=lambda s: s[1] - s[0])
    out: list[tuple[int, int, int]] = []
    k = 0
    while k < len(stretches):  # so many at once that the longest bounds the memory
        n = max(1, 200_000 // (stretches[min(k + 511, len(stretches) - 1)][1] - stretches[min(k + 511, len(stretches) - 1)][0] + 2))
        out += _best_paths(w, scores, stretches[k : k + min(n, 512)])
        k += min(n, 512)
    return sorted(out)


def _best_paths(w: Weights, scores: np.ndarray, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Viterbi over stretches of like lengths, each with one more "outside" at either end."""
    longest = max(b - a for a, b in stretches) + 2
    own = np.full((len(stretches), longest, TAGS), -1e6, np.float32)
    own[:, :, 0] = 0
    for k, (a, b) in enumerate(stretches):
        own[k, 1 : 1 + b - a] = scores[:, a:b].T
    best = own[:, 0]
    back = np.zeros((longest, len(stretches), TAGS), np.int8)
    for t in range(1, longest):
        steps = best[:, :, None] + w.moves
        back[t] = steps.argmax(1)
        best = steps.max(1) + own[:, t]
    tag = np.zeros(len(stretches), np.int64)
    path = np.zeros((longest, len(stretches)), np.int8)
    for t in range(longest - 1, 0, -1):
        path[t] = tag
        tag = back[t, np.arange(len(stretches)), tag]
    out = []
    for k in np.flatnonzero(path.any(0)).tolist():
        a, b = stretches[k]
        tags = path[1 : 1 + b - a, k]
        cuts = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
        out += [(a + x, int(tags[x]) - 1, a + y) for x, y in zip(cuts, cuts[1:], strict=False) if y > x and tags[x]]
    return out


def _checked(text: str, kind: int, start: int, end: int) -> Span | None:
    """A tagger's span without blanks and quotes at its ends, if it is what its kind asks for."""
    while start < end and text[start] in " \t\n\r\"'`=:,;<[{":
        start += 1
    while start < end and text[end - 1] in " \t\n\r\"'`=:,;>]}.!?":
        end -= 1
    value = text[start:end]
    digits = re.sub(r"[^0-9]", "", value)
    ok = (
        re.fullmatch(r"[^\s@]+\s?(?:@|\[at\]|\(at\))\s?[^\s@]+\.[^\s@.]+", value) is not None,
        re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", value) is not None and all(int(x) <= 255 for x in value.split(".")),
        12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .-]+", value) is not None,
        9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", value) is not None and re.search(r"[ ().-]", value) is not None,
        len(value) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_-]+", value) is not None and bool(digits) and len(digits) < len(value),
    )[kind]
    return (start, kind, end) if ok else None


def all_spans(w: Weights, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and those with the tagger's."""
    out = []
    k = 0
    while k < len(texts):
        group, size = [], 0
        while k < len(texts) and (not group or size + len(texts[k]) <= CHUNK):
            group.append(texts[k])
            size += len(texts[k])
            k += 1
        scores, first, filled = text_scores(w, group)
        found = decode(w, scores, filled)
        at = 0
        for text, begin in zip(group, first.tolist(), strict=True):
            base = base_spans(text)
            spans, taken, k_base = list(base), 0, 0  # taken: where the base spans that start before a span end
            while at < len(found) and found[at][0] < begin + len(text):
                start, kind, end = found[at]
                at += 1
                span = _checked(text, kind, start - begin, end - begin)
                if span is None:
                    continue
                while k_base < len(base) and base[k_base][0] < span[2]:
                    taken = max(taken, base[k_base][2])
                    k_base += 1
                if taken <= span[0]:
                    spans.append(span)
            out.append((base, sorted(spans)))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **training: float) -> DataFrame:
    """doc_id, the number of base spans of each kind, the base spans' SHA-256, all spans of every whole text and their number."""
    ship(docs.sparkSession)
    weights = trained(**training)

    def run(columns: dict[str, pa.Array]) -> dict[str, list]:
        both = all_spans(weights, [x or "" for x in texts_of(columns["text"])])
        out = {f"n_{k}": [sum(s[1] == i for s in base) for base, _ in both] for i, k in enumerate(KINDS[:4])}
        return out | {"doc_id": columns["doc_id"], "base_sha256": [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in both], "spans": [spelled(x) for _, x in both], "n_spans": [len(x) for _, x in both]}

    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(by_row(run, FOUND), f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in angle brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = None, **training: float) -> DataFrame:
    """docs with personal data replaced in its text; other columns stay, and length_column, if given, is set anew. Null stays null."""
    ship(docs.sparkSession)
    weights = trained(**training)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 512):
                texts = texts_of(part.column(names.index(text_column)))
                both = all_spans(weights, [x or "" for x in texts])
                new = [None if x is None else redacted(x, spans) for x, (_, spans) in zip(texts, both, strict=True)]
                columns = list(part.columns)
                columns[names.index(text_column)] = pa.array(new, part.schema.field(names.index(text_column)).type)
                if length_column:
                    kind = part.schema.field(names.index(length_column)).type
                    columns[names.index(length_column)] = pa.array([None if x is None else len(x) for x in new], kind)
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name in (text_column, length_column)) for f in docs.schema])
    return docs.mapInArrow(run, schema)
