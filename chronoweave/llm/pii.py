"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions.

The network reads characters: each of ASCII has its own embedding, other letters share one and other signs another. It
is trained in numpy on labelled spans (generated ones by default, `labelled_examples`), and is a constant of a few
hundred kilobytes that travels with the tasks. Every spelling it is taught holds a digit, an at sign or a bracketed
"at", so windows without any of these are not scored. The other windows overlap by half; each is decoded by Viterbi,
and every character takes the label of the window in whose middle half it lies, over the whole text. A run of one
kind is added if it holds one of these signs too, overlaps no fixed span and, for cards, keeps the checksum that
defines a card number: a sum over all digits is not in reach of a tagger. No pattern is asked about the form of what
the network proposes.

Cases: a null text counts as empty. Texts of any length are read whole. Repeated rows get equal results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronoweave.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
LABELS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BASE_SIGN = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in linear time: by kind as listed, then start."""
    if not text or not _BASE_SIGN.search(text):
        return []
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- the network

#: The characters of ASCII, other letters, other signs, and the filling after the end.
CLASSES = 131
LETTER, SIGN, FILL = 128, 129, 130


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.minimum(codes, LETTER).astype(np.int16)
    for i in np.flatnonzero(codes >= 128):
        x[i] = LETTER if text[i].isalpha() else SIGN
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Forward and backward LSTM over characters, a linear layer, and CRF transitions."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        g = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"T": np.zeros((LABELS, LABELS), np.float32), "s": np.zeros(LABELS, np.float32), "V": g(2 * hidden, LABELS), "c": np.zeros(LABELS, np.float32)}
        for d in "fb":
            self.p |= {f"E{d}": g(CLASSES, 4 * hidden), f"U{d}": g(hidden, 4 * hidden)}
            self.p[f"E{d}"][:, hidden : 2 * hidden] += 1  # forget gates begin open

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        h = self.hidden
        n, steps = x.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        hs, cs = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, trace = np.empty((n, steps, h), np.float32), []
        for t in order:
            z = self.p[f"E{d}"][x[:, t]] + hs @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, cand = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, hidden_before = cs, hs
            cs = f * cs + i * cand
            tc = np.tanh(cs)
            hs = o * tc
            out[:, t] = hs
            if keep:
                trace.append((t, i, f, o, cand, before, hidden_before, tc))
        return out, trace

    def emissions(self, x: np.ndarray, keep: bool = False):
        a, ta = self._lstm(x, "f", keep)
        b, tb = self._lstm(x, "b", keep)
        joined = np.concatenate([a, b], axis=2)
        return joined @ self.p["V"] + self.p["c"], joined, ta, tb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Labels of windows (rows, WINDOW) by Viterbi."""
        e = self.emissions(x)[0]
        n, steps, _ = e.shape
        score, back = e[:, 0] + self.p["s"], np.empty((n, steps, LABELS), np.int8)
        for t in range(1, steps):
            through = score[:, :, None] + self.p["T"]
            back[:, t] = through.argmax(1)
            score = through.max(1) + e[:, t]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF and its gradients."""
        e, joined, ta, tb = self.emissions(x, keep=True)
        n, steps, k = e.shape
        T, s = self.p["T"], self.p["s"]

        # forward and backward sums, each step scaled to one
        top = e.max(2, keepdims=True)
        m, P = np.exp(e - top), np.exp(T)
        fore, back, scale = np.empty_like(m), np.ones_like(m), np.empty((n, steps), m.dtype)
        for t in range(steps):
            fore[:, t] = m[:, t] * (np.exp(s) if t == 0 else fore[:, t - 1] @ P)
            scale[:, t] = fore[:, t].sum(1)
            fore[:, t] /= scale[:, t, None]
        for t in range(steps - 2, -1, -1):
            back[:, t] = (m[:, t + 1] * back[:, t + 1]) @ P.T / scale[:, t + 1, None]
        z = np.log(scale).sum(1) + top.sum((1, 2))
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(steps), y].sum(1) + s[y[:, 0]] + T[y[:, :-1], y[:, 1:]].sum(1)
        de = fore * back
        de[rows, np.arange(steps), y] -= 1
        dT = P * np.einsum("nti,ntj->ij", fore[:, :-1], m[:, 1:] * back[:, 1:] / scale[:, 1:, None], optimize=True)
        np.add.at(dT, (y[:, :-1], y[:, 1:]), -1)
        grads = {"T": dT / n, "s": de[:, 0].sum(0) / n}
        de = (de / n).astype(np.float32)
        grads |= {"V": joined.reshape(-1, joined.shape[2]).T @ de.reshape(-1, k), "c": de.sum((0, 1))}
        dj, h = de @ self.p["V"].T, self.hidden
        for d, trace, part in (("f", ta, dj[:, :, :h]), ("b", tb, dj[:, :, h:])):
            U, dzs = np.zeros_like(self.p[f"U{d}"]), np.empty((steps, n, 4 * h), np.float32)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, cand, before, hidden_before, tc in reversed(trace):
                dh = dh + part[:, t]
                do, dc = dh * tc, dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
                dzs[t] = dz
                U += hidden_before.T @ dz
                dh, dc = dz @ self.p[f"U{d}"].T, dc * f
            one_hot = (x.T.reshape(-1)[:, None] == np.arange(CLASSES)).astype(np.float32)
            grads |= {f"E{d}": one_hot.T @ dzs.reshape(-1, 4 * h), f"U{d}": U}
        return float((z - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam; returns the mean loss of each epoch."""
        rng, losses = np.random.default_rng(seed), []
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, grads = self.gradients(x[rows], y[rows])
                total += loss * len(rows)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses


def labelled_examples(n: int = 1600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with labelled spans in many spellings, and as many numbers that are no personal data.

    Digit strings of the length of a card are labelled as cards whether or not their checksum holds.
    """
    rng = np.random.default_rng(seed)
    pick = lambda s: s[rng.integers(len(s))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def word() -> str:
        w = "".join(pick("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.integers(2, 10)))
        return pick([w, w, w, w, w.capitalize(), w.upper()])

    def email() -> str:
        local = word() + pick(["", "", pick("._-+") + word(), pick("._-+") + digits(2)])
        at, dot = pick([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        return local + at + pick(["", word() + "-", "mail" + digits(1) + dot]) + word() + dot + pick(["com", "org", "net", "example" + dot + "com", "co" + dot + "uk", "de"])

    def ip() -> str:
        if rng.random() < 0.3:
            groups = [hexes(rng.integers(1, 5)) for _ in range(rng.integers(4, 9))]
            return ":".join(groups) if len(groups) == 8 else ":".join(groups[:2]) + "::" + ":".join(groups[2:])
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        sep = pick(["", "", " ", "-", "."])
        cuts = pick([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 4, 2)])
        return sep.join(digits(k) for k in cuts)

    def phone() -> str:
        form = pick(["+1 ({}) {}-{}", "+{} {} {}", "+{}-{}-{}", "({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "+1.{}.{}.{}", "00{} {} {}", "001-{}-{}-{}", "1-{}-{}-{}"])
        return form.format(digits(3), digits(3), digits(4))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    noise = [
        lambda: str(rng.integers(1900, 2030)), lambda: digits(pick([1, 2, 3, 5, 6, 8])), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: hexes(pick([8, 24, 32, 40])), lambda: f"@{word()}",
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"${digits(1)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)},{digits(3)},{digits(3)}", lambda: f"#{digits(4)}", lambda: f"{word()}{digits(3)}",
        lambda: f"{word()}_{digits(2)}={digits(2)}", lambda: f"19{digits(2)}-20{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{word()} @ {digits(2)}", lambda: f"{pick('ABCDEF')}-{digits(5)}", lambda: f"http://{word()}.com/{digits(4)}",
        lambda: f"{digits(2)}.{digits(4)}, {digits(2)}.{digits(4)}", lambda: f"AKIA{hexes(16).upper()}", lambda: f'{pick(["token", "key"])} = "{hexes(40)}"',
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(4, 9)):
            draw = rng.random()
            if draw < 0.25:
                kind = pick(KINDS)
                s = make[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = pick(noise)() if draw < 0.5 else word()
            text += s + pick([" ", " ", " ", " ", ", ", ". ", "\n", "!! ", " - ", ") ", "; "]) + pick(["", "", "", "", "", "("])
        out.append((text, spans))
    return out


def train_tagger(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, seed: int = 7) -> Tagger:
    xs, ys = [], []
    for text, spans in examples:
        x = encode(text)
        for at in range(0, len(x), WINDOW - 16):
            w, l = x[at : at + WINDOW], np.zeros(WINDOW, np.int64)
            for kind, a, b in spans:
                a, b = max(a, at), min(b, at + WINDOW)
                if a < b:
                    l[a - at : b - at] = 2 + 2 * KINDS.index(kind)
                    l[a - at] -= 1
            xs.append(np.pad(w, (0, WINDOW - len(w)), constant_values=FILL))
            ys.append(l)
    tagger = Tagger(seed=seed)
    tagger.train(np.stack(xs), np.stack(ys), epochs)
    return tagger


def windows_of(text: str) -> list[int]:
    """Starts of the windows within STRIDE of a digit, an at sign or a bracketed "at", on a grid of STRIDE."""
    out: list[int] = []
    for m in _TRIGGER.finditer(text):
        at = m.start() // STRIDE * STRIDE
        for start in (at - 2 * STRIDE, at - STRIDE, at, at + STRIDE):
            if 0 <= start < len(text) and (not out or start > out[-1]):
                out.append(start)
    return out


def method_spans(texts: list[str], tagger: Tagger, base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the network adds to the spans in `base`."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo: list[tuple[int, list[int], np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not todo:
            return
        x = np.concatenate([w for _, _, w in todo])
        y, at = tagger.decode(x), 0
        for i, starts, _ in todo:
            found[i] = reconcile(texts[i], starts, y[at : at + len(starts)], base[i])
            at += len(starts)

    for i, text in enumerate(texts):
        starts = windows_of(text) if text else []
        if not starts:
            continue
        codes = np.pad(encode(text), (0, WINDOW), constant_values=FILL)
        todo.append((i, starts, codes[np.asarray(starts)[:, None] + np.arange(WINDOW)]))
        size += len(starts)
        if size > 4000:
            flush()
            todo, size = [], 0
    flush()
    return found


def reconcile(text: str, starts: list[int], labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Each character takes the label of the window in whose middle half it lies; then spans over the whole text.

    The outer quarters of a window see too little on one side. They count at the beginning of the text alone.
    """
    if not labels.any():
        return []
    place = (np.asarray(starts)[:, None] + np.arange(WINDOW)).reshape(-1)
    t = np.broadcast_to(np.arange(WINDOW), labels.shape).reshape(-1)
    use = (place < len(text)) & (t < WINDOW - STRIDE // 2) & ((t >= STRIDE // 2) | (place < STRIDE // 2)) & (labels.reshape(-1) > 0)
    at, label = place[use], labels.reshape(-1)[use].astype(np.int64)
    kind = (label - 1) // 2
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (label[1:] % 2 == 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at))[: len(begins)] - 1
    fixed = sorted((s, e) for _, s, e in base)
    opens, closes = [s for s, _ in fixed], list(accumulate((e for _, e in fixed), max))
    out = []
    for i, j in zip(begins, ends, strict=True):
        name, a, b = KINDS[kind[i]], int(at[i]), int(at[j]) + 1
        before = bisect_left(opens, b)  # fixed spans that begin before b
        if before and closes[before - 1] > a:
            continue
        if not _TRIGGER.search(text, a, b):
            continue
        if name != "card" or luhn(re.sub("[^0-9]", "", text[a:b])):
            out.append((name, a, b))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_pii(docs: DataFrame, tagger: Tagger, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, base, spans): joined kind:start:end, code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            base = [base_spans(t) for t in texts]
            more = method_spans(texts, shared.value, base)
            yield pd.DataFrame({"key": frame["key"], "base": [_joined(b) for b in base], "spans": [_joined(b + m) for b, m in zip(base, more, strict=True)]})

    return map_texts(docs, key, text, run, "base string, spans string")
