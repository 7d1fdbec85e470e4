"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans are what the four patterns and their checks give. The tagger looks for further ones, above
all those that are written out ("joe at mail dot com", "five five five ...", "(212) 555-0187"). It
reads the stretches of a text that lie within MARGIN characters of a trigger: a digit, an at-sign, an
"at" or "dot" that may stand for one, a run of figures in words. A test holds that all labelled spans
lie in such stretches, so what is skipped holds none. A stretch is read in overlapping windows, whose
emissions are blended by the distance from their edges; one Viterbi path over the whole stretch
reconciles them. A span's score is how much its path gains over leaving it out; it is added where it
touches no base span, reaches its kind's least score, calibrated on windows that trained nothing, and
holds what its kind means: an email an at and then a dot, an IP four numbers of at most 255, a card 13
to 19 digits passing Luhn, a phone 9 to 15 digits, as signs or as words.

Network and transitions are trained by `train`, in numpy, on labelled spans set among invented prose
and look-alikes (versions, dates, prices, hex strings, other numbers, the same words in other use).
That takes some minutes, so its result is kept beside this module: `python -m kvlake.llm.pii` makes it
again.

Null and empty texts have no spans. Positions are code points, ends exclusive. Very long texts are
read whole; a stretch of over LONGEST characters is cut at a space. Repeated rows are each read; spans
of one kind never overlap, those of different kinds may. Columns besides doc_id and text are not read
when spans are found, and pass unchanged (n_chars is brought up to date) when they are masked. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_slices

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Characters of a window in training and in reading, and between the beginnings of two windows that are read.
TRAINED, WINDOW, STRIDE = 64, 96, 64
#: Characters around a trigger that are read; longest stretch.
MARGIN, LONGEST = 64, 4096
N_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

# ---------------------------------------------------------------- patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FIGURES = "zero one two three four five six seven eight nine".split()
_TRIGGER = re.compile(r"[0-9@]|\bdot\b|[(\[{] ?(?:at|dot)\b|\bat [\w.-]{1,64}\.[a-z]{2,6}\b|\b(?:" + "|".join(_FIGURES) + r"|oh)[ ,-]+(?:" + "|".join(_FIGURES) + r"|oh)[ ,-]+(?:" + "|".join(_FIGURES) + r"|oh)\b", re.I)
_AT_AND_DOT = re.compile(r"(?:@|\bat\b).*(?:\.|\bdot\b)", re.I | re.S)
_FIGURE = re.compile(r"[0-9]|\b(?:" + "|".join(_FIGURES) + r"|oh)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _at_most_255(number: str) -> bool:
    """Of a run of digits, however long."""
    number = number.lstrip("0")
    return len(number) < 4 and int(number or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out, begin = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > begin and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            begin = m.end()
        else:
            begin = max(begin, at + 1)
        at = text.find("@", max(at + 1, begin))
    for m in _IP.finditer(text):
        if all(_at_most_255(p) for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def figures(s: str) -> str:
    """The digits of a span, whether written as digits or as words."""
    return "".join(x if x.isdigit() else str(_FIGURES.index(x.lower())) if x.lower() in _FIGURES else "0" for x in _FIGURE.findall(s))


def means(kind: str, s: str) -> bool:
    """Whether an added span holds the figures that its kind means."""
    if kind == "email":
        return bool(_AT_AND_DOT.search(s))
    if kind == "ip":
        numbers = re.findall(r"[0-9]+", s)
        return len(numbers) == 4 and all(map(_at_most_255, numbers))
    d = figures(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


# ---------------------------------------------------------------- network

_PUNCT = " \n\t.,:;!?@+-_()[]{}/\\%#&*=\"'<>|$~^`"
_ID = np.full(0x10000, 3, np.uint8)  # others
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _ID[ord(_c)] = _ID[ord(_c.upper())] = 4 + _i
_ID[0x30:0x3A] = 1
for _i, _c in enumerate(_PUNCT):
    _ID[ord(_c)] = 30 + _i
N_CHARS = 30 + len(_PUNCT)


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _ID[np.minimum(points, 0xFFFF)]


def _bilstm(ids: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool):
    """States (direction, time, batch, unit) of LSTMs that read ids (batch, time) forwards and backwards.

    table: input weights and bias of each character, u: recurrent weights; each for both directions.
    """
    n, steps = ids.shape
    k = u.shape[1]
    both = np.stack([ids, ids[:, ::-1]])
    side = np.arange(2)[:, None]
    h, c = np.zeros((2, n, k), u.dtype), np.zeros((2, n, k), u.dtype)
    out, kept = np.empty((2, steps, n, k), u.dtype), []
    for t in range(steps):
        z = table[side, both[:, :, t]]
        z += h @ u
        z[..., : 3 * k] *= 0.5
        np.tanh(z, out=z)
        z[..., : 3 * k] += 1
        z[..., : 3 * k] *= 0.5  # input, forget, output gates; then the candidate
        before = c
        c = z[..., k : 2 * k] * c + z[..., :k] * z[..., 3 * k :]
        tc = np.tanh(c)
        if keep:
            kept.append((z, before, tc, h))
        h = z[..., 2 * k : 3 * k] * tc
        out[:, t] = h
    out[1] = out[1, ::-1]
    return out, kept


def _bilstm_back(ids: np.ndarray, u: np.ndarray, kept: list, d_out: np.ndarray):
    """Gradients of table and u from those of the states."""
    _, steps, n, k = d_out.shape
    both = np.stack([ids, ids[:, ::-1]])
    d_out = np.stack([d_out[0], d_out[1, ::-1]])
    back = np.ascontiguousarray(u.transpose(0, 2, 1))
    all_dz, all_h = np.empty((2, steps, n, 4 * k), u.dtype), np.empty((2, steps, n, k), u.dtype)
    dh, dc = np.zeros((2, n, k), u.dtype), np.zeros((2, n, k), u.dtype)
    for t in range(steps - 1, -1, -1):
        z, before, tc, h0 = kept[t]
        g = z[..., 3 * k :]
        dh = dh + d_out[:, t]
        dc = dc + dh * z[..., 2 * k : 3 * k] * (1 - tc * tc)
        dz = all_dz[:, t]
        dz[..., :k] = dc * g
        dz[..., k : 2 * k] = dc * before
        dz[..., 2 * k : 3 * k] = dh * tc
        dz[..., : 3 * k] *= z[..., : 3 * k] * (1 - z[..., : 3 * k])
        dz[..., 3 * k :] = dc * z[..., :k] * (1 - g * g)
        all_h[:, t] = h0
        dh, dc = dz @ back, dc * z[..., k : 2 * k]
    flat_dz, flat_h = all_dz.reshape(2, -1, 4 * k), all_h.reshape(2, -1, k)
    d_u = flat_h.transpose(0, 2, 1) @ flat_dz
    hot = np.eye(N_CHARS, dtype=u.dtype)[both.transpose(0, 2, 1).reshape(2, -1)]
    return hot.transpose(0, 2, 1) @ flat_dz, d_u


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradient(em: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Negative log-likelihood of tag paths (batch, time), and its gradients. em: (time, batch, tags)."""
    steps, n, _ = em.shape
    alpha = [em[0]]
    for t in range(1, steps):
        alpha.append(_lse(alpha[-1][:, :, None] + trans[None], 1) + em[t])
    beta = [np.zeros_like(em[0])]
    for t in range(steps - 1, 0, -1):
        beta.append(_lse(trans[None] + (em[t] + beta[-1])[:, None, :], 2))
    beta.reverse()
    total = _lse(alpha[-1], 1)
    d_em, d_trans = np.empty_like(em), np.zeros_like(trans)
    rows, score = np.arange(n), np.zeros(n)
    for t in range(steps):
        d_em[t] = np.exp(alpha[t] + beta[t] - total[:, None])
        score += em[t, rows, tags[:, t]]
        d_em[t, rows, tags[:, t]] -= 1
        if t:
            d_trans += np.exp(alpha[t - 1][:, :, None] + trans[None] + (em[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(d_trans, (tags[:, t - 1], tags[:, t]), -1)
            score += trans[tags[:, t - 1], tags[:, t]]
    return float((total - score).mean()), d_em / n, d_trans / n


class Tagger:
    """Parameters: character tables and recurrent weights of both directions; output weights, bias; transitions.

    least: the least score of a span of each kind.
    """

    def __init__(self, parameters: list[np.ndarray], least=None):
        self.p, self.least = parameters, np.zeros(len(KINDS)) if least is None else least

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Emissions (time, batch, tag), and what the gradient needs."""
        states, kept = _bilstm(ids, self.p[0], self.p[1], keep)
        both = np.concatenate([states[0], states[1]], 2)
        return both @ self.p[2] + self.p[3], (both, kept)


def bars() -> np.ndarray:
    """Transitions that no path takes: an I after what isn't its own B or I."""
    out = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


# ---------------------------------------------------------------- labelled spans

_SYLLABLES = "ar en ti on la de ver sch eau ción mo ra li st und the or es ne ka é ñ ü ß ing er he nd at do ot th ea ha in re nt ed es ly ble ia ar ero ao ie ge keit ung ich ein eau oi ai".split()
_COMMON = "at the of in on and to a is it with from by for der die das und le la les de un est el los que no at dot com at home one two of five at".split()


def labelled_texts(n: int, seed: int, spans: float = 0.16) -> Iterator[tuple[str, list[int]]]:
    """Texts of some length, with the tag of each character; a share `spans` of their words are spans, as many look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda a, b=None: "".join(str(x) for x in rng.integers(0, 10, int(rng.integers(a, (b or a) + 1))))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    latin = lambda: pick(["".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9)))), "".join(c for c in word() + word() if c.isascii()) or "ann", pick("joe jane mary info sales admin peter max lena web mail post office acme example server".split())])

    def card() -> str:
        d = num(12, 18)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick(["", "", " ", "-", ".", "/", "_"])
        return d if not sep else sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        name = pick([latin() + pick([".", "_", ""]) + latin(), latin() + "." + num(1, 3), latin() + num(0, 3), latin()])
        host, top = pick([latin(), latin() + num(1), latin() + "." + latin(), "mail" + num(1) + ".example"]), pick(["com", "org", "net", "de", "co.uk", "info", "io", "fr", "es"])
        x = rng.random()
        if x < 0.3:
            return f"{name}@{host}.{top}"
        at, dot = pick([(" at ", " dot ")] * 5 + [(" AT ", " DOT "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", "."), ("{at}", "{dot}"), (" @ ", " . ")])
        whole = name + at + host.replace(".", dot) + dot + top.replace(".", dot)
        return whole if rng.random() < 0.6 else whole.replace(".", dot)

    def ip() -> str:
        return pick([".", ".", ".", "[.]", "(.)", " . ", " dot ", "-dot-", " [dot] "]).join(str(x) for x in rng.integers(0, 256, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        if rng.random() < 0.2:
            sep = pick([" ", " ", "-", ", "])
            return sep.join(pick([_FIGURES[int(x)]] * 12 + ["oh" if x == "0" else _FIGURES[int(x)]]) for x in num(9, 11))
        return pick([f"+{num(1, 2)} ({a}) {b}-{c}", f"+{num(1, 3)} {a} {b} {c}", f"+{num(10, 12)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)}-{a}-{b}-{c}", f"+{num(2)}/{a}/{b}{c}", f"{a}/{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"tel:{a}-{b}-{c}"[4:]])

    def decoy() -> str:
        few = " ".join(_FIGURES[int(x)] for x in num(1, 4))
        return pick([f"{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}.{num(1, 2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"${num(1, 5)}.{num(2)}", "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(8, 44)))), num(1, 8), f"{num(1, 3)},{num(3)}", f"@{latin()}", f"{num(1, 3)}%", f"No. {num(1, 4)}", f"{num(20, 30)}", f'token = "{num(4)}{latin()}{num(6)}"', 'token = "' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', f"{num(3)}-{num(5)}", f"({num(4)})", f"+{num(1, 2)}", f"{num(2)}.{num(2)}.{num(4)}", few, f"{few} or {few}", f"{word()} at {word()}", f"look at {latin()} dot", f"{word()} dot {word()}", f"at {few}", f"{latin()} at {word()} and {word()}", f"{word()}. At {word()}", f"dot {word()} com", f"{word()} at the {latin()}. {word().capitalize()}", f"{latin()}.{latin()}", f"www.{latin()}.com"])

    made = (email, ip, card, phone)

    def span() -> tuple[str, int]:
        k = pick([0, 0, 1, 2, 3])
        return made[k](), k

    for _ in range(n):
        text, mark, filled = [], [], 0
        while filled < 3 * TRAINED:
            x = rng.random()
            if x < spans:
                s, k = span()
                t = [2 + 2 * k] * len(s)
                t[0] = 1 + 2 * k
            else:
                s = decoy() if x < spans + 0.14 else word().capitalize() if x < spans + 0.2 else pick(_COMMON) if x < spans + 0.4 else word().upper() if x < spans + 0.44 else word()
                t = [0] * len(s)
            if rng.random() < 0.1 and t[-1] == 0 and not s[-1].isdigit():
                glue = ""
            else:
                glue = pick([" "] * 12 + [", ", ", ", ". ", ". ", "\n", "\n", ": ", "; ", "### ", "!! ", "&&& ", "$$$ ", "%%% ", "*** "])
            text.append(s + glue)
            mark += t + [0] * len(glue)
            filled += len(s) + len(glue)
        yield "".join(text), mark


def labelled_windows(n: int, seed: int, spans: float = 0.16) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and tags of windows of labelled texts, at random places."""
    rng = np.random.default_rng(seed + 1000)
    ids, tags = np.zeros((n, TRAINED), np.uint8), np.zeros((n, TRAINED), np.int64)
    for r, (text, mark) in enumerate(labelled_texts(n, seed, spans)):
        whole = char_ids(text)
        at = int(rng.integers(0, len(whole) - TRAINED))
        ids[r], tags[r] = whole[at : at + TRAINED], mark[at : at + TRAINED]
        for t in range(TRAINED):  # a span that the window cuts begins with its I as B
            if tags[r, t] and tags[r, t] % 2 == 0 and (t == 0 or tags[r, t - 1] not in (tags[r, t], tags[r, t] - 1)):
                tags[r, t] -= 1
    return ids, tags


def calibrated(model: Tagger, n: int, seed: int, right: float = 0.99) -> np.ndarray:
    """Least score of each kind: the share of right spans above it reaches `right` in labelled texts, and none is found in texts without spans."""
    out = np.zeros(len(KINDS))
    scores: list[list] = [[] for _ in KINDS]
    for share in (0.16, 0.0):
        texts = list(labelled_texts(n, seed, share))
        for (text, mark), spans in zip(texts, tag([char_ids(t) for t, _ in texts], model)):
            true = {(a, b, k) for a, b, k in path_spans(np.array(mark))}
            for a, b, kind, score in spans:
                if means(kind, text[a:b]):
                    good = any(k == kind and a < d and c < b for c, d, k in true)
                    scores[_ORDER[kind]].append((score, good))
                    if not share:
                        out[_ORDER[kind]] = max(out[_ORDER[kind]], score + 1e-3)
    for k, found in enumerate(scores):
        found.sort(reverse=True)
        good = np.cumsum([g for _, g in found]) / (np.arange(len(found)) + 1)
        enough = np.flatnonzero(good >= right)
        out[k] = max(out[k], found[int(enough[-1])][0]) if len(enough) else np.inf
    return out


def train(n: int = 9000, hidden: int = 24, epochs: int = 10, batch: int = 100, rate: float = 0.02, seed: int = 3) -> Tagger:
    rng = np.random.default_rng(seed)
    ids, tags = labelled_windows(n, seed)
    k = hidden
    table = rng.normal(0, 0.3, (2, N_CHARS, 4 * k))
    table[..., k : 2 * k] += 1
    p = [table, rng.normal(0, 0.2, (2, k, 4 * k)), rng.normal(0, 0.2, (2 * k, N_TAGS)), np.zeros(N_TAGS), np.zeros((N_TAGS, N_TAGS))]
    p = [x.astype(np.float32) for x in p]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    barred, steps = bars().astype(np.float32), epochs * (n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n - batch + 1, batch):
            x, y = ids[order[a : a + batch]], tags[order[a : a + batch]]
            em, (both, kept) = Tagger(p).emissions(x, keep=True)
            _, d_em, d_trans = crf_gradient(em, y, p[4] + barred)
            d_both = d_em @ p[2].T
            d_table, d_u = _bilstm_back(x, p[1], kept, np.stack([d_both[..., :k], d_both[..., k:]]))
            flat, d_flat = both.reshape(-1, 2 * k), d_em.reshape(-1, N_TAGS)
            grads = [d_table, d_u, flat.T @ d_flat, d_flat.sum(0), d_trans]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            t += 1
            step = rate * (1 - t / (steps + 1))
            for i, g in enumerate(grads):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p[i] = (p[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    p[4] = p[4] + barred
    return Tagger(p, calibrated(Tagger(p), n // 3, seed + 1))


# ---------------------------------------------------------------- decoding


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around triggers, in order; those that would touch are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    cut = []
    for a, b in out:
        while b - a > LONGEST:
            at = text.rfind(" ", a + LONGEST // 2, a + LONGEST)
            at = at if at > 0 else a + LONGEST
            cut.append((a, at))
            a = at
        cut.append((a, b))
    return cut


def viterbi(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best paths (batch, time) of stretches padded to one length; past a stretch's end tags are 0."""
    n, steps, k = em.shape
    back = np.zeros((steps, n, k), np.int8)
    first = np.zeros(k, em.dtype)
    first[2::2] = -1e4
    score = em[:, 0] + first
    for t in range(1, steps):
        both = score[:, :, None] + trans[None]
        back[t] = both.argmax(1)
        new = both.max(1) + em[:, t]
        score = np.where((t < lengths)[:, None], new, score)
    path = np.zeros((n, steps), np.int8)
    tag, rows = score.argmax(1), np.arange(n)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[:, t] = np.where(inside, tag, 0)
        tag = np.where(inside & (t > 0), back[t, rows, tag], tag)
    return path


def read(parts: list[np.ndarray], model: Tagger, at_once: int = 512) -> np.ndarray:
    """Emissions of the characters of texts (given as ids), one after another: those of their windows, blended."""
    sizes = np.array([len(x) for x in parts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(parts)), counts)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    place = np.minimum(place, np.maximum(0, sizes[owner] - WINDOW))  # the last one ends with its text
    flat = np.concatenate([*parts, np.full(WINDOW, _ID[32], np.uint8)])
    em, weight = np.zeros((first[-1], N_TAGS), np.float32), np.zeros(first[-1], np.float32)
    ramp = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    for a in range(0, len(owner), at_once):
        o, at = owner[a : a + at_once], place[a : a + at_once]
        inside = at[:, None] + np.arange(WINDOW) < sizes[o][:, None]
        where = np.where(inside, first[o][:, None] + at[:, None] + np.arange(WINDOW), first[-1])
        e = model.emissions(flat[where])[0].transpose(1, 0, 2)
        for k in range(len(o)):
            i = first[o[k]] + at[k]
            n = min(WINDOW, int(sizes[o[k]] - at[k]))
            em[i : i + n] += e[k, :n] * ramp[:n, None]
            weight[i : i + n] += ramp[:n]
    return em / np.maximum(weight, 1e-6)[:, None]


def tag(parts: list[np.ndarray], model: Tagger) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of the spans of stretches, given as character ids."""
    out: list[list] = [[] for _ in parts]
    if not parts:
        return out
    em, sizes, trans = read(parts, model), np.array([len(x) for x in parts]), model.p[4]
    first = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * sizes[order[b]] <= 200_000:
            b += 1
        group = order[a:b]
        padded = np.zeros((len(group), int(sizes[group].max()), N_TAGS), np.float32)
        for r, i in enumerate(group):
            padded[r, : sizes[i]] = em[first[i] : first[i + 1]]
        for r, path in enumerate(viterbi(padded, sizes[group], trans)):
            for x, y, kind in path_spans(path):
                tags = np.concatenate([[0], path[x:y], [0]])
                own = padded[r, x:y]
                score = float((own[np.arange(y - x), path[x:y]] - own[:, 0]).sum() + trans[tags[:-1], tags[1:]].sum() - (y - x + 1) * trans[0, 0])
                out[group[r]].append((x, y, kind, score))
        a = b
    return out


def path_spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    out, start, kind = [], -1, 0
    if not path.any():
        return out
    for t, tag in enumerate([*path.tolist(), 0]):
        if start >= 0 and tag != 2 + 2 * kind:
            out.append((start, t, KINDS[kind]))
            start = -1
        if tag % 2 == 1:
            start, kind = t, tag // 2
    return out


def find_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    parts, where = [], []
    for d, text in enumerate(texts):
        found = stretches(text)
        if found:
            ids = char_ids(text)
            parts += [ids[a:b] for a, b in found]
            where += [(d, a) for a, _ in found]
    tagged: list[list] = [[] for _ in texts]
    for (d, a), spans in zip(where, tag(parts, model)):
        tagged[d] += [(a + x, a + y, kind, score) for x, y, kind, score in spans]
    out = []
    for text, spans in zip(texts, tagged):
        base = base_spans(text)
        starts = [s for s, _, _ in base]
        reach = list(accumulate((e for _, e, _ in base), max))  # the furthest end of the spans so far
        added = []
        for s, e, kind, score in spans:
            k = bisect_left(starts, e)  # base spans that begin before this one ends
            if score >= model.least[_ORDER[kind]] and not (k and reach[k - 1] > s) and means(kind, text[s:e]) and not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum()):
                added.append((s, e, kind))
        out.append((base, added))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]])))


_KEPT = Path(__file__).with_name("pii_tagger.npz")


@lru_cache
def trained() -> Tagger:
    """What `train` made, read on the driver."""
    with np.load(_KEPT) as kept:
        return Tagger([kept[f"p{i}"] for i in range(5)], kept["least"])


def _handed(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(trained())


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256, spans, n_added (by the tagger), n_spans (all) for every row of docs."""
    model = _handed(docs)
    nothing = hashlib.sha256(b"").hexdigest()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                n = part.num_rows
                counts, sha, spans, extra, total = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i, (base, added) in enumerate(find_spans(part.column(1).to_pylist(), model.value)):
                    for _, _, kind in base:
                        counts[_ORDER[kind], i] += 1
                    if base:
                        sha[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i], extra[i], total[i] = joined(base + added), len(added), len(base) + len(added)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(sha), pa.array(spans), pa.array(extra), pa.array(total)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(tell, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def masked(text: str, spans: list) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked and n_chars brought up to date."""
    model = _handed(docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                names = part.schema.names
                k = names.index("text")
                text = part.column(k).to_pylist()
                chars = part.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
                for i, (base, added) in enumerate(find_spans([t or "" for t in text], model.value)):
                    if base or added:
                        text[i] = masked(text[i], base + added)
                        if chars:
                            chars[i] = len(text[i])
                for name, values in (("text", text), ("n_chars", chars)):
                    if values is not None:
                        c = names.index(name)
                        part = part.set_column(c, part.schema.field(c), pa.array(values, part.schema.field(c).type))
                yield part

    return docs.mapInArrow(mask, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    made = train()
    np.savez_compressed(_KEPT, least=made.least, **{f"p{i}": x for i, x in enumerate(made.p)})
