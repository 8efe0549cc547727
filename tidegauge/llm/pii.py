"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions, all in NumPy.

The patterns give the base spans. The network is trained from labelled spans (see training_windows) and reads windows
that overlap; each window is decoded by Viterbi over the CRF, and the windows of a text are reconciled into one tag a
character: the tag of the window in which the character lies farthest from an edge. A span counts if the CRF holds each
of its tags likely enough (MIN_CONFIDENCE); no rule follows or chooses what is read: windows cover all of every text.
The network reads each window twice at most: in single precision first (Skim), and exactly where its best tags come near
to outweighing none. Elsewhere Viterbi gives no tag, so that both ways have the same spans. Spans of the network never
replace or overlap base spans.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import io
import itertools
import math
import pkgutil
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import WIDE_SLICE_BYTES, table, text_slices

Span = tuple[str, int, int]

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no text takes more than linear time.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WINDOW, STRIDE = 96, 48
#: Characters of a window that is read; those before and after it in a text share STRIDE of them with it.
READ = 384
EMBED, HIDDEN = 10, 24
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.02, 11
TRAIN_WINDOWS = 5000
#: Windows that are decoded at once: their gates stay in a core's cache.
DECODED = 192
#: Windows that are skimmed at once, and those that are skimmed before what they leave is decoded.
SKIMMED, ROUND = 2048, 16_384
#: Symbols of padding that are skimmed after a window's last character.
PADS = 16
#: Windows are decoded whose best tags, as skimmed, score no less than this below none at all. Skimmed scores of a
#: character's tags were off by 0.015 in the mean and by 0.24 at most on 1,152 windows of sf0.1.
MARGIN = 2.0
#: Least marginal probability of a tag within a span that the network adds.
MIN_CONFIDENCE = 0.9
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by kind and start, in code points, the end left out."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _AT_DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    if not _ANCHOR.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.groups())]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _char_codes() -> np.ndarray:
    """Input symbol of each code point below 256: printable ASCII by itself, other letters one, the rest one; 0 is padding."""
    codes = np.full(257, 97, dtype=np.int64)
    for c in range(32, 127):
        codes[c] = c - 31
    codes[[9, 10, 13]] = 1
    for c in range(128, 257):
        codes[c] = 96
    return codes


_CODES = _char_codes()
SYMBOLS = 98


def symbols(text: str) -> np.ndarray:
    return _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 256)]


#: Bits of operands: their products then sum to whole numbers of a unit, below 2 ** 53 of them, which any order of adding
#: gives exactly. Gradients have one bit less, since they are summed over a batch's characters.
BITS = 20
#: The logistic function is a table over [-REACH, REACH] with so many steps a unit.
REACH, STEPS = 16, 4096
# Ln 2 as two parts, the first with few enough bits for exact multiples.
_LN2 = (0.693145751953125, 1.4286068203094172e-06)


def _exp(x: np.ndarray) -> np.ndarray:
    """e ** x in sums and products alone, to about 1e-15."""
    x = np.clip(x, -700.0, 700.0)
    k = np.rint(x * 1.4426950408889634)
    r = (x - k * _LN2[0]) - k * _LN2[1]
    out = np.ones_like(r)
    for n in range(13, 0, -1):
        out = 1 + out * (r / n)
    return np.ldexp(out, k.astype(np.int32))


#: Place of 0 in the table, with the half that rounds.
_ZERO = REACH * STEPS + 0.5
_LOGISTIC = 1 / (1 + _exp(np.arange(REACH * STEPS, -REACH * STEPS - 1, -1) / STEPS))


def _looked_up(at: np.ndarray) -> np.ndarray:
    """The logistic function at the place at / STEPS - REACH of its table; beyond it, its ends."""
    return _LOGISTIC.take(at.astype(np.int64), mode="clip")


def _fixed(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """x rounded to bits binary places below its greatest magnitude."""
    unit = _unit_of(np.abs(x).max(initial=0.0), bits)
    return np.rint(x / unit) * unit


def _unit_of(greatest: float, bits: int) -> float:
    return math.ldexp(1.0, max(int(np.frexp(greatest)[1]), -900) - bits)


def _unit(h: np.ndarray) -> np.ndarray:
    """Activations, which lie in -1 to 1, rounded to BITS binary places."""
    return np.rint(h * (1 << BITS)) / (1 << BITS)


class LstmCrf:
    """One LSTM each way over embedded characters, a linear layer to tag scores, CRF transitions between tags.

    Training and reading give the same bits on every machine: matrices are multiplied in rounded numbers whose sums are
    exact in any order, sums over a batch likewise, and all else is elementwise in the four operations, square roots and
    tables. No result hangs on a BLAS, on vector widths or on a mathematical library."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.random(shape) - 0.5) * np.sqrt(12.0 / shape[0])

        t = len(TAGS)
        self.p = {"E": start(SYMBOLS, EMBED), "out": start(2 * HIDDEN, t), "b": np.zeros(t), "trans": np.zeros((t, t))}
        for way in "fb":
            self.p |= {f"{way}W": start(EMBED + HIDDEN, 4 * HIDDEN), f"{way}c": np.repeat(np.array([0.0, 1.0, 0.0, 0.0]), HIDDEN)}
        # A span's inside follows its own begin or inside; nothing else may.
        self.allowed = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in TAGS] for a in TAGS])
        self.first = np.array([not t.startswith("I") for t in TAGS])

    def _run(self, way: str, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """codes: (steps, n) in reading order; gates input, forget, output, candidate, features before windows. Sums are
        places in the table."""
        w, k = self.p[f"{way}W"], HIDDEN
        # The candidate is tanh(z) = 2 logistic(2 z) - 1.
        scale = STEPS * np.repeat([1, 1, 1, 2], k)[:, None]
        ahead = np.ascontiguousarray((_fixed(self.p["E"]) @ _fixed(w[:EMBED]) + self.p[f"{way}c"]).T * scale + _ZERO)
        wh = np.ascontiguousarray(_fixed(w[EMBED:]).T * scale)
        (steps, n), out = codes.shape, np.empty((k, *codes.shape))
        gates, cells, tops = (np.empty((m * k, steps, n)) for m in (4, 1, 1)) if keep else (None,) * 3
        h, c = np.zeros((k, n)), np.zeros((k, n))
        for s in range(steps):
            g = _looked_up(ahead.take(codes[s], axis=1, mode="clip") + wh @ h)
            c = g[k : 2 * k] * c + g[:k] * (2 * g[3 * k :] - 1)
            tc = 2 * _looked_up(c * (2 * STEPS) + _ZERO) - 1
            h = _unit(g[2 * k : 3 * k] * tc)
            out[:, s] = h
            if keep:
                gates[:, s], cells[:, s], tops[:, s] = g, c, tc
        return out, (gates, cells, tops, out)

    def _emissions(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """codes (n, steps) -> tag scores (tags, steps, n)."""
        forward, kf = self._run("f", codes.T, keep)
        backward, kb = self._run("b", codes.T[::-1], keep)
        h = np.concatenate([forward, backward[:, ::-1]])
        e = _fixed(self.p["out"]).T @ h.reshape(2 * HIDDEN, -1)
        return e.reshape(-1, *codes.T.shape) + self.p["b"][:, None, None], (h, kf, kb)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """codes (n, steps) -> tag scores (steps, n, tags)."""
        return self._emissions(codes)[0].transpose(1, 2, 0)

    def _back(self, way: str, x: np.ndarray, kept: tuple, dout: np.ndarray, grads: dict) -> np.ndarray:
        """x (EMBED, steps, n) and the gradient of out -> that of x."""
        gates, cells, tops, out = kept
        w, k = self.p[f"{way}W"], HIDDEN
        wx, wh = _fixed(w[:EMBED]), _fixed(w[EMBED:])
        i, f, o = (gates[m * k : (m + 1) * k] for m in range(3))
        u = 2 * gates[3 * k :] - 1
        before = lambda a: np.concatenate([np.zeros_like(a[:, :1]), a[:, :-1]], axis=1)
        slope = np.concatenate([u * i * (1 - i), before(cells) * f * (1 - f), tops * o * (1 - o), i * (1 - u * u)])
        into_c = o * (1 - tops * tops)
        # Gradients in whole units; should they outgrow what sums exactly, all is done again with a larger unit.
        unit, limit = _unit_of(np.abs(dout).max(initial=0.0), BITS), float(1 << (BITS + 6))
        steps, dz = x.shape[1], np.empty_like(gates)
        while True:
            dh = dc = np.zeros((k, x.shape[2]))
            for s in range(steps - 1, -1, -1):
                dh = dh + dout[:, s]
                dc = dc + dh * into_c[:, s]
                now = np.concatenate([dc, dc, dh, dc]) * slope[:, s]
                dz[:, s] = now
                dh, dc = (wh @ np.rint(now / unit)) * unit, dc * f[:, s]
            if np.abs(dz).max(initial=0.0) < limit * unit:
                break
            unit *= 64
        flat = _fixed(dz, BITS - 1).reshape(4 * k, -1)
        grads[f"{way}W"] = np.concatenate([_fixed(x, BITS - 1).reshape(EMBED, -1) @ flat.T, _fixed(before(out), BITS - 1).reshape(k, -1) @ flat.T])
        grads[f"{way}c"] = flat.sum(axis=1)
        return (wx @ flat).reshape(x.shape)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of the tags (n, steps) under the CRF."""
        e, (h, kf, kb) = self._emissions(codes, keep=True)
        (t, steps, n), y = e.shape, tags.T
        alpha, beta, ahead, trans = self._chances(e)
        de = alpha * beta
        np.add.at(de, (y, np.arange(steps)[:, None], np.arange(n)), -1.0)
        de = _fixed(de, BITS - 1)
        flat = lambda c: _fixed(c, BITS - 1).reshape(t, -1)
        dtrans = flat(alpha[:, :-1]) @ flat(ahead[:, 1:] * beta[:, 1:]).T * trans
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        grads = {"trans": dtrans, "b": de.sum(axis=(1, 2)), "out": _fixed(h, BITS - 1).reshape(2 * HIDDEN, -1) @ de.reshape(t, -1).T}
        dh = (_fixed(self.p["out"]) @ de.reshape(t, -1)).reshape(2 * HIDDEN, steps, n)
        x = self.p["E"].T[:, codes.T]
        dx = self._back("f", x, kf, dh[:HIDDEN], grads) + self._back("b", x[:, ::-1], kb, dh[HIDDEN:, ::-1], grads)[:, ::-1]
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], codes.T.ravel(), _fixed(dx, BITS - 1).reshape(EMBED, -1).T)
        return {k: g / n for k, g in grads.items()}

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags (n, steps) by Viterbi; an inside tag never stands without its begin."""
        return self._viterbi(self.scores(codes))

    def decode_with_confidence(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags and the CRF's marginal probability of each (n, steps); only windows with a tag need one."""
        e = self._emissions(codes)[0]
        tags = self._viterbi(e.transpose(1, 2, 0))
        sure = np.ones(tags.shape)
        own = np.flatnonzero(tags.any(axis=1))
        if len(own):
            alpha, beta, _, _ = self._chances(e[:, :, own])
            sure[own] = np.take_along_axis(alpha * beta, tags[own].T[None].astype(np.int64), axis=0)[0].T
        return tags, sure

    def _chances(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward chances (tags, steps, n), whose product is each tag's marginal probability; the tags' own
        weights over the forward scale, and the transitions' weights. Alpha, trans, weight and beta give a pair's marginal.
        Sums over tags go tag by tag, in their order."""
        own = _exp(e - e.max(axis=0))
        trans = _exp(self.p["trans"] - self.p["trans"].max())
        alpha, beta = np.empty_like(own), np.ones_like(own)
        for s in range(own.shape[1]):
            reached = own[:, s] if s == 0 else (alpha[:, None, s - 1] * trans[:, :, None]).sum(axis=0) * own[:, s]
            scale = reached.sum(axis=0)
            alpha[:, s] = reached / scale
            own[:, s] /= scale
        for s in range(own.shape[1] - 2, -1, -1):
            beta[:, s] = ((own[:, s + 1] * beta[:, s + 1])[:, None] * trans.T[:, :, None]).sum(axis=0)
        return alpha, beta, own, trans

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of scores (steps, n, tags). Where a path came from is asked on the way back, of the path taken alone."""
        steps, n, t = e.shape
        trans = np.where(self.allowed, self.p["trans"], -1e9)
        own, best = e.transpose(0, 2, 1), np.empty((steps, t, n))
        best[0] = np.where(self.first[:, None], own[0], -1e9)
        for s in range(1, steps):
            best[s] = (best[s - 1][:, None] + trans[:, :, None]).max(axis=0) + own[s]
        out = np.empty((n, steps), dtype=np.int8)
        out[:, -1] = best[-1].argmax(axis=0)
        for s in range(steps - 1, 0, -1):
            out[:, s - 1] = (best[s - 1] + trans[:, out[:, s]]).argmax(axis=0)
        return out


#: Next to 1.5 * 2 ** 23 the last bits of a number in single precision count ones. Shifted left by _SHIFT they are the bits
#: of a power of two with _FRACTION bits of its fraction, and all others are gone. _ONE is where that power is 1.
_FRACTION = 13
_SHIFT = np.int32(23 - _FRACTION)
_ONE = 1.5 * (1 << 23) + 127 * (1 << _FRACTION)
#: What e ** x has more than 1 for each unit of x, and the mean by which the straight line between two powers of two lies
#: above those between, in logarithms.
_PER_UNIT = (1 << _FRACTION) / math.log(2)
_ABOVE = 0.0573 * (1 << _FRACTION)
#: Bits of the product of e ** x and e ** -x, as powers are added.
_EVEN = np.int32(254 << 23)
#: Greatest sum of a gate, and greatest cell, of which the powers and their products stay within single precision.
_GATE_REACH, _CELL_REACH = 32.0, 80.0


class Skim:
    """An LstmCrf in single precision, without tables: tells how near a window's best tags come to outweighing none."""

    def __init__(self, model: LstmCrf) -> None:
        p, k = model.p, HIDDEN
        single = functools.partial(np.ascontiguousarray, dtype=np.float32)
        begin, inside = (np.arange(m, len(TAGS), 2) for m in (1, 2))
        order = np.concatenate([begin, inside])
        self.embedded, self.ways = single(p["E"].T), {}
        # Sums of gates are those of e ** -z, of the candidate of e ** z. A cell is kept as _PER_UNIT of it, by which the input
        # gate's power is divided.
        scale = _PER_UNIT * np.repeat([-1.0, -1.0, -1.0, 1.0], k)
        one = _ONE - np.repeat([math.log(_PER_UNIT) * _PER_UNIT + _ABOVE, _ABOVE, _ABOVE, 0.0], k)
        over_none = (p["out"][:, order] - p["out"][:, :1]).T
        widest = 0.0
        for way, own in (("f", over_none[:, :k]), ("b", over_none[:, k:])):
            w, c = p[f"{way}W"], p[f"{way}c"]
            widest = max(widest, float((np.abs(w[EMBED:]).sum(axis=0) + np.abs(p["E"] @ w[:EMBED] + c).max(axis=0)).max()))
            both = np.zeros((4 * k + len(own), k + EMBED + 1))
            both[: 4 * k] = (np.concatenate([w[EMBED:], w[:EMBED], c[None]]) * scale).T
            both[: 4 * k, -1] += one
            both[4 * k :, :k] = own
            self.ways[way] = single(both)
        self.fits = widest < _GATE_REACH
        self.bias = single(p["b"][order] - p["b"][0])[:, None]
        # Transitions as they differ from none to none; that of leaving a span is paid as it is entered.
        trans = p["trans"] - p["trans"][0, 0]
        leave = trans[:, 0]
        column = lambda x: single(x)[:, None]
        self.leave = column(leave[order])
        self.enter = column(trans[0, begin] + leave[begin])
        self.follow = column((trans[1:, begin] - leave[1:, None]).max(axis=0) + leave[begin])
        self.on = column(trans[begin, inside] + leave[inside] - leave[begin])
        self.stay = column(trans[inside, inside])

    def _run(self, way: str, codes: np.ndarray, scores: np.ndarray, start: np.ndarray | float = 0.0) -> np.ndarray:
        """Adds what one LSTM gives to the scores (steps, tags, n) over none; codes (steps, n) and scores in reading order.
        start is the state that it begins in; the one that it ends in is returned: activations and cells (2, features, n)."""
        w, k, n = self.ways[way], HIDDEN, codes.shape[1]
        given = np.zeros((w.shape[1], n), np.float32)
        given[-1] = 1
        h, x = given[:k], given[k:-1]
        sums, cell, up, down = (np.empty((m, n), np.float32) for m in (len(w), k, k, k))
        h[:], cell[:] = np.zeros((2, 1, 1)) + start
        gates, before = sums[: 4 * k], sums[4 * k :]
        (i, f, o, u), f_and_o = gates.reshape(4, k, n), gates[k : 3 * k]
        gate_bits, u_bits, up_bits, down_bits = (x.view(np.int32) for x in (gates, u, up, down))
        one, of_input, at_one = np.array([1, 1 / _PER_UNIT, _ONE], np.float32)
        least, most = np.array([_ONE - _CELL_REACH * _PER_UNIT, _ONE + _CELL_REACH * _PER_UNIT], np.float32)
        for s in range(len(codes)):
            self.embedded.take(codes[s], axis=1, out=x, mode="clip")
            np.matmul(w, given, out=sums)
            if s:
                scores[s - 1] += before
            # A gate is the reciprocal of 1 and its power, tanh a quotient of sums of a power and its inverse.
            np.left_shift(gate_bits, _SHIFT, out=gate_bits)
            i += of_input
            f_and_o += one
            np.subtract(_EVEN, u_bits, out=down_bits)
            np.subtract(u, down, out=up)
            u += down
            up /= u
            up /= i
            cell /= f
            cell += up
            # A cell moves by 1 at most.
            if s % 16 == 0:
                wide = max(cell.max(), -cell.min()) > (_CELL_REACH - 16) * _PER_UNIT
            np.add(cell, at_one, out=up)
            if wide:
                np.clip(up, least, most, out=up)
            np.left_shift(up_bits, _SHIFT, out=up_bits)
            np.subtract(_EVEN, up_bits, out=down_bits)
            np.subtract(up, down, out=u)
            up += down
            u /= up
            np.divide(u, o, out=h)
        scores[-1] += np.matmul(w, given, out=sums)[4 * k :]
        return np.stack([h, cell])

    def scores(self, codes: np.ndarray, pads: int = 0) -> np.ndarray:
        """codes (n, steps), after which as many symbols of padding are left out as pads says -> scores over none (steps,
        tags, n): the begin tags of all kinds, then the inside tags. The backward LSTM has read the padding."""
        codes = np.ascontiguousarray(codes.T, dtype=np.intp)
        out = np.empty((len(codes), len(self.leave), codes.shape[1]), np.float32)
        out[:] = self.bias
        self._run("f", codes, out)
        padding = np.zeros((pads, 1), np.intp)
        start = self._run("b", padding, np.zeros((pads, len(self.leave), 1), np.float32)) if pads else 0.0
        self._run("b", codes[::-1], out[::-1], start)
        return out

    def gains(self, codes: np.ndarray, pads: int = 0) -> np.ndarray:
        """By how much the best span of each window (n, steps) outweighs none, or a little more: a begin tag may follow
        any span at the price of the cheapest. Windows of a model that single precision does not hold get infinity.
        pads is that of scores()."""
        n = len(codes)
        if not self.fits:
            return np.full(n, np.inf, np.float32)
        half = len(self.leave) // 2
        best, ended = np.full((2, n), -np.inf, np.float32)
        at = np.full((2 * half, n), -np.inf, np.float32)
        begin, inside = at[:half], at[half:]
        for score in self.scores(codes, pads):
            inside += self.stay
            begin += self.on
            np.maximum(inside, begin, out=inside)
            np.add(self.follow, ended, out=begin)
            np.maximum(begin, self.enter, out=begin)
            at += score
            at.max(axis=0, out=ended)
            np.maximum(best, ended, out=best)
        # A span that a window's edge cuts is not left.
        return np.maximum(best, (at - self.leave).max(axis=0))

    def gains_of_texts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """gains() of windows that hold so many characters each, the rest of them being padding. Windows are read by length,
        no farther than PADS symbols after the longest one of those that are read at once."""
        order, ends = np.argsort(-lengths, kind="stable"), np.minimum(lengths + PADS, codes.shape[1])
        whole, out = int((ends == codes.shape[1]).sum()), np.empty(len(codes), np.float32)
        for part, most in ((order[:whole], SKIMMED), (order[whole:], -(-SKIMMED // 4))):
            for own in np.array_split(part, -(-len(part) // most)) if len(part) else ():
                upto = int(ends[own[0]])
                out[own] = self.gains(codes[own, :upto], codes.shape[1] - upto)
        return out


def training_windows(n: int = TRAIN_WINDOWS, seed: int = SEED) -> Iterator[tuple[str, list[Span]]]:
    """Labelled spans: personal data in many written forms between invented words, and look-alikes that are none. Card
    numbers in the forms of the base pattern count as look-alikes, since Luhn's sum, which tells them apart, is its matter.
    Of a span that a window's edge cuts, the rest has its label if it still holds a digit or an @; without them it may be
    any word. One window in four ends with its text, before its last character."""
    rng = np.random.default_rng(seed)

    def pick(*xs: str) -> str:
        return xs[int(rng.integers(len(xs)))]

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def word() -> str:
        onset, vowel, coda = ("", "b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "sch", "st", "t", "th", "tr", "v", "w", "x", "z", "ç", "ñ", "j"), ("a", "e", "i", "o", "u", "ä", "é", "è", "í", "ó", "ö", "ü", "ai", "ea", "eau", "ie", "ou", "y"), ("", "", "n", "r", "s", "t", "nd", "ng", "lle", "ch", "m", "d", "l", "st", "ß")
        w = "".join(pick(*onset) + pick(*vowel) + pick(*coda) for _ in range(int(rng.integers(1, 5))))
        return pick(w, w, w, w, w, w.capitalize(), w.upper()) + pick("", "", "", "", "", ",", ".", ".", "!!", "###", " |", "&&&", "$$$", "%%%", "***", ".***", "...", ";", ":", '"')

    def card(k: int, lead: str) -> str:
        body = lead + digits(k - 1 - len(lead))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def email() -> str:
        name = pick("", "j.", "max_") + word().strip(",.!#| ").lower() + pick("", ".", "-", "+") + digits(int(rng.integers(0, 3)))
        return (name or "a") + "@" + pick("mail", "web", "post") + pick("", digits(1)) + pick(".example.com", ".org", ".co.uk", ".de", ".EXAMPLE.COM", "")

    def ip() -> str:
        parts = [f"{x:x}" for x in rng.integers(0, 65536, 8)]
        return pick(".".join(str(x) for x in rng.integers(0, 256, 4)), ":".join(parts), f"{parts[0]}:{parts[1]}::{parts[2]}:{parts[3]}", f"fe80::{parts[0]}:{parts[1]}:{parts[2]}:{parts[3]}")

    def number() -> str:
        if rng.random() < 0.5:
            c = card(15, pick("34", "37"))
            return pick(".", " ", "-").join([c[:4], c[4:10], c[10:]])
        c = card(16, pick("4", "5", "2", "6"))
        return pick(".", "/", " - ").join([c[:4], c[4:8], c[8:12], c[12:]])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+{digits(11)}", f"+44 20 {c} {digits(4)}", f"1-{a}-{b}-{c}")

    def nothing() -> str:
        return pick("CC BY-NC 4.0.", "version 3.", "Version 2.0.", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f'token = "{rng.bytes(20).hex()}"', digits(int(rng.integers(1, 13))), f"{digits(2)}.{digits(1)}.{digits(1)}", f"no. {digits(5)}", "@", f"@{word()}", f"{digits(3)},{digits(3)}", f"{digits(4)}/{digits(2)}", f"{digits(1)}.{digits(3)}.{digits(3)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(3)} {digits(3)}", f"{digits(4)} {digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}", digits(int(rng.integers(12, 22))), digits(16), " ".join(digits(4) for _ in range(4)), f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", pick(word(), word()) + "://" + word(), " ".join(word() for _ in range(12)), " ".join(word() for _ in range(12)), " ".join(word() for _ in range(12)), f"{digits(3)}-{digits(2)}", f"{digits(1)}-{digits(1)}", f"{digits(2)}%", f"§ {digits(3)}", f"{digits(2)} {digits(2)} {digits(2)}", f'"{rng.bytes(16).hex()}"')

    makers = (("email", email), ("ip", ip), ("card", number), ("phone", phone), ("", nothing), ("", word))
    for _ in range(n):
        text, spans, ends = "", [], []
        while len(text) < WINDOW:
            kind, make = makers[int(rng.choice(6, p=(0.06, 0.06, 0.07, 0.08, 0.21, 0.52)))]
            piece = make()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
            ends.append(len(text))
            text += pick(" ", " ", " ", "\n", ", ", ". ")
        cut = int(rng.integers(0, max(1, len(text) - WINDOW)))
        end = cut + WINDOW
        if rng.random() < 0.25 and (within := [e for e in ends if cut + WINDOW // 4 <= e < end]):
            end = within[int(rng.integers(len(within)))]
        left = [(k, max(a, cut), min(b, end)) for k, a, b in spans if a < end and b > cut]
        yield text[cut:end], [(k, a - cut, b - cut) for k, a, b in left if _ANCHOR.search(text, a, b)]


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = SEED) -> LstmCrf:
    """Adam on the CRF's likelihood of the labelled spans."""
    codes, tags = np.zeros((len(examples), WINDOW), dtype=np.int64), np.zeros((len(examples), WINDOW), dtype=np.int64)
    for i, (text, spans) in enumerate(examples):
        codes[i, : len(text)] = symbols(text)
        for kind, a, b in spans:
            tags[i, a:b] = TAGS.index(f"I-{kind}")
            tags[i, a] = TAGS.index(f"B-{kind}")
    model, rng, fade_one, fade_two = LstmCrf(seed), np.random.default_rng(seed), 1.0, 1.0
    one, two = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            fade_one, fade_two = fade_one * 0.9, fade_two * 0.99
            grads = model.gradients(codes[order[at : at + BATCH]], tags[order[at : at + BATCH]])
            norm = math.sqrt(sum(float(_fixed(g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                model.p[k] -= RATE * (1 - epoch / epochs) * (one[k] / (1 - fade_one)) / (np.sqrt(two[k] / (1 - fade_two)) + 1e-8)
    return model


#: Weights are kept in whole units of this, within 16 bits.
WEIGHT_UNIT = 1 / 1024
WEIGHTS = "pii_weights.npz"


def fitted() -> dict[str, np.ndarray]:
    """The weights that WEIGHTS holds, in units: fitted on training_windows() in about two minutes, the same on every
    machine. `python -m tidegauge.llm.pii` writes them; a test fits them anew and compares."""
    return {k: np.rint(v / WEIGHT_UNIT).astype(np.int16) for k, v in fit(list(training_windows())).p.items()}


@functools.lru_cache(maxsize=1)
def default_model() -> LstmCrf:
    """The network with the weights of fitted()."""
    model = LstmCrf()
    with np.load(io.BytesIO(pkgutil.get_data("tidegauge.llm", WEIGHTS))) as kept:
        model.p = {k: kept[k] * WEIGHT_UNIT for k in model.p}
    return model


def window_starts(text: str) -> Iterable[int]:
    """Starts of overlapping windows over all of a text."""
    return range(0, max(1, len(text) - STRIDE), READ - STRIDE) if text else ()


class _Tags:
    """Tags of one text, reconciled as its windows come in order: where windows overlap, the one decides in which the
    character lies farthest from an edge. What no further window reaches is kept where it is tagged, and nothing else."""

    _EDGE = np.minimum(np.arange(READ), np.arange(READ)[::-1]).astype(np.int16)

    def __init__(self) -> None:
        self._at, self._far, self._tag, self._p = 0, np.zeros(0, np.int16), np.zeros(0, np.int8), np.zeros(0)
        self._kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, start: int, tags: np.ndarray, sure: np.ndarray) -> None:
        self._settle(start)
        n = READ - len(self._far)
        far = np.concatenate([self._far, np.full(n, -1, np.int16)])
        nearer = self._EDGE > far
        self._far = np.where(nearer, self._EDGE, far)
        self._tag = np.where(nearer, tags, np.concatenate([self._tag, np.zeros(n, np.int8)]))
        self._p = np.where(nearer, sure, np.concatenate([self._p, np.zeros(n)]))
        self._at = start

    def _settle(self, upto: int) -> None:
        """Characters before upto are decided."""
        done = min(max(0, upto - self._at), len(self._tag))
        own = np.flatnonzero(self._tag[:done])
        if len(own):
            self._kept.append((self._at + own, self._tag[own], self._p[own].astype(np.float32)))
        self._far, self._tag, self._p = self._far[done:], self._tag[done:], self._p[done:]

    def spans(self) -> Iterator[Span]:
        """Maximal runs of one kind that are likely enough; a begin tag starts anew."""
        self._settle(self._at + READ)
        if not self._kept:
            return
        at, tag, p = (np.concatenate(x) for x in zip(*self._kept, strict=True))
        kind, begins = (tag - 1) // 2, (tag - 1) % 2 == 0
        new = np.ones(len(at), dtype=bool)
        new[1:] = begins[1:] | (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        for i in np.flatnonzero(np.minimum.reduceat(p, first) >= MIN_CONFIDENCE).tolist():
            yield KINDS[kind[first[i]]], int(at[first[i]]), int(at[last[i]]) + 1


def _decoded(model: LstmCrf, codes: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tags and their probabilities of the windows that which names, in order; DECODED of them are held at once."""
    for k in range(0, len(which), DECODED):
        own = codes[which[k : k + DECODED]].astype(np.int64)
        tags, sure = model.decode_with_confidence(own)
        tags[own == 0] = 0
        yield from zip(tags, sure, strict=True)


def added_spans(model: LstmCrf, texts: list[str], base: list[list[Span]], starts_of: Callable[[str], Iterable[int]] = window_starts) -> list[list[Span]]:
    """Spans of the network that touch no base span, one list a text. starts_of gives a text's windows in order; ROUND
    of them are held at once, whatever the length of a text."""
    out: list[list[Span]] = [[] for _ in texts]
    windows = ((i, s) for i, t in enumerate(texts) for s in starts_of(t))
    now, held = -1, _Tags()

    def finish() -> None:
        if now >= 0:
            taken = sorted((a, b) for _, a, b in base[now])
            starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
            # The base spans that begin before the end of a found one must all end before its start.
            out[now] = [(kind, a, b) for kind, a, b in held.spans() if not (k := bisect.bisect_left(starts, b)) or reach[k - 1] <= a]

    skim = Skim(model)
    none, certain = np.zeros(READ, np.int8), np.ones(READ)
    # Windows without a tag since, which count only where one with tags overlaps them; the end of the last one decoded.
    skipped, reach = [], 0
    while part := list(itertools.islice(windows, ROUND)):
        codes = np.zeros((len(part), READ), dtype=np.uint8)
        for k, (i, s) in enumerate(part):
            got = symbols(texts[i][s : s + READ])
            codes[k, : len(got)] = got
        near = skim.gains_of_texts(codes, np.count_nonzero(codes, axis=1)) >= -MARGIN
        decoded = _decoded(model, codes, np.flatnonzero(near))
        for k, (i, s) in enumerate(part):
            if i != now:
                finish()
                now, held, skipped, reach = i, _Tags(), [], 0
            if near[k]:
                for before in skipped:
                    if before + READ > s:
                        held.add(before, none, certain)
                held.add(s, *next(decoded))
                skipped, reach = [], s + READ
            elif s < reach:
                held.add(s, none, certain)
            else:
                skipped = [x for x in skipped if x + READ > s]
                skipped.append(s)
    finish()
    return out


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(texts: list[str], model: LstmCrf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(model, texts, base), strict=True))


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans, one placeholder for all."""
    out, last = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, model: LstmCrf | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every text, null as empty; base spans are
    counted and digested, spans holds them and the added ones."""
    net = model or default_model()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch in text_slices(whole, "text", WIDE_SLICE_BYTES):
                texts = pc.fill_null(batch.column("text"), "")
                rows = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
                counts = {k: np.zeros(batch.num_rows, dtype=np.int64) for k in KINDS}
                sums, spans = [empty] * batch.num_rows, [""] * batch.num_rows
                for i, (base, more) in zip(rows.tolist(), find(texts.take(pa.array(rows)).to_pylist(), net), strict=True):
                    for kind, _, _ in base:
                        counts[kind][i] += 1
                    sums[i] = hashlib.sha256(join_spans(base).encode()).hexdigest()
                    spans[i] = join_spans(base + more)
                cols = [batch.column("doc_id"), *(pa.array(counts[k]) for k in KINDS), pa.array(sums, type=pa.string()), pa.array(spans, type=pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, model: LstmCrf | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind; null texts stay null, other columns stay as they are."""
    net = model or default_model()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", WIDE_SLICE_BYTES):
                col = batch.column("text")
                rows = np.flatnonzero(pc.binary_length(pc.fill_null(col, "")).to_numpy(zero_copy_only=False))
                if len(rows):
                    texts = col.take(pa.array(rows)).to_pylist()
                    new = {i: redact(t, base + more) for i, t, (base, more) in zip(rows.tolist(), texts, find(texts, net), strict=True)}
                    masks = np.zeros(len(col), dtype=bool)
                    masks[rows] = True
                    col = pc.replace_with_mask(col, pa.array(masks), pa.array([new[i] for i in rows.tolist()], type=col.type))
                at = batch.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([col if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(step, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return detect(table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    from pathlib import Path

    np.savez_compressed(Path(__file__).with_name(WEIGHTS), **fitted())
