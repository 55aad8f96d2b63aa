"""Personal data: fixed rules, and a character-level bidirectional LSTM with CRF transitions.

Rules (half-open code point ranges, leftmost and without overlap for each kind): e-mail addresses, IPv4 addresses, card numbers
(Luhn), phone numbers. The network reads every text whole, in windows of ``SPREAD`` characters of which neighbours share ``OVERLAP`` (it is trained on
windows of ``WINDOW``). Each window is decoded by itself (Viterbi, with the certainty of its tags, where its best path tags anything); the windows' spans are then reconciled over the whole text: spans
of one kind that overlap are one, and of spans of different kinds that overlap the set with the greatest certain length stays. Spans of ``LEAST`` characters or
more whose tags are certain enough (``SURE``) and that touch no rule span are added as ``kind`` + ``_net``.

The network is trained in one task on a bounded sample of segments: the surroundings of triggers (a digit, ``@`` or ``+``, also in full width; "at" and
"dot" where they may stand for signs of an address), joined if nearer than ``2 * AROUND`` and grown to whole runs of other than blanks and to whole rule
spans (``SAMPLE`` with rule spans of each kind and without any, by hash, those of at most ``LONGEST`` characters), and as many stretches between them, with the rule spans as labels, and on ``DISGUISES`` copies of each: its spans written as the rules can't read them
(spelt-out signs, other separators, full-width digits) and still labelled, or replaced by harmless numbers, dates and versions. A quarter of the segments with all
copies is held back; ``recall`` (disguised spans found there) and ``clean`` (share of segments without a span left alone) stay with the network. With fewer
than ``ENOUGH`` labelled segments none is fitted and nothing is added.

Every text is read twice, whole: for the sample, then for the spans. A null or empty text has no spans; repeated rows give repeated results; long texts are as
many windows as they need; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.llm.common import keyed_text, per_worker, slices
from pegwatch.llm.spans import SPAN, Adam, char_codes, fit_in_task
from pegwatch.session import cut

KINDS = ("email", "ip", "card", "phone")
# fixed values
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = re.compile("[0-9@+\uff10-\uff19\uff20\uff0b]+")
WORDY = re.compile(r"[(\[{<]\x20*(?:at|dot)\x20*[)\]}>]|(?<![^\W_])(?:dot|at(?=\x20+[A-Za-z0-9-]+\.[A-Za-z]))(?![^\W_])", re.IGNORECASE)

AROUND, WINDOW = 20, 64
SPREAD, OVERLAP, READ = 288, WINDOW // 2, 1024  # windows of whole texts, what two of them share, windows read at once
SAMPLE, LONGEST, ENOUGH, DISGUISES, PLAIN = 150, 4096, 20, 2, 256
EPOCHS, STEPS = 10, 120  # passes over the sample, and steps at least
HIDDEN, EMBED = 16, 12
LEAST, SURE = 6, 0.95
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start. Each search starts where a leftmost match can: at the run before
    an ``@``, at the head of a run of digits, at a ``+``; so the time is linear in the text."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    ips, cards, ip_done, card_done = [], [], 0, 0
    for run in DIGITS.finditer(text):
        s = run.start()
        if s >= ip_done and (m := IP.match(text, s)):
            ip_done = m.end()
            if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in m.groups()):
                ips.append((1, s, ip_done))
        if s >= card_done and (m := CARD.match(text, s)):
            card_done = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append((2, s, card_done))
    found += ips + cards
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((3, at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return found


def segments(text: str, spans: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Surroundings of the triggers, grown to whole runs without a blank and whole rule spans; none overlap."""
    parts = [(max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)) for found in (SIGNS.finditer(text), WORDY.finditer(text)) for m in found]
    out: list[list[int]] = []
    for a, b in sorted(parts + [(s, e) for _, s, e in spans]):
        done = out[-1][1] if out else 0
        if a > done or not out:
            while a > done and not text[a - 1].isspace():
                a -= 1
        if b > done or not out:
            while b < len(text) and not text[b].isspace():
                b += 1
        if out and a <= done:
            out[-1][1] = max(done, b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def stretch(text: str, parts: list[tuple[int, int]]) -> str:
    """The longest part of a text between its segments, ``PLAIN`` characters of it at most: what a network that reads whole texts mostly sees."""
    edges = [0, *(x for p in parts for x in p), len(text)]
    a, b = max(zip(edges[::2], edges[1::2], strict=True), key=lambda p: p[1] - p[0])
    return text[a:min(b, a + PLAIN)]


def scan(rows: DataFrame) -> DataFrame:
    """For training: seen (start and text of each segment with the rule spans in it; last, a stretch without any)."""
    seen = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("kinds", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32()))]))

    def one(text: str) -> list:
        base, out = rule_spans(text), []
        parts = segments(text, base)
        for a, b in parts:
            inside = [(k, s - a, e - a) for k, s, e in base if a <= s and e <= b]
            out.append({"start": a, "text": text[a:b], "kinds": [k for k, _, _ in inside], "marks": [x for _, s, e in inside for x in (s, e)]})
        plain = stretch(text, parts)
        return out + ([{"start": None, "text": plain, "kinds": [], "marks": []}] if plain else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([one(t) for t in part.column("text").to_pylist()], seen)], names=["seen"])

    return rows.mapInArrow(run, "seen array<struct<start:int,text:string,kinds:array<int>,marks:array<int>>>")


def tags_of(size: int, kinds: list[int], marks: list[int]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, s, e in zip(kinds, marks[::2], marks[1::2], strict=True):
        if not out[s:e].any():
            out[s:e], out[s] = 2 + 2 * k, 1 + 2 * k
    return out


WIDE = {c: chr(ord(c) + 0xFEE0) for c in "0123456789"}
NARROW = {0xFEE0 + c: c for c in range(0x21, 0x7F)}  # full-width signs as the network reads them


def written_otherwise(kind: int, text: str, rnd: np.random.Generator) -> str:
    """A rule span as the rules can't read it."""
    pick = lambda *some: some[int(rnd.integers(0, len(some)))]
    if kind == 0:
        at, dot = pick(" at ", " (at) ", "(at)", " [at] ", "[at]", " AT "), pick(" dot ", " (dot) ", "[dot]", " DOT ", ".")
        local, domain = text.split("@", 1)
        return local + at + domain.replace(".", dot)
    digits = re.findall("[0-9]+", text)
    if kind == 1:
        out = pick(" . ", " dot ", "[.]", " (dot) ", ",").join(digits)
    elif kind == 2:
        whole = "".join(digits)
        out = pick(".", " - ", "_", "/", "  ").join(whole[i:i + 4] for i in range(0, len(whole), 4))
    else:
        out = pick("00", "plus ", "\uff0b", "(00) ") + pick(".", "/", " - ", " ", "-").join(digits)
    return "".join(WIDE.get(c, c) for c in out) if rnd.random() < 0.25 else out


def harmless(rnd: np.random.Generator) -> str:
    n = lambda a, b: str(int(rnd.integers(a, b)))
    return (f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 20)}.{n(0, 40)}.{n(0, 90)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"{n(1, 900)},{n(100, 999)}.{n(10, 99)}",
            f"{n(10_000, 9_999_999)}", f"{n(2, 99)} at {n(1, 12)}", "noted at once", "a dot on")[int(rnd.integers(0, 8))]


def disguised(text: str, kinds: list[int], marks: list[int], telling: bool, rnd: np.random.Generator) -> tuple[str, list[int], list[int]]:
    """The segment with its spans written otherwise (still labelled), or with harmless text in their place (no labels)."""
    out, kept, places, at = "", [], [], 0
    for k, s, e in sorted(zip(kinds, marks[::2], marks[1::2], strict=True), key=lambda x: x[1]):
        if s < at:
            continue
        out += text[at:s]
        new = written_otherwise(k, text[s:e], rnd) if telling else harmless(rnd)
        if telling:
            kept.append(k)
            places += [len(out), len(out) + len(new)]
        out, at = out + new, e
    return out + text[at:], kept, places


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end, certainty) of all windows as one set without overlaps: those of a kind that overlap are one; of what
    then overlaps, the set with the greatest certain length."""
    merged: list[list] = []
    for k, s, e, p in sorted(spans):
        if merged and merged[-1][0] == k and s < merged[-1][2]:
            merged[-1][2], merged[-1][3] = max(e, merged[-1][2]), max(p, merged[-1][3])
        else:
            merged.append([k, s, e, p])
    merged.sort(key=lambda x: (x[2], x[1], x[0]))
    ends = [m[2] for m in merged]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (_, s, e, p) in enumerate(merged):
        before = bisect_right(ends, s, 0, i)
        best.append(max((best[before][0] + (e - s) * p, before, True), (best[i][0], i, False)))
    out, i = [], len(merged)
    while i:
        _, before, taken = best[i]
        if taken:
            out.append(tuple(merged[i - 1][:3]))
        i = before
    return sorted(out, key=lambda x: x[1])


def _bounded(x: np.ndarray) -> np.ndarray:
    """The cells' bounded function, of slope (1 - |value|)^2: a division takes a fifth of the time of an exponential."""
    return x / (1 + np.abs(x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, texts: list[str], tags: list[np.ndarray], seed: int = 5, epochs: int | None = None):
        rnd = np.random.default_rng(seed)
        glorot = lambda a, b: rnd.normal(0, np.sqrt(2 / a), (a, b)).astype(np.float32)
        self.w = {"emb": rnd.normal(0, 0.3, (128, EMBED)).astype(np.float32), "out": glorot(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.w[f"{d}x"], self.w[f"{d}h"] = glorot(EMBED, 4 * HIDDEN), glorot(HIDDEN, 4 * HIDDEN)
            self.w[f"{d}c"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.banned = np.zeros((TAGS, TAGS), np.float32)  # an inside tag only follows its own kind
        for k in range(len(KINDS)):
            self.banned[:, 2 + 2 * k] = -1e4
            self.banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        pieces, truth, sizes = [], [], []
        for t, y in zip(texts, tags, strict=True):
            for lo in range(0, max(1, len(t) - WINDOW // 2), WINDOW // 2):
                part = y[lo:lo + WINDOW].copy()
                if len(part) and part[0] and part[0] % 2 == 0:  # a window may begin inside a span
                    part[0] -= 1
                pieces.append(t[lo:lo + WINDOW])
                truth.append(np.pad(part, (0, WINDOW - len(part))))
                sizes.append(len(part))
        codes, truth, sizes = codes_of(pieces), np.array(truth), np.array(sizes)
        batches = max(1, len(codes) // 64)
        epochs = epochs or max(EPOCHS, -(-STEPS // batches))
        steps = Adam(self.w, 0.04)
        for epoch in range(epochs):
            steps.rate = 0.04 * (1 - epoch / epochs) + 0.002
            for some in np.array_split(rnd.permutation(len(codes)), batches):
                steps.step(self._gradients(codes[some], truth[some], sizes[some]))

    def _lstm(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Over time-major inputs (time, rows, EMBED)."""
        n = x.shape[1]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        out = np.zeros((len(x), n, HIDDEN), np.float32)
        for t in range(len(x)):
            z = pre[t] + h @ self.w[f"{d}h"]
            s = (1 + _bounded(z[:, : 3 * HIDDEN])) * np.float32(0.5)
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], _bounded(z[:, 3 * HIDDEN:])
            before = c
            c = f * c + i * g
            tc = _bounded(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def _reversed(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each row the index that turns its first ``size`` places around."""
        t = np.arange(codes.shape[1])[None, :]
        return np.where(t < sizes[:, None], sizes[:, None] - 1 - t, t)

    def emissions(self, codes: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        turn = self._reversed(codes, sizes)
        x = self.w["emb"][codes]
        back = np.take_along_axis(x, turn[..., None], 1)
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._lstm("f", x.swapaxes(0, 1), kf).swapaxes(0, 1)
        hb = np.take_along_axis(self._lstm("b", back.swapaxes(0, 1), kb).swapaxes(0, 1), turn[..., None], 1)
        h = np.concatenate([hf, hb], 2)
        if keep is not None:
            keep |= {"turn": turn, "x": x, "back": back, "f": kf, "b": kb, "h": h}
        return h @ self.w["out"] + self.w["ob"]

    def _gradients(self, codes, truth, sizes) -> dict[str, np.ndarray]:
        kept: dict = {}
        e = self.emissions(codes, sizes, kept)
        n, steps = codes.shape
        trans = (self.w["trans"] + self.banned).astype(np.float64)
        live = np.arange(steps)[None, :] < sizes[:, None]
        alpha, beta = np.zeros((steps, n, TAGS)), np.zeros((steps, n, TAGS))
        alpha[0] = e[:, 0]
        for t in range(1, steps):
            new = _logsumexp(alpha[t - 1][:, :, None] + trans[None], 1) + e[:, t]
            alpha[t] = np.where(live[:, t, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = _logsumexp(trans[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[:, t + 1, None], new, 0)
        z = _logsumexp(alpha[-1], 1)
        de = np.exp(alpha.swapaxes(0, 1) + beta.swapaxes(0, 1) - z[:, None, None]) * live[..., None]
        de[np.arange(n)[:, None], np.arange(steps)[None, :], truth] -= live
        dtrans = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            joint = np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            dtrans += joint.sum(0)
            np.subtract.at(dtrans, (truth[live[:, t], t - 1], truth[live[:, t], t]), 1)
        de, scale = (de / n).astype(np.float32), 1 / n
        h = kept["h"]
        grads = {"out": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "ob": de.sum((0, 1)), "trans": (dtrans * scale).astype(np.float32)}
        dh = de @ self.w["out"].T
        slope = lambda value: (1 - np.abs(value)) ** 2
        demb = np.zeros_like(self.w["emb"])
        for d, part, x in (("f", dh[..., :HIDDEN], kept["x"]), ("b", np.take_along_axis(dh[..., HIDDEN:], kept["turn"][..., None], 1), kept["back"])):
            gx, gh, dz_all = np.zeros_like(self.w[f"{d}x"]), np.zeros_like(self.w[f"{d}h"]), np.zeros((steps, n, 4 * HIDDEN), np.float32)
            carry_h, carry_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                before_h, before_c, i, f, o, g, tc = kept[d][t]
                total = part[:, t] + carry_h
                dc = total * o * slope(tc) + carry_c
                dz = np.concatenate([dc * g * slope(2 * i - 1) / 2, dc * before_c * slope(2 * f - 1) / 2, total * tc * slope(2 * o - 1) / 2, dc * i * slope(g)], 1)
                carry_c = dc * f
                carry_h = dz @ self.w[f"{d}h"].T
                gh += before_h.T @ dz
                dz_all[t] = dz
            flat = dz_all.swapaxes(0, 1)
            gx += x.reshape(-1, EMBED).T @ flat.reshape(-1, 4 * HIDDEN)
            grads |= {f"{d}x": gx, f"{d}h": gh, f"{d}c": flat.sum((0, 1))}
            dx = flat @ self.w[f"{d}x"].T
            where = codes if d == "f" else np.take_along_axis(codes, kept["turn"], 1)
            np.add.at(demb, where, dx)
        grads["emb"] = demb
        return grads

    def scores(self, codes: np.ndarray, sizes: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """The emissions, for reading only (rows, places, tags; in memory tags, places, rows): inputs by table, the gates in blocks of their own,
        every step in place, a gate as twice its value. Padding (code 0) offers nothing to a state without anything, so the backward states begin
        at each window's last character. ``room`` (32-bit) holds the states where memory is used again."""
        n, steps = codes.shape
        seen = np.ascontiguousarray(codes.T, np.intp)
        blocks = lambda x: np.ascontiguousarray(x.reshape(len(x), 4, HIDDEN).swapaxes(0, 1), np.float32)
        z, more = np.empty((4, n, HIDDEN), np.float32), np.empty((4, n, HIDDEN), np.float32)
        gates, offer, keep, out, cell = z[:3], z[0], z[1], z[2], z[3]
        states = (np.empty(steps * n * HIDDEN, np.float32) if room is None else room[:steps * n * HIDDEN]).reshape(steps, n, HIDDEN)
        half, one, e = np.float32(0.5), np.float32(1), np.zeros((TAGS, steps * n), np.float32)
        for d, order, part in (("f", range(steps), self.w["out"][:HIDDEN]), ("b", range(steps - 1, -1, -1), self.w["out"][HIDDEN:])):
            table = self.w["emb"] @ self.w[f"{d}x"] + self.w[f"{d}c"]
            table[0] = 0
            table, own = blocks(table), blocks(self.w[f"{d}h"] * half)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in order:
                np.take(table, seen[t], 1, out=z, mode="clip")
                np.matmul(h, own, out=more)
                np.add(z, more, out=z)
                np.abs(z, out=more)
                np.add(more, one, out=more)
                np.divide(z, more, out=z)
                np.add(gates, one, out=gates)
                np.multiply(c, keep, out=c)
                np.multiply(offer, cell, out=cell)
                np.add(c, cell, out=c)
                np.multiply(c, half, out=c)
                h = np.abs(c, out=states[t])
                np.add(h, one, out=h)
                np.divide(c, h, out=h)
                np.multiply(h, out, out=h)
            e += (part.T * half).astype(np.float32) @ states.reshape(-1, HIDDEN).T
        e += self.w["ob"][:, None]
        return e.reshape(TAGS, steps, n).transpose(2, 1, 0)

    def plain(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Windows whose best tags are surely all outside: the best path that tags anything, found by its weight alone (relative to all places
        outside, in 32 bits), doesn't come near theirs."""
        trans = self.w["trans"] + self.banned
        trans = (trans - trans[0, 0]).astype(np.float32)
        begin, inside = slice(0, 2 * len(KINDS), 2), slice(1, 2 * len(KINDS), 2)  # tags without the one for outside
        after = np.ascontiguousarray(trans[1:, [*range(1, TAGS, 2), 0]])[:, :, None]  # from a tag into the begin of one, or out
        opens, goes_on, stays = trans[0, 1::2, None], np.diag(trans[1::2, 2::2])[:, None], np.diag(trans[2::2, 2::2])[:, None]
        at = e.transpose(1, 2, 0)  # places, tags, windows
        n, short = len(e), int(sizes.min(initial=len(at)))
        best, gone = np.full((TAGS - 1, n), -1e6, np.float32), np.full(n, -1e6, np.float32)  # the last place tagged; outside again
        made, reach, new = np.empty((TAGS - 1, len(KINDS) + 1, n), np.float32), np.empty((len(KINDS) + 1, n), np.float32), np.empty_like(best)
        for t in range(len(at)):
            np.add(best[:, None, :], after, out=made)
            made.max(0, out=reach)
            np.add(best[begin], goes_on, out=new[begin])
            np.add(best[inside], stays, out=new[inside])
            np.maximum(new[begin], new[inside], out=new[inside])
            np.maximum(reach[:-1], np.maximum(gone, 0) + opens, out=new[begin])
            if not t:
                new[:] = 0  # no transition leads to the first place
            new += at[t, 1:]
            new -= at[t, :1]
            np.maximum(gone, reach[-1], out=reach[-1])
            live = True if t < short else t < sizes
            np.copyto(best, new, where=live)
            np.copyto(gone, reach[-1], where=live)
        return np.maximum(best.max(0), gone) < -1e-2

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the sure spans of each text: its windows decoded, then reconciled. Every window is read; tags are only
        sought where some may be, and certainties where some are."""
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        owner, at, sizes, codes = windows_of(texts)
        order = np.argsort(sizes, kind="stable")  # windows of about one length are read together
        room = np.empty(min(READ, len(order)) * SPREAD * HIDDEN, np.float32)
        held, waiting = [], 0

        def take_spans() -> None:
            some = np.concatenate([w for w, _ in held])
            e = np.zeros((len(some), SPREAD, TAGS))
            lo = 0
            for w, part in held:
                e[lo:lo + len(w), :part.shape[1]] = part
                lo += len(w)
            tags = self.viterbi(e, sizes[some])
            tagged = np.flatnonzero(tags.any(1))
            for w, row, p in zip(some[tagged].tolist(), tags[tagged], self.certainty(e[tagged], sizes[some[tagged]]), strict=True):
                found[owner[w]] += [(k, int(at[w]) + a, int(at[w]) + b, c) for k, a, b, c in self.spans_of(row[:sizes[w]], p[:sizes[w]])]

        for lo in range(0, len(order), READ):
            some = order[lo:lo + READ]
            e = self.scores(codes[some, :sizes[some[-1]]], sizes[some], room)
            maybe = np.flatnonzero(~self.plain(e, sizes[some]))
            held.append((some[maybe], e[maybe]))
            waiting += len(maybe)
            if waiting and (waiting >= READ or lo + READ >= len(order)):
                take_spans()
                held, waiting = [], 0
        return [[s for s in reconciled([f for f in spans if f[3] >= SURE]) if s[2] - s[1] >= LEAST] for spans in found]

    def viterbi(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best tags of each window (rows, places); places after its size are outside."""
        n, steps, _ = e.shape
        trans = (self.w["trans"] + self.banned).astype(np.float64)
        best, back = e[:, 0].copy(), np.zeros(e.shape, np.int64)
        for t in range(1, steps):
            reach = best[:, :, None] + trans[None]
            back[:, t] = reach.argmax(1)
            live = (t < sizes)[:, None]
            best = np.where(live, reach.max(1) + e[:, t], best)
        tags = np.zeros((n, steps), np.int64)
        at = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            live = t < sizes
            tags[:, t] = np.where(live, at, 0)
            at = np.where(live, back[np.arange(n), t, at], at) if t else at
        return tags

    def certainty(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place, given the whole window."""
        trans = (self.w["trans"] + self.banned).astype(np.float64)
        steps = e.shape[1]
        ahead, behind = np.zeros(e.shape), np.zeros(e.shape)
        ahead[:, 0] = e[:, 0]
        for t in range(1, steps):
            ahead[:, t] = _logsumexp(ahead[:, t - 1][:, :, None] + trans[None], 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            new = _logsumexp(trans[None] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t + 1 < sizes)[:, None], new, 0)
        both = ahead + behind
        return np.exp(both - _logsumexp(both, 2)[..., None])

    @staticmethod
    def spans_of(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, mean certainty of being inside that kind). A window may begin inside a span."""
        out, t = [], 0
        while t < len(tags):
            end = t + 1
            if tags[t]:
                k = (int(tags[t]) - 1) // 2
                while end < len(tags) and tags[end] == 2 + 2 * k:
                    end += 1
                out.append((k, t, end, float(sure[t:end, 1 + 2 * k:3 + 2 * k].sum(1).mean())))
            t = end
        return out


def codes_of(texts: list[str]) -> np.ndarray:
    return char_codes([t if t.isascii() else t.translate(NARROW) for t in texts], WINDOW)


def narrow_codes(text: str, width: int) -> np.ndarray:
    """``char_codes`` of one text, full-width signs as the plain ones, padded with 0."""
    out = np.zeros(width, np.uint8)
    if text.isascii():
        c = np.frombuffer(text.encode(), np.uint8)
    else:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where((c > 0xFF00) & (c < 0xFF5F), c - 0xFEE0, c)
    out[:len(c)] = np.where(c < 128, np.maximum(c, 1), 1)
    return out


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of whole texts, each sharing ``OVERLAP`` characters with the next: text, start, size and codes (padded with 0)."""
    step = SPREAD - OVERLAP
    owner, at, sizes, codes = [], [], [], []
    for i, t in enumerate(texts):
        starts = np.arange(0, max(1, len(t) - OVERLAP), step)
        codes.append(np.lib.stride_tricks.sliding_window_view(narrow_codes(t, int(starts[-1]) + SPREAD), SPREAD)[::step])
        at.append(starts)
        sizes.append(np.minimum(SPREAD, len(t) - starts))
        owner.append(np.full(len(starts), i))
    if not texts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, SPREAD), np.uint8)
    return np.concatenate(owner), np.concatenate(at), np.concatenate(sizes), np.concatenate(codes)


def fit(scanned: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger from a bounded sample of segments; None if too few hold a rule span."""
    each = scanned.select(F.explode("seen").alias("s")).select("s.text", "s.kinds", "s.marks", F.col("s.start").isNull().alias("plain")).where(F.length("text") <= LONGEST)
    rows, labelled = {}, 0
    for k in (*range(len(KINDS)), None, "plain"):
        mine = each.where("plain") if k == "plain" else each.where(F.size("kinds") == 0).where("not plain") if k is None else each.where(F.array_contains("kinds", k))
        got = mine.drop("plain").distinct().orderBy(F.xxhash64("text"), "text").limit(sample).collect()
        labelled += len(got) if isinstance(k, int) else 0
        rows |= {(r["text"], tuple(r["kinds"]), tuple(r["marks"])): r for r in got}
    if labelled < ENOUGH:
        return None
    return fit_in_task(scanned.sparkSession, trained, [(r["text"], list(r["kinds"]), list(r["marks"])) for r in (rows[k] for k in sorted(rows))])


def trained(rows: list[tuple[str, list[int], list[int]]], seed: int = 5, copies: int = DISGUISES) -> Tagger:
    """A tagger from three quarters of the labelled segments and their disguised copies, measured on those of the rest."""
    rnd = np.random.default_rng(seed)
    held = set(rnd.permutation(len(rows))[:len(rows) // 4].tolist())
    used, kept = [], []
    for i, (text, kinds, marks) in enumerate(rows):
        made = [disguised(text, kinds, marks, c % 2 == 0 or rnd.random() < 0.5, rnd) for c in range(copies)] if kinds else []
        (kept if i in held else used).extend([(text, kinds, marks, False), *((*m, True) for m in made)])
    tagger = Tagger([t for t, *_ in used], [tags_of(len(t), k, m) for t, k, m, _ in used], seed)
    found = tagger.decode([t for t, *_ in kept])
    asked = [(k, s, e, spans) for (_, kinds, marks, made), spans in zip(kept, found, strict=True) if made for k, s, e in zip(kinds, marks[::2], marks[1::2], strict=True)]
    hits = [any(x[0] == k and 2 * (min(e, x[2]) - max(s, x[1])) > e - s for x in spans) for k, s, e, spans in asked]
    bare = [not spans for (_, kinds, _, _), spans in zip(kept, found, strict=True) if not kinds]
    tagger.recall, tagger.clean = float(np.mean(hits)) if hits else None, float(np.mean(bare)) if bare else None
    return tagger


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (rule spans by kind as listed, then start), spans (all spans in that order, added ones after)."""
    spark, rows = docs.sparkSession, keyed_text(docs, id_col, text_col)
    made, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(fit(cut(scan(rows), "personal_segments")))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda found, end="": [{"kind": KINDS[k] + end, "start": s, "end": e} for k, s, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = per_worker("personal", made, lambda: shared.value)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = part.column("text").to_pylist()
                base = [rule_spans(t) for t in texts]
                added = tagger.decode(texts) if tagger is not None else [[] for _ in texts]
                added = [sorted(f for f in new if not any(s < f[2] and f[1] < e for _, s, e in old)) for old, new in zip(base, added, strict=True)]
                every = [named(old) + named(new, "_net") for old, new in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(named, base), spans), pa.array(every, spans)], names=["doc_id", "base", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base {SPAN}, spans {SPAN}")
