"""Secret scans: fixed rules, and a character convolutional network over every candidate and its surroundings.

Rules (spans are half-open code point ranges of whole matches, leftmost and without overlap for each kind): assignments
to a telling name, access keys, long hexadecimal runs. A candidate is a maximal run of ``[A-Za-z0-9+/_=.-]`` of
``LEAST`` characters or more (without a name and its ``=`` before it) that has a digit or both cases after its first character, or that
something assigns (``:`` or ``=`` before it). The network sees each whole candidate with ``AROUND`` characters on both sides;
candidates that it accepts and that touch no rule span are added as kind ``net``.

The network is trained on every distinct candidate of the table, inside rule spans and outside. The rules' findings have few shapes, so each also gives ``DISGUISES``
labelled findings of other shapes: another name or none, other separators, a value of another alphabet and length; and each outside candidate gives ``DISGUISES``
harmless assignments (numbers, dates, versions, paths, words and identifiers made of the text around). Each row also comes without its surroundings, so that shape
counts by itself. All copies of a row stay on one side when a quarter (by hash) is held back. The rows are written and dealt into parts of about ``PART``; in each of
``EPOCHS`` rounds every part takes its steps from the same weights, and the weights and moments of all parts are averaged by their rows. On the held-back rows, by
sums that Spark takes, the scores are calibrated (a logistic fit with smoothed targets) and the threshold is the greatest that keeps ``RECALL`` of all labelled
findings, those without a candidate counted as missed. ``recall``, ``disguised_recall`` and ``precision`` there stay with the network. With fewer
than ``ENOUGH`` rows of either class no network is fitted and nothing is added.

Every text is read once, whole; what is kept of it for training and scoring are its spans and candidates. A null or empty text has no spans; repeated rows give
repeated results; long candidates are read in overlapping pieces whose features are pooled; an empty table gives an
empty table.
"""

from __future__ import annotations

import copy
import math
import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.functions.ranks import exact_quantiles
from pegwatch.llm.common import keyed_text, per_worker, ship_code, slices
from pegwatch.llm.spans import SPAN, Adam, char_codes
from pegwatch.session import cut

# fixed values
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

LEAST, AROUND = 6, 24
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
NAMED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*=(?=[^=])")
MIXED = re.compile(r"[0-9]|(?<=.)[A-Z].*[a-z]|(?<=.)[a-z].*[A-Z]", re.DOTALL)
ASSIGNED = re.compile(r"""[:=]\x20*["']?\Z""")
LONGEST, ENOUGH, RECALL, DISGUISES = 4096, 20, 0.95, 2  # longer texts are pooled in blocks
EPOCHS, PART, PART_CHARS = 8, 1 << 14, 1 << 24  # rounds, and rows and characters of a part
PIECE, WIDTH, FILTERS, HIDDEN, EMBED = 160, 5, 40, 16, 12
# Names under which the disguised copies are assigned, telling and harmless ones.
TELLING = ("pwd", "pass", "passphrase", "auth", "credential", "client_secret", "private_key", "access_key", "bearer", "DB_PWD", "login_pass", "apikey", "signing_key", "pin_code", "session_key", "Authorization")
HARMLESS = ("lang", "version", "date", "width", "count", "id", "author", "title", "path", "file", "size", "page", "color", "name", "city", "mode", "status", "ref", "line", "host", "type", "since")


def rule_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = []
    low = text.lower() if text.isascii() else None
    if any(n in low for n in NAMES) if low is not None else ASSIGN.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in RUN.finditer(text):
        start, end = m.span()
        named = NAMED.match(text, start, end)
        if named:
            start = named.end()
        if end - start >= LEAST and (named or MIXED.search(text[start:end]) or ASSIGNED.search(text, max(0, start - 4), start)):
            out.append((start, end))
    return out


def secret_value(rnd: np.random.Generator) -> str:
    """A made-up value: its alphabet, length and parts vary."""
    pick = lambda chars, n: "".join(chars[i] for i in rnd.integers(0, len(chars), n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kind, n = rnd.integers(0, 7), int(rnd.integers(8, 45))
    if kind == 0:
        return pick(low + up + dig, n)
    if kind == 1:
        return pick(low + up + dig + "+/", n) + "=" * int(rnd.integers(0, 3))
    if kind == 2:
        return pick("ABCDEF" + dig, n)
    if kind == 3:
        return pick(low, int(rnd.integers(4, 9))) + pick(dig, int(rnd.integers(2, 5))) + pick(low + up + dig, int(rnd.integers(0, 8)))
    if kind == 4:
        return "-".join(pick("abcdef" + dig, k) for k in (8, 4, 4, 4, 12))
    if kind == 5:
        return pick(low, 2) + "_" + pick(low, 4) + "_" + pick(low + up + dig, n)
    return pick(low + dig, n)


def harmless_value(rnd: np.random.Generator, words: list[str]) -> str:
    word = lambda: words[rnd.integers(0, len(words))] if words else "value"
    number = lambda a, b: str(int(rnd.integers(a, b)))
    kind = rnd.integers(0, 8)
    if kind == 0:
        return number(100_000, 10**int(rnd.integers(7, 17)))
    if kind == 1:
        return f"{number(1990, 2030)}-{number(10, 13)}-{number(10, 29)}"
    if kind == 2:
        return f"{number(1, 20)}.{number(0, 40)}.{number(0, 900)}"
    if kind == 3:
        return "/".join(word() for _ in range(3)) + ".txt"
    if kind == 4:
        return word() + word().capitalize() + word().capitalize()
    if kind == 5:
        return f"{word()}_{word()}_{number(1, 99)}"
    if kind == 6:
        return f"www.{word()}.com/{word()}"
    return (word() + word())[:14] if rnd.random() < 0.5 else word() + "-" + word()


def disguised(seen: tuple[str, int, int], telling: bool, rnd: np.random.Generator) -> tuple[str, int, int]:
    """Another labelled row in the same surroundings: a name and a value of other shapes."""
    text, at, end = seen
    left, right = text[:at], text[end:]
    left = left[:max(0, len(left) - int(rnd.integers(8, 24)))]
    words = [w for w in re.findall("[a-z]{3,}", (left + right).lower())]
    value = secret_value(rnd) if telling else harmless_value(rnd, words)
    names = TELLING if telling else HARMLESS
    name = names[rnd.integers(0, len(names))] if rnd.random() < (0.75 if telling else 0.6) else ""
    name = name.upper() if rnd.random() < 0.2 else name
    mark = (": ", "=", " = ", ":", ' = "', ': "', " ")[rnd.integers(0, 7)] if name else " "
    lead = (left + " " + name + mark)[-AROUND:]
    tail = (('"' if mark.endswith('"') else "") + " " + right.lstrip('"\''))[:AROUND]
    return lead + value + tail, len(lead), len(lead) + len(value)


def scan(rows: DataFrame) -> DataFrame:
    """doc_id, base (rule spans), found (start, end, labelled, seen: the candidate with its surroundings and where it lies in them)."""
    pieces = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("inside", pa.bool_()), ("seen", pa.string()), ("at", pa.int32())]))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def one(text: str) -> tuple[list, list]:
        base = rule_spans(text)
        found = []
        for s, e in candidates(text):
            lo = max(0, s - AROUND)
            found.append({"start": s, "end": e, "inside": any(a < e and s < b for a, _, b in base), "seen": text[lo:e + AROUND], "at": s - lo})
        return [{"kind": k, "start": s, "end": e} for s, k, e in base], found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                both = [one(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([b for b, _ in both], spans), pa.array([f for _, f in both], pieces)], names=["doc_id", "base", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base {SPAN}, found array<struct<start:int,end:int,inside:boolean,seen:string,at:int>>")


class CharNet:
    """Embedding of characters and of being inside the candidate, one convolution, the greatest response of each filter over the whole
    candidate and its surroundings, a hidden layer, a linear score; then the calibration."""

    def __init__(self, seen: list[tuple[str, int, int]], truth: np.ndarray, missed: float = 0.0, seed: int = 11, epochs: int = 8, copies: int = DISGUISES):
        """``missed``: share of the labelled findings that hold no candidate."""
        rnd = self._start(seed)
        order = rnd.permutation(len(seen))
        quarter = np.zeros(len(seen), bool)
        quarter[order[:len(order) // 4]] = True
        rows = [(s, t, q, False) for s, t, q in zip(seen, truth.tolist(), quarter.tolist(), strict=True)]
        rows += [(alone(s), t, q, False) for s, t, q, _ in list(rows)]
        # the rarer class gets more copies of each row, so that both count alike
        most = max(truth.sum(), (~truth).sum())
        each = {t: copies * max(1, round(most / max(1, (truth == t).sum()))) for t in (True, False)}
        rows += [(disguised(s, t, rnd), t, q, True) for s, t, q, _ in rows[:len(seen)] for _ in range(each[t])]
        seen, truth = [r[0] for r in rows], np.array([r[1] for r in rows], bool)
        held, made = np.array([r[2] for r in rows], bool), np.array([r[3] for r in rows], bool)
        used = np.flatnonzero(~held)
        steps = Adam(self.w, 0.01)
        for epoch in range(epochs):
            steps.rate = 0.01 * (1 - epoch / epochs) + 0.001
            self._pass(steps, seen, truth, rnd.permutation(used))
        z = self.raw([seen[i] for i in np.flatnonzero(held)])
        y, made = truth[held], made[held]
        self.scale = self._logistic(z, y.astype(float))
        every = self._calibrated(z)
        p = np.sort(every[y])
        wanted = min(1.0, RECALL / max(1e-9, 1 - missed))  # of those with a candidate
        self.threshold = float(p[int(np.floor((1 - wanted) * len(p)))]) if len(p) else 1.1
        hit = every >= self.threshold
        share = lambda part: float(hit[part].mean()) if part.any() else None
        self.recall, self.disguised_recall = (share(y) or 0.0) * (1 - missed), share(y & made)
        self.precision = float(y[hit].mean()) if hit.any() else None
        self.wrongly = share(~y & ~made)  # of the table's own held-back candidates outside rules

    @classmethod
    def blank(cls, seed: int = 11) -> CharNet:
        """A network that has seen nothing."""
        net = cls.__new__(cls)
        net._start(seed)
        return net

    def _start(self, seed: int) -> np.random.Generator:
        rnd = np.random.default_rng(seed)
        shape = WIDTH * (EMBED + 1)
        self.w = {"emb": rnd.normal(0, 0.3, (128, EMBED)).astype(np.float32), "conv": rnd.normal(0, 1 / np.sqrt(shape), (shape, FILTERS)).astype(np.float32),
                  "cb": np.zeros(FILTERS, np.float32), "hid": rnd.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(np.float32), "hb": np.zeros(HIDDEN, np.float32),
                  "out": rnd.normal(0, 0.3, HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32)}
        return rnd

    def _pass(self, steps: Adam, seen: list[tuple[str, int, int]], truth: np.ndarray, order: np.ndarray) -> None:
        for some in np.array_split(order, max(1, len(order) // 64)):
            steps.step(self._gradients([seen[i] for i in some], truth[some].astype(np.float32), np.ones(len(some), np.float32)))

    @staticmethod
    def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        n = y.sum()
        y = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))  # smoothed targets, so that no score saturates

        def sums(a: float, b: float) -> tuple[float, ...]:
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            q = p * (1 - p)
            return ((p - y) * z).sum(), (p - y).sum(), (q * z * z).sum(), (q * z).sum(), q.sum()

        return newton(sums)

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))

    def _columns(self, texts: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the inside flag, and the text of each piece; long texts make several overlapping pieces."""
        parts, owner, flags = [], [], []
        for i, (t, at, end) in enumerate(texts):
            starts = range(0, max(1, len(t) - WIDTH + 1), PIECE - WIDTH + 1)
            for lo in starts if len(t) <= LONGEST else self._telling(t, at, end, starts):
                parts.append(t[lo:lo + PIECE])
                owner.append(i)
                flags.append((at - lo, end - lo))
        width = max(WIDTH, max(map(len, parts)))
        inside = np.zeros((len(parts), width), np.float32)
        for i, (a, b) in enumerate(flags):
            inside[i, max(0, a):max(0, b)] = 1
        return char_codes(parts, width), inside, np.array(owner)

    def _telling(self, text: str, at: int, end: int, starts: range) -> list[int]:
        """Of a long text's pieces those that give some filter its greatest response first: no other enters the pooled features."""
        best = []
        for lo in range(0, len(starts), 256):
            some = starts[lo:lo + 256]
            inside = np.zeros((len(some), PIECE), np.float32)
            for i, a in enumerate(some):
                inside[i, max(0, at - a):max(0, end - a)] = 1
            best.append(self._responses(char_codes([text[a:a + PIECE] for a in some], PIECE), inside)[1].max(1))
        return [starts[i] for i in sorted(set(np.concatenate(best).argmax(0).tolist()))]

    def _responses(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([self.w["emb"][codes] * (codes > 0)[..., None], inside[..., None]], 2)
        n = x.shape[1] - WIDTH + 1
        stacked = np.concatenate([x[:, k:k + n] for k in range(WIDTH)], 2)
        return stacked, np.maximum(stacked @ self.w["conv"] + self.w["cb"], 0)

    def _forward(self, texts):
        codes, inside, owner = self._columns(texts)
        stacked, h = self._responses(codes, inside)
        best = h.max(1)
        pooled = np.zeros((len(texts), FILTERS), h.dtype)
        np.maximum.at(pooled, owner, best)
        deep = np.maximum(pooled @ self.w["hid"] + self.w["hb"], 0)
        return codes, owner, stacked, h, pooled, deep, deep @ self.w["out"] + self.w["ob"][0]

    def raw(self, texts: list[tuple[str, int, int]]) -> np.ndarray:
        return np.concatenate([self._forward(texts[i:i + 256])[-1] for i in range(0, len(texts), 256)]) if texts else np.zeros(0)

    def accepts(self, texts: list[tuple[str, int, int]]) -> np.ndarray:
        return self._calibrated(self.raw(texts)) >= self.threshold

    def _gradients(self, texts, y, weight) -> dict[str, np.ndarray]:
        codes, owner, stacked, h, pooled, deep, z = self._forward(texts)
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        ddeep = dz[:, None] * self.w["out"] * (deep > 0)
        dpool = ddeep @ self.w["hid"].T
        # only the place that gave a filter's greatest response has a gradient; of several pieces the first one
        place = h.argmax(1)
        pieces = np.arange(len(owner))[:, None]
        mine = (h[pieces, place, np.arange(FILTERS)] >= pooled[owner]) & (pooled[owner] > 0)
        if len(owner) > len(texts):
            taken = np.zeros((len(texts), FILTERS), bool)
            for p, o in enumerate(owner):
                mine[p] &= ~taken[o]
                taken[o] |= mine[p]
        g = np.where(mine, dpool[owner], 0).astype(h.dtype)
        dwin = (g[:, :, None] * self.w["conv"].T[None]).reshape(len(owner), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        demb = np.zeros_like(self.w["emb"])
        np.add.at(demb, codes[pieces[..., None], place[..., None] + np.arange(WIDTH)], dwin)
        demb[0] = 0
        return {"emb": demb, "conv": np.einsum("pf,pfs->sf", g, stacked[pieces, place]), "cb": g.sum(0), "hid": pooled.T @ ddeep, "hb": ddeep.sum(0),
                "out": deep.T @ dz, "ob": np.array([dz.sum()], np.float32)}


def newton(sums: Callable[[float, float], tuple[float, ...]]) -> tuple[float, float]:
    """The logistic fit whose gradient and curvature sums are given for a scale and an offset: Newton with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        gz, g, hzz, hz, h = sums(a, b)
        step = np.linalg.solve(np.array([[hzz + 1e-2, hz], [hz, h + 1e-2]]), np.array([gz + 1e-2 * (a - 1), g + 1e-2 * b]))
        step *= min(1.0, 0.5 / max(1e-12, float(np.abs(step).max())))  # never far at once
        a, b = a - step[0], b - step[1]
        if float(np.abs(step).max()) < 1e-9:
            break
    return float(a), float(b)


def alone(seen: tuple[str, int, int]) -> tuple[str, int, int]:
    """The candidate by its shape alone."""
    text, at, end = seen
    return " " * at + text[at:end] + " " * (len(text) - end), at, end


def training_rows(rows: DataFrame, copies: dict[bool, int]) -> DataFrame:
    """seen, at, stop, inside, held, made, part: every row (inside, seen, at, stop), itself, by its shape alone and disguised ``copies`` times."""
    last = F.when(F.col("inside"), copies[True]).otherwise(copies[False]) + 1
    size = rows.agg(F.sum(last + 1).alias("n"), F.sum((last + 1) * F.length("seen")).alias("chars")).first()
    parts = max(1, -(-size["n"] // PART), -(-size["chars"] // PART_CHARS))
    copied = rows.select("inside", "seen", "at", "stop", (F.pmod(F.xxhash64("seen", "at"), F.lit(4)) == 0).alias("held"), F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    dealt = copied.withColumn("part", F.pmod(F.xxhash64("copy", "at", "seen"), F.lit(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for r in batch.select(["inside", "seen", "at", "stop", "copy"]).to_pylist():
                seen = (r["seen"], r["at"], r["stop"])
                rnd = np.random.default_rng([crc32(r["seen"].encode("utf-8", "surrogatepass")), r["at"], r["copy"]])
                new.append(seen if r["copy"] == 0 else alone(seen) if r["copy"] == 1 else disguised(seen, r["inside"], rnd))
            text, at, stop = zip(*new, strict=True) if new else ((), (), ())
            made = pa.array([c > 1 for c in batch.column("copy").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(at, pa.int32()), pa.array(stop, pa.int32()), batch.column("inside"), batch.column("held"), made,
                                              batch.column("part")], names=["seen", "at", "stop", "inside", "held", "made", "part"])

    return dealt.mapInArrow(run, "seen string, at int, stop int, inside boolean, held boolean, made boolean, part bigint")


def one_round(start: Broadcast, seed: int, epoch: int) -> Callable:
    """The steps of a part from the shared weights: a row with the part's weights and moments times its rows."""

    def part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        steps, mine, which = copy.deepcopy(start.value), CharNet.blank(seed), int(key[0])
        mine.w = steps.w
        frame = frame.sort_values(["seen", "at", "stop", "inside"])
        seen = list(zip(frame["seen"].tolist(), frame["at"].tolist(), frame["stop"].tolist(), strict=True))
        n = len(seen)
        mine._pass(steps, seen, frame["inside"].to_numpy(bool), np.random.default_rng([seed, epoch, which]).permutation(n))
        sums = [{k: v.astype(np.float64) * n for k, v in x.items()} for x in (steps.w, steps.m, steps.v)]
        return pd.DataFrame({"some": [which % 32], "state": [pickle.dumps((n, steps.t * n, *sums))]})

    return part


def trained(rows: DataFrame, epochs: int = EPOCHS, seed: int = 11) -> CharNet:
    """Rounds over all rows that aren't held back: each part's steps start at the same weights, then all parts' results are averaged by their rows."""
    net, used = CharNet.blank(seed), rows.where("not held").select("seen", "at", "stop", "inside", "part")
    state = Adam(net.w, 0.01)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": [pickle.dumps(added(frame["state"]))]})

    for epoch in range(epochs):
        state.rate = 0.01 * (1 - epoch / epochs) + 0.001
        start = rows.sparkSession.sparkContext.broadcast(state)
        sums = used.groupBy("part").applyInPandas(one_round(start, seed, epoch), "some bigint, state binary").groupBy("some").applyInPandas(total, "state binary")
        n, t, *means = added(r["state"] for r in sums.collect())  # 32 rows at most, however many parts
        start.unpersist()
        state = Adam(net.w, 0.01)
        state.t = round(t / n)
        for mine, mean in zip((state.w, state.m, state.v), means, strict=True):
            for k in mine:
                mine[k] = (mean[k] / n).astype(mine[k].dtype)
    net.w = state.w
    return net


def added(states: Iterable[bytes]) -> tuple:
    n, t, *sums = 0, 0, {}, {}, {}
    for m, u, *more in sorted((pickle.loads(s) for s in states), key=lambda x: (x[0], float(x[2]["ob"][0]))):
        n, t = n + m, t + u
        for mine, new in zip(sums, more, strict=True):
            for k, v in new.items():
                mine[k] = mine.get(k, 0) + v
    return n, t, *sums


def calibrate(net: CharNet, rows: DataFrame, missed: float) -> CharNet:
    """Calibration, threshold and measures from all rows that are held back."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = shared.value.raw([(r["seen"], r["at"], r["stop"]) for r in batch.select(["seen", "at", "stop"]).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(float)), batch.column("inside"), batch.column("made")], names=["z", "inside", "made"])

    held = cut(rows.where("held").mapInArrow(run, "z double, inside boolean, made boolean"), "secret_held")
    size = held.agg(F.count("*").alias("n"), F.count_if("inside").alias("yes")).first()
    y = F.when(F.col("inside"), (size["yes"] + 1) / (size["yes"] + 2)).otherwise(1 / (size["n"] - size["yes"] + 2))
    z, score = F.col("z"), lambda a, b: 1 / (1 + F.exp(-F.greatest(F.least(a * F.col("z") + b, F.lit(30.0)), F.lit(-30.0))))

    def sums(a: float, b: float) -> tuple[float, ...]:
        p = score(float(a), float(b))
        q = p * (1 - p)
        return tuple(x or 0.0 for x in held.agg(F.sum((p - y) * z), F.sum(p - y), F.sum(q * z * z), F.sum(q * z), F.sum(q)).first())

    net.scale = newton(sums)
    p = held.select("inside", "made", score(*net.scale).alias("p"))
    found, wanted = p.where("inside"), min(1.0, RECALL / max(1e-9, 1 - missed))  # of those with a candidate
    net.threshold = 1.1
    if size["yes"]:
        at = math.floor((1 - wanted) * size["yes"]) / max(1, size["yes"] - 1)
        near = exact_quantiles(found, "p", {"at": min(1.0, at)}).first()["at"]
        net.threshold = found.where(F.col("p") <= near + 1e-9).agg(F.max("p")).first()[0] - 1e-9
    hit = (F.col("p") >= net.threshold).cast("double")
    got = p.agg(F.avg(F.when(F.col("inside"), hit)).alias("recall"), F.avg(F.when(F.col("inside") & F.col("made"), hit)).alias("disguised"),
                F.avg(F.when(hit == 1, F.col("inside").cast("double"))).alias("precision"), F.avg(F.when(~F.col("inside") & ~F.col("made"), hit)).alias("wrongly")).first()
    net.recall, net.disguised_recall, net.precision, net.wrongly = (got["recall"] or 0.0) * (1 - missed), got["disguised"], got["precision"], got["wrongly"]
    return net


def fit(scanned: DataFrame) -> CharNet | None:
    """A network from all distinct candidates of the scanned texts; None if either class is too rare."""
    each = scanned.select(F.explode("found").alias("c")).select("c.*").select("inside", "seen", "at", (F.col("at") + F.col("end") - F.col("start")).alias("stop"))
    rows = cut(each.distinct(), "secret_rows")
    sizes = {r["inside"]: r["count"] for r in rows.groupBy("inside").count().collect()}
    if min(sizes.get(t, 0) for t in (True, False)) < ENOUGH:
        return None
    bare = F.filter("base", lambda b: ~F.exists("found", lambda c: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    lacking = scanned.agg(F.sum(F.size(bare)).alias("bare"), F.sum(F.size("base")).alias("all")).first()
    # the rarer class gets more copies of each row, so that both count alike
    copies = {t: DISGUISES * max(1, round(max(sizes.values()) / sizes[t])) for t in (True, False)}
    ship_code(scanned.sparkSession)
    ready = cut(training_rows(rows, copies), "secret_training")
    return calibrate(trained(ready), ready, (lacking["bare"] or 0) / max(1, lacking["all"] or 0))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (rule spans by start, then kind as listed), spans (all spans in that order, added ones as kind ``net``)."""
    spark = docs.sparkSession
    scanned = cut(scan(keyed_text(docs, id_col, text_col)), "secret_candidates")
    made, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(fit(scanned))
    order = {k: i for i, k in enumerate((*KINDS, "net"))}
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = per_worker("secrets", made, lambda: shared.value)
        for batch in batches:
            base, found = batch.column("base").to_pylist(), batch.column("found").to_pylist()
            asked = [(i, c) for i, cs in enumerate(found) for c in cs if not c["inside"]] if net is not None else []
            added = [[] for _ in base]
            for at in range(0, len(asked), 256):
                some = asked[at:at + 256]
                yes = net.accepts([(c["seen"], c["at"], c["at"] + c["end"] - c["start"]) for _, c in some])
                for (i, c), ok in zip(some, yes, strict=True):
                    if ok:
                        added[i].append({"kind": "net", "start": c["start"], "end": c["end"]})
            every = [sorted(b + a, key=lambda s: (s["start"], order[s["kind"]])) for b, a in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(every, spans)], names=["doc_id", "base", "spans"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(run, f"doc_id {kind}, base {SPAN}, spans {SPAN}")
