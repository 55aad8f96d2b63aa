"""SentencePiece encoding and decoding for merge-type (BPE) models.

Method: a prefix table. The encoding of a prefix is the encoding of a shorter prefix plus one last token, and that last
token is unique. For every end position an automaton lists the pieces that end there; the one whose pair with the last
token of the prefix before it is compatible (their joint encoding is just those two) is stored. The ids are then read
backwards from the end. Work is linear in the text, without a merge queue.

A text is cut where no piece can span (before a space mark that follows another character, and around a line break if
no piece holds one); the ids of a cut-out word are kept in a bounded worker cache.

Nulls and empty texts encode to no ids and decode to an empty text. Repeated rows give repeated results, very long texts
are encoded whole, an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pegwatch.llm.common import Bounded, keyed_text, per_worker, slices

SPACE = "▁"
CACHED_BYTES, PAIR_BYTES = 64 << 20, 32 << 20
SCHEMA = "doc_id {id}, ids array<int>, decoded string"


class PieceModel:
    """Piece table of a merge-type model file: automaton, merge ranks, byte pieces, normalisation switches."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with identity normalisation are supported")
        kind = pb.ModelProto.SentencePiece
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.piece_id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.piece = {i: s for s, i in self.piece_id.items()}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        if any(p.type not in (kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN) for p in proto.pieces) or len(self.byte_ids) < 256:
            raise ValueError("user-defined or unused pieces, or a model without byte pieces")
        self.surface = [b""] * len(proto.pieces)
        for s, i in self.piece_id.items():
            self.surface[i] = s.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        self.space_cuts = not any(SPACE in s.lstrip(SPACE) for s in self.piece_id)
        self.line_cuts = self.space_cuts and not any("\n" in s for s in self.piece_id)
        self.chunks = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.line_cuts else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.shared = {-s for s, n in Counter(self.score.values()).items() if n > 1}  # merge times of several pieces
        self.spines = Bounded(self._spines, 4 * Bounded.ENTRY * len(self.piece))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.piece_id.items():
            if self.merged(s) == [s]:  # other pieces never come out of an encoding
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.alone = Bounded(self._pair_fits, PAIR_BYTES)
        self.words = Bounded(self._word, CACHED_BYTES)

    def merged(self, text: str) -> list[str]:
        """The definition, for texts of two pieces at most: join the best-scored neighbours, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, piece: int) -> tuple | None:
        """How a piece grows when it is encoded alone: the parts at its right and at its left edge, each with the merge
        times between which it stands there. None if its merges don't run in the order of their times."""
        text, score = self.piece[piece], self.score
        parts, times = list(text), [float("-inf")]
        right, left = [[parts[-1], times[0], float("inf")]], [[parts[0], times[0], float("inf")]]
        while len(parts) > 1:
            s, at = max((score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))
            at, time = -at, -s
            if time < times[-1] or time in self.shared:
                return None
            times.append(time)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            for edge, spine in ((parts[-1], right), (parts[0], left)):
                if edge != spine[-1][0]:
                    spine[-1][2] = time
                    spine.append([edge, time, float("inf")])
        return right, left

    def _pair_fits(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens side by side encode to themselves: no part at the right edge of the first may join a part
        at the left edge of the second while both stand. On equal times the left merge comes first."""
        one, two = self.spines[pair[0]], self.spines[pair[1]]
        if one is not None and two is not None:
            score, shared = self.score, False
            for a, born_a, gone_a in one[0]:
                for b, born_b, gone_b in two[1]:
                    if born_a <= gone_b and born_b < gone_a and (s := score.get(a + b)) is not None:
                        if -s in self.shared:
                            shared = True
                        elif -s < gone_a and -s <= gone_b:
                            return False
            if not shared:
                return True
        a, b = self.piece[pair[0]], self.piece[pair[1]]
        return self.merged(a + b) == [a, b]

    def chunk_ids(self, text: str) -> list[int]:
        """Ids of an already escaped text by the prefix table. ``last[i]`` is the last token of the first i characters:
        its id and where it starts; -1 for a character that only byte pieces can write."""
        n = len(text)
        last_id, last_start = [-1] * (n + 1), list(range(-1, n))
        at, fits = 0, self.alone
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            if end == at:
                continue  # settled by a longer piece
            start = end - size
            if start == 0 or last_id[start] < 0 or fits[last_id[start], piece]:
                last_id[end], last_start[end], at = piece, start, end
        ids, end = [], n
        while end:
            start = last_start[end]
            if last_id[end] < 0:
                ids += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
            else:
                ids.append(last_id[end])
            end = start
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        """Little-endian ids of a chunk. A word is its chunk without the first space mark; one that starts with a line
        break has none."""
        chunk = word if word[:1] == "\n" and self.line_cuts else SPACE + word
        return np.array(self.chunk_ids(chunk), "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if not (self.space_cuts and self.prefix):
            return np.array(self.chunk_ids(self.prefix + text.replace(" ", SPACE)), "<i4")
        plain = not (SPACE in text or "  " in text or text[0] == " " or text[-1] == " ")
        if plain and not self.line_cuts:
            words = text.split(" ")
        elif plain and " \n" not in text and text[0] != "\n":
            words = text.replace("\n", " \n").split(" ")
        else:
            words = [c[1:] if c[0] == SPACE else c for c in self.chunks.findall(self.prefix + text.replace(" ", SPACE))]
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, space marks as spaces, the space of the dummy prefix taken away, bytes read as UTF-8."""
        if not len(ids):
            return ""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" " and int(ids[0]) in self.piece:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (whole text, no begin or end ids), decoded (the text those ids decode to). One narrow pass."""
    rows = keyed_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_worker("piece", model_path, lambda: PieceModel(model_path))
        for batch in batches:
            for part in slices(batch):
                ids = [model.encode(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in ids]).astype("<i4")
                flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([model.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"])
        model.words.rest()
        model.alone.rest()

    return rows.mapInArrow(run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))
