"""Exact merge-type encoding by backtracking, and decoding, for SentencePiece BPE models.

Merging characters by score is what defines the encoding, but it need not be carried out on the
text. A sequence of pieces is the encoding exactly if each piece encodes to itself and each two
neighbours encode to themselves together. So the encoder walks the text with the longest pieces
that an Aho-Corasick automaton finds, tests each piece against the one before by re-merging the
two (remembered by pair), and goes back to the next shorter piece where that fails; a bitfield
of failed positions keeps it from entering one twice.

Texts fall into segments that begin with white space, as no piece has it after another
character; segments are remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import text_of

MARK = "▁"  # fixed value: stands for a space inside pieces
REMEMBERED = 600_000  # segments in a worker's table, emptied when full
LONGEST_REMEMBERED = 48  # characters


class Pieces:
    """Encoder and decoder made from a model's bytes; the library only reads the vocabulary."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text, self.id, self.score = [], {}, []
        self.byte = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i)):
                self.id[piece] = i
        if len(self.byte) != 256 or any(c not in self.id for p in self.id for c in p):
            raise ValueError("only models with byte fallback whose characters are all pieces are supported")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces with white space after another character are not supported")
        if [sp.normalize(x) for x in ("a  b ", "Ａ\n")] != [MARK + "a" + MARK * 2 + "b" + MARK, MARK + "Ａ\n"]:
            raise ValueError("only models that leave characters and white space as they are, after one space in front, are supported")
        # Pieces that don't encode to themselves never occur; characters always do.
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.breaks = not any("\n" in p for p in self.id)  # then a line break stands alone
        self.byte_ids = set(self.byte.values())
        self.utf8 = [p.replace(MARK, " ").encode() for p in self.text]
        for b, i in self.byte.items():
            self.utf8[i] = bytes([b])
        self.digits = [str(i).encode() for i in range(len(self.text))]
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[int, bytes, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours that form the best-scored piece, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def next_shorter(self, i: int) -> int | None:
        """The longest sound piece that is a proper prefix of this one."""
        if i not in self.shorter:
            text, found = self.text[i], None
            for n in range(len(text) - 1, 0, -1):
                if text[:n] in self.automaton:
                    found = self.id[text[:n]]
                    break
            self.shorter[i] = found
        return self.shorter[i]

    def fits(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are side by side."""
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def segment(self, text: str) -> list[int]:
        """The ids of one segment. A character without a piece stands alone, as its UTF-8 bytes."""
        longest: list[int | None] = [None] * len(text)
        for end, (n, i) in self.automaton.iter(text):
            longest[end - n + 1] = i  # ends ascend, so the longest from each place stays
        if None not in longest:
            return self.backtrack(longest, 0, len(text))
        out: list[int] = []
        begin = 0
        for at in [*(k for k, i in enumerate(longest) if i is None), len(text)]:
            if at > begin:
                out += self.backtrack(longest, begin, at)
            if at < len(text):
                out += [self.byte[b] for b in text[at].encode("utf-8", "surrogatepass")]
            begin = at + 1
        return out

    def backtrack(self, longest: list[int | None], begin: int, end: int) -> list[int]:
        text, pairs, out, pos, i = self.text, self.pairs, [], begin, longest[begin]
        failed = bytearray((end - begin >> 3) + 1)
        last = None
        while True:
            to = pos + len(text[i])
            at = to - begin
            if not failed[at >> 3] >> (at & 7) & 1 and (last is None or pairs.get((last, i)) or (last, i) not in pairs and self.fits(last, i)):
                out.append(i)
                if to == end:
                    return out
                pos, last, i = to, i, longest[to]
                continue
            i = self.next_shorter(i)
            while i is None:  # nothing fits here: never come back, shorten the piece before
                at = pos - begin
                failed[at >> 3] |= 1 << (at & 7)
                i = out.pop()
                pos -= len(text[i])
                last = out[-1] if out else None
                i = self.next_shorter(i)

    def remembered(self, rest: str) -> tuple[int, bytes, bytes]:
        """Number of ids, ids as text, and decoded bytes of a segment as rests() gives it."""
        ids = self.segment(rest if rest[:1] in (MARK, "\n") else MARK + rest)
        digits, utf8 = self.digits, self.utf8
        found = len(ids), b",".join([digits[i] for i in ids]), b"".join([utf8[i] for i in ids])
        if len(rest) <= LONGEST_REMEMBERED:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[rest] = found
        return found

    def rests(self, text: str) -> list[str]:
        """The segments of a text: from a line break, from a space (which is left out), or from marks."""
        if not text:
            return []
        if not self.breaks or MARK in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return text.replace("\n", " \n").split(" ")

    def encode(self, text: str) -> list[int]:
        return [i for rest in self.rests(text) for i in self.segment(rest if rest[:1] in (MARK, "\n") else MARK + rest)]

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.utf8[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space in front that encoding adds goes, broken bytes become U+FFFD."""
        out = self.decoded(ids).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " and ids[0] not in self.byte_ids else out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha-256 of the ids joined by commas, sha-256 of the decoded text."""
        seen, parts = self.seen, []
        for rest in self.rests(text):
            parts.append(seen.get(rest) or self.remembered(rest))
        ids, back = hashlib.sha256(), hashlib.sha256()
        ids.update(b",".join([p[1] for p in parts]))
        back.update(b"".join([p[2] for p in parts])[1:])
        return sum(p[0] for p in parts), ids.hexdigest(), back.hexdigest()


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """One encoder for each model in a worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs (doc_id, text).

    A null or empty text has no ids, and the digests of nothing. No shuffle; rows that repeat and
    null ids give a row each. The model file (below a megabyte) is read on the driver and goes
    with the tasks. Other columns are not read.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for b in batches:
            found = [pieces.digest(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_columns(docs: DataFrame, model_path: str, **names: str) -> DataFrame:
    """Every row of docs with its ids and decoded text as two more columns (ids, decoded)."""
    ids, decoded = names.get("ids", "ids"), names.get("decoded", "decoded")
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        pieces = loaded(model.value)
        for texts in batches:
            found = [pieces.encode(t) for t in texts]
            yield pd.DataFrame({"ids": found, "decoded": [pieces.decode(i) for i in found]})

    run.__annotations__ = {}
    return docs.withColumn(ids, run(text_of())).withColumn(decoded, F.col(f"{ids}.decoded")).withColumn(ids, F.col(f"{ids}.ids"))
