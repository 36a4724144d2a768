"""Encoding by a BPE model of the sentencepiece library with a table of last tokens for each prefix.

A BPE encoding is the only sequence of tokens in which every token encodes as itself and every two neighbours encode as
those two.  So each prefix of a text has exactly one possible last token: the one that matches there (an Aho-Corasick
automaton gives all matches), and is compatible with the last token of the prefix before it.  The table is filled from
left to right in linear time and the ids are read from its end backwards.

No piece of the model has a space mark after another character, so the table starts anew at each word (run of space
marks with what follows it), and the ids of frequent words are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

SPACE = "▁"
#: Bounds of what a task remembers (words twice, in a new and an old table); beyond them it starts anew, and results stay the same.
WORDS, PAIRS, LONGEST = 60_000, 250_000, 48


class Encoder:
    """Encodes as sentencepiece does with the BPE model in model_file (identity normalizer, space mark put first)."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=model_file)
        _check_normalizer(model.serialized_model_proto())
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for i, p in self.piece.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("the model has pieces over more than one word")
        #: For each token those that were asked for before it, and whether they are compatible.
        self.before: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.matches = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self._merged(p) == [p]:  # others are never an outcome
                self.matches.add_word(p, (i, len(p), self.before.setdefault(i, {})))
        self.matches.make_automaton()
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.bare, self.spaced = _Words(self, ""), _Words(self, SPACE)
        self.ends = [array("I", [i]).tobytes() for i in (self.bos, self.eos)]
        self.newline = None if any("\n" in p for p in self.id) else array("I", self._bytes("\n")[::-1]).tobytes()
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def _merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours that make the best piece, the leftmost among equals. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                if (s := self.score.get(parts[k] + parts[k + 1])) is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their text: merging it never joins parts of both."""
        if self.pairs >= PAIRS:
            for known in self.before.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        get, none = self.score.get, float("-inf")
        parts = [*self.piece[a], *self.piece[b]]
        edge = len(self.piece[a]) - 1  # the last part of the left token
        scores = [get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while (best := max(scores)) != none:
            at = scores.index(best)
            if at == edge:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
            edge -= at < edge
        self.before[b][a] = best == none
        return best == none

    def _word(self, word: str) -> list[int]:
        """The prefix table of one word; a character that no piece covers is written as its bytes and parts the word."""
        size = len(word)
        last = [-1] * (size + 1)  # the last token of each prefix
        length = [0] * (size + 1)  # and its length; 0: the character before is written as bytes
        start = ended = 0  # where the table began anew; the next end without token
        for end, (token, n, before) in self.matches.iter(word):
            if end < ended:
                continue
            if end > ended:  # the characters between have no piece
                start = ended = end
            j = end + 1 - n
            if j > start:
                known = before.get(last[j])
                if not (self._compatible(last[j], token) if known is None else known):
                    continue
            elif j < start:
                continue
            ended = end + 1
            last[ended], length[ended] = token, n
        ids: list[int] = []
        i = size
        while i:
            if n := length[i]:
                ids.append(last[i])
                i -= n
            else:
                ids += self._bytes(word[i - 1])
                i -= 1
        ids.reverse()
        return ids

    def _bytes(self, char: str) -> list[int]:
        """Ids of a character without piece, in reverse order."""
        return [self.bytes[b] for b in reversed(char.encode())] if self.bytes else [self.unk]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers, begin and end ids included; null is the empty text."""
        if not text:
            return self.ends[0] + self.ends[1]
        out = [self.ends[0]]
        if text[0] == " " or "  " in text or SPACE in text or self.newline is None:
            out += map(self.bare.__getitem__, self.split(SPACE + text.replace(" ", SPACE)))
        else:  # each word has one space mark or, after a line feed (which no piece covers), none
            first, *lines = text.split("\n")
            out += map(self.spaced.__getitem__, first.split(" "))
            for line in lines:
                head, *words = line.split(" ")
                out.append(self.newline)
                out.append(self.bare[head])
                out += map(self.spaced.__getitem__, words)
        out.append(self.ends[1])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(array("I", ids).tolist())


class _Words(dict):
    """Packed ids of words, each with the mark put before it.  A full table becomes the old one, whose words come back when they are met.

    Where no piece has the last letter or digit and the next character beside one another, no token spans both, so a word and
    the marks behind it are encoded one by one.
    """

    def __init__(self, encoder: Encoder, mark: str):
        super().__init__({"": b""} if not mark else {})
        self.encoder, self.mark, self.old = encoder, mark, {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            size = len(word)
            if size > 1 and not word[-1].isalnum():
                size -= 1
                while size and not word[size - 1].isalnum():
                    size -= 1
            if 0 < size < len(word) and word[size - 1 : size + 1] not in self.encoder.inside:
                ids = self[word[:size]] + self.encoder.bare[word[size:]]
            else:
                ids = array("I", self.encoder._word(self.mark + word)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _check_normalizer(proto: bytes) -> None:
    """Raises unless the model takes texts as they are, puts a space mark first and keeps all spaces."""
    want = {b"name": b"identity", b"charsmap": b"", "prefix": 1, "fewer_spaces": 0, "escape": 1}
    for number, value in _fields(proto):
        if number == 3:
            spec = dict(_fields(value))
            have = {b"name": spec.get(1, b""), b"charsmap": spec.get(2, b""), "prefix": spec.get(3, 1), "fewer_spaces": spec.get(4, 1), "escape": spec.get(5, 1)}
            if have != want:
                raise ValueError(f"a normalizer of another kind: {have}")
        if number == 2 and dict(_fields(value)).get(3) != 2:
            raise ValueError("not a BPE model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message, numbers and bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens long, ids_sha256, decoded string, decoded_sha256): one row per input row.

    Null and empty texts give the begin and end ids alone and decode to the empty text.  Null ids and repeated rows stay
    as they are, an empty table gives no rows.  With ids=False the columns ids and decoded are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                made: list[list] = [[], [], [], [], []]
                for text in part.column(1):
                    found = encoder.encode(text.as_py())
                    back = encoder.decode(found)
                    for column, value in zip(made, (found if ids else None, len(found) // 4, sha256(found).hexdigest(), back if ids else None, sha256(back.encode()).hexdigest()), strict=True):
                        column.append(value)
                arrays = {"doc_id": part.column(0), "ids": pa.array([array("i", x) for x in made[0]] if ids else [], pa.list_(pa.int32())), "n_tokens": pa.array(made[1], pa.int64()), "ids_sha256": pa.array(made[2], pa.string()), "decoded": pa.array(made[3] if ids else [], pa.string()), "decoded_sha256": pa.array(made[4], pa.string())}
                names = [n for n in arrays if ids or n not in ("ids", "decoded")]
                yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

    kept = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string" if ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, kept)
