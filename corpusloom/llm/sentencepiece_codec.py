"""SentencePiece encoding and decoding through a table of distinct marked words.

When no piece of the vocabulary has a whitespace marker behind another character, a segmentation
never crosses the start of a marked word (a run of markers and the characters up to the next
marker). Each task keeps a table of the distinct marked words it has met; the library segments a
word once, and a document's ids are the table's entries joined back by position. The table is
bounded (``TABLE_WORDS``); when it is full it starts anew, which changes speed and never results.
No shuffle is needed: exchanging every word position of the corpus for one global table moves
several times the input.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
#: Most distinct words that a task's table holds.
TABLE_WORDS = 400_000
#: Words longer than this (characters) are segmented without being kept.
KEPT_CHARS = 64
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts on which the split must agree with the library before it is used.
_PROBES = ("a  b ", " a\tb c\n\n d", f"x{MARK}y {MARK}", "   ", "ﬁ ｆİ ​ z", "é é\x00\x01 q")


@lru_cache(maxsize=4)
def processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


class WordTable:
    """Distinct marked words and their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model_path: str, limit: int = TABLE_WORDS) -> None:
        self.model = processor(model_path)
        self.limit = limit
        self.table: dict[str, bytes] = {}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and all(
            self._joined(p) == self._pack(self.model.encode(p)) for p in _PROBES
        )
        self.begin, self.end = self._pack([self.model.bos_id()]), self._pack([self.model.eos_id()])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if packed.itemsize != 4:
            raise ValueError("unsigned int of 32 bits expected")
        return packed.tobytes()

    def _segment(self, words: list[str]) -> list[bytes]:
        """The library adds the first marker itself; a lone marker is looked up."""
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        return [self._pack(i if len(w) > 1 else [self.model.piece_to_id(MARK)]) for w, i in zip(words, ids, strict=True)]

    def _joined(self, text: str) -> bytes:
        if not text:
            return b""
        words = _WORD.findall(MARK + text.replace(" ", MARK))
        table = self.table
        new = [w for w in set(words) if w not in table]
        if new:
            found = dict(zip(new, self._segment(new), strict=True))
            kept = {w: i for w, i in found.items() if len(w) <= KEPT_CHARS}
            if len(table) + len(kept) > self.limit:
                table.clear()
                return b"".join([found[w] if w in found else table.setdefault(w, self._segment([w])[0]) for w in words])
            table.update(kept)
            if len(kept) < len(found):
                return b"".join([table[w] if w in table else found[w] for w in words])
        return b"".join([table[w] for w in words])

    def encode(self, text: str) -> bytes:
        body = self._joined(text) if self.splits else self._pack(self.model.encode(text))
        return self.begin + body + self.end

    def decode(self, ids: bytes) -> str:
        return self.model.decode(memoryview(ids).cast("I").tolist())


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids binary, n_tokens long, decoded string`` for each row.

    ``ids`` holds little-endian unsigned 32-bit integers with begin and end ids. A null or empty text
    has the ids begin, end and decodes to the empty text. Repeated rows and null ids are kept as they
    are; other columns of the input, whatever their names, are not read.
    """

    def make():
        table = WordTable(model_path)

        def work(key, text):
            ids = table.encode(text or "")
            return ((key, ids, len(ids) // 4, table.decode(ids)),)

        return work

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, "doc_id long, ids binary, n_tokens long, decoded string", make)
