"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the last bytes cuts a text where its value is small, so a passage that documents share is cut alike in all of them.
A task encodes each distinct chunk once and keeps the result (bounded).  A cut may fall inside a pre-token, so each join is repaired:
the end of one chunk and the beginning of the next are encoded again together, out to the nearest places where both agree with any longer
context: a letter, digit or closing mark followed by a space, where every pre-token ends whatever stands around it.  A chunk without such
a place joins the repair as a whole, which goes on until one comes.  The joined ids are then those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import hashing
from traceloom.llm.ship import ship

#: Fixed value: how the byte-level vocabulary splits text into pre-tokens.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 32  # bytes the rolling hash sees
CUT_BITS = 9  # a cut every 512 bytes on average
HELD_CHARS = 24 << 20  # characters of chunks a task keeps
CLOSING = frozenset(".,;:!?")
_STEP = 1 << 20


def cuts_of(text: str) -> list[int]:
    """Character positions where the rolling hash cuts ``text``: they depend on the ``WINDOW`` bytes before each alone."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    places = []
    power, inverse = hashing._powers()
    codes = hashing.stream(5, 256)
    for at in range(0, len(data), _STEP - WINDOW):
        part = data[at : at + _STEP]
        if len(part) <= WINDOW:
            break
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * power[: len(part)], out=total[1:])
        rolled = (total[WINDOW:-1] - total[: -WINDOW - 1]) * inverse[: len(part) - WINDOW]
        found = np.flatnonzero(hashing.mix(rolled) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
        places.append(found[(part[found] & 0xC0) != 0x80] + at)
    if not places:
        return []
    offsets = np.unique(np.concatenate(places))
    if len(data) == len(text):
        return offsets.tolist()
    starts = np.cumsum((data & 0xC0) != 0x80)
    return (starts[offsets] - 1).tolist()


def _byte_of() -> dict[str, int]:
    """The bytes behind the printable characters of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(model: dict, split: str):
    """A faster encoder of plain text for vocabularies whose ids follow the order of their merges, else None."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = model["vocab"]
    if len(vocabulary) != 256 + len(merges) or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    import tiktoken

    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _sure(text: str) -> tuple[int, int]:
    """The first and last place where a space follows a letter, digit or closing mark; -1 if there is none."""
    first = text.find(" ", 1)
    while first > 0 and not (text[first - 1].isalnum() or text[first - 1] in CLOSING):
        first = text.find(" ", first + 1)
    last = text.rfind(" ")
    while last > 0 and not (text[last - 1].isalnum() or text[last - 1] in CLOSING):
        last = text.rfind(" ", 0, last)
    return (first, last) if first > 0 else (-1, -1)


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library, with bounded stores of chunks and pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        splitter = layout.get("pre_tokenizer") or {}
        if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or layout.get("normalizer"):
            raise ValueError("only byte-level vocabularies without a normaliser or prefix space can be joined")
        self.special = {t["content"]: t["id"] for t in layout.get("added_tokens", [])}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._chunks: OrderedDict[str, tuple[str, array | None, str]] = OrderedDict()
        self._held = 0
        self._merger = _merger(layout["model"], SPLIT)
        self.encoded_chunks = self.reused_chunks = 0

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens, encoded alone."""
        if not text:
            return []
        if self._merger is not None:
            try:
                text.encode("latin-1")  # letters, digits and spaces that every Unicode version classes alike
                return self._merger(text)
            except UnicodeEncodeError:
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, text: str) -> tuple[str, array | None, str]:
        """(beginning, ids between, end); a chunk without a sure boundary is all beginning and has no ids.  Ids are kept in four bytes each, not as objects."""
        held = self._chunks.get(text)
        if held is not None:
            self._chunks.move_to_end(text)
            self.reused_chunks += 1
            return held
        first, last = _sure(text)
        made = (text, None, "") if first < 0 else (text[:first], array("i", self._plain(text[first:last])), text[last:])
        self.encoded_chunks += 1
        if len(text) <= HELD_CHARS // 16:
            self._chunks[text] = made
            self._held += len(text)
            while self._held > HELD_CHARS:
                self._held -= len(self._chunks.popitem(last=False)[0])
        return made

    def _segment(self, text: str, out: list[int]) -> None:
        at, seam = 0, []
        for cut in [*cuts_of(text), len(text)]:
            if cut <= at:
                continue
            head, ids, tail = self._chunk(text[at:cut])
            at = cut
            seam.append(head)
            if ids is not None:
                out.extend(self._plain("".join(seam)))
                out.extend(ids)
                seam = [tail]
        out.extend(self._plain("".join(seam)))

    def encode(self, text: str | None) -> list[int]:
        """The ids the tokenizers library gives for the whole text with add_special_tokens=False."""
        out: list[int] = []
        if not text:
            return out
        if self._special is None or "<" not in text:
            parts = [text]
        else:
            parts = self._special.split(text)
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._segment(part, out)
        return out

    def decode(self, ids) -> str:
        return self.tokenizer.decode([int(i) for i in ids], skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; null and empty texts have none."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([codec(path).encode(t) for t in texts], dtype=object)

    return docs.withColumn(name, ids(F.col("text")))


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; null ids count as none."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in column:
            yield pd.Series([codec(path).decode(r if r is not None else ()) for r in rows], dtype=object)

    return encoded.withColumn(name, text(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, decoded and hashed where the text is.

    A lone surrogate cannot be stored in UTF-8 and does not occur; null counts as the empty text.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for texts in column:
            rows = []
            for t in texts:
                ids = own.encode(t)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
