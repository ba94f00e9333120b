"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

A tokenizer of this family never joins characters across ASCII white space, and cuts what is normalised into pieces, each of which
its model encodes for itself. Arrow finds the distinct words of some megabytes of texts. A word of printable ASCII signs and Latin-1
letters is lower-cased and cut by the tokenizer's own pattern; one with another sign, or with what may begin a special token,
goes to the tokenizer as a whole. Each distinct piece is encoded once; a text's ids are those of its words in turn. Most is forgotten at
the end of a task, and all beyond a number of pieces: workers live on through other stages, which need their memory.
The file's normaliser and pre-tokenizer are checked on loading: another family is refused.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "word_bpe_49k.json"
#: A worker forgets its pieces beyond so many, to bound its memory; between tasks beyond so many.
MOST_PIECES, MOST_IDLE = 400_000, 50_000
#: Longer pieces are encoded each time.
LONGEST_KEPT = 100
#: Texts are taken together up to so many bytes, or one that is longer.
GATHERED = 8_000_000
# What the file has to say for pieces to be independent and case not to matter.
_NORMALISER = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: A sign that normalising does more to than lower-casing, or that the pattern below doesn't know; and the same pattern for all others, in lower case.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_SPECIAL = "<|"
_encoders: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Letters of the model for each Latin-1 letter: its UTF-8 bytes, where those that don't print stand for themselves from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    sign = {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class _Pieces(dict):
    """Ids of each piece, or word with other signs, as little-endian unsigned 32-bit numbers; new ones are encoded."""

    def __init__(self, tokenizer):
        self.encode, self.tokenize, self.letters = tokenizer.encode, tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            ids = [t.id for t in self.tokenize(piece)]
        elif _other(piece):
            ids = self.encode(piece, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.tokenize(piece.translate(self.letters))]
        found = array("I", ids).tobytes()
        if len(piece) <= LONGEST_KEPT:
            self[piece] = found
        return found


def _other(text: str) -> bool:
    return _SPECIAL in text or _OTHER.search(text) is not None


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in larger ones, by the bytes of a column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch[column].nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._check(json.loads(self.tokenizer.to_str()))
        self.known = _Pieces(self.tokenizer)

    def _check(self, said: dict) -> None:
        normaliser, pre = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
        steps = [x["type"] for x in normaliser.get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])]
        if steps != _NORMALISER or split[:1] != [_SPLIT]:
            raise ValueError("the tokenizer doesn't take a text word by word, without regard to case")

    def rest(self) -> None:
        """Called at the end of a task."""
        if len(self.known) > MOST_IDLE:
            self.known.clear()

    def _of_words(self, words: pa.Array) -> list[bytes]:
        """Ids of each of some distinct words."""
        if not len(words):
            return []
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.view(pa.binary())), b"\n")[0].as_py().decode("utf-8", "replace")
        get, cut = self.known.__getitem__, _PIECE.findall
        if not _other(whole):
            return [get(w) if w.isalpha() else b"".join(map(get, cut(w))) for w in whole.lower().split("\n")]
        out = []
        for word in whole.split("\n"):
            out.append(get(word) if _other(word) else b"".join(map(get, cut(word.lower()))))
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all UTF-8 texts (binary, without nulls) one after the other, as unsigned 32-bit numbers, and the end of each text's."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        texts = texts.view(pa.string())
        if not pc.any(pc.match_substring(texts, _SPECIAL)).as_py():  # special tokens are told by their case
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        found = self._of_words(coded.dictionary)
        until = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))])
        ids = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(until), pa.py_buffer(b"".join(found))]).take(coded.indices)
        until, flat = (np.frombuffer(x, dtype=kind) if x is not None else np.zeros(1 - i, dtype=kind) for i, (x, kind) in enumerate(zip(ids.buffers()[1:], ("<i8", "<u4"), strict=True)))
        ends = until[np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))] // 4
        return flat[: until[len(ids)] // 4], ends

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        flat, ends = self.encode_flat(pa.array(texts, pa.binary()))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if texts else []


def encoder(path: str | None = None) -> WordEncoder:
    """This worker's encoder for the vocabulary file at path."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
