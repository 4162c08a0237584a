"""Ids by the tokenizers library, with the ids of recurring pieces of text kept between documents."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

DEFAULT_JSON = "byte_bpe_50k.json"
#: Two white-space characters in a row; without them every blank starts a pre-token and every line end is one.
TWO_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}|\x00"
#: After a letter every other character starts a pre-token.
LETTERS_END = r"(\pL)([^\pL \n])"
#: The characters by which a byte-level vocabulary names bytes, but for line ends, which part words here.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = dict(zip((b for b in range(256) if b not in PRINTABLE), range(256, 512)))
del BYTE_NAMES[ord("\n")]


def quoted(text: str) -> str:
    """A pattern of Arrow's for this very text."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


class PieceEncoder:
    """Encodes whole texts; a text is cut only where the pre-tokeniser has a boundary whatever surrounds it.

    Cutting and counting out distinct pieces is Arrow's work, so that Python sees each piece of a batch once.
    ``most`` bounds the pieces that are held; beyond it the store starts anew.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.tokenizer = Tokenizer.from_file(path)
        # texts with added tokens are left whole, as a token is found across pre-tokens
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = "|".join([TWO_BLANKS, *map(quoted, added)])
        # a run of letters is one pre-token, which the library's model takes as it is, once bytes have their names
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.most = most
        self.known: dict[str, bytes] = {"": b""}
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")

    def learn(self, new: list[str]) -> None:
        """Adds the ids of pieces to the store."""
        known = self.known
        letters = [p for p in new if p.isalpha() or p[0] == " " and p[1:].isalpha()]
        others = list(set(new).difference(letters)) if len(letters) < len(new) else []
        if letters:
            plain = letters if self.normalizer is None else map(self.normalizer.normalize_str, letters)
            named = "\n".join(plain).encode().decode("latin-1").translate(BYTE_NAMES).split("\n")
            code, tokenize = self.dtype.char, self.model.tokenize
            for p, word in zip(letters, named):
                known[p] = array(code, [t.id for t in tokenize(word)]).tobytes()
        for at in range(0, len(others), 8192):
            some = others[at : at + 8192]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[p] = array(self.dtype.char, e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as an array of ``dtype``."""
        out: list[np.ndarray | None] = [None] * len(texts)
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, self.whole)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)):
            out[k] = np.array(e.ids, self.dtype)
        plain = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if len(plain):
            for k, ids in zip(plain, self._pieces(column.take(pa.array(plain)))):
                out[k] = ids
        return out

    def _pieces(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring_regex(texts, LETTERS_END, "\\1\0\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\0\n\0"), " ", "\0 ")
        cut = pc.split_pattern(marked, "\0")
        coded = cut.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self.known = {"": b""}
        # one string for all pieces: no piece holds a zero
        listed = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        names = pc.binary_join(listed, pa.scalar("\0", pa.large_string()))[0].as_py().split("\0")
        found = list(map(self.known.get, names))
        if new := [k for k, ids in enumerate(found) if ids is None]:
            self.learn([names[k] for k in new])
            for k in new:
                found[k] = self.known[names[k]]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        stream = ids.buffers()[2]
        every = np.frombuffer(stream, self.dtype) if stream is not None and stream.size else np.empty(0, self.dtype)
        ends = ends // self.dtype.itemsize
        return [every[a:b] for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_JSON)
