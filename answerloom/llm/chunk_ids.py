"""Token ids of chunks of text, each distinct chunk encoded once."""

import re
from array import array

import numpy as np

from answerloom.llm.textscan import gather
from answerloom.operators.tokenizer import BYTE_CHARS

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)  # ASCII signs but the apostrophe, which begins contractions
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


def letter_borders(data):
    """Where, between neighbouring bytes, an ASCII letter meets a sign: word patterns never join them."""
    letter, sign = _LETTER[data], _SIGN[data]
    return (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])


def _bytes_of(column):
    """Values of a large binary column without NULLs."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    raw = column.buffers()[2].to_pybytes() if len(column) else b""
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]


class ChunkIds:
    """Ids of distinct chunks of text, remembered; of two halves the older is dropped when the newer is full.

    ``words`` matches chunks that the tokenizer takes for one word and leaves as they are; these go to its
    merge model directly, all others through the whole tokenizer.
    """

    def __init__(self, model, words, limit=1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer, self.half = Tokenizer.from_str(model), limit // 2
        self.merge, self.word = self.tokenizer.model.tokenize, re.compile(words).fullmatch
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young, self.old = {}, {}

    def find(self, chunks):
        """Id bytes of distinct chunks."""
        out = [*map(self.young.get, chunks)]
        new = [i for i, ids in enumerate(out) if ids is None]
        for i in new:
            out[i] = self.old.get(chunks[i])
        texts = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            chunk = chunks[i]
            if self.word(chunk):
                symbols = chunk.decode("latin-1").translate(BYTE_CHARS)
                out[i] = array("I", [t.id for t in self.merge(symbols)]).tobytes()
            else:
                texts.append(i)
        if texts:
            encoded = self.tokenizer.encode_batch_fast(
                [chunks[i].decode("utf-8", "replace") for i in texts], add_special_tokens=False)
            for i, e in zip(texts, encoded):
                out[i] = array("I", e.ids).tobytes()
        self.young.update((chunks[i], out[i]) for i in new)
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        return out

    def lay_out(self, coded):
        """The ids of a dictionary-encoded binary column in one array, and how many each value has."""
        found = self.find(_bytes_of(coded.dictionary))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        used = coded.indices.to_numpy(zero_copy_only=False)
        sized = sizes[used]
        return flat[gather((np.cumsum(sizes) - sizes)[used], sized)], sized
