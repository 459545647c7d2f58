"""Encoding by a tokenizer file of the tokenizers library, once per worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from wakelane.llm.chunks import ChunkEncoder, flat, interleaved

#: Words encoded in one call, told apart by the tokens that begin or end a word.
JOINED = 200


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """A memoised encoder whose ids are those of the library's encode(text, add_special_tokens=False).

    Added tokens inside texts are matched as the library does; texts that hold
    one are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    begins = ends.copy()
    for token, i in vocabulary.items():
        begins[i], ends[i] = token.startswith("Ġ"), token.endswith("</w>")
    by_end = bool(ends.any())

    def texts(strings):
        return flat([e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)])

    def words(strings):
        """Space-led words: many to a call, cut again where a word begins or ends."""
        if not strings:
            return texts(strings)
        groups = [strings[k : k + JOINED] for k in range(0, len(strings), JOINED)]
        encoded = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(["".join(x) for x in groups], add_special_tokens=False)]
        sizes = []
        for k, (some, ids) in enumerate(zip(groups, encoded)):
            marks = np.flatnonzero((ends if by_end else begins)[ids])
            own = np.diff(marks, prepend=-1) if by_end else np.diff(marks, append=len(ids))
            if len(own) != len(some) or own.sum() != len(ids):  # a word that the normalizer splits or drops
                own, encoded[k] = texts(some)
            sizes.append(own)
        return np.concatenate(sizes), np.concatenate(encoded)

    def learn(chunks):
        # Words whose lower case is letters too are one pre-token whatever the normalizer.
        plain = np.fromiter((c[0] == " " and c[1:].isalpha() and (c.isascii() or c[1:].lower().isalpha()) for c in chunks), bool, len(chunks))
        simple, rest = ([c for c, p in zip(chunks, plain) if p == x] for x in (True, False))
        return interleaved(plain, words(simple), texts(rest))

    return ChunkEncoder(learn, [t.content for t in tokenizer.get_added_tokens_decoder().values()])
