"""Token ids of public tokenizers."""

from __future__ import annotations

import base64
import os
import re
from functools import cache, cached_property

import numpy as np

#: Characters on which both libraries were tested to agree whatever their Unicode tables; a text with any other goes to tokenizers.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧]")


#: Characters that are encoded at a time, and places where a text can be cut, for a new piece begins there whatever stands
#: around them: behind a letter, in front of a space and a letter, or of a mark that no special token has.
PART = 1 << 20
_CUT = re.compile(r"[A-Za-zА-Яа-я一-龥ぁ-んァ-ヶ가-힣](?= [A-Za-z]|[!-,./:;=?\[\]{}、。，！？；：）」])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as `tokenizers` gives them for the file at `path`, without special tokens added.

    Where a file of the same name ending in .tiktoken lies beside it (the same vocabulary as ranks), texts of
    plain Latin characters take that library's path, which gives the same ids in a quarter of the time.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def exact(self):
        """The tokenizer itself, loaded when a text first needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text; a very long one is encoded in parts, which gives the same ids.

        It is cut at the first place behind PART characters where a piece of the tokenizer's own pattern ends. A run of
        letters without a mark or space is one piece, and is encoded whole.
        """
        parts, at = [], 0
        while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            parts.append(self._ids(text[at : cut.end()]))
            at = cut.end()
        parts.append(self._ids(text[at:] if at else text))
        return np.concatenate(parts) if at else parts[0]

    def _ids(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and not _OTHER.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    return Encoder(path)
