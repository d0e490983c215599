"""Token ids of a public byte-level BPE, in Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

#: White space as the pattern's ``\s`` has it (the Unicode property), and runs of it that are encoded without the pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 10_000
_LONG = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=2)
def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """Ids as ``tokenizers`` gives them for ``byte_bpe_50k.json`` with add_special_tokens=False.

    The same merges are held as ranks by ``tiktoken``, which takes a third of the time; a text with
    the special token's string, which ``tokenizers`` reads as that token, goes to ``tokenizers``. The
    pattern's ``\\s+(?!\\S)`` overflows the stack of ``tiktoken`` on long runs of white space, so such
    runs are cut out first: all of a run but its last character is one piece by that pattern (all
    of it at the end of the text), and that piece's bytes are merged directly.
    Paths default to the installed public files and are resolved where this runs.
    """
    import tiktoken

    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return exact().encode(text, add_special_tokens=False).ids
        if len(text) < LONG_RUN:
            return fast.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            ids += fast.encode_ordinary(text[at : run.start()])
            ids += fast._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + fast.encode_ordinary(text[at:])

    return encode
