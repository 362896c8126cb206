"""Fast token ids of a public word-BPE vocabulary.

The vocabulary's tokenizer drops white space, so a text's ids are the ids of
its blank-separated chunks in order, and chunks repeat: their ids are kept in
a bounded memo. Chunks of plain Latin text are merged by tiktoken with the
vocabulary's own ranks (the end-of-word mark becomes byte 0xFF, which UTF-8
never uses; as each merge joins two earlier tokens, picking the pair with the
lowest rank gives the same ids). All other chunks go to the vocabulary's own
tokenizer. Tests compare the ids with that tokenizer's on whole texts.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import tiktoken
from tokenizers import Tokenizer

END_OF_WORD = "</w>"
MEMO = 700_000               # chunks kept in a worker; then the memo starts anew
SLICE = 1 << 20            # characters split at a time

# fixed values: letters outside ASCII whose case and class no Unicode version changes
_LATIN = "À-ÖØ-öø-įı-ž"
_PLAIN = re.compile(rf"[\x21-\x7e{_LATIN}]+").fullmatch
# fixed value: the vocabulary's own word pattern, and the same for plain chunks
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+").findall


def _byte_names() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(path: str) -> tiktoken.Encoding | None:
    """tiktoken with the file's ranks; None if the file isn't of the known kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [{}])[0]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END_OF_WORD or split.get("pattern") != {"Regex": _PATTERN}:
        return None
    names, vocab = _byte_names(), model["vocab"]

    def raw(token: str) -> bytes:
        body = token.removesuffix(END_OF_WORD)
        return bytes(names[c] for c in body) + b"\xff" * (body != token)

    special = {t["content"] for t in spec["added_tokens"]}
    for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        if not max(vocab[a], vocab[b]) < vocab[a + b]:
            return None
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={raw(t): i for t, i in vocab.items() if t not in special}, special_tokens={})


class ChunkTokenizer:
    """Token ids as bytes (little-endian unsigned 32-bit)."""

    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        self.fast = _merger(path)
        self.memo: dict[str, bytes] = {"": b""}

    def _chunk(self, chunk: str) -> bytes:
        ascii_only = chunk.isascii() and chunk.isprintable()
        if self.fast is None or not (ascii_only or _PLAIN(chunk)) or "<|" in chunk:
            return array("I", self.slow.encode(chunk, add_special_tokens=False).ids).tobytes()
        merge = self.fast._encode_single_piece
        if ascii_only and chunk.isalpha():
            return array("I", merge(chunk.lower().encode() + b"\xff")).tobytes()
        out = array("I")
        for piece in _PIECES(chunk.lower()):
            out.extend(merge(piece.encode() + b"\xff"))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; blanks, tabs and line ends separate chunks."""
        return b"".join(self._encoded(text))

    def _encoded(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE else text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            chunks = text[at:end].replace("\n", " ").replace("\t", " ").split(" ")
            memo = self.memo
            try:
                yield b"".join(map(memo.__getitem__, chunks))
            except KeyError:
                if len(memo) > MEMO:
                    memo = self.memo = {"": b""}
                for c in chunks:
                    if c not in memo:
                        memo[c] = self._chunk(c)
                yield b"".join(map(memo.__getitem__, chunks))
            at = end


@functools.cache
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer (and memo) for each worker process."""
    return ChunkTokenizer(path)
