"""The byte-level BPE library, with a faster encoder of the same vocabulary where both provably agree.

The tokenizer file decides what a text's ids are. If its merges are in the order of its ids and it splits by the usual
byte-level pattern, the rank encoder gives the same ids several times faster; it is used for texts of characters below
U+0250, whose classes no Unicode version changed. All other texts and files go to the library itself."""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: the pattern of byte-level BPE that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BEYOND = re.compile("[^\x00-\u024f]")


def byte_signs() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for signs from U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Library:
    """The ids of texts as the tokenizers library gives them for a file."""

    _open: dict[str, Library] = {}

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ranks = self._rank_encoder(file)

    @classmethod
    def of(cls, file: str) -> Library:
        """One for each worker and file."""
        if file not in cls._open:
            cls._open[file] = cls(file)
        return cls._open[file]

    def special_strings(self) -> list[str]:
        """Strings that become one token wherever they stand in a text."""
        return [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _rank_encoder(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        if model.get("type") != "BPE" or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
            return None
        vocab, skip = model["vocab"], {t["content"] for t in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab["".join(p)] for p in pairs]
        signs = byte_signs()
        if any(b <= a for a, b in zip(ids, ids[1:], strict=False)) or len(ids) + len(signs) != len(vocab) - len(skip & set(vocab)):
            return None
        import tiktoken

        ranks = {bytes(signs[c] for c in t): i for t, i in vocab.items() if t not in skip}
        self.special = {t["content"] for t in added}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """32-bit ids of each text, special strings inside texts becoming special tokens as is the library's default."""
        out: list[np.ndarray | None] = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.ranks is None or _BEYOND.search(t):
                slow.append(i)
            else:
                out[i] = self.ranks.encode_to_numpy(t, allowed_special=self.special, disallowed_special=()).view(np.int32)
        if slow:
            got = self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)
            for i, e in zip(slow, got, strict=True):
                out[i] = np.array(e.ids, np.int32)
        return out


class Bytes:
    """The bytes behind each id, for decoding without the library's per-token strings."""

    _open: dict[str, Bytes] = {}

    def __init__(self, file: str) -> None:
        tokenizer = Library.of(file).tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        added = tokenizer.get_added_tokens_decoder()
        of_sign = byte_signs()
        parts = []
        for i in range(size):
            token = added[i].content if i in added else tokenizer.id_to_token(i)
            parts.append(token.encode() if i in added else bytes(of_sign[c] for c in token))
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    @classmethod
    def of(cls, file: str) -> Bytes:
        if file not in cls._open:
            cls._open[file] = cls(file)
        return cls._open[file]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; what isn't valid UTF-8 becomes U+FFFD, as the library has it."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        raw = self.blob[at].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
