"""Ids of whole texts by the ``tokenizers`` library, with a bounded cache of the chunks it would split them into.

Byte-pair encoding never crosses a pre-token, and invented as well as natural
prose repeats its words, so a text is cut into pre-tokens first and each
distinct one goes through the tokenizer once.  The cut is done by ``re`` only on
texts whose characters all behave alike in both regular-expression engines
(ASCII and Latin-1 letters); any other text, any text that holds the string of an
added token, and any tokenizer with another pre-tokenizer, is encoded whole.  The
ids are the same either way: those of ``Tokenizer.from_file`` without special
tokens added.  With ``plain_specials`` the strings of special tokens are ordinary
text, so that no text encodes to their ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import worker_state

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile("[^\t\n\r\x0b\x0c\x20-\x7eÀ-ÖØ-öø-ÿ]")
# The split patterns of the two vocabularies, written for those characters; words first, as no other part starts like one.
_BYTE_LEVEL = re.compile(
    f" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
_WORD_LEVEL = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-zß-öø-ÿ0-9]+")
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_MARK = "\x00"
CACHE_CHUNKS = 300_000   # distinct chunks in each of two generations
PIECE_CHARS = 2_000_000  # longer texts are cut at single spaces between words


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file: ``name`` itself if it is a path, else of the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, capacity: int = CACHE_CHUNKS, plain_specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.plain_specials, self.whole = tokenizer_path(name), plain_specials, None
        self.pattern, self.lower = None, False
        # For chunks: the same model, told where the chunks end by a character that none of them has.
        self.joined = Tokenizer.from_file(self.path)
        self.vocab_size = self.joined.get_vocab_size(with_added_tokens=True)
        state = lambda part: json.loads(part.__getstate__()) if part is not None else None
        pre, norm = state(self.joined.pre_tokenizer) or {}, state(self.joined.normalizer)
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.pattern = _BYTE_LEVEL
        elif _WORD_SPLIT in json.dumps(pre).replace("\\\\", "\\") and '"Lowercase"' in json.dumps(norm):
            self.pattern, self.lower = _WORD_LEVEL, True
        added = [t for t in self.joined.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.added = [t.content.strip() for t in added]
        if norm and any(t.normalized for t in added):
            self.pattern = None   # they are looked for in the normalized text
        self.joined.encode_special_tokens = True
        self.joined.normalizer = normalizers.Sequence([])
        self.joined.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(_MARK, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.joined.encode(_MARK, add_special_tokens=False).ids
        if len(mark) == 1:
            self.mark_id = mark[0]
        else:
            self.pattern = None
        self.capacity, self.new, self.old = capacity, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        todo: list[str] = []
        chars = 0
        for t in texts:
            todo.append(t)
            chars += len(t)
            if chars > PIECE_CHARS:
                out += self._some(todo)
                todo, chars = [], 0
        return out + self._some(todo)

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return [self._whole(t) for t in texts]
        pieces, owner = [], []
        result: list[bytes | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if _OTHER.search(t) or any(a in t for a in self.added):
                result[i] = self._whole(t)
            else:
                for p in _pieces(t):
                    pieces.append(self.pattern.findall(p.lower() if self.lower else p))
                    owner.append(i)
        get, parts, gaps, missing = self.new.get, [], [], set()
        for chunks in pieces:
            found = list(map(get, chunks))
            gap = [i for i, ids in enumerate(found) if ids is None] if None in found else []
            missing.update([chunks[i] for i in gap])
            parts.append(found)
            gaps.append(gap)
        known = self._known(missing)
        joined: dict[int, list[bytes]] = {}
        for owner_, chunks, found, gap in zip(owner, pieces, parts, gaps):
            for i in gap:
                found[i] = known[chunks[i]]
            joined.setdefault(owner_, []).append(b"".join(found))
        for i, bits in joined.items():
            result[i] = b"".join(bits)
        return result

    def _whole(self, text: str) -> bytes:
        if self.whole is None:  # few workers meet a text that needs it
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = self.plain_specials
        ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _known(self, chunks: set[str]) -> dict[str, bytes]:
        """The newer generation of the cache, with ``chunks`` (none of which it had) in it."""
        missing = []
        if len(self.new) + len(chunks) > self.capacity:
            self.old, self.new = self.new, {}
        for c in chunks:
            ids = self.old.get(c)
            if ids is None:
                missing.append(c)
            else:
                self.new[c] = ids
        for at in range(0, len(missing), 512):
            some = missing[at:at + 512]
            ids = np.array(self.joined.encode_batch_fast(
                [_MARK.join(some) + _MARK], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            raw, start = ids.tobytes(), 0
            for c, end in zip(some, ends, strict=True):
                self.new[c] = raw[4 * start:4 * end]
                start = end + 1
        return self.new


def _pieces(text: str):
    """The text, or pieces of it cut before a single space between two words (where a new pre-token starts)."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        at = text.find(" ", start + PIECE_CHARS)
        while at != -1 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encoder(name: str, capacity: int = CACHE_CHUNKS, plain_specials: bool = True) -> ChunkEncoder:
    """The worker's encoder for a vocabulary; it lives across tasks."""
    kept = worker_state("encoders")
    key = (name, plain_specials)
    if key not in kept:
        kept[key] = ChunkEncoder(name, capacity, plain_specials)
    kept[key].capacity = capacity
    return kept[key]
