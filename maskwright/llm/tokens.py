"""Token ids of whole texts by the tokenizers library, with a memo of blank-separated pieces and one of their parts."""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import regex

#: Pieces kept by a worker; a full memo starts anew, so it bounds memory and changes no id.
MEMO_PIECES = 1_000_000
_GROUP = 256
#: Fixed value: the split pattern of the tokenizer whose parts are remembered.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A piece of these characters is composed already and lower-cases sign by sign, so it splits here as in the tokenizer.
SIMPLE = regex.compile(r"[\n\x21-\x7E\xA1-\u012F\u0131-\u024F]+")
_LOADED: dict[str, "TextEncoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _separable(config: dict) -> bool:
    """Whether ids of a text are those of its blank-separated pieces, one after another.

    Holds if white space is only ever dropped: composed, squeezed and lower-cased text, split by a
    pattern no match of which has white space, and added tokens that neither hold nor strip blanks.
    """
    pre = config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    normal = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and len(steps) == 2
        and steps[0].get("type") == "Split"
        and steps[0].get("invert") is True
        and steps[0].get("behavior") == "Removed"
        and steps[0]["pattern"].get("Regex") == PARTS
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and config.get("post_processor") is None
        and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in config["added_tokens"])
    )


#: The code of a line break between pieces.
LINE = 1 << 62


def _byte_signs() -> dict[int, int]:
    """The sign that the byte-level step writes for each byte: its own where that is visible, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}


_SIGNS = _byte_signs()


class TextEncoder:
    """Encodes texts without special tokens being added; ids are those of ``Tokenizer.encode``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.memo_ok = _separable(config)
        special = [t["content"] for t in config["added_tokens"] if t.get("special")]
        self.mark = special[-1] if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if special else None
        self.memo_ok = self.memo_ok and self.mark is not None
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in config["added_tokens"]) or r"(?!)")
        self.find_parts = regex.compile(PARTS + r"|\n").findall
        self.model = self.tokenizer.model
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    @classmethod
    def load(cls, path: str) -> "TextEncoder":
        """One encoder for each worker process and file."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.parts: dict[str, int] = {"\n": LINE}
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, self.dtype)
        self.used = 0
        self.n_codes = 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Codes of new entries whose ids lie end to end."""
        n, m = self.n_codes, len(lengths)
        while n + m > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.used += len(ids)
        self.n_codes += m
        return range(n, n + m)

    def _ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries end to end, where each entry ends)."""
        length = self.length[codes]
        ends = np.cumsum(length)
        return self.pool[np.repeat(self.start[codes] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _part_codes(self, parts: list[str]) -> range:
        """Codes of parts, which the model itself merges: nothing is left to normalise or to split."""
        written = (t if t.isascii() else t.encode("utf-8").decode("latin-1").translate(_SIGNS) for t in parts)
        tokenize = self.model.tokenize
        found = [[token.id for token in tokenize(t)] for t in written]
        return self._store(np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found)))

    def _encoded(self, texts: list[str]) -> range:
        """Codes of texts that don't hold the mark, by the tokenizer."""
        flat, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), _GROUP):
            # one text of many pieces; the mark's id, which none of them has, parts them again
            joined = np.array(self._plain([self.mark.join(texts[at : at + _GROUP])])[0], np.int64)
            is_mark = joined == self.mark_id
            cuts = np.flatnonzero(is_mark)
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(joined)]])) - 1)
            flat.append(joined[~is_mark])
        return self._store(np.concatenate(flat), np.concatenate(lengths))

    def _add(self, pieces: list[bytes]) -> None:
        """Remember new pieces: simple ones by their parts, of which far fewer are new, others by the tokenizer."""
        lines = b"\n".join(pieces).decode("utf-8")
        if SIMPLE.fullmatch(lines) and not self.added.search(lines):
            self._add_simple(pieces, lines)
            return
        simple, other, marked = [], [], []
        for p, t in zip(pieces, lines.split("\n")):
            (marked if self.added.search(t) else simple if SIMPLE.fullmatch(t) else other).append(p)
        if simple:
            self._add_simple(simple, b"\n".join(simple).decode("utf-8"))
        if other:
            self.codes.update(zip(other, self._encoded([p.decode("utf-8") for p in other])))
        if marked:
            whole = [np.array(ids, np.int64) for ids in self._plain([p.decode("utf-8") for p in marked])]
            self.codes.update(zip(marked, self._store(np.concatenate(whole), np.array([len(x) for x in whole]))))

    def _add_simple(self, pieces: list[bytes], lines: str) -> None:
        parts = self.find_parts(lines.lower())
        known = self.parts
        codes = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = list(dict.fromkeys(map(parts.__getitem__, missing)))
            known.update(zip(new, self._part_codes(new)))
            codes[missing] = np.fromiter(map(known.__getitem__, map(parts.__getitem__, missing)), np.int64, len(missing))
        breaks = codes == LINE
        sizes = np.diff(np.concatenate([[-1], np.flatnonzero(breaks), [len(codes)]])) - 1
        ids, ends = self._ids_of(codes[~breaks])
        upto = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
        self.codes.update(zip(pieces, self._store(ids, np.diff(upto))))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text; null is empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; all texts together should stay within some megabytes."""
        if not self.memo_ok:
            return [np.array(ids, self.dtype) for ids in self._plain([t or "" for t in texts])]
        by_text = [(t or "").encode("utf-8").split() for t in texts]
        pieces = list(chain.from_iterable(by_text))
        if not pieces:
            return [np.zeros(0, self.dtype) for _ in texts]
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = list(dict.fromkeys(map(pieces.__getitem__, missing.tolist())))
            if len(self.codes) + len(new) > MEMO_PIECES:
                self._clear()
                new, missing = list(dict.fromkeys(pieces)), np.arange(len(pieces))
            self._add(new)
            codes[missing] = np.fromiter(map(self.codes.__getitem__, map(pieces.__getitem__, missing.tolist())), np.int64, len(missing))
        ids, ends = self._ids_of(codes)
        upto = np.append(0, ends)[np.cumsum([0] + [len(x) for x in by_text])].tolist()
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]


def encoded(encoder: TextEncoder, texts, group_chars: int = 1 << 20):
    """Ids of each of an iterable of texts, a megabyte or a single text at a time."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        if held and size + len(text or "") > group_chars:
            yield from encoder.encode_all(held)
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield from encoder.encode_all(held)
