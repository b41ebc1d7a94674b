"""Token ids of whole texts by a byte-level BPE of the `tokenizers` library, in numpy blocks.

The byte-level pre-tokeniser cuts a text at borders that depend on character classes alone, so they are found
for a block at once; each distinct piece is hashed, encoded once by the library's model and looked up from then
on. The table of known pieces is a bounded cache. Texts with characters that older Unicode tables lack or with an added token
go through the library whole, as do all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from lodestone.llm import textbytes as tb

LETTER, NUMBER, SPACE, OTHER, RARE = range(5)
#: Entries of the piece cache before it starts anew.
CACHE = 1_500_000
# Fixed values of byte-level BPE: endings that follow an apostrophe, and what counts as white space.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACES = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    old = unicodedata.ucd_3_2_0
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(sys.maxunicode + 1, RARE, np.uint8)
    for c in range(0x30000):
        now, then = unicodedata.category(chr(c))[0], old.category(chr(c))[0]
        if now == then:
            out[c] = kind.get(now, OTHER)
    out[_SPACES] = SPACE
    return out


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def borders(codes: np.ndarray, kinds: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokeniser's pieces in a block of texts."""
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = first[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    # The last character of a white-space run before other text: a blank joins that text, anything else stands alone.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~first[1:]
    start |= last
    after = np.flatnonzero(last & (codes == 0x20)) + 1
    start[after] = False
    lone = np.flatnonzero((codes == 0x27) & start)
    lone = lone[(lone + 1 < n)]
    lone = lone[start[lone + 1] & (kinds[lone + 1] == LETTER) & ~first[lone + 1]]
    if len(lone):
        stop = np.append(np.flatnonzero(first), n)
        for at in lone.tolist():
            end = int(stop[np.searchsorted(stop, at, "right")])
            tail = "".join(map(chr, codes[at + 1 : min(at + 3, end)]))
            took = next((len(e) for e in _ENDINGS if tail.startswith(e)), 0)
            if took:
                start[at + 1] = False
                if at + 1 + took < end:
                    start[at + 1 + took] = True
    return np.flatnonzero(start)


class Encoder:
    """ids(texts) → (all ids, offsets of the texts in them)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.fast = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("byte_fallback")
        )
        # An added token in a text has an id of its own, which the pieces don't know.
        added = [re.escape(a["content"]) for a in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        self.piece_ids = self._pieces(model) if self.fast else None
        self.clear()

    def _pieces(self, model: dict):
        """A function from a piece's bytes to its ids. Where ids rise in the order of the merges, as here, they are the
        ranks that `tiktoken` wants, and it merges a single piece several times faster than the model's own call."""
        letters = _byte_letters()
        table = {b: letters[b] for b in range(256)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made == sorted(set(made)) and all(model["vocab"].get(c, made[0]) < made[0] for c in letters.values()) and not model.get("ignore_merges"):
            import tiktoken

            back = {c: b for b, c in letters.items()}
            names = {*letters.values(), *(a + b for a, b in merges)}
            ranks = {bytes(back[c] for c in t): model["vocab"][t] for t in names}
            return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda piece: [t.id for t in self.tok.model.tokenize(piece.decode("latin-1").translate(table))]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros((0, 2), np.int64)
        self.ids_known = np.zeros(0, np.uint32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.concatenate(([0], np.cumsum(size)))
        joined = "".join(texts)
        try:
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        except UnicodeEncodeError:
            return self.whole(texts)
        kinds = classes()[codes] if self.fast else None
        if not self.fast or (kinds == RARE).any() or self.added and self.added.search(joined):
            if len(texts) == 1:
                return self.whole(texts)
            if not self.fast:
                return self.whole(texts)
            parts = [self.ids([t]) for t in texts]
            return np.concatenate([p[0] for p in parts]), np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = borders(codes, kinds, off)
        ends = np.append(starts[1:], len(codes))
        up, down = tb._Powers.upto(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        h = tb.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        uniq, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = self.look_up(uniq, starts[one], ends[one], joined)
        lo, count = self.where[at, 0], self.where[at, 1]
        lo, count = lo[inverse], count[inverse]
        edge = np.concatenate(([0], np.cumsum(count)))
        pick = np.arange(edge[-1]) + np.repeat(lo - edge[:-1], count)
        return self.ids_known[pick], edge[np.searchsorted(starts, off)]

    def look_up(self, uniq: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
        if len(self.keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            got, count = [], []
            for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True):
                ids = self.piece_ids(joined[s:e].encode())
                got += ids
                count.append(len(ids))
            count = np.array(count, np.int64)
            lo = len(self.ids_known) + np.cumsum(count) - count
            self.ids_known = np.concatenate((self.ids_known, np.array(got, np.uint32)))
            self.where = np.insert(self.where, at[new], np.stack((lo, count), 1), axis=0)
            self.keys = np.insert(self.keys, at[new], uniq[new])
            at = np.searchsorted(self.keys, uniq)
        return at

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        off = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64)
        return np.array([i for g in got for i in g], np.uint32), off


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
