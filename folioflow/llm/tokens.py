"""Token ids of whole texts, by a public tokenizer whose path is a parameter.

Any tokenizer file works, by the library's own calls. One kind has a faster way, and only where its
settings are exactly those named in :data:`SPLITS_AT_SPACE` (else a text's ids could differ):
it drops white space and never joins across it, so a text's ids are the ids of its white-space
separated pieces, in order; and within a piece of plain Latin characters those of its runs of letters, single
digits and runs of other signs. Each worker keeps the ids of what it has met (a table bounded by
bytes that only saves time). What a batch of texts adds is merged in numpy, all its runs side by
side by the file's own merges; pieces of other kinds go to the library.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import regex
from tokenizers import Tokenizer

from folioflow.llm.common import FORGET

#: Bytes of pieces and their ids that a worker remembers (frequent ones are met early), about; and the longest piece.
REMEMBERED = 60_000_000
#: What a remembered piece takes besides its own bytes and its ids': two objects and a place in the table.
OVERHEAD = 170
LONGEST = 48
#: Runs that are merged side by side.
AT_ONCE = 4096
# The settings of a tokenizer for which the faster way is right.
SPLITS_AT_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Pieces that may be taken apart: no white space of any kind, no combining marks, no
#: apostrophes (they begin suffixes) and no signs of which special tokens are made.
PLAIN = regex.compile(r"[!-&(-;=?-~\u00a1-\u012f\u0131-\u024f]")
#: What each character up to U+024F is: not plain, a letter, a number (a run by itself) or another sign.
OTHER, LETTER, NUMBER, SIGN = range(4)
KINDS = np.array([OTHER if not PLAIN.fullmatch(c) else LETTER if regex.fullmatch(r"\p{L}", c) else NUMBER if regex.fullmatch(r"\p{N}", c) else SIGN for c in map(chr, range(0x250))] + [OTHER], dtype=np.uint8)
#: Bytes that a byte-level vocabulary writes as other characters, in order from U+0100.
_ELSEWHERE = [*range(33), *range(127, 161), 173]
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(_ELSEWHERE) if b > 32}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merges of many runs side by side: in each round every run takes its merge of least rank, the leftmost of equals."""

    NONE, NEVER = 0xFFFF, np.iinfo(np.int32).max

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.uint16)
        self.ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ranks]
        signs = [chr(BYTE_LEVEL.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocabulary.get(c + end, self.NONE) for c in signs], dtype=np.uint16) for end in ("", "</w>"))
        there = np.array([b > 32 for b in range(256)])
        self.whole = bool((self.inner[there] != self.NONE).all() and (self.last[there] != self.NONE).all())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NEVER)

    def of(self, runs: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """The ids of each run; none is empty."""
        width = int(sizes.max()) + 1
        ids = np.full((len(runs), width), self.NONE, dtype=np.uint16)
        data = np.frombuffer(b"".join(runs), dtype=np.uint8)
        ids[np.arange(width) < sizes[:, None]] = self.inner[data]
        ids[np.arange(len(runs)), sizes - 1] = self.last[data[np.cumsum(sizes) - 1]]
        live, own, rank = np.arange(len(runs)), ids, self.rank(ids[:, :-1], ids[:, 1:])
        place = np.arange(width - 1)
        while True:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(at)), at]
            if not (go := least != self.NEVER).all():
                ids[live[~go]] = own[~go]
                live, own, rank, at, least = live[go], own[go], rank[go], at[go], least[go]
            if not len(live):
                break
            row = np.arange(len(live))
            own = np.concatenate((np.take_along_axis(own, place + (place > at[:, None]), 1), np.full((len(live), 1), self.NONE, dtype=np.uint16)), axis=1)
            own[row, at] = self.made[least]
            rank = np.concatenate((np.take_along_axis(rank, place[:-1] + (place[:-1] >= at[:, None]), 1), np.full((len(live), 1), self.NEVER, dtype=np.int32)), axis=1)
            rank[row, at] = self.rank(own[row, at], own[row, at + 1])
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.rank(own[before, at[before] - 1], own[before, at[before]])
        there = ids != self.NONE
        taken, ends = ids[there].astype("<u2").tobytes(), (2 * np.cumsum(there.sum(axis=1))).tolist()
        return [taken[s:e] for s, e in zip([0, *ends], ends, strict=False)]


class Encoder(dict):
    """Bytes of a piece -> its ids as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.held = Tokenizer.from_file(path), 0
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= Merges.NONE:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        about = json.loads(self.tokenizer.to_str())
        special = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and regex.fullmatch(r"<\|[a-z]+\|>", t["content"]) for t in about["added_tokens"])
        self.by_pieces = special and all(about[k] == v for k, v in SPLITS_AT_SPACE.items()) and about["model"].get("end_of_word_suffix") == "</w>" and not any(about["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        if self.by_pieces:
            self.merges = Merges(about["model"]["vocab"], about["model"]["merges"])
            self.by_pieces = self.merges.whole

    def alone(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def runs(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each of many distinct lower-cased runs."""
        out = [b""] * len(runs)
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(runs), AT_ONCE):
            rows = order[k : k + AT_ONCE]
            rows, long = rows[sizes[rows] <= LONGEST], rows[sizes[rows] > LONGEST].tolist()
            for i in long:
                out[i] = self.alone(runs[i].decode())
            if len(rows):
                at = rows.tolist()
                for i, ids in zip(at, self.merges.of([runs[i] for i in at], sizes[rows]), strict=True):
                    out[i] = ids
        return out

    def keep(self, found: dict[bytes, bytes]) -> None:
        """Remembers pieces while there is room."""
        if self.held < REMEMBERED:
            kept = {p: x for p, x in found.items() if len(p) <= LONGEST}
            self.update(kept)
            self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + OVERHEAD * len(kept)

    def apart(self, pieces: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The lower-cased runs of plain pieces, and how many each piece has."""
        text = b" ".join(pieces).decode()
        kinds = KINDS[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]  # a space is not plain
        signs = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")  # as many: no plain letter becomes two
        new = np.flatnonzero(((kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)) & (kinds[1:] != OTHER) & (kinds[:-1] != OTHER)) + 1
        runs = np.insert(signs, new, 32).tobytes().decode("utf-32-le").encode().split(b" ")
        pieces_of = np.searchsorted(np.flatnonzero(kinds == OTHER), new)
        return runs, (np.bincount(pieces_of, minlength=len(pieces)) + 1).tolist()

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces that are not known yet; they are remembered while there is room."""
        own, found = list(pieces), {}
        signs = np.frombuffer(b" ".join(own).decode().encode("utf-32-le"), dtype="<u4")
        other = np.flatnonzero((KINDS[np.minimum(signs, 0x250)] == OTHER) & (signs != 32))
        if len(other):
            for k in set(np.searchsorted(np.flatnonzero(signs == 32), other).tolist()):
                found[own[k]] = self.alone(own[k].decode())
            own = [p for p in own if p not in found]
        if own:
            runs, counts = self.apart(own)
            ids = list(map(self.get, runs))
            if new := list({r for r, x in zip(runs, ids, strict=True) if x is None}):
                fresh = dict(zip(new, self.runs(new), strict=True))
                found |= fresh
                ids = [fresh[r] if x is None else x for r, x in zip(runs, ids, strict=True)]
            at = 0
            for piece, n in zip(own, counts, strict=True):
                found[piece] = ids[at] if n == 1 else b"".join(ids[at : at + n])
                at += n
        self.keep(found)
        return found

    def all16(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, two bytes each."""
        if not self.by_pieces:
            return [np.array(x.ids, dtype="<u2").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        get, out, lacking, fresh = self.get, [], [], set()
        for text in texts:
            pieces = text.encode().split()
            ids = list(map(get, pieces))
            k = -1
            try:
                while True:
                    k = ids.index(None, k + 1)
                    lacking.append((ids, k, pieces[k]))
                    fresh.add(pieces[k])
            except ValueError:  # no other is lacking
                pass
            out.append(ids)
        found = self.learn(fresh) if fresh else {}
        for ids, k, piece in lacking:
            ids[k] = found[piece]
        return [b"".join(ids) for ids in out]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


FORGET.append(encoder.cache_clear)


def crc32_of(ids16: bytes | memoryview) -> int:
    """The unsigned crc32 of ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids16, dtype="<u2").astype("<u4").tobytes())
