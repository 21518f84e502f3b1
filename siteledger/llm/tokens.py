"""Byte-level BPE ids of whole batches, from a public vocabulary file whose path is a parameter."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _byte_of() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` one after the other."""
    ends = np.cumsum(lengths, dtype=np.int32)
    out = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def split_pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut at single spaces: pieces with a dictionary of the distinct ones, and where each text's pieces start."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().dictionary_encode(), bounds - bounds[0]


class ByteBPE:
    """The ids of the ``tokenizers`` file without added special tokens; the file's own added tokens keep their ids.

    The pattern never joins a word to the single space before the next one. So texts are cut at such spaces, each distinct
    piece of a batch is encoded once, and the ids of a text are gathered from its pieces. A text with other white space
    around such a cut is encoded whole.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = tuple(added)
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.width = np.zeros(self.size, np.int64)  # bytes of each id
        for token, i in ranks.items():
            self.width[i] = len(token)
        self._whole = lambda text: encoding.encode(text, allowed_special="all")
        self._plain = encoding.encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._whole(text), np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start (with the end of the last)."""
        return self.encode_pieces(texts, *split_pieces(texts))

    def encode_pieces(self, texts: pa.Array, codes: pa.DictionaryArray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the pieces that ``split_pieces`` gives."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        pieces, code = codes.dictionary, codes.indices.to_numpy()
        size = pc.binary_length(pieces).to_numpy()
        odd = (size == 0) | (pc.binary_length(pc.utf8_trim_whitespace(pieces)).to_numpy() < size)
        for name in self.added:
            odd |= pc.match_substring(pieces, name).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(odd[code], bounds[:-1]) > 0

        # All good pieces as one text; where a piece ends follows from the widths of the ids.
        good = np.flatnonzero(~odd)
        joined = " ".join(["", *pieces.take(pa.array(good)).to_pylist()])
        flat = np.array(self._plain(joined), np.int32)
        cut = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(size[good] + 1)) + 1
        start, length = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
        length[good] = np.diff(cut, prepend=0)
        start[good] = cut - length[good]

        # The first piece of a text has no space before it; it and the texts taken whole come from a second store.
        firsts: dict[str, tuple[int, int]] = {}
        store, at = [flat], len(flat)
        piece_start, piece_length = start[code], length[code]
        for i in range(n):
            key = texts[i].as_py() or "" if whole[i] else pieces[int(code[bounds[i]])].as_py()
            if key not in firsts:
                own = np.array((self._whole if whole[i] else self._plain)(key), np.int32)
                store.append(own)
                firsts[key] = (at, len(own))
                at += len(own)
            if whole[i]:
                piece_length[bounds[i] : bounds[i + 1]] = 0
            piece_start[bounds[i]], piece_length[bounds[i]] = firsts[key]
        ids = np.concatenate(store)[ragged(piece_start, piece_length)]
        per_text = np.add.reduceat(piece_length, bounds[:-1], dtype=np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
