"""Fast exact encoding with the tokenizers library: each distinct pre-token is encoded once.

Both byte-level BPE files here split a text into pre-tokens and encode each by
itself, so a text's ids are its pre-tokens' ids, end to end.  Pre-tokens are cut
and hashed by numpy, and the library's model encodes only those that a bounded
table doesn't hold yet.  A text is handed to the library whole when it holds
anything whose treatment isn't settled by bytes: characters beyond ASCII and the
letters of Latin-1, other control characters, an apostrophe, or the beginning of
a special string.  Other tokenizer files are handed all texts whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .vector import slices, span_hash

WS, LETTER, DIGIT, OTHER = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0D]] = WS
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = KIND[0x80:] = LETTER
#: Bytes that send a text to the library as a whole: controls, the apostrophe, and lead bytes other than C3.
ODD = np.zeros(256, bool)
ODD[:32] = True
ODD[[9, 10, 13]] = False
ODD[[0x27, 0x7F]] = True
ODD[0xC0:] = True
ODD[0xC3] = False


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if it prints, else the next of U+0100 and on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PieceEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.style = self._style(json.load(open(path, encoding="utf-8")))
        self.most, self.symbols = most, byte_symbols()
        self.clear()

    @staticmethod
    def _style(spec: dict) -> str:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        if model["type"] != "BPE" or model.get("dropout"):
            return "whole"
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "spaced"
        steps = [s["type"] for s in (norm or {}).get("normalizers", [])]
        inner = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in inner] == ["Split", "ByteLevel"]:
            # letters as one, digits alone, other characters as one; white space falls away
            if inner[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and inner[0]["behavior"] == "Removed":
                return "lowered"
        return "whole"

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # of each key: where its ids start
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _model_ids(self, piece: bytes) -> list[int]:
        text = piece.decode() if piece.isascii() and b" " not in piece and b"\n" not in piece and b"\r" not in piece and b"\t" not in piece else "".join([self.symbols[b] for b in piece])
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        found = [self._model_ids(p) for p in pieces]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.uint32, int(count.sum()))
        at = len(self.ids) + np.cumsum(count) - count
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.at, self.count = all_keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, flat])

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens."""
        n = len(data)
        kind = KIND[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        start |= first[:-1]
        if self.style == "lowered":
            start |= kind == DIGIT
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], n)
            keep = kind[starts] != WS
            return starts[keep], ends[keep]
        # the last white space before other characters is a piece of its own, or joins them if it is a space
        after = np.flatnonzero(start[1:] & (kind[1:] != WS) & (kind[:-1] == WS) & ~first[1:-1]) + 1
        start[after - 1] = True
        start[after[data[after - 1] == 0x20]] = False
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids of each text)."""
        flat, per = [], []
        for i, j in slices(offsets):
            ids, n = self._encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            flat.append(ids)
            per.append(n)
        return (np.concatenate(flat), np.concatenate(per)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        per = [self._encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids=False)[1] for i, j in slices(offsets)]
        return np.concatenate(per) if per else np.zeros(0, np.int64)

    def _encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        odd = np.ones(n_docs, bool)
        if self.style != "whole" and len(data):
            bad = ODD[data]
            cont = np.flatnonzero(data == 0xC3) + 1
            cont = cont[cont < len(data)]
            bad[cont[(data[cont] == 0x97) | (data[cont] == 0xB7)]] = True  # the signs among the letters
            lead = np.flatnonzero(data == 0x3C)
            lead = lead[lead + 1 < len(data)]
            bad[lead[data[lead + 1] == 0x7C]] = True
            odd = np.add.reduceat(np.append(bad, False).astype(np.int64), offsets[:-1]) > 0
            odd &= offsets[1:] > offsets[:-1]
        elif self.style != "whole":
            odd[:] = False
        if odd.all() and n_docs:
            return self._whole(data, offsets, np.arange(n_docs))
        if odd.any():
            good = np.flatnonzero(~odd)
            parts = [data[offsets[k] : offsets[k + 1]] for k in good]
            sub = np.concatenate(parts) if parts else data[:0]
            sub_off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            a, na = self._pieces(sub, sub_off, ids)
            b, nb = self._whole(data, offsets, np.flatnonzero(odd))
            per = np.zeros(n_docs, np.int64)
            per[good], per[odd] = na, nb
            if not ids:
                return a, per
            out, to = np.empty(int(per.sum()), np.uint32), np.concatenate([[0], np.cumsum(per)])
            for src, n, docs in ((a, na, good), (b, nb, np.flatnonzero(odd))):
                ends = np.cumsum(n)
                for k, d in enumerate(docs):
                    out[to[d] : to[d + 1]] = src[ends[k] - n[k] : ends[k]]
            return out, per
        return self._pieces(data, offsets, ids)

    def _whole(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids for d in docs]
        return np.fromiter((i for x in out for i in x), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        if self.style == "lowered":
            upper = (data >= 65) & (data <= 90)
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            data = data + upper.astype(np.uint8) * np.uint8(32)
        starts, ends = self._cut(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        distinct, where, back = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], [raw[s:e] for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            at = np.searchsorted(self.keys, distinct)
        count = self.count[at][back]
        total = np.concatenate([[0], np.cumsum(count)])
        first_piece = np.searchsorted(starts, offsets)
        per = total[first_piece[1:]] - total[first_piece[:-1]]
        if not ids:
            return np.zeros(0, np.uint32), per
        index = np.repeat(self.at[at][back] - total[:-1], count) + np.arange(total[-1])
        return self.ids[index], per
