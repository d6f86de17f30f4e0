"""Encoding by a table of distinct space-bounded pieces, exact for tokenizers that never join over white space."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker keeps; beyond it the table starts anew.
TABLE_ROWS = 2_000_000
#: Pieces that are encoded as one text; where their cuts are not clear, 16ths of them are tried.
JOINED = 256
#: White space before a space or a line end, or a line end at the text's edge, in RE2.
_WIDE = r"[\s\x0b\x1c-\x1f\x{85}\pZ][ \n]|\A\n|\n\z|\n[\s\x0b\x1c-\x1f\x{85}\pZ]"
_workers: dict = {}


def tokenizer(path: str):
    """The tokenizer of this worker process."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _workers[path] = Tokenizer.from_file(path)
        _workers[path].no_truncation()
        _workers[path].no_padding()
    return _workers[path]


class SpacePieces:
    """ids of whole texts as uint16, for a byte-level BPE whose words take one leading space.

    Such a tokenizer always cuts between a non-space and the space or line end after it, so `" piece"` and `"\\npiece"`
    encode the same alone as in their text. Texts in which white space meets white space are encoded whole.
    """

    def __init__(self, path: str):
        self.tok, self.table = tokenizer(path), {"": b""}
        self.space = np.array(self.tok.encode(" ", add_special_tokens=False).ids, "<u2").tobytes()
        self.marks = {c: np.array(self.tok.encode(c, add_special_tokens=False).ids, "<u2").tobytes() for c in ".,;:!?"}
        size = self.tok.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = np.arange(size) == (line[0] if len(line) == 1 else -1)
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def _learn(self, pieces: list[str]) -> None:
        """Put pieces into the table; one that ends a known piece's letters with a mark is put together."""
        if len(self.table) + len(pieces) > TABLE_ROWS:
            self.table.clear()
            self.table[""] = b""
        table, plain, late = self.table, [], []
        for p in pieces:
            if p[-1] in self.marks and p[-2:-1].isalpha():
                late.append(p)
            else:
                plain.append(p)
        known = set(plain)
        plain += {b for p in late if (b := p[:-1]) not in table and b not in known}
        opening = [p for p in plain if p[0] == "\n"]
        plain = [p for p in plain if p[0] != "\n"]
        for a in range(0, len(opening), JOINED):
            self._cut(opening[a : a + JOINED], "", self.line)
        for a in range(0, len(plain), JOINED):
            self._cut(plain[a : a + JOINED], " ", self.opens)
        for p in late:
            table[p] = table[p[:-1]] + self.marks[p[-1]]

    def _cut(self, own: list[str], before: str, opens: np.ndarray) -> None:
        """Learn pieces from the text they make up, each with `before` before it; each begins at an id of `opens`."""
        ids = np.array(self.tok.encode_batch_fast([before + before.join(own)], add_special_tokens=False)[0].ids, "<u2")
        cuts = np.flatnonzero(opens[ids])
        if len(cuts) == len(own):
            raw, cuts = ids.tobytes(), (cuts * 2).tolist()
            self.table.update(zip(own, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))))
        elif len(own) == 1:  # a piece with an unusual start
            self.table[own[0]] = ids.tobytes()
        else:
            part = -(-len(own) // 16)
            for a in range(0, len(own), part):
                self._cut(own[a : a + part], before, opens)

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text), with `end_id` after each text if it is given.

        Arrow splits the texts, numbers the distinct pieces and puts their ids back by position; Python looks up only those.
        """
        whole = lambda t: np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        wide = pc.match_substring_regex(texts, _WIDE)
        heads = {k: whole(texts[k].as_py()) for k in np.flatnonzero(wide.to_numpy(zero_copy_only=False)).tolist()}
        if heads:
            texts = pc.if_else(wide, "", texts)
        # a line end opens the piece after it; the space put behind each text opens an empty piece, the place of `end_id`
        split = pc.split_pattern(pc.binary_join_element_wise(pc.replace_substring(texts, "\n", " \n"), "", " "), " ")
        cuts = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        # by way of numpy, as to_pylist makes an Arrow scalar of every piece first
        distinct, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().copy()
        found = list(map(self.table.get, distinct))
        if None in found:
            gaps = [k for k, f in enumerate(found) if f is None]
            self._learn([distinct[k] for k in gaps])
            for k in gaps:
                found[k] = self.table[distinct[k]]
        # the first piece of a text has no space before it, an empty last one is the space at the text's end
        size, first, last = len(found), cuts[:-1], cuts[1:] - 2
        found += [heads[k] if k in heads else whole(distinct[at[c]]) if distinct[at[c]] else b"" for k, c in enumerate(first.tolist())]
        found += [self.space, b"" if end_id is None else np.array([end_id], "<u2").tobytes()]
        at[last[(at[last] == distinct.index("")) & (last > first)]] = size + n
        at[first] = size + np.arange(n)
        at[cuts[1:] - 1] = size + n + 1
        placed = pa.array(found, pa.large_binary()).take(pa.array(at))
        ends = placed.buffers()[1]
        ends = np.frombuffer(ends, "<i8", len(placed) + 1, 8 * placed.offset)
        ids = np.frombuffer(placed.buffers()[2], "<u2", int(ends[-1]) // 2)
        return ids, np.diff(ends[cuts]) // 2
