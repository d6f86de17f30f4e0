"""Pieces of texts that are learnt together, and what that costs in calls."""

import public_tokenizers
import pyarrow as pa
import pytest

from gridwell.llm import chunked_bpe
from gridwell.llm.chunked_bpe import SpacePieces


class Counted:
    """A tokenizer that counts its batch calls and the texts in them."""

    def __init__(self, tok):
        self.tok, self.calls = tok, 0

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, texts, **how):
        self.calls += 1
        return self.tok.encode_batch_fast(texts, **how)


def coder():
    made = SpacePieces(public_tokenizers.path("byte_bpe_50k.json"))
    made.tok = Counted(made.tok)
    return made


def words(n):
    return ["".join(chr(97 + k // 26**d % 26) for d in range(4)) for k in range(n)]


def test_new_pieces_need_few_calls():
    one, text = coder(), " ".join(["first", *words(1024)])
    ids, _ = one.encode(pa.array([text]))
    assert ids.tolist() == one.tok.encode(text, add_special_tokens=False).ids
    assert one.tok.calls <= 5


@pytest.mark.parametrize("joined", [1, 5, 17, 256])
def test_pieces_whose_cuts_are_not_clear_are_learnt_in_parts(monkeypatch, joined):
    """Without known openings no joined text can be cut, so all pieces are learnt alone in the end."""
    monkeypatch.setattr(chunked_bpe, "JOINED", joined)
    one = coder()
    one.opens[:], one.line[:] = False, False
    texts = [" ".join(["x", *words(300)]), "a\nline, éé <|endoftext|> 12.5% 'tis\nend.", ""]
    ids, sizes = one.encode(pa.array(texts), 0)
    want = [[*one.tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))

