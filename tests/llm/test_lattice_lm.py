"""Operator 8 against sums over all segmentations written out."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from awkward import documents, frame, real

from labelforge.llm.lattice_lm import Lattice, score_documents

PATH = P.path("piece_bpe_32k.model")


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    """The same model, word by word."""

    def __init__(self, rows):
        self.v = sentencepiece.SentencePieceProcessor(model_file=PATH)
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        self.words = Counter(w for i, t, _ in rows if not held(i) for w in cut(t))
        self.docs = sum(not held(i) for i, _, _ in rows)
        n = np.ones(self.v.get_piece_size() + 1)
        for w, c in self.words.items():
            for k in self.v.encode(w):
                n[k] += c
        n[-1] += self.docs
        self.log_p = np.log(n / n.sum())
        self.piece = {self.v.id_to_piece(k): self.log_p[k] for k in range(3, self.v.get_piece_size())}
        self.memo = {}

    def word(self, w):
        if w not in self.memo:
            x = "▁" + w
            a = [0.0] + [-math.inf] * len(x)
            for j in range(1, len(x) + 1):
                for i in range(max(0, j - 40), j):
                    p = self.piece.get(x[i:j])
                    if p is None and j - i == 1:
                        p = sum(self.piece[f"<0x{b:02X}>"] for b in x[i].encode())
                    if p is not None:
                        a[j] = np.logaddexp(a[j], a[i] + p)
            self.memo[w] = float(a[-1])
        return self.memo[w]


@pytest.mark.parametrize("kind", ["awkward", "real", "untrained", "empty"])
def test_scores(spark, kind):
    rows = {"awkward": documents(), "real": real(spark, 60), "empty": [],
            "untrained": [(i, t, s) for i, t, s in documents() if zlib.crc32(str(i).encode()) % 7 == 2]}[kind]
    m = Plain(rows)
    n = sum(m.words.values()) + m.docs
    v = len(m.words) + (m.docs > 0)
    got = sorted((tuple(r) for r in score_documents(frame(spark, rows), PATH).collect()), key=lambda r: (repr(r[0]), r[2], r[6]))
    want = []
    for i, t, _ in rows:
        w = cut(t)
        base = sum(math.log10((m.words[x] + 1) / (n + v + 1)) for x in w) + math.log10((m.docs + 1) / (n + v + 1))
        score = (sum(map(m.word, w)) + m.log_p[-1]) / math.log(10)
        want.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(w) + 1, sum(x in m.words for x in w) + (m.docs > 0), n, base, score))
    want.sort(key=lambda r: (repr(r[0]), r[2], r[6]))
    assert len(got) == len(want)
    for g, x in zip(got, want, strict=True):
        assert g[:5] == x[:5]
        assert g[5] == pytest.approx(x[5], rel=1e-9) and g[6] == pytest.approx(x[6], rel=1e-9)


def test_a_model_is_better_on_its_language_than_no_training():
    v = sentencepiece.SentencePieceProcessor(model_file=PATH)
    flat = Lattice(v, np.full(v.get_piece_size(), -math.log(v.get_piece_size())))
    words = ["the", "x" * 300, "日本", "\x00", "straße", "​", "a"]
    assert np.isfinite(flat.words(words)).all()
    assert flat.words(words)[0] == pytest.approx(flat.words(["the"])[0])
