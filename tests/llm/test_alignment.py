import hashlib
import os
from collections import Counter

import pytest
from cases import awkward, frame, with_clashes

from assayflow.llm.alignment import Alignment, ByteLevel, Pieces
from assayflow.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no public tokenizers here")
ODD = [
    "plain words, and more", "  two  spaces   three ", "line\nbreaks\r\n\ttabs", "<|endoftext|> is text", "<s> too </s> <unk>", "Ünïcödé ﬁ ligature ½ ² ™", "漢字かな交じり文 😀👩‍👩‍👧", "a\u0000b", "▁under",
    "a b​c﻿d", "don't we'll I'M 's", "x" * 3000, " " * 500, "1234567890" * 30, "́combining é", "   ", "\x7f\x1b[0m", "ends with space ",
]


def brute(rows):
    """Every pair of tokens is looked at, on the bytes of the tokenizers' own libraries."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    vocabulary = {i: s for s, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    s = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = s.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def cut(tokens):
        out, at = [], 0
        for i, b in tokens:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out

    docs, total = [], Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a = [(i, bytes(byte[c] for c in vocabulary[i])) for i in t.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in s.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc_id, [], [], Counter(), ""))
            continue
        a, b = cut(a), cut(b)
        links, j = Counter(), 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            for k, x, y in b[j:]:
                if x >= hi:
                    break
                links[i, k] += 1
        total += links
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        pa_, pb_ = 0, 0
        for e in ends:
            ga, gb = [], []
            while pa_ < len(a) and a[pa_][2] <= e:
                ga.append(a[pa_][0])
                pa_ += 1
            while pb_ < len(b) and b[pb_][2] <= e:
                gb.append(b[pb_][0])
                pb_ += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            start = e
        assert start == len(whole)
        docs.append((doc_id, a, b, links, ";".join(groups)))
    top = {}
    for (_, k), n in total.items():
        top[k] = max(top.get(k, 0), n)
    out = []
    for doc_id, a, b, links, groups in docs:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        best = sum(n for (i, k), n in links.items() if total[i, k] == top[k])
        out.append((doc_id, len(a), len(b), groups.count("|") if groups else 0, sum(links.values()), best, sum(n * total[p] for p, n in links.items()), sha, groups))
    return sorted(out, key=str), total


def rows_of(spark, rows, **given):
    found = Alignment(with_clashes(frame(spark, rows)), A, B, spans=True, **given)
    got = found.documents().collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got), key=str), found


@pytest.mark.parametrize("block", [1 << 21, 50])
def test_against_all_pairs(spark, block):
    texts = [t for t in ODD if "|" not in t] + ["<endoftext|> once more"]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(texts)] + [(300 + i, "the same words again and again " * i) for i in range(6)]
    expected, total = brute(rows)
    got, found = rows_of(spark, rows, block=block)
    # A bar in the text is a token like others: groups are counted by the operator, not by bars.
    assert got == expected
    assert {(r.a_id, r.b_id): r["count"] for r in found.links().collect()} == total
    assert all(r.best == (r["count"] == max(n for (_, k), n in total.items() if k == r.b_id)) for r in found.links().limit(200).collect())


def test_empty_table(spark):
    assert rows_of(spark, [])[0] == []


def test_fast_and_own_encoding_agree():
    own = ByteLevel(A)
    assert own.fast is not None
    for text in ODD + [t or "" for _, t in awkward()]:
        assert own.fast.encode_ordinary(" " + text) == own.slow.encode(" " + text, add_special_tokens=False).ids
        assert b"".join(own.bytes[i] for i in own.encode(text)) == text.encode()


def test_pieces_bytes():
    own = Pieces(B)
    assert own.bytes[own.model.piece_to_id("<0x0A>")] == b"\n" and own.bytes[own.model.piece_to_id("▁the")] == b" the"
