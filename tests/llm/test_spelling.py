import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import awkward, frame, with_clashes

from assayflow.llm import spelling
from assayflow.llm.spelling import PATHS, parity_masks, spelling_groups


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(docs, **given):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(docs, **given).collect())


def corpus():
    r = random.Random(11)
    letters = "abcdeéèßxyzÿÀ×"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 10))) for _ in range(60)]
    words = []
    for w in base:
        chain, often = w, 400
        while often >= 5:
            words += [chain] * often
            for _ in range(3):
                at = r.randrange(len(chain))
                words += [r.choice([chain[:at] + chain[at + 1 :], chain[:at] + r.choice(letters) + chain[at:], chain[:at] + r.choice(letters) + chain[at + 1 :]])] * r.randrange(3, 9)
            at = r.randrange(len(chain))
            chain, often = chain[:at] + r.choice(letters) + chain[at + r.randrange(2) :], often // 7
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa"] * 6 + ["bababa", "ababab", "baabab"] * 7
    r.shuffle(words)
    words = [w.upper() if r.random() < 0.1 and w.isascii() else w for w in words]
    return awkward() + [(100 + i if i % 9 else None, " ".join(words[i * 40 : i * 40 + 40]).replace(" ", r.choice([" ", "\n", ", ", "1"]))) for i in range(-(-len(words) // 40))]


@pytest.mark.parametrize("group", [8192, 12])
def test_against_brute_force(spark, group):
    rows = corpus()
    expected = brute(rows, every=7)
    assert any(f and r != f for _, f, r, *_ in expected)  # forms of forms
    assert found(with_clashes(frame(spark, rows)).repartition(3), every=7, group=group) == expected


def test_letter_left_out_by_the_contracts_hash(spark):
    rows = [(i, "letters " * 9 + "Wordses") for i in range(400)]
    got = found(frame(spark, rows))
    assert got == brute(rows) and len(got) > 2


def test_groups_divided_to_the_end(spark, monkeypatch):
    rows = [(i, " ".join(f"{a}{b}cdefg" for a in "abcdefgh" for b in "stuvwxyz") + " acdefg") for i in range(6)]
    assert found(frame(spark, rows), group=1) == brute(rows)


def test_empty_table_and_arguments(spark):
    assert found(frame(spark, [])) == []
    with pytest.raises(ValueError):
        spelling_groups(frame(spark, []), times=1)


def test_an_edit_leaves_one_band_of_each_level():
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüýÿß"
    for _ in range(300):
        w = "".join(r.choice(letters) for _ in range(r.randrange(6, 14)))
        at = r.randrange(len(w))
        x = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]])
        a, b = parity_masks([w.encode("latin-1"), x.encode("latin-1")])
        flips = int(a ^ b)
        assert flips.bit_count() <= 2
        for level in range(1, spelling.DEPTH + 1):
            here = [p for p in PATHS.same if len(p) == level and not flips & PATHS.same[p] and all(flips & d for d in PATHS.differ[p])]
            assert len(here) == 1


def test_masks_tell_odd_letters():
    a, b, c = parity_masks([b"abcabd", b"cd", b"aab"])
    assert a == b and c == np.uint64(2)
