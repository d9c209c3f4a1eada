import hashlib
import re

from cases import awkward, frame, with_clashes

from assayflow.llm import pii

TEXTS = [
    "mail a.b@c.de or x@y, z@@q.com a@b.c@d.e 1.2.3.4.5 256.1.1.1 010.020.030.255 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 123-4567.",
    "+12 +123456789 ++44 20 7946 0958 +1((( 1.2.3.4.5.6.7.8 é 192.168.0.1 4379362835490466 +1234567890123456", "@@@ @a.b %@x.y a@-.-", "Version 2.0. version 3.",
    "😀 é@b.c é.x@b.co.uk x@é.com 12 34 56 78 90 12 34 5", "9" * 3000 + ".1.1.1", "a" * 3000 + "@" + "b" * 50, "call (555) 123-4567 now", "joe @ mail.example.com",
]


def plain(text):
    """The patterns as stated."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p) < 4000 and int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            odd, even = [int(x) for x in d[-1::-2]], [int(x) * 2 for x in d[-2::-2]]
            if low <= len(d) <= high and (kind == "phone" or (sum(odd) + sum(x // 10 + x % 10 for x in even)) % 10 == 0):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns_as_stated():
    for t in TEXTS:
        assert pii.base_spans(t) == plain(t), t[:80]


def test_decoding_is_the_best_segmentation():
    crf = pii.SemiCRF.fit([v for t in TEXTS[:2] for v in pii.variants(t[:100], pii._fits(plain(t[:100])))], epochs=2)

    def best(segments, at, n):
        if at == n:
            return 0.0
        return max(sum(crf.weights.get(f, 0.0) for f in fs) + best(segments, j, n) for i, j, _, fs in segments if i == at)

    text = "to 1.2.3.4 or +1 (555) 123-4567"
    tokens, segments = crf.lattice(text)
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    spans = {(starts[a], ends[b]): k for k, a, b in crf.decode(text)}
    covered = {t for i, j in spans for t in range(i, j)}
    score = sum(sum(crf.weights.get(f, 0.0) for f in fs) for i, j, k, fs in segments if (k and spans.get((i, j)) == k) or (not k and i not in covered))
    assert abs(score - best(segments, 0, len(tokens))) < 1e-9


def corpus():
    import random

    r = random.Random(1)
    fill = lambda n: " ".join(r.choice("the of and ing er ion re that with".split()) for _ in range(n))
    rows = []
    for i in range(240):
        what = (
            f"+1 ({r.randrange(100, 1000)}) 555-{r.randrange(1000, 10000)}", f"er.{r.randrange(100)}@mail{r.randrange(9)}.example.com",
            ".".join(str(r.randrange(256)) for _ in range(4)), "4111111111111111", "Version 2.0.", f'token = "{r.getrandbits(160):040x}"',
        )[i % 6]
        rows.append((1000 + i, f"{fill(9)} {what} {fill(7)}."))
    return rows


def test_model_adds_missed_forms_and_leaves_clean_text(spark):
    rows = corpus() + [(1, "please call (555) 123-4567 now"), (2, "the er.7 @ mail3.example.com of"), (3, "the of and"), (4, "Version 2.0. of the"), (5, "in 1999 the 42 of")]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert [s.kind for s in got[1].added] == ["phone"]
    assert [s.kind for s in got[2].added] == ["email"]
    assert not got[3].added and not got[4].added and not got[5].added
    assert sum(len(r.added) for r in got.values()) <= 4


def test_digest_against_brute_force(spark):
    rows = awkward() + [(50 + i, t) for i, t in enumerate(TEXTS)]
    got = pii.pii_digest(pii.find_pii(with_clashes(frame(spark, rows)))).collect()
    want = []
    for i, t in rows:
        spans = plain(t or "")
        want.append((i, *(sum(k == s[0] for s in spans) for k in pii.KINDS), hashlib.sha256(pii.span_text(spans).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got)
    for r in got:  # base spans stay, in order
        assert [s for s in r.spans.split(",") if s] == sorted((s for s in r.spans.split(",") if s), key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_empty_table(spark):
    assert pii.pii_digest(pii.find_pii(frame(spark, []))).collect() == []


def test_redaction():
    assert pii.redact("to a@b.c now", [("email", 3, 8)]) == "to [EMAIL] now"
    assert pii.redact("x 1.2.3.4", [("card", 2, 9), ("ip", 2, 9)]) == "x [CARD]"
