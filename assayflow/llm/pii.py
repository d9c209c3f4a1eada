"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to theirs."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from assayflow.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes its last run of digits whole, so one can never start inside a run: the look-behind only saves retries.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token holding one of these may belong to an entity, and every entity holds such a token.
_EVIDENCE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\w(?:[\w.%+@-]*\w)?|\S")

Span = tuple[str, int, int]


# ---------------------------------------------------------------- fixed patterns
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The pattern matches of each kind, leftmost and non-overlapping, by start and then kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ---------------------------------------------------------------- islands
#: Characters on either side of evidence that its island takes in, then to the next space or this much again.
REACH = 40


def islands(text: str) -> list[tuple[int, str]]:
    """Stretches around evidence, with their offsets. Tokens outside can't belong to an entity."""
    out: list[tuple[int, int]] = []
    for m in _EVIDENCE.finditer(text):
        if out and m.start() < out[-1][1] - REACH:
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.start() + 2 * REACH)
        for _ in range(REACH):
            if a > 0 and not text[a - 1].isspace():
                a -= 1
            if b < len(text) and not text[b].isspace():
                b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(a, text[a:b]) for a, b in out]


# ---------------------------------------------------------------- the model
#: Longest entity in tokens.
LONGEST = 8
_SHAPES = ((re.compile("[0-9]"), "d"), (re.compile("[A-Za-z]"), "a"))


def _shape(s: str) -> str:
    for pattern, letter in _SHAPES:
        s = pattern.sub(letter, s)
    return re.sub(r"(a)a+", r"\1", s)[:40]


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


def span_features(s: str, left: str, right: str) -> list[str]:
    """Features of a whole candidate span, which no single token shows."""
    d = _digits(s)
    parts = s.split(".")
    out = [
        "bias", f"digits={_bucket(len(d))}", f"shape={_shape(s)}", f"left={_shape(left)[-2:]}", f"right={_shape(right)[:2]}",
        f"first={_shape(s[:1])}", f"at={s.count('@')}", f"letters={bool(re.search('[A-Za-z]', s))}", f"dots={min(4, s.count('.'))}",
        f"groups={min(6, len(re.findall('[0-9]+', s)))}", f"parens={s.count('(')}{s.count(')')}", f"spaces={min(5, s.count(' '))}",
    ]
    if 12 <= len(d) <= 19:
        out.append(f"luhn={luhn(d)}")
    if len(parts) == 4 and all(p.isdecimal() for p in parts):
        out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if "@" in s:
        host = s.rpartition("@")[2].strip()
        out.append(f"host={bool(_DOMAIN.fullmatch(host))}")
    return out


def _token_features(s: str) -> list[str]:
    return ["O", f"O:shape={_shape(s)}", f"O:evidence={bool(_EVIDENCE.search(s))}", f"O:digits={_bucket(len(_digits(s)))}"]


@dataclass
class SemiCRF:
    """Weights by feature; a segmentation scores the sum over its spans and its tokens outside spans."""

    weights: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, list[str]]]:
        """Candidate segments (first token, token after the last, kind or "", features), by their first token.

        Every span of up to LONGEST tokens that may be an entity is one of each kind: the weights choose.
        """
        word = [text[a:b] for a, b in tokens]
        strong = [bool(_EVIDENCE.search(w)) for w in word]
        for i, w in enumerate(word):
            yield i, i + 1, "", _token_features(w)
            for j in range(i + 1, min(len(word), i + LONGEST) + 1):
                last = word[j - 1]
                if not last[-1].isalnum() or not any(strong[i:j]):
                    continue
                s = text[tokens[i][0] : tokens[j - 1][1]]
                at = "@" in s
                if not at and not (strong[j - 1] and (strong[i] or w in "+(")):
                    continue
                if at and j - i > 3:
                    continue
                shared = span_features(s, text[max(0, tokens[i][0] - 2) : tokens[i][0]], text[tokens[j - 1][1] : tokens[j - 1][1] + 2])
                for kind in KINDS:
                    yield i, j, kind, [f"{kind}:{f}" for f in shared]

    @classmethod
    def lattice(cls, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
        """Tokens' offsets, and all candidate segments."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        return tokens, list(cls.segments(text, tokens))

    def decode(self, text: str) -> list[Span]:
        """The best segmentation's entities, by dynamic programming over segments of bounded length, which are made as they are passed."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        best = [0.0] + [-math.inf] * len(tokens)
        back: list[tuple[int, str]] = [(0, "")] * (len(tokens) + 1)
        for i, j, kind, feats in self.segments(text, tokens):  # ordered by start, so best[i] is final
            score = best[i] + sum(self.weights.get(f, 0.0) for f in feats)
            if score > best[j]:
                best[j], back[j] = score, (i, kind)
        out, j = [], len(tokens)
        while j:
            i, kind = back[j]
            if kind:
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
        return out[::-1]

    @classmethod
    def fit(cls, examples: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.2, l2: float = 1e-4) -> SemiCRF:
        """Maximum likelihood by AdaGrad: expected against observed features, from the forward and backward sums."""
        index: dict[str, int] = {}
        data = []
        for text, spans in examples:
            tokens, segments = cls.lattice(text)
            starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            inside = {(starts[a], ends[b]): k for k, a, b in spans if a in starts and b in ends}
            covered = {t for i, j in inside for t in range(i, j)}
            gold = [n for n, (i, j, kind, _) in enumerate(segments) if (kind and inside.get((i, j)) == kind) or (not kind and i not in covered)]
            if tokens and sum(segments[n][1] - segments[n][0] for n in gold) == len(tokens):
                feats = [np.array([index.setdefault(f, len(index)) for f in s[3]]) for s in segments]
                data.append((len(tokens), [(i, j) for i, j, _, _ in segments], feats, set(gold)))
        w, seen = np.zeros(len(index)), np.full(len(index), 1e-6)
        for _ in range(epochs):
            for n, edges, feats, gold in data:
                score = [w[f].sum() for f in feats]
                forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                for (i, j), s in zip(edges, score):
                    forward[j] = _logadd(forward[j], forward[i] + s)
                for (i, j), s in zip(reversed(edges), reversed(score)):
                    backward[i] = _logadd(backward[i], backward[j] + s)
                for k, (i, j) in enumerate(edges):
                    p = math.exp(forward[i] + score[k] + backward[j] - forward[n]) - (k in gold)
                    if abs(p) > 1e-3:
                        f = feats[k]
                        g = p + l2 * w[f]
                        seen[f] += g * g
                        w[f] -= rate * g / np.sqrt(seen[f])
        return cls({f: float(w[i]) for f, i in index.items() if w[i]})


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


# ---------------------------------------------------------------- training examples
def variants(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The island itself, and forms that the patterns miss: a phone without its plus, an address with spaces around @."""
    out = [(text, spans)]
    for kind, a, b in spans:
        s = text[a:b]
        other = None
        if kind == "phone" and re.fullmatch(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s):
            other = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", s)
        elif kind == "email":
            other = s.replace("@", " @ ")
        if other:
            moved = [(k, x, y) if y <= a else (k, x + len(other) - len(s), y + len(other) - len(s)) for k, x, y in spans if y <= a or x >= b]
            out.append((text[:a] + other + text[b:], [*moved, (kind, a, a + len(other))]))
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ISLAND = T.StructType([T.StructField("start", T.LongType()), T.StructField("text", T.StringType())])


def _scan(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("islands", T.ArrayType(_ISLAND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string())]))]
        for batch in batches:
            base, around = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                if _EVIDENCE.search(t):
                    base.append([dict(zip(("kind", "start", "end"), s)) for s in base_spans(t)])
                    around.append([{"start": a, "text": s} for a, s in islands(t)])
                else:
                    base.append([])
                    around.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(base, kinds[1]), pa.array(around, kinds[2])], ["doc_id", "base", "islands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pieces(text: str, size: int = 2000) -> list[str]:
    """A long island cut at spaces, so that no token is cut: of up to ``size`` characters, or one token."""
    out = []
    while len(text) > size:
        at = text.rfind(" ", 1, size + 1)
        at = at if at > 0 else text.find(" ", size)
        if at < 0:
            break
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def fit_model(scanned: DataFrame, sample: int = 800) -> SemiCRF:
    """Fit on islands that the patterns label: the ``sample`` of least hash, and a share of it for each kind and
    for islands without any, so that no kind is lost where it is rare. The bound doesn't grow with the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [p for t in batch.column(0).to_pylist() for p in pieces(t)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([sorted({s[0] for s in base_spans(t)}) for t in texts], pa.list_(pa.string()))], ["text", "kinds"])

    islands = scanned.filter(F.size("islands") > 0).select(F.explode("islands").alias("i")).select(F.col("i.text").alias("text")).distinct()
    rows = Scratch(scanned.sparkSession, "pii-fit").save(islands.mapInArrow(run, "text string, kinds array<string>"), "pieces").distinct()
    share = max(1, sample // (len(KINDS) + 1))
    wanted = [(F.lit(True), sample), (F.size("kinds") == 0, share), *((F.array_contains("kinds", k), share) for k in KINDS)]
    texts = dict.fromkeys(r.text for which, n in wanted for r in rows.filter(which).orderBy(F.xxhash64("text"), "text").limit(n).collect())
    return SemiCRF.fit([v for t in texts for v in variants(t, _fits(base_spans(t)))])


def _fits(spans: list[Span]) -> list[Span]:
    """Spans that don't overlap an earlier one."""
    out: list[Span] = []
    for s in spans:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = 800, model: SemiCRF | None = None) -> DataFrame:
    """Per row: ``doc_id, base, added``, each an array of (kind, start, end) in code points, end exclusive.

    One scan of the whole texts applies the patterns and cuts out the islands around digits and @, which are
    saved; the model is fitted on a bounded sample of islands (``sample``) and decodes all of them. Its spans
    are added where they overlap no pattern match. A span that the model adds has at most ``LONGEST`` tokens, and its
    features see the first 40 signs of a token's shape; the patterns know no such limits.

    Defined cases: a null text is empty and has no spans; null ids stay; repeated rows each give a row; an
    empty table gives no rows (and an empty model); other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.save(_scan(docs, text, doc_id), "scanned")
    crf = model or fit_model(scanned, sample)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("added", T.ArrayType(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Span]] = {}
        for batch in batches:
            added = []
            for base, around in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                taken = [(b["start"], b["end"]) for b in base]
                own = []
                for island in around:
                    if (found := known.get(island["text"])) is None:
                        if len(known) > 50_000:
                            known.clear()
                        found = known[island["text"]] = crf.decode(island["text"])
                    for kind, a, b in found:
                        a, b = a + island["start"], b + island["start"]
                        if all(b <= x or y <= a for x, y in taken):
                            own.append({"kind": kind, "start": a, "end": b})
                added.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, batch.schema.field(1).type)], ["doc_id", "base", "added"])

    return scanned.mapInArrow(run, schema)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the pattern spans and the text of all spans, for each row of ``find_pii``."""
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))

    def of(kind):
        return lambda s: s["kind"] == kind

    def joined(spans):
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), rank[s["kind"]].alias("r"), s["kind"].alias("k"), s["end"].alias("e"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
