from cases import frame

from assayflow.llm import pii


def test_rare_kinds_are_sampled_and_long_islands_not_cut(spark, monkeypatch):
    got = []
    monkeypatch.setattr(pii.SemiCRF, "fit", classmethod(lambda cls, examples: got.extend(examples) or cls({})))
    rows = [(i, f"in {1000 + i} the sum was {i * 7}") for i in range(400)] + [(900, "call +1 (555) 123-4567 now"), (901, "to a.b@c.de now"), (902, " ".join(["12.5"] * 600) + " er@mail.example.org")]
    pii.fit_model(pii._scan(frame(spark, rows), "text", "doc_id"), 20)
    assert {"phone", "email"} <= {s[0] for _, spans in got for s in spans}
    assert len(got) <= 2 * 40


def test_pieces():
    text = " ".join(["12.5"] * 600) + " er@mail.example.org"
    assert "".join(pii.pieces(text)) == text and len(pii.pieces(text)) > 1
    assert all(set(p.split()) <= {"12.5", "er@mail.example.org"} and len(p) <= 2000 for p in pii.pieces(text))
    assert pii.pieces("9" * 3000) == ["9" * 3000]
