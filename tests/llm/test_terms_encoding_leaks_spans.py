"""Term counts, encoding, leak search and shared spans against brute force, with hostile input."""

import random
import re
from collections import Counter

import pytest
from dyadica.llm import encoding, leakage, shared_spans, term_frequency

ROWS = [
    ("c1", "The user is Kind!", "a b a"), ("c1", "kind", "b c"), ("c2", "KIND", None), ("c2", None, ""), (None, "kind", "a"),
    ("c3", "  ", "!!"), ("c3", "the user is", "a-b"), ("c1", "The user is Kind!", "a b a"),
]


def brute_terms(rows):
    occ, rec = Counter(), {}
    for cell, label, text in rows:
        terms = [("assumption", t) for t in term_frequency.value_term(label)]
        terms += [("description", t) for t in term_frequency.word_terms(text)]
        for t in terms:
            occ[t] += 1
            rec.setdefault(t, set())
            if cell is not None:
                rec[t].add(cell)
    return {(f, t): (n, len(rec[f, t])) for (f, t), n in occ.items()}


def counted(df):
    got = term_frequency.term_counts(df, "cell", {"assumption": "value", "description": "words"}).collect()
    return {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in got}, {r["field"]: r["field_records"] for r in got}


def test_term_counts(frame):
    got, totals = counted(frame(ROWS, "cell string, assumption string, description string", clash=True))
    assert got == brute_terms(ROWS)
    assert totals == {"assumption": 3, "description": 2}
    assert term_frequency.value_term("the  user IS: hurt") == ["hurt"]


def test_hot_record_and_flush(frame, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["x", "y", None]), rng.choice("abc"), " ".join(rng.choices("pqrst", k=6))) for _ in range(600)]
    df = frame(rows, "cell string, assumption string, description string")
    plain, _ = counted(df)
    assert plain == brute_terms(rows)
    monkeypatch.setattr(term_frequency, "HOT_ROWS", 50)  # the hot record is split by term
    monkeypatch.setattr(term_frequency, "MOST_COUNTERS", 3)
    assert counted(df)[0] == plain


def test_marks_and_empty(frame):
    rows = [(f"c{i}", "often" if i < 30 else f"rare{i}", None) for i in range(40)]
    counts = term_frequency.term_counts(frame(rows, "cell string, assumption string, description string"), "cell", {"assumption": "value", "description": "words"})
    marks = {r["term"]: r["mark"] for r in term_frequency.marked_terms(counts).collect()}
    assert marks["often"] == "common" and marks["rare35"] == "rare"
    assert counted(frame([], "cell string, assumption string, description string"))[0] == {}


TEXTS = ["Hello world", "", None, "   \n\n\t ", "don't stop, it's 2024!!", "naïve 🙂 日本語", "x" * 5000, " spaced   out  ", "a1" * 400, "word " * 3000]


def test_encoding_round_trip(frame):
    rows = list(enumerate(TEXTS)) + [(0, "Hello world"), (None, "null key")]
    ids = encoding.encode_corpus(frame(rows, "doc long, text string", clash=True), "doc", "text")
    assert ids.columns == ["doc", "ids"]
    got = [(r["doc"], r["ids"]) for r in ids.collect()]
    assert len(got) == len(rows)
    assert dict(got)[1] == [] and dict(got)[2] == []
    back = {r["doc"]: r["text"] for r in encoding.decode_corpus(ids, "doc").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))


def test_encoding_equals_the_other_library():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    other = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    enc = encoding.encoder(open(encoding.RANK_FILE, "rb").read())
    for t in TEXTS:
        assert encoding.encode_text(enc, t) == (other.encode(t, add_special_tokens=False).ids if t else [])


def test_pieces_are_safe():
    enc = encoding.encoder(open(encoding.RANK_FILE, "rb").read())
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices([" ", "  ", "\n", "ab", "cd'll", "'s", "12", "é", "🙂", "...", "日"], k=300))
        cut = list(encoding.pieces(text, 20))
        assert "".join(cut) == text
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def grams_leaked(docs, items, least):
    table = {}
    for i, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k in range(len(w) - least + 1):
            table.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in table.get(tuple(w[k : k + least]), ())}
    return out


def test_leaks_against_brute_force(frame):
    rng = random.Random(5)
    words = list("abcdef")
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(25)] + [(90, None), (None, "a b c d")]
    items += [(91, items[0][1] + " a b"), (92, items[0][1])]
    docs = [(d, "-".join(rng.choices(words, k=rng.randint(0, 60)))) for d in range(60)] + [(70, None), (71, ""), (0, "A, b! " + items[2][1])]
    docs.append((72, " ".join(rng.choices(words, k=3000))))
    found = leakage.leaked_passages(frame(docs, "doc long, text string", clash=True), frame(items, "item long, body string"), "doc", "text", "item", "body", 5)
    got = {tuple(r) for r in leakage.leaks(found, "doc", "item").collect()}
    assert got == grams_leaked(docs, [x for x in items if x[0] is not None], 5)
    for r in found.collect():
        assert r["n_words"] == r["end_word"] - r["first_word"] >= 5


def test_leaks_empty_tables(frame):
    docs, items = frame([], "doc long, text string"), frame([], "item long, body string")
    some = frame([(1, "a b c d e f")], "doc long, text string")
    for d in (docs, some):
        assert leakage.leaked_passages(d, items, "doc", "text", "item", "body", 3).count() == 0
    found = leakage.leaked_passages(some, frame([(4, "b c d e")], "item long, body string"), "doc", "text", "item", "body", 3)
    row = leakage.leak_coverage(some, found, "doc", "text").first()
    assert row["leaked_words"] == 4 and row["drop_document"]


def brute_shared(docs, n):
    seen = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(d)
    return {w for w, ds in seen.items() if len(ds) > 1}


def test_shared_spans_against_brute_force(frame, monkeypatch):
    rng = random.Random(7)
    text = lambda k: "".join(rng.choices("abcd ", k=k))
    common, short = text(60), text(39)
    docs = [(i, text(rng.randint(0, 150))) for i in range(30)]
    docs += [(40, text(30) + common + text(20)), (41, common), (42, text(5) + common[:45]), (43, text(9) + short + "x"), (44, short + text(50))]
    docs += [(45, docs[3][1] + "é🙂" * 40), (46, docs[3][1] + "é🙂" * 40), (47, None), (48, ""), (49, common * 2), (50, "z" * 90), (50, "z" * 90), (51, text(3000) + common)]
    monkeypatch.setattr(shared_spans, "SEGMENT", 500)
    df = frame(docs + [(None, common)], "doc long, text string", clash=True)
    windows = brute_shared(docs, 40)
    expected = {d for d, t in docs if any((t or "")[k : k + 40] in windows for k in range(len(t or "") - 39))}
    docs_df, spotted = shared_spans.shared_windows(df, "doc", "text", 40, 20)
    some = docs_df.join(spotted.select("text_id").distinct(), "text_id", "left_semi").select("key").union(docs_df.filter("first_key <> last_key").select("key"))
    assert {r[0] for r in some.collect()} == expected
    monkeypatch.setattr(shared_spans, "GRAM", 20)


def test_shared_span_edges_and_share(frame):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    common = text(450)
    docs = [(1, "Q" + common + "R" + text(100)), (2, text(80) + "S" + common + "T"), (3, text(700)), (4, text(399)), (5, "same" * 200), (6, "same" * 200), (7, None)]
    df = frame(docs, "doc long, text string")
    spans = {(r["doc"], r["start"], r["end"]) for r in shared_spans.shared_spans(df, "doc", "text").collect()}
    assert spans == {(1, 1, 451), (2, 81, 531), (5, 0, 800), (6, 0, 800)}
    share = {r["doc"]: r["share"] for r in shared_spans.shared_share(df, "doc", "text").collect()}
    assert share[5] == 1.0 and share[3] == 0.0 and share[7] is None and share[1] == pytest.approx(450 / 552)
    assert {r[0] for r in shared_spans.shared_records(df, "doc", "text").collect()} == {1, 2, 5, 6}
    assert shared_spans.shared_records(frame([], "doc long, text string"), "doc", "text").count() == 0
