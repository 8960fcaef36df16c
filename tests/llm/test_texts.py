"""Personal information, broken pairs and truncation."""

import random

from dyadica.llm import broken_pairs, personal_info, truncation


def kinds(text):
    return [k for _, _, k, _ in personal_info.find_spans(text)]


def test_found_kinds():
    cases = {
        "Write to jo.doe+x@mail.example or not": ["email"], "reach JO [at] MAIL [dot] EXAMPLE now": ["email"], "x_9 (at) some.test it": ["email"], "a ＠ b . example": [],
        "Call me on +44 7700 900 372 after six.": ["phone"], "tel: (212) 555-0108": ["phone"], "I texted 030/23125196.": ["phone"], "rang from 555 0107 ext. 55 twice": ["phone"],
        "My social security number is 000-72-3906.": ["id_number"], "Passport no. XQ3873203 was": ["id_number"], "tax number QQ 40 88 18 C.": ["id_number"], "IBAN GB82 WEST 1234 5698 7654 32 ok": ["id_number"],
        "card 4111 1111 1111 1111 here": ["id_number"], "We live at 104 Tanner Hill Road, Selport 00167, right": ["address"], "PO Box 442, Quenstow": ["address"], "in Lindenweg 17a, 00607 Holby wohnt": ["address"],
        "at 12 rue des Tilleuls, Town": ["address"], "Calle del Olmo 58, 2º B": ["address"], "I spoke to Farid Drayarelli about it": ["name"], "It was ULLA RUSKEQUIST who did": ["name"],
        "Best regards, Mrs Nibander": ["name"], "signed by Célia R. Toreholt.": ["name"], "Caldedrin, Ruben wrote": ["name"], "My name is Xyrr Plomb, for": ["name"],
    }
    for text, expected in cases.items():
        if expected:
            assert kinds(text) == expected, text


def test_not_personal():
    for text in [
        "The order number was 4477-22-6074 and it", "The invoice over 522.02 lists article 0061769.", "Ticket #252487 is open.", "Flight QX 6167 was late on 2030-06-10.", "The raffle ticket says 1907196",
        "I follow @linham_corner for", "at 8:30 pm @ the usual place.", "Thalenmaar & Drayunova Bakery had", "Mark my words, fine by May.", "Lake Holham was frozen, so we walked along Alder Lane.",
        "Version 3.3.15 crashed", "I paid 1640 euros", "moved to Kelport", "card 4111 1111 1111 1112 number", "", None, "   ",
    ]:
        assert kinds(text) == [], text


def test_redaction_keeps_the_rest(frame):
    text = "Hi. Call me on +44 7700 900 372, or write to a@b.example!\nBye 🙂"
    assert personal_info.redact(text) == "Hi. Call me on [PHONE], or write to [EMAIL]!\nBye 🙂"
    long = "plain words, nothing here. " * 20000 + "mail x@y.example"
    people = [("u1", "faith", [("user", text), ("assistant", None)]), ("u1", "faith", [("user", text), ("assistant", None)]), ("u2", None, None), (None, "x", [("user", "")])]
    prompts = [("d1", "original_post", long), ("d2", "flipped_story", None)]
    p = frame(people, "persona_id string, persona_type string, messages array<struct<role string, content string>>", clash=True)
    q = frame(prompts, "prompt_id string, prompt_type string, text string", clash=True)
    got = {tuple(r) for r in personal_info.kinds_found(p, q).collect()}
    assert got == {("personas", "faith", "u1", 0, "phone"), ("personas", "faith", "u1", 0, "email"), ("prompts", "original_post", "d1", 0, "email")}
    assert personal_info.kinds_found(p.limit(0), q.limit(0)).count() == 0


PROMPT = "My cousin moved the party twice and never told me about it. I had already paid for the cake and the hall, so now I feel foolish and angry."


def test_defects():
    d = broken_pairs.defect
    for nothing in (None, "", " \n", "​", "N/A", "**RESPONSE:**", "[no reply]", "{}", "null", "...", "<empty>"):
        assert d(nothing, PROMPT, None, True) == "empty"
    assert d(PROMPT, PROMPT, None, False) == "copied"
    assert d("You wrote: " + PROMPT.lower().replace(",", ""), PROMPT, None, False) == "copied"
    assert d(PROMPT.replace("party", "really").replace("angry", "sad"), PROMPT, None, False) == "copied"
    for no in ("I cannot assist with that request.", "I'm sorry, but I can't help with this one. Please try later.", "Unfortunately this falls outside what I am allowed to discuss.", "Dabei kann ich leider nicht helfen."):
        assert d(no, PROMPT, None, False) == "refusal", no
    assert d("Creo que deberías hablar con tu prima antes de la fiesta, pero no es fácil.", PROMPT, None, False) == "other_language"
    assert d("Creo que deberías hablar con tu prima antes de la fiesta, pero no es fácil.", None, PROMPT, False) == "other_language"
    assert d("Creo que deberías hablar con tu prima antes de la fiesta.", None, None, False) is None
    assert d("You could ask the hall for", PROMPT, None, True) == "truncated"
    for fine in ("Not at all!", "You did fine.", "I can't tell you how often a cake turns into a fight about respect.", "I am unable to see the other side from here, but I can help you plan the talk. Take care 💛"):
        assert d(fine, PROMPT, None, False) is None, fine


def test_prompt_automaton_matches():
    rng = random.Random(1)
    for _ in range(40):
        p, r = rng.choices("abc", k=30), rng.choices("abc", k=25)
        for start, n, at in broken_pairs.PromptAutomaton(p).matches(r, 3):
            assert n >= 3 and r[start : start + n] == p[at : at + n]


ADVICE = ["You could write a short note before the {} and leave it at that.", "It might help to ask what your {} expected last summer.", "Both of you seem to remember the {} quite differently."]
WORDS = ["gathering", "neighbour", "celebration", "grandmother", "apartment", "projector"]


def replies(n=900, seed=2):
    rng, rows, cut = random.Random(seed), [], set()
    for i in range(n):
        text = " ".join(rng.choice(ADVICE).format(rng.choice(WORDS)) for _ in range(rng.randint(1, 5)))
        if i % 12 == 0:
            text = text[: rng.randint(30, len(text) - 3)]
            if text[-1] == "." or text[-1] == " " and text.rstrip()[-1] == ".":
                text = text.rstrip(" .") + " It might he"
            cut.add(i)
        elif i % 5 == 0:
            text += rng.choice([" Rooting for you", " Be well", "\n\n- breathe\n- ask once", " 🙂", " (truly.)"])
        rows.append((i, "m-one" if i % 2 else " M-One", text))
    return rows, cut


def test_cut_values(frame):
    rows, cut = replies()
    rows += [(9000, "m-one", None), (9001, None, ""), (9002, "m-one", "N/A"), (9003, None, "You could write a short note before the gath�")]
    got = truncation.cut_values(frame(rows, "rid long, alias string, reply string", clash=False), "rid", "alias", "reply")
    found = {r["rid"] for r in got.collect()}
    assert 9003 in found and not found & {9000, 9001, 9002}
    found.discard(9003)
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.05 * len(cut)
    df = frame(rows, "rid long, alias string, reply string")
    share = {r["alias"]: r["share"] for r in truncation.cut_shares(df, got, "rid", "alias").collect()}
    assert 0.05 < share["m-one"] < 0.12 and set(share) == {"m-one", None}


def test_pairs_on_tables(frame):
    rows, _ = replies(300)
    table = [(i, a, t, "d1", "original_post") for i, a, t in rows] + [(5000, "m", PROMPT, " D1 ", "original_post"), (5000, "m", PROMPT, "d1", "original_post"), (5001, "m", "", None, None), (5002, None, "I must decline to answer.", "dx", "original_post")]
    df = frame(table, "response_id long, alias string, response string, prompt_id string, prompt_type string", clash=True)
    prompts = frame([("d1", "original_post", PROMPT), ("d1", "original_post", PROMPT), ("d1", "flipped_story", None), (None, "original_post", "x")], "prompt_id string, prompt_type string, text string")
    args = ("response_id", "response", "alias", "prompt_id", "prompt_type", "text")
    got = [(r[0], r[1]) for r in broken_pairs.broken_pairs(df, prompts, *args).collect()]
    assert got.count((5000, "copied")) == 2 and (5001, "empty") in got and (5002, "refusal") in got
    assert broken_pairs.broken_pairs(df.limit(0), prompts.limit(0), *args).count() == 0
